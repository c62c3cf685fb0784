"""The tool's search and the route's analysis against plain retellings; the report of an evaluation."""

import json
import math
import random

import pytest

from colloquy import __main__ as cli
from colloquy import rules, schema
from colloquy.functions.segment import icu_segmenter
from colloquy.plans import entries
from colloquy.plans.plan import terms
from colloquy.sources import sinks

AGENCIES = {"経済産業大臣": "経済産業省", "環境省局長": "環境省", "財務省局長": "財務省"}
ASKS = ("水素の税制について、政府としてはどのような見解をお持ちなのか、具体的に伺いたいと存じます。どうですか。", "短い水素税制か。", "廃棄物の回収について、今後の方針をお聞きしたいと思いますが、いかがでしょうか。お願いいたします。", "水素" + "あ" * 200 + "税制。政府の見解を伺います。どのようにお考えでしょうか。", "い" * 1001 + "水素の税制。どうですか。")
REPLIES = ("水素の税制を進めます。", "検討いたします。", "廃棄物の回収は進めます。", "", "税制は" + "続" * 300)


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows = random.Random(6), []
    for m in range(40):
        for i in range(24):
            asks = rng.random() < 0.4
            title = rng.choice([*AGENCIES, "参考人", None])
            rows.append((f"m{m:02}", rng.choice([f"s{i}", f"s{i}", None, "s0"]), i + 1, f"20{19 + m % 6}-0{1 + m % 9}-01", "委員会", "山田" if asks else rng.choice(["鈴木", None]), "会派" if asks else None, None if asks else title, None, rng.choice(ASKS if asks else REPLIES), f"u{m}-{i}", i))
    return rows, spark.createDataFrame(rows, schema.TURNS).repartition(3)


def meetings_with(rows, words, since, limit):
    hit = {}
    for r in rows:
        if r[3] >= since and all(w in r[9] for w in words):
            hit[r[0]] = max(hit.get(r[0], ""), r[3])
    ids = sorted(hit, key=lambda i: i)
    return sorted(ids, key=lambda i: hit[i], reverse=True)[:limit]


def replies(rows, meeting):
    """(asking turn, replying turn, agency) of a meeting."""
    asked = None
    for r in sorted((r for r in rows if r[0] == meeting), key=lambda r: (r[2], r[11])):
        if r[6]:
            asked = r
        elif asked and AGENCIES.get(r[7]) and r[9].strip():
            yield asked, r, AGENCIES[r[7]]


def near(text, words):
    places = [[i for i in range(len(text)) if text.startswith(w, i)] for w in words]
    if not all(places):
        return False
    return len(words) == 1 or any((b - (a + len(words[0])) if b > a else a - (b + len(words[1]))) <= 180 for a in places[0] for b in places[1])


def test_assignments(spark, corpus):
    rows, df = corpus
    words = ["水素", "税制"]
    got = entries.search_assignments(df, "水素の税制について聞きます", [" 水素 ", "税制", "水素", "他"], "2020-01-01")
    kept = meetings_with(rows, words, "2020-01-01", 10)
    want, seen = [], set()
    for m in kept:
        for ask, reply, agency in replies(rows, m):
            a, b = near(ask[9], words), near(reply[9], words)
            if len(ask[9]) < 20 or not (a or b) or len(ask[9]) > 1000 and not b or (m, reply[1] or "", agency) in seen:
                continue
            seen.add((m, reply[1] or "", agency))
            share = max(sum(w in t for w in words) / 2 for t in (ask[9], reply[9]))
            want.append((f"{m}:{ask[1] or ask[2]}", agency, reply[10], round(share, 3), "answer" if b else "question"))
    assert got.focused == "水素 税制" and got.searched == ["水素 税制"] and got.meetings == len(kept) == 10 and got.found == len(want) > 8
    own = [(r["case_id"], r["ministry"], r["url"], r["relevance"], r["context_match"]) for r in got.candidates.collect()]
    assert len(own) == min(30, len(want)) and set(own) <= set(want) and [o[3] for o in own] == sorted((w[3] for w in want), reverse=True)[:30]


def test_assignments_fall_back(spark, corpus):
    """Two terms that no meeting holds together are searched one by one."""
    rows, df = corpus
    got = entries.search_assignments(df, "廃棄物と水素について", ["検討いたします", "無い語"], "2020-01-01")
    assert got.searched == ["検討いたします 無い語", "検討いたします", "無い語"] and got.meetings == len(meetings_with(rows, ["検討いたします"], "2020-01-01", 10))
    none = entries.search_assignments(df, "何も見つからない質問です", ["無い語"])
    assert (none.meetings, none.found, none.candidates.count(), none.searched) == (0, 0, 0, ["無い語"])
    for wrong in (("短い", ["水素"], "2020-01-01"), ("あ" * 1201, ["水素"], "2020-01-01"), ("水素の税制について", ["  "], "2020-01-01"), ("水素の税制について", ["水素"], "2020/01/01")):
        with pytest.raises(ValueError):
            entries.search_assignments(df, *wrong)
        assert cli.assignments(df, *wrong)["evidence"] == []
    assert cli.assignments(df, "水素の税制について聞きます", ["水素"])["candidate_count"] > 0
    assert entries.asked_terms(["a  b", "a b", "", "c" * 99, "d"]) == ["a b", "c" * 80]


def test_analysis(spark, corpus):
    """Shares, evidence and the number of questions, from scores worked out one by one."""
    rows, df = corpus
    segment = icu_segmenter(spark)
    question = "廃棄物の回収と水素の税制について政府の見解を伺います"
    words = terms(question, segment, rules.ROUTE_STOPWORDS)
    got = entries.analyze(df, question, segment)
    searched = sorted(words, key=len, reverse=True)[:2]
    kept = next((k for k in ([*meetings_with(rows, [w], "2020-01-01", 6)] for w in searched) if k), [])
    assert got.searched == searched[: next(i for i, w in enumerate(searched) if meetings_with(rows, [w], "2020-01-01", 6)) + 1] and kept
    pairs = got.evidence.collect()
    asked = {r[9][:260]: r[9] for r in rows}
    assert 0 < len(pairs) <= 8 and all(p["score"] >= 0.055 and len(p["question"]) <= 260 and len(p["answer"]) <= 220 for p in pairs)
    assert all(len(asked[p["question"]]) >= 35 for p in pairs) and [p["score"] for p in pairs] == sorted((p["score"] for p in pairs), reverse=True)
    every = entries.route_pairs(df.where(df.issue_id.isin(kept)), words).collect()
    groups = {}
    for p in every:
        groups.setdefault((p["date"], p["meeting"], p["question"]), []).append(p)
    weight, n = {}, {}
    for own in groups.values():
        names = sorted({p["ministry"] for p in own})
        for name in names:
            weight[name] = weight.get(name, 0) + max(own[0]["score"], 0.05) / len(names)
            n[name] = n.get(name, 0) + 1
    shares = {r["ministry"]: (r["percent"], r["n"]) for r in got.shares.collect()}
    assert got.questions == len(groups) and sum(p for p, _ in shares.values()) == 100 and {k: v[1] for k, v in shares.items()} == n
    total = sum(weight.values())
    assert all(abs(shares[k][0] - math.floor(weight[k] / total * 100 + 0.5)) <= len(shares) for k in shares)
    assert cli.analysis(df, question)["pairs"] == got.questions
    for wrong in ("短い質問", "あ" * 1201, "について" * 4):
        with pytest.raises(ValueError):
            entries.analyze(df, wrong, segment)
    nothing = entries.analyze(df.limit(0), question, segment)
    assert (nothing.shares.count(), nothing.evidence.count(), nothing.questions, nothing.searched) == (0, 0, 0, searched)


def test_report(spark, tmp_path):
    """Whole after each question, also where the next one kills the run; stops at the first that fails or is partial."""
    path = tmp_path / "out" / "report.json"
    read = lambda: json.loads(path.read_text())
    seen = []

    def ask(q):
        if seen:
            assert [r["question"] for r in read()["results"]] == seen
        if q == "dies":
            raise KeyboardInterrupt
        seen.append(q)
        return {"assessment_status": "failed" if q == "fails" else "reviewed", "assessment_partial": q == "part", "n": len(seen)}

    with pytest.raises(KeyboardInterrupt):
        sinks.EvaluationReport(spark, str(path), version="1").run(["a", "b", "dies", "c"], ask)
    assert [r["result"]["n"] for r in read()["results"]] == [1, 2] and "stopped_reason" not in read() and read()["version"] == "1"
    for last in ("fails", "part"):
        seen.clear()
        state = sinks.EvaluationReport(spark, str(path)).run(["a", last, "c"], ask)
        assert read() == state and len(state["results"]) == 2 and state["stopped_reason"].endswith("remaining cases were not attempted.")
    assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["report.json"]
