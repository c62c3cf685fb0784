"""What reviewers answer, compared with a plain reading of the same JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import verdicts

FIELDS = ("id", "beneficiary", "activity", "relation", "comparison", "decision", "q", "a")


def plain(data, ids, parts):
    """(reasons by place, kinds, settled) of a response that could be read."""
    reasons, kinds, good, late = [], [], {}, set()
    for row in data:
        reason = kind = None
        if not isinstance(row, dict):
            reason = "invalid_row"
        else:
            sem = FIELDS[:6]
            if not all(k in row for k in sem):
                reason = "missing_semantic_fields"
            elif any(k not in FIELDS for k in row):
                reason = "unknown_fields"
            elif any(not isinstance(v, str) for v in row.values()):
                reason = "non_string_fields"
            elif "q" not in row or "a" not in row:
                if row["decision"] == "accept":
                    reason = "missing_accepted_refs"
                elif row["decision"] not in ("reject", "uncertain"):
                    reason = "invalid_row"
        if reason is None:
            r = {"q": "", "a": ""} | row
            said = "uncertain" if r["relation"] == "unclear" or (r["decision"] == "accept" and r["relation"] != "same") else "reject" if r["relation"] != "same" else r["decision"]
            if r["id"] not in ids:
                reason = "unknown_id"
            elif r["id"] in good:
                reason = "duplicate_id"
                late.add(r["id"])
            elif r["decision"] not in ("accept", "reject", "uncertain"):
                reason = "invalid_decision"
            elif not r["comparison"].strip():
                reason = "blank_comparison"
            elif len(r["comparison"]) > 300:
                reason = "long_comparison"
            elif r["relation"] not in ("same", "broader", "provider_only", "different", "unclear"):
                reason, own = "invalid_relation", r["relation"].strip()
                kind = "blank" if not own else "surrounding_whitespace" if own in ("same", "unclear") else "letter_case" if own.lower() == "same" else "decision_code" if own == "accept" else "other"
            elif said == "accept" and not (r["beneficiary"].strip() and r["activity"].strip() and r["q"] and r["a"]):
                reason = "blank_accepted_roles_or_refs"
            else:
                foreign = said == "accept" and not ((r["id"], "q", r["q"]) in parts and (r["id"], "a", r["a"]) in parts)
                good[r["id"]] = None if foreign else (said, parts.get((r["id"], "a", r["a"])) if said == "accept" else None)
                reason = "unknown_accepted_refs" if foreign else None
        reasons.append(reason)
        kinds.append(kind)
    done = {i: good[i] if good.get(i) and i not in late else ("uncertain", None) for i in ids}
    return reasons, kinds, done


def some_row(rng, ids):
    row = dict(
        id=rng.choice([*ids, *ids, "c9"]), beneficiary=rng.choice(["who", "who", " "]), activity="what", relation=rng.choice(["same"] * 6 + ["broader", "unclear", " same", "Same", "accept", "", "　", "x"]),
        comparison=rng.choice(["why"] * 8 + [" ", "\n", "y" * 301]), decision=rng.choice(["accept"] * 4 + ["reject", "uncertain", "yes"]), q=rng.choice(["q1", "q1", "q1", "", "z"]), a=rng.choice(["v1a1", "v2a1", "v1a1", "", "v9a1"]),
    )
    for _ in range(rng.choice([0, 0, 0, 1])):
        k = rng.choice(FIELDS + ("q", "a", "q", "a"))
        rng.choice([lambda: row.pop(k), lambda: row.update({k: rng.choice([1, None, True, {"x": "y"}, ["s"], 1.5])}), lambda: row.update(note="n")])()
    return rng.choice([row] * 20 + ["text", 3, None, [row], {}])


def test_reviews_like_a_plain_reading(spark):
    rng = random.Random(4)
    ids = ["c1", "c2", "c3", "c4"]
    data = {b: [some_row(rng, ids) for _ in range(rng.randint(0, 9))] for b in range(60)}
    text = lambda b: json.dumps({"reviews": data[b]}, ensure_ascii=False)
    rows = [(b, json.dumps(text(b)) if b % 3 else text(b)) for b in data]
    broken = ["", None, "no", "[1]", "{}", '{"reviews":1}', '{"reviews":[],"more":1}', '"x"', "7", "null"]
    rows += [(100 + i, x) for i, x in enumerate(broken)]
    parts = {(i, "q", "q1"): None for i in ids} | {(i, "a", f"v{v}a1"): f"{i}-{v}" for i in ids for v in (1, 2)}
    responses = spark.createDataFrame(rows, "batch int, response string")
    cited = spark.createDataFrame([(b, *k, " ".join(k), o) for b in data for k, o in parts.items()], "batch int, id string, side string, part_id string, text string, owner string")
    candidates = spark.createDataFrame([(b, i) for b, _ in rows for i in ids], "batch int, id string")
    read = verdicts.read_reviews(responses)
    assert {r["batch"]: r["readable"] for r in read.collect()} == {b: b < 100 for b, _ in rows}
    checked = verdicts.checked_rows(verdicts.review_rows(read), candidates, cited).cache()
    got = {(r["batch"], r["place"]): (r["reason"], r["kind"]) for r in checked.collect()}
    settled = {(r["batch"], r["id"]): (r["decision"], r["owner"]) for r in verdicts.settled(candidates, checked).collect()}
    seen = set()
    for b in data:
        reasons, kinds, done = plain(data[b], ids, parts)
        assert [got[b, i] for i in range(len(reasons))] == list(zip(reasons, kinds)), data[b]
        assert {i: settled[b, i] for i in ids} == done
        seen |= {*reasons, *kinds}
    assert all(settled[100 + i, "c1"] == ("uncertain", None) for i in range(len(broken)))
    assert len(got) == sum(map(len, data.values())) and len(seen) == 1 + 12 + 5 + 1
    counted = {(r["batch"], r["counter"]): r["n"] for r in verdicts.batch_counters(read, checked).collect()}
    assert counted[100, "invalid_review"] == 1 and all(counted.get((b, "returned"), 0) == len(data[b]) for b in data)


def test_answer_of_a_variant(spark):
    """The variant whose answer is cited owns the case; a fifth variant isn't offered."""
    rows = spark.createDataFrame([(0, "c1", i, f"u{i}", "問い。", f"答え{i}。") for i in range(6)], "batch int, id string, ord int, url string, question string, answer string")
    parts = verdicts.answer_parts(rows, ["batch", "id"], "ord", "url")
    assert {(r["side"], r["part_id"], r["text"], r["owner"]) for r in parts.collect()} == {("q", "q1", "問い。", "u0")} | {("a", f"v{i + 1}a1", f"答え{i}。", f"u{i}") for i in range(4)}
    review = dict(id="c1", beneficiary="who", activity="what", relation="same", comparison="why", decision="accept", q="q1", a="v3a1")
    read = verdicts.read_reviews(spark.createDataFrame([(0, json.dumps({"reviews": [review]}))], "batch int, response string"))
    ids = rows.select("batch", "id").distinct()
    got = verdicts.settled(ids, verdicts.checked_rows(verdicts.review_rows(read), ids, parts)).first()
    assert (got["decision"], got["completed"], got["answer_evidence"], got["owner"]) == ("accept", True, "答え2。", "u2")


@pytest.mark.parametrize(("n", "sizes"), [(0, []), (6, [6]), (7, [4, 3]), (8, [4, 4]), (11, [4, 4])])
def test_early_batches(spark, n, sizes):
    rows = [(f"k{i}", "省", "問い", "答え", f"https://a.jp/{i}", i) for i in range(n)]
    rows += [(f"k{i}", "省", "another", "x", f"https://a.jp/{i}", 50 + i) for i in range(n)] + [("k", "", "q", "a", "https://a.jp/z", -1), ("k", "省", None, "a", "https://a.jp/z", -2), ("k", "省", "q", "a", "http://a.jp/z", -3)]
    got = verdicts.early_candidates(spark.createDataFrame(rows, "case_id string, ministry string, question string, answer string, url string, ord int"), "a.jp").orderBy("ord").collect()
    assert [r["id"] for r in got] == [f"c{i + 1}" for i in range(min(n, 8))] and all(r["question"] == "問い" for r in got)
    assert [sum(r["batch"] == b for r in got) for b in range(len(sizes))] == sizes


def test_early_reviews(spark):
    candidates = spark.createDataFrame([(f"c{i}", "問いの全文です。次。さらに。終わり。", "答えの全文です。", i) for i in range(1, 4)], "id string, question string, answer string, ord int")
    good = [("c1", "accept", "why", "問いの全文です。", "「答えの全文です。」"), ("c2", "accept", "why", "問い", "no quote"), ("c3", "reject", " no ", "", "")]
    run = lambda rows: verdicts.early_reviewed(candidates, spark.createDataFrame(rows, "id string, decision string, reason string, question_evidence string, answer_evidence string"))
    got = {r["id"]: (r["screening"], r["question_evidence"], r["answer_evidence"]) for r in run(good).collect()}
    assert got == {"c1": ("accept", "問いの全文です。次。さらに。", "答えの全文です。"), "c2": ("uncertain", "", ""), "c3": ("reject", "", "")}
    assert [r[0] for r in verdicts.early_feedback(run(good)).collect()] == ["no"]
    assert verdicts.early_evidence(run(good).where(F.col("screening") == "accept")).count() == 1
    for bad in ([*good[:2]], [*good, good[0]], [*good, ("c9", *good[0][1:])], [("c1", "yes", *good[0][2:]), *good[1:]], [("c1", "accept", " ", "", ""), *good[1:]], [("c1", "accept", "y" * 301, "", ""), *good[1:]], [("c1", "accept", "why", None, ""), *good[1:]]):
        assert run(bad).count() == 0
