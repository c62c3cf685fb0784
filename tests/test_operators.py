"""Operators on small fixtures of Japanese turns, and rules that the sample tables don't reach."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from colloquy import schema
from colloquy.functions import hits, segment
from colloquy.functions import text as tx
from colloquy.operators import lookups, passages, ranking, review, roles, scoring, shares, turns
from colloquy.plans import plan as pl
from colloquy.plans import retrieval
from colloquy.sources import readers, sinks
from colloquy.streaming import state


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def cut(spark):
    return segment.icu_segmenter(spark)


def turn(i, order, speaker, group, position, speech, meeting="委員会", date="2024-05-01", url=None, role=None):
    return (i, f"{i}-{order}", order, date, meeting, speaker, group, position, role, speech, url or f"u{i}-{order}", order)


@pytest.fixture(scope="module")
def debate(spark):
    rows = [
        turn("m1", 1, "山田", "党", None, "スタートアップ支援の税制について、政府はどうお考えでしょうか。"),
        turn("m1", 2, "議長", None, "委員長", "大臣。"),
        turn("m1", 3, "鈴木", None, "経済産業大臣", "スタートアップ支援の税制は拡充してまいります。"),
        turn("m1", 4, "佐藤", "別党", None, "次の農業の質問をいたします。"),
        turn("m1", 5, "高橋", None, "農林水産大臣", "農業についてお答えします。"),
        turn("m2", 1, "田中", "党", None, "ペットボトルの回収はどうなっていますか。"),
        turn("m2", 2, "伊藤", None, "環境大臣", "ペットボトルの回収を進めます。"),
    ]
    return spark.createDataFrame(rows, schema.TURNS)


def test_title_resolution(spark):
    agency = lambda title, answer="", before="": one(spark, roles.answering_agency(F.col("t"), F.col("a"), F.col("b")), t=title, a=answer, b=before)
    assert agency("経済産業大臣") == "経済産業省"
    assert agency("財務大臣・内閣府特命担当大臣(金融)") is None
    assert agency("財務大臣・内閣府特命担当大臣(金融)", "金融庁としてお答えします。") == "金融庁"
    assert agency("財務大臣・内閣府特命担当大臣(金融)", "連携する金融庁として対応します。") is None
    assert agency("財務大臣・内閣府特命担当大臣(金融)", "お答えします。", "金融庁としては進めます。") == "金融庁"
    assert agency("内閣府大臣政務官", "環境省としては進めます。") == "環境省"
    assert agency("内閣総理大臣") == "内閣府・内閣官房等"
    assert agency("参考人") is None


def test_roles(spark):
    ask = lambda g, r, p, t: one(spark, roles.is_questioner(F.col("g"), F.col("r"), F.col("p"), F.col("t")), g=g, r=r, p=p, t=t)
    assert ask("党", "", "", "伺います。") and not ask("", "", "", "伺います。")
    assert not ask("党", "", "", "○山田委員長 開会します。") and ask("党", "", "", "委員長に伺います。")
    assert not ask("党", "", "副大臣", "x")
    assert one(spark, roles.is_lawmaker(F.col("g"), F.col("r"), F.col("p")), g="党", r="", p="理事") is False


def test_plan(cut):
    own = pl.make_plan("スタートアップ支援の税制について教えてください。", cut)
    assert own.groups[0].text.startswith("スタートアップ") and "教え" not in "".join(g.text for g in own.groups)
    assert 1 <= len(own.queries) <= 5 and own.queries[0]
    change = pl.make_plan("保育士の配置基準を撤廃すべきではないか", cut)
    assert change.groups[-1] == pl.Concept("撤廃", ("撤廃",), "requested_change") and all(g.role is None for g in change.subjects)
    hinted = pl.make_plan("どう", cut, ("水素ステーション",))
    assert hinted.groups[0].text == "水素ステーション" and hinted.recall_groups
    with pytest.raises(ValueError):
        pl.validate_request("短い")
    assert pl.valid_query("水素 税制") and not pl.valid_query("a") and not pl.valid_query("a; b")
    assert pl.law_term("ペットボトル", cut) == "ペットボトル"


def test_katakana_borders(spark, cut):
    rows = spark.createDataFrame([("ペットボトルの回収",), ("ペットショップの規制",), ("ペットの健康",), ("カーペットの販売",)], "t string")
    pet = pl.Concept("ペット", ("ペット",))
    runs = segment.touching_runs(rows, "t", [pet], cut)
    found = {r["t"]: r["c"] for r in rows.select("t", hits.concept_hit(F.col("t"), pet, runs)["coverage"].alias("c")).collect()}
    assert found == {"ペットボトルの回収": 0.0, "ペットショップの規制": 1.0, "ペットの健康": 1.0, "カーペットの販売": 0.0}


def test_hits(spark):
    hit = lambda t, c: one(spark, hits.concept_hit(F.col("t"), c), t=t)
    own = pl.Concept("産業廃棄物", ("産業", "廃棄物"))
    assert hit("産業廃棄物が", own).asDict() == {"coverage": 1.0, "start": 0, "end": 5}
    assert hit("廃棄物と産業", own).asDict() == {"coverage": 1.0, "start": 0, "end": 6}
    assert hit("廃棄物のみ", own)["coverage"] == 0.5 and hit("なし", own)["coverage"] == 0.0
    assert hit("国家公務員制度の法", pl.Concept("公務員", ("公務員",)))["coverage"] == 1.0
    assert hit("独立行政医薬品機構が", pl.Concept("医薬品", ("医薬品",)))["coverage"] == 0.0
    assert hit("無償に", pl.Concept("無償化", ("無償化",)))["coverage"] == 1.0


def test_passages(spark):
    rows = spark.createDataFrame([(1, "一。二！三？次に、四。"), (2, ""), (3, "。。")], "k int, t string")
    own = passages.passage_windows(rows, ["k"], "t")
    got = [r["passage"] for r in own.where("k = 1").orderBy("window_no").collect()]
    assert got[:3] == ["一。", "一。二！", "一。二！三？"] and "次に、" in got
    assert not any("三？次に" in g and not g.startswith("次に") for g in got)
    assert own.where("k = 2").count() == 0 and [r["passage"] for r in own.where("k = 3").orderBy("window_no").collect()] == ["。", "。。", "。"]


def test_islands(spark):
    rows = spark.createDataFrame([("m", "a", 1, 0), ("m", "b", 2, 1), ("m", "d", 4, 2), ("m", "a", 1, 3), ("m", "n", None, 4)], "m string, s string, o int, ord int")
    own = turns.contiguous_runs(rows, "m", "s", "o", "ord")
    assert sorted((r["s"], r["run"]) for r in own.collect()) == [("a", 1), ("b", 1), ("d", 2)]
    ties = spark.createDataFrame([("m", "a", 1, 0), ("m", "b", 1, 1)], rows.schema)
    assert turns.contiguous_runs(ties, "m", "s", "o", "ord").agg(F.max("run")).first()[0] == 2


def test_pairs_and_retrieval(spark, cut, debate):
    own = pl.make_plan("スタートアップ支援の税制について", cut)
    strict = turns.strict_pairs(debate, own).collect()
    assert [(r["ministry"], r["case_id"]) for r in strict] == [("経済産業省", "m1:m1-1")]
    assert set(strict[0].asDict()) == {c.split()[0] for c in schema.PAIRS.split(", ")}
    recall = turns.recall_pairs(debate, own).collect()
    assert {r["ministry"] for r in recall} == {"経済産業省"} and recall[0]["retrieval_score"] > 0.5
    fast = retrieval.retrieve_fast(debate, own, 2024)
    assert 1 <= fast.scans <= 3 and [r["ministry"] for r in fast.candidates.collect()] == ["経済産業省"]
    yearly = retrieval.retrieve_yearly(debate, own, 2024)
    assert yearly.meetings == ["m1"] and [(r["ministry"], r["percent"]) for r in yearly.shares.collect()] == [("経済産業省", 100)]
    none = retrieval.retrieve_fast(debate, pl.Plan("", (pl.Concept("無", ("無",)),), ("存在しない語",)), 2024)
    assert none.candidates.count() == 0
    assert turns.labeled_pairs(debate).count() == 0  # both questions are too short to train on
    assert turns.tool_pairs(debate, ["スタートアップ", "税制"]).select("ministry").collect()[0][0] == "経済産業省"


def test_route(spark):
    long = "スタートアップ支援の税制について、政府としてはどのようにお考えなのか、具体的な見解を伺いたいと存じます。"
    rows = spark.createDataFrame([turn("m", 1, "山田", "党", None, long), turn("m", 2, "鈴木", None, "財務省局長", "税制を" + "続" * 300)], schema.TURNS)
    got = turns.route_pairs(rows, ["スタートアップ", "税制"]).collect()
    assert [(r["ministry"], len(r["answer"])) for r in got] == [("財務省", 220)]
    assert turns.route_pairs(rows, ["農業"]).count() == 0
    assert shares.weighted_shares(turns.route_pairs(rows, ["税制"]), ["date", "meeting", "question"], "ministry", "score", "ord").collect()[0]["percent"] == 100
    urls = spark.createDataFrame([("https://a.jp/x",), ("https://b.jp/a.jp",), ("http://a.jp",), (None,)], "u string")
    assert [r[0] for r in urls.select(lookups.allowed_url(F.col("u"), "a.jp")).collect()] == [True, False, False, False]


def test_shares(spark):
    rows = spark.createDataFrame([("q1", "A"), ("q1", "A"), ("q1", "B"), ("q2", "A")], "c string, m string")
    got = {r["ministry"]: (r["percent"], r["n"]) for r in shares.fractional_shares(rows, "c", "m").collect()}
    assert got == {"A": (75, 2), "B": (25, 1)}
    eight = spark.createDataFrame([(f"q{i}", f"M{i}") for i in range(8)], "c string, m string")
    assert sorted(r["percent"] for r in shares.fractional_shares(eight, "c", "m").collect()) == [9] + [13] * 7
    assert shares.fractional_shares(rows.where("c = 'x'"), "c", "m").count() == 0


def test_diversified(spark):
    dense = [(f"d:{i}", "A", f"u{i}", "d", 0.9, i) for i in range(30)]
    rows = spark.createDataFrame([*dense, ("e:1", "A", "x", "e", 0.8, 30), ("f:1", "B", "y", "f", 0.8, 31)], "case_id string, ministry string, url string, bucket string, score double, ord int")
    got = ranking.diversified(rows, 24).orderBy("selection").collect()
    assert len({r["case_id"] for r in got}) == 24 and {"e:1", "f:1"} <= {r["case_id"] for r in got}
    assert [r["selection"] for r in got] == list(range(1, 25))
    assert ranking.diversified(rows.where("score > 1"), 24).count() == 0


def plain_diversified(rows, limit):
    """The greedy choice by its definition. rows: dicts."""
    order = sorted(rows, key=lambda r: (-(r["score"] or 0), [-ord(c) for c in r["date"]], r["bucket"] or "", r["ord"]))
    first = {}
    for r in order:
        first.setdefault((r["case_id"], r["ministry"], r["url"]), r)
    buckets, selected, cases, counts = {}, [], set(), {}
    for r in first.values():
        buckets.setdefault(r["bucket"] or "", []).append(r)
    for fresh in (True, False):
        while len(selected) < limit:
            best = None
            for b, own in buckets.items():
                r = next((r for r in own if r not in selected and not (fresh and (r["case_id"], r["ministry"]) in cases)), None)
                if r and (best is None or (r["score"] or 0) + 0.15 / (1 + counts.get(b, 0)) > best[0]):
                    best = (r["score"] or 0) + 0.15 / (1 + counts.get(b, 0)), r, b
            if best is None:
                break
            selected.append(best[1])
            cases.add((best[1]["case_id"], best[1]["ministry"]))
            counts[best[2]] = counts.get(best[2], 0) + 1
    return [(r["case_id"], r["ministry"], r["url"]) for r in selected]


def test_diversified_choice(spark):
    """Meetings whose rows have the same places stay apart; ties go by date and meeting."""
    rng = random.Random(1)
    schema_ = "case_id string, ministry string, url string, bucket string, score double, ord int, date string"
    same = [("m1:1", "A", "u1", "m1", 0.9, 0, "2024-01-01"), ("m1:2", "A", "u2", "m1", 0.89, 1, "2024-01-01"), ("m2:1", "A", "u3", "m2", 0.88, 0, "2024-01-01"), ("m1:3", "A", "u4", "m1", 0.87, 2, "2024-01-01")]
    got = ranking.diversified(spark.createDataFrame(same, schema_), 4, date="date").orderBy("selection").collect()
    assert [r["bucket"] for r in got] == ["m1", "m2", "m1", "m1"]
    for limit in (3, 7):
        rows = [(f"m{m}:{rng.randrange(4)}", rng.choice("AB"), f"u{rng.randrange(6)}", f"m{m}", rng.choice([None, 0.5, 0.6, 0.65, 0.9]), i, rng.choice(["2024-01-01", "2023-05-05"])) for m in range(6) for i in range(rng.randrange(1, 12))]
        own = spark.createDataFrame(rows, schema_)
        got = ranking.diversified(own.repartition(5), limit, date="date").orderBy("selection").collect()
        names = [c.split()[0] for c in schema_.split(", ")]
        assert [(r["case_id"], r["ministry"], r["url"]) for r in got] == plain_diversified([dict(zip(names, r)) for r in rows], limit)


@pytest.mark.parametrize(("adaptive", "coalesce", "advisory"), [("true", "true", "64MB"), ("true", "true", "100KB"), ("true", "false", "64MB"), ("false", "false", "64MB")])
def test_numbered(spark, adaptive, coalesce, advisory):
    """Every row has a place of its own, whatever columns are used and however partitions are coalesced."""
    settings = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    rows = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), (F.col("id") % 3).alias("z"))
    got = ranking.numbered(rows, ["k"], "place").select("place", "k", "payload").collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert sorted(r["place"] for r in got) == list(range(20_000))
    assert [r["k"] for r in sorted(got, key=lambda r: r["place"])] == sorted(r["k"] for r in got) and len({r["payload"] for r in got}) == 20_000


def test_best_windows(spark):
    """The best window of a row is that of all windows put together, also for texts with shifts, long sentences and no hits."""
    rng = random.Random(2)
    words = ["水素", "支援", "水素支援", "税制", "次に、", "農業", "です", "伺います", "質問しません", "か？", "。", "。", "！", "x" * 300]
    rows = [(i, "".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))) for i in range(150)] + [(900, ""), (901, None), (902, "。" * 30), (903, "水素支援税制")]
    own = spark.createDataFrame(rows, "k int, t string")
    plan_ = pl.Plan("", (pl.Concept("水素支援", ("水素", "支援")), pl.Concept("税制", ("税制",))), ("水素",))
    windows = passages.passage_windows(own, ["k"], "t")
    for fast, slow, more in ((passages.best_recall, passages.recall_windows, []), (passages.best_question, passages.question_windows, ["coverage"])):
        columns = ["k", "start", "end", "passage", "score", *more]
        a, b = fast(own, ["k"], "t", plan_).select(columns).collect(), slow(windows, ["k"], plan_).select(columns).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 20
    dotted = pl.Plan("", (pl.Concept("素。税", ("素。税",)),), ("素",))
    assert passages.crosses(list(dotted.groups), "[。]") and passages.best_recall(own, ["k"], "t", dotted).count() >= 0


def test_spans(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["ab", "aba", "cd", "x" * rng.randrange(1, 90), " "]) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(999, None)]
    own = spark.createDataFrame(rows, "k int, t string")
    got = {r["k"]: (r["s"]["start"], r["s"]["end"]) for r in own.select("k", scoring.spans(F.col("t"), ["ab", "cd"]).alias("s")).collect()}
    want = {}
    for k, t in rows:
        a, b = ([i for i in range(len(t or "")) if t.startswith(x, i)][:80] for x in ("ab", "cd"))
        near = [(max(i, j) + 2 - min(i, j), min(i, j), max(i, j) + 2) for i in a for j in b if max(i, j) - min(i, j) - 2 <= 180]
        if near:
            want[k] = min(near)[1:]
    assert got == want


def test_answers_without_the_concept(spark, cut):
    """A reply linked by the question's own words, short replies that refer back, and those that must not inherit a topic."""
    ask = "水素ステーションの整備について、補助金の交付要件と審査期間をどう見直すのか伺います。"
    plan_ = pl.Plan("", (pl.Concept("水素ステーション", ("水素ステーション",)), pl.Concept("整備", ("整備",))), ("水素",))
    reply = lambda text, question=ask: spark.createDataFrame([turn("m", 1, "山", "党", None, question), turn("m", 2, "鈴", None, "経済産業大臣", text)], schema.TURNS)
    context = lambda *a: [(r["context"], r["relevance"]) for r in turns.strict_pairs(reply(*a), plan_, segment=cut).collect()]
    assert context("水素ステーションの整備を進めます。") == [("answer", 1.0)]
    assert context("水素ステーションは補助金の交付要件を改め、審査期間も短くいたします。") == [("question_vocabulary", 0.875)]
    assert context("御指摘のとおりです。") == [("turn", 0.75)]
    assert context("御指摘の防衛装備の移転と農業予算の拡大を行います。") == []  # about two other things
    assert context("御指摘のとおりです。", ask + "農業についても教示ください。次に、防衛を伺います。") == []  # asked for several things


def test_clip_of_an_unmatched_answer(spark):
    long = "前置きです。" + "あ" * 790 + "。" + "い" * 2000
    rows = spark.createDataFrame([turn("m", 1, "山", "党", None, "水素の税制を伺います。"), turn("m", 2, "鈴", None, "経済産業大臣", long)], schema.TURNS)
    got = turns.recall_pairs(rows, pl.Plan("", (pl.Concept("水素", ("水素",)),), ("水素",))).first()
    assert got["answer"] == long[: 6 + 1100] and got["answer_truncated"]


def test_latest(spark):
    a = spark.createDataFrame([turn("m", 1, "old", None, None, "x"), turn("m", 2, "b", None, None, "y")], schema.TURNS)
    b = spark.createDataFrame([turn("m", 1, "new", None, None, "x")], schema.TURNS)
    none = a.withColumn("speech_id", F.lit(None).cast("string"))
    got = retrieval.latest([a, b, none]).collect()
    assert sorted((r["speaker"], r["speech_id"]) for r in got if r["speech_id"]) == [("b", "m-2"), ("new", "m-1")] and len(got) == 4


def test_review(spark):
    good = dict(id="c1", beneficiary="who", activity="what", relation="same", comparison="why", decision="accept", q="q1", a="a1")
    rows = [good, good | {"id": "c2", "relation": "broader"}, good | {"id": "c3", "a": "zz"}, good | {"id": "c4", "decision": "reject", "relation": "different", "q": None, "a": None}, good | {"id": "c9"}, good | {"id": "c5"}, good | {"id": "c5"}, good | {"id": "c6", "decision": "yes"}]
    reviews = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(rows)], f"{schema.REVIEWS}, ord int")
    candidates = spark.createDataFrame([(f"c{i}",) for i in range(1, 8)], "id string")
    parts = spark.createDataFrame([(f"c{i}", p, f"{p} of {i}") for i in range(1, 8) for p in ("q1", "a1")], "id string, part_id string, text string")
    got = {r["id"]: (r["decision"], r["reason"]) for r in review.reconcile(candidates, reviews, parts).collect()}
    assert got == {"c1": ("accept", None), "c2": ("uncertain", None), "c3": ("uncertain", "foreign_reference"), "c4": ("reject", None), "c5": ("uncertain", "duplicate_id"), "c6": ("uncertain", "missing"), "c7": ("uncertain", "missing")}
    assert {r["decision"] for r in review.reconcile(candidates, reviews, parts, strict=True).collect()} == {"uncertain"}
    counts = {r["reason"]: r["n"] for r in review.failure_counts(review.checked(reviews, candidates)).collect()}
    assert counts == {"unknown_id": 1, "duplicate_id": 1, "invalid_decision": 1}
    batches = ranking.batches(candidates, ["id"], 3)
    ran = review.run_reviewer(batches, lambda b: b[["id"]].assign(decision="accept") if b["batch"].iloc[0] else (_ for _ in ()).throw(TimeoutError()), "id string, decision string")
    assert sorted(r["id"] for r in ran.collect()) == ["c4", "c5", "c6", "c7"]


def test_reviewer_tries_again(spark, tmp_path):
    """Once more after a failure, then in halves; a quota that is used up isn't asked twice."""
    candidates = spark.createDataFrame([(f"c{i}",) for i in range(1, 13)], "id string")
    batches = ranking.batches(candidates, ["id"], 4).select("id", "batch")

    def reviewer(own):
        calls = tmp_path / "_".join(own["id"])
        n = int(calls.read_text()) + 1 if calls.exists() else 1
        calls.write_text(str(n))
        first = sorted(own["id"])[0]
        if "c1" in set(own["id"]) and n < 2:
            raise TimeoutError
        if len(own) == 4 and "c2" in set(own["id"]) or "c3" in set(own["id"]):
            raise ValueError(first)
        if "c5" in set(own["id"]):
            raise review.NotNow
        return own[["id"]].assign(decision="accept")

    order = [sorted(r["id"] for r in batches.where(F.col("batch") == b).collect()) for b in range(3)]
    got = {r["id"] for r in review.run_reviewer(batches, reviewer, "id string, decision string", split=4).collect()}
    lost = {"c3", "c5"}
    for own in order:
        halves = [own] if not {"c2", "c3"} & set(own) else [own[:2], own[2:]]
        for h in halves:
            assert (set(h) <= got) == (not lost & set(h)) and (not lost & set(h) or not set(h) & got)
    assert any((tmp_path / "_".join(o)).read_text() == "2" for o in order if "c1" in o)


def test_quotes(spark):
    assert one(spark, tx.grounded(F.col("s"), F.col("q")), s="甲は乙である。", q="「乙である」") == "乙である"
    assert one(spark, tx.grounded(F.col("s"), F.col("q")), s="甲は乙である。", q="丙") is None
    assert one(spark, tx.quote_with_context(F.col("s"), F.col("q")), s="甲。乙。丙。丁。", q="甲。") == "甲。乙。丙。"
    parts = one(spark, tx.sentence_parts(F.col("s"), "q"), s="○山田君 お答え申し上げます。税を下げます。ありがとうございます。")
    assert parts == {"q1": "税を下げます。"}
    assert one(spark, tx.normalize(F.col("s")), s=" Ａ　Ｂ\n") == "A B"
    assert one(spark, tx.and_rewrite(F.col("s")), s="水素 AND 税制") == "水素 税制"


@pytest.mark.parametrize(
    ("code", "message", "status", "kind"),
    [(3036, "", 0, "quota_exhausted"), (None, "Error 3040: x", 0, "model_busy"), (None, "", 429, "model_busy"), (None, "context window limit", 0, "model_input_limit"), (3007, "", 0, "model_timeout"),
     (5018, "", 0, "model_access_denied"), (None, "daily neuron allocation", 429, "quota_exhausted"), (99, "odd", 500, "model_request_failed")],
)
def test_errors(spark, code, message, status, kind):
    row = spark.createDataFrame([(code, message, status)], "c int, m string, s int").select(lookups.error_kind(F.col("c"), F.col("m"), F.col("s")).alias("k")).first()
    assert row["k"] == kind


def test_laws(spark):
    item = lambda title, *s: ({"law_id": "L1"}, {"law_title": title}, [(x,) for x in s])
    laws = spark.createDataFrame([([item("環境省設置法", "<b>一</b>", "廃棄物に関すること。"), item("廃棄物法", "x")], 5)], schema.LAWS_JSON)
    got = lookups.jurisdiction(laws).collect()
    assert [(r["ministry"], r["snippet"], r["truncated"]) for r in got] == [("環境省", "廃棄物に関すること。", True)]
    assert lookups.law_titles(spark).count() == 48


def test_files(spark, debate, tmp_path):
    rows = spark.createDataFrame([("q", None, "A")], "question string, answer string, ministry string")
    assert sinks.write_jsonl(rows, f"{tmp_path}/j") == 1
    assert readers.read_labeled(spark, f"{tmp_path}/j").first()["ministry"] == "A"
    sinks.write_csv(rows, f"{tmp_path}/c", ["question", "answer"])
    parts = [p.read_text(encoding="utf-8-sig").splitlines() for p in tmp_path.glob("c/part*")]  # Spark may add one with a header alone
    assert parts and all(p[0] == "question,answer" for p in parts) and [line for p in parts for line in p[1:]] == ["q,"]
    (tmp_path / "m.json").write_text('[{"issueID":"i","date":"2024-01-01","nameOfMeeting":"会","speechRecord":[{"speechID":"s","speechOrder":"3","speech":"x"},{"speechID":"t","speechOrder":"?"}]}]')
    got = readers.read_meetings(spark, f"{tmp_path}/m.json").orderBy("ord").collect()
    assert [(r["speech_order"], r["ord"]) for r in got] == [(3, 0), (None, 1)] and set(got[0].asDict()) == set(debate.columns)
    notes = spark.createDataFrame([], "title string, content string")
    assert sinks.append_row(notes, f"{tmp_path}/n", {"title": " a ", "content": "b"})["title"] == "a"
    with pytest.raises(ValueError):
        sinks.append_row(notes, f"{tmp_path}/n", {"title": " "})
    assert not sinks.best_effort(lambda: 1 / 0)


def test_caches(spark):
    now = dt.datetime(2024, 1, 2, 12)
    marks = spark.createDataFrame([("verified_quota", dt.datetime(2024, 1, 2, 9)), ("other", dt.datetime(2025, 1, 1))], "kind string, at timestamp")
    assert state.paused_until(marks, now) == dt.datetime(2024, 1, 3) and state.paused_until(marks, dt.datetime(2024, 1, 3, 1)) is None
    entries = spark.createDataFrame([(i, 400_000 if i < 40 else 3_000_000) for i in range(41)], "at int, size int")
    assert state.evict(entries, ["at"]).count() == 32 and state.evict(entries, ["at"], size="size").count() == 30
    kept = spark.createDataFrame([("k", now + dt.timedelta(hours=1), 7)], "key string, expires_at timestamp, v int")
    fresh = lambda: spark.createDataFrame([(8,)], "v int")
    assert state.cached(kept, "k", now, fresh).first()["v"] == 7 and state.cached(kept, "k", now + dt.timedelta(hours=2), fresh).first()["v"] == 8


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    usage = run(state.stream_daily_usage(stream(), "ts", F.lit(1), 100), "usage", "complete")
    days = {r["day"]: r["n"] for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert {r["day"].date(): (r["used"], r["exhausted"]) for r in usage.collect()} == {d: (n, n >= 100) for d, n in days.items()}
    # all events are one batch, so a key is in flight from its first event on
    assert run(state.stream_in_flight(stream(), "ts", "user_id"), "flight").groupBy("user_id").count().where("count > 1").isEmpty()
    assert spark.table("flight").count() == events.select("user_id").distinct().count()
    own = sorted((r["user_id"], r["ts"]) for r in events.select("user_id", F.col("ts").cast("timestamp").alias("ts")).collect())
    want, gap = [], dt.timedelta(minutes=30)
    for user, ts in own:
        if want and want[-1][0] == user and ts < want[-1][2]:
            want[-1] = [user, want[-1][1], ts + gap, want[-1][3] + 1]
        else:
            want.append([user, ts, ts + gap, 1])
    newest = max(ts for _, ts in own) - dt.timedelta(hours=1)
    got = {tuple(r) for r in run(state.stream_sessions(stream(), "ts", "user_id"), "sessions").select("user_id", "begin", "end", "n").collect()}
    assert got == {tuple(w) for w in want if w[2] <= newest} and got
