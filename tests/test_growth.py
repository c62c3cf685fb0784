"""What must not grow faster than the input: rows shuffled, and work repeated for each use of a result."""

import json
import random
import re
import unicodedata
from collections import Counter
from math import sqrt

import pytest
from pyspark.sql import functions as F

from colloquy import rules
from colloquy.functions import text as tx
from colloquy.functions.segment import IcuSegmenter
from colloquy.operators import bridge, classify, ranking, roles, verdicts
from colloquy.plans.plan import concepts


def shuffled(spark, action) -> int:
    """Rows that an action's stages write to shuffles."""
    status, hub = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def written() -> dict:
        hub.waitUntilEmpty(30_000)
        stages = status.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    action()
    return sum(n for stage, n in written().items() if stage not in before)


@pytest.fixture
def words(spark):
    """400 texts of 200 words each, of which ten are common; two rows share an id."""
    draw = random.Random(1)
    rows = [(i % 399, f"l{i % 3}", " ".join([*draw.choices([f"common{j}x" for j in range(10)] + [f"mid{j}x" for j in range(60)], k=195), *(f"rare{draw.randrange(300)}y" for _ in range(5))])) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id int, label string, t string").repartition(4)


@pytest.mark.parametrize("most", [0, 40, 200, 10**6])
def test_cosines_whatever_is_common(spark, words, most):
    rows, df = words
    tokens = tx.word_tokens(F.col("t"))
    got = classify.similarities(df, "id", classify.train_centroids(df, "label", tokens=tokens), "label", tokens=tokens, most=most).collect()
    bags, centroids = {}, {}
    for i, label, text in rows:
        bags.setdefault(i, Counter()).update(text.split())
        centroids.setdefault(label, Counter()).update(text.split())
    norm = lambda c: sqrt(sum(n * n for n in c.values()))
    want = {(i, label): sum(n * c[t] for t, n in b.items()) / norm(b) / norm(c) for i, b in bags.items() for label, c in centroids.items()}
    assert {(r["id"], r["label"]): pytest.approx(r["cosine"], abs=1e-12) for r in got} == want


def test_bags_are_not_shuffled_to_a_large_vocabulary(spark, words):
    """Even where no table is small enough for Spark to broadcast, common tokens meet the centroids in their rows."""
    _, df = words
    tokens = tx.word_tokens(F.col("t"))
    centroids = classify.train_centroids(df, "label", tokens=tokens)
    bags = df.select("id", F.explode(F.array_distinct(tokens))).count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = shuffled(spark, lambda: classify.similarities(df, "id", centroids, "label", tokens=tokens).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert n < bags / 2


def test_agencies_are_looked_for_once(spark):
    """Each name's pattern stands in the plan once for the answer and twice for the answer before, not once for each use."""
    own = spark.createDataFrame([("経済産業大臣", "a", "b")], "t string, a string, b string").select(roles.answering_agency(F.col("t"), F.col("a"), F.col("b")).alias("x"))
    plan = own._jdf.queryExecution().analyzed().toString()
    name = rules.TITLE_RULES[0][1]
    assert plan.count(f"{name}{rules.CAPACITY}") <= 3


def test_words_are_cut_in_tasks(spark):
    """The same words as on the driver, where no text is cut any more; a segmenter without a column function travels to the tasks."""

    class Tasks(IcuSegmenter):
        def __call__(self, text):
            raise AssertionError("cut on the driver")

    texts = ["水素ステーションの整備について、補助金の交付要件を伺います。", "", "𠮷野家のAI化 😀 ペット", "スタートアップ支援の税制", "a\u3000b  ｱｲｳ"]
    df = spark.createDataFrame([(t,) for t in [*texts, texts[0]]], "t string")
    driver = IcuSegmenter(spark)
    want = {t: [c.text for c in concepts(t, driver)] for t in texts}
    got = bridge.spoken(df, Tasks(spark)).collect()
    assert len(got) == len(texts) and {r["said"]: r["topics"] for r in got} == want
    cut = df.select("t", driver.segments(F.col("t")).alias("s")).collect()
    assert all([(s[1:], s[0] == "+") for s in r["s"]] == driver(r["t"]) for r in cut)
    own = bridge.spoken(df, lambda t: [(w, True) for w in t.split()]).where("said = ''").collect()
    assert [r["topics"] for r in own] == [[]]


def test_only_cited_parts_are_looked_up(spark):
    """Sentences that nobody cites are not shuffled, once dealt by candidate; a part that is cited twice, or not there, is as before."""
    docs = spark.createDataFrame([(i // 8, str(i), i, ". ".join(f"sentence {i} {j}" for j in range(60))) for i in range(48)], "batch long, id string, doc_id long, text string")
    parts = verdicts.answer_parts(docs, ["batch", "id"], "doc_id", "doc_id", question="text", answer="text", sentence="[^.]+", skip=(), header="^$")
    review = lambda i: {"id": str(i), "beneficiary": "b", "activity": "a", "relation": "same", "comparison": "c", "decision": "accept", "q": "q1", "a": "v1a99" if i == 5 else "v1a2"}
    texts = spark.createDataFrame([(b, json.dumps({"reviews": [review(b * 8 + i) for i in range(8)]})) for b in range(6)], "batch long, response string")
    checked = []
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = shuffled(spark, lambda: checked.extend(verdicts.checked_rows(verdicts.review_rows(verdicts.read_reviews(texts)), docs.select("batch", "id"), parts).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert n < 48 * 60
    assert {(r["id"], r["reason"], r["question_evidence"], r["answer_evidence"], r["owner"]) for r in checked} == {
        (str(i), "unknown_accepted_refs", None, None, None) if i == 5 else (str(i), None, f"sentence {i} 0", f"sentence {i} 1", i) for i in range(48)}


def test_only_texts_that_may_change_go_to_python(spark, monkeypatch):
    """Letters taken for plain are left alone by NFKC, alone and beside each other; of a text of such letters Python gets a null."""
    plain = [c for c in map(chr, range(0x110000)) if re.match(f"[{tx.PLAIN}]", c)]
    seconds = {chr(int(d[1], 16)) for d in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000)) if len(d) == 2 and not d[0].startswith("<")}
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in plain) and not seconds & set(plain)
    texts = ["ＡＢＣ　ｱ", "が", "plain text", "水素、ステーション。", "é", "", None, "①", "\U0001d400"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["n"] for r in df.select("k", tx.normal_form(F.col("t")).alias("n")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    monkeypatch.setattr(tx, "_nfkc", F.pandas_udf(lambda t: t.map(lambda x: f"sent {x}", na_action="ignore"), "string"))
    got = {r["k"]: r["n"] for r in df.select("k", tx.normal_form(F.col("t")).alias("n")).collect()}
    assert [i for i, n in got.items() if (n or "").startswith("sent")] == [0, 1, 4, 7, 8]


def test_texts_of_candidates_stay_out_of_python(spark):
    """The greedy choice is given what decides, not the rows' texts."""
    df = spark.range(50).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("case_id"), F.lit("m").alias("ministry"), F.lit("u").alias("url"), (F.col("id") % 3).cast("string").alias("bucket"), (F.col("id") / 50).alias("score"), F.repeat(F.lit("long"), 9).alias("body"))
    out = ranking.diversified(df, 4)
    sent = re.search(r"\(\d+\) MapInPandas\nInput \[\d+\]: \[(.*?)\]", out._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert "body" not in sent[1] and "_score" in sent[1]
    assert sorted(r["selection"] for r in out.collect()) == [1, 2, 3, 4] and {r["body"] for r in out.collect()} == {"long" * 9}
