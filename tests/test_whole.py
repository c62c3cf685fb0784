"""Jobs over all rows, where a smaller one had been registered."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions import text as tx
from colloquy.operators import classify, ranking, review, scoring
from colloquy.queries import QUERIES


def by_hand(rows, n=8):
    """Neighbours of every id divisible by 100, one pair at a time."""
    found = set()
    for q, a in rows:
        if q % 100 == 0:
            near = []
            for r, b in rows:
                if r != q and len(a) == len(b):
                    length = np.linalg.norm(a) * np.linalg.norm(b)
                    near.append((-round(float(np.dot(a, b) / length) if length else 0.0, 9), r))
            found |= {(q, r, round(-c, 6)) for c, r in sorted(near)[:n]}
    return found


def test_dense_neighbours(spark, sf, tmp_path):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["dense_cosine_neighbours"](spark, sf).select("query", "vec_id", "cosine").collect()}
    assert {q for q, _, _ in got} == {r for r, _ in rows if r % 100 == 0} and len({q for q, _, _ in got}) > 1
    assert got == by_hand(rows)


def test_dense_neighbours_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 16)
    rng = np.random.default_rng(1)
    # No id 0, vectors without length, of another width and repeated, and several blocks on both sides.
    rows = [(i, rng.integers(-2, 3, 3 if i % 7 else 2).astype(float)) for i in range(100, 4100, 10)] + [(5, np.zeros(3)), (6, np.ones(5))]
    spark.createDataFrame([(i, v.tolist()) for i, v in rows] + [(7, None), (None, [1.0, 1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {tuple(r) for r in QUERIES["dense_cosine_neighbours"](spark, str(tmp_path)).select("query", "vec_id", "cosine").collect()} == by_hand(rows)
    assert QUERIES["dense_cosine_topk"](spark, str(tmp_path)).count() == 0
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["dense_cosine_neighbours"](spark, f"{tmp_path}/none").count() == 0 == QUERIES["dense_cosine_topk"](spark, f"{tmp_path}/none").count()


def test_exports_hold_texts(spark, tmp_path):
    texts = ["a\nb", "a\r\nb\rc", 'say "so", twice ""', "  blanks \t ", "back\\slash \\\" and \\", "", "été, \u2028 日本", "\n", '"', "x" * 100_000, "\ufeffmark", "#,'"]
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {(str(i), hashlib.md5(t.encode()).hexdigest(), "en", "web") for i, t, *_ in rows}
    for name in ("csv_export_text", "jsonl_roundtrip_text"):
        assert {(str(r["doc_id"]), r["digest"], r["lang"], r["source"]) for r in QUERIES[name](spark, str(tmp_path)).collect()} == whole
    for name in ("csv_export", "jsonl_roundtrip"):
        assert sorted(str(r["doc_id"]) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(str(i) for i, *_ in rows)


def test_no_rows_are_filtered(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    runs = QUERIES["contiguous_runs_whole"](spark, sf).collect()
    assert len(runs) == read("conversations").count() and max(r["run"] for r in runs) > 1
    words = {r["doc_id"] for r in read("documents").where("text rlike '[A-Za-z][A-Za-z0-9]|[A-Za-z0-9][A-Za-z]'").select("doc_id").collect()}
    assert {r["doc_id"] for r in QUERIES["cosine_predict_whole"](spark, sf).collect()} == words
    labelled = {str(r["doc_id"]) for r in read("labels").collect()}
    whole = QUERIES["review_reconcile_whole"](spark, sf).collect()
    assert len(whole) == read("documents").count()
    bad = {i for i in labelled if int(i) % 13 == 0 or int(i) % 17 == 0}
    assert not [r for r in whole if r["id"] in labelled - bad and r["reason"] == "missing"]
    semantic = sum((int(i) % 13 == 0) * (1 + (int(i) % 11 == 0)) for i in labelled)
    assert {r["reason"]: r["n"] for r in QUERIES["validation_counters_whole"](spark, sf).collect()}["missing_semantic_field"] == semantic


def test_folds_go_by_place(spark, tmp_path):
    """Ids that all end in 0 or 9 have both sides of the split."""
    for digit in (0, 9):
        rows = [(10 * i + digit, "alpha beta" if i % 2 else "gamma delta", "en" if i % 2 else "fr") for i in range(40)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/{digit}/documents.parquet")
        got = QUERIES["evaluate_split"](spark, f"{tmp_path}/{digit}").first()
        assert (got["total"], got["covered"], got["correct"]) == (8, 8, 8)
        trained = {(r["lang"], r["token"]): r["n"] for r in QUERIES["centroid_train"](spark, f"{tmp_path}/{digit}").collect()}
        assert trained == {("en", "alpha"): 16, ("en", "beta"): 16, ("fr", "gamma"): 16, ("fr", "delta"): 16}


def test_similarities_by_hand(spark):
    """Rows that share a key are one text; rows without a key, without words or with words of their own are told apart."""
    texts = [(1, "tax tax road"), (1, "road water zebra"), (2, "water"), (3, ""), (4, None), (5, "zebra"), (None, "tax")] + [(6, "tax road " * 40)] * 3
    rows = spark.createDataFrame(texts, "k long, text string").withColumn("tokens", F.split(F.coalesce("text", F.lit("")), " ")).withColumn("tokens", F.filter("tokens", lambda t: t != ""))
    labels = {"a": {"tax": 5, "road": 1}, "b": {"water": 2, "road": 3}}
    centroids = spark.createDataFrame([(lab, t, n) for lab, own in labels.items() for t, n in own.items()], "ministry string, token string, n long")
    bags: dict[int, Counter] = {}
    for k, t in texts:
        if k is not None:
            bags.setdefault(k, Counter()).update((t or "").split())
    want = {}
    for k, own in bags.items():
        for lab, c in labels.items():
            if set(own) & set(c):
                length = math.sqrt(sum(n * n for n in own.values())) * math.sqrt(sum(n * n for n in c.values()))
                want[k, lab] = round(sum(n * c.get(t, 0) for t, n in own.items()) / length, 12)
    for limit in ("10485760", "-1"):  # centroids broadcast, and too large for it
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = {(r["k"], r["ministry"]): round(r["cosine"], 12) for r in classify.similarities(rows, "k", centroids, tokens=F.col("tokens")).collect()}
        assert got == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bags_and_runs_by_hand(spark):
    texts = ["", None, "a", "日本語 の日本", "😀a😀a", "12 ab  12", "aaaa"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    for r in rows.select("i", tx.char_ngrams(F.col("t"), stopwords=("zz",)).alias("g"), tx.bag(tx.char_ngrams(F.col("t"), stopwords=("zz",))).alias("b")).collect():
        chars = "".join((texts[r["i"]] or "").split())
        grams = [chars[k : k + n] for n in (2, 3) for k in range(len(chars) - n + 1)]
        grams = [g for g in grams if not g.isdigit()]
        assert list(r["g"]) == grams
        assert {x["token"]: x["n"] for x in r["b"]} == Counter(grams)


def test_lists_are_numbered_over_parts(spark):
    """Batches, scope checks and the question dictionary on rows in many parts, one question on a third of them."""
    rows = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), (F.col("id") % 40).cast("string"))).alias("q")).repartition(16)
    got = {r["n"]: (r["batch"], r["id"], r["batch_id"]) for r in ranking.batches(rows, ["n"]).collect()}
    assert got == {i: (i // 8, f"c{i + 1}", f"c{i % 8 + 1}") for i in range(3000)}
    scope = {r["n"]: r["scope"] for r in review.scope_budget(rows, F.when(F.col("n") != 7, F.col("n") % 5 == 2), ["n"], 4).collect()}
    unsure = [i for i in range(3000) if i % 5 == 2]
    assert scope == {i: "clear" if i not in set(unsure) else "check" if i in unsure[:4] else "overflow" for i in range(3000)}
    said = {r["n"]: r["q"] for r in review.question_dictionary(rows, "q", "n").collect()}
    first = {}
    for i in range(3000):
        first.setdefault("hot" if i % 3 == 0 else f"q{i % 40}", i)
    assert {i: q for i, q in said.items() if q is not None} == {i: q for q, i in first.items()} and len(said) == 3000
