"""The pipeline's stages by their own operators, and what has to hold between them."""

from collections import Counter

import corpus_pipeline
from fixtures import components, documents, lower, simhash, words_of
from test_text_ops import plain_targets

from colloquy.llm import op3_simhash, op7_decontamination, op8_mixing
from colloquy.llm.queries import ORACLES, QUERIES


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["toxicity"](spark, docs, sf).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    one = stage["simhash"](spark, clean, sf).cache()
    found = op3_simhash.near_duplicates(clean).collect()
    assert Counter(r["doc_id"] for r in one.collect()) == Counter({r["component_id"] for r in found})
    kept = stage["decontamination"](spark, one, sf).cache()
    bad = {r["doc_id"] for r in op7_decontamination.contamination(one, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in one.collect()} - bad
    mix = stage["mixing"](spark, kept, sf).cache()
    copies = {r["doc_id"]: r["copies"] for r in op8_mixing.mixed(kept).collect()}
    assert mix.columns == docs.columns and Counter(r["doc_id"] for r in mix.collect()) == Counter({d: n for d, n in copies.items() if n})
    shards = stage["sharding"](spark, mix, sf)
    assert Counter(r["doc_id"] for r in shards.collect()) == Counter(r["doc_id"] for r in mix.collect())
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r["doc_id"] for r in shards.collect())


def test_stages_by_brute_force(spark, sf):
    """SimHash, decontamination, mixing and sharding, each on the last one's rows, by plain Python."""
    stage, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    one = stage["simhash"](spark, docs, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [simhash(t) for _, t in rows]
    groups = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    first = {}
    for (d, _), g in zip(rows, groups):
        first[g] = min(first.get(g, d), d)
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(first.values())
    kept = stage["decontamination"](spark, one, sf).cache()

    def shingles(text):
        w = "".join(c if not c.isascii() or c.isalnum() else " " for c in lower(text)).split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))} or ({tuple(w)} if w else set())

    items = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    assert all(len(next(iter(s))) == 5 for s in items)
    clean = {r["doc_id"] for r in one.collect() if not any(len(s & shingles(r["text"])) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert {r["doc_id"] for r in kept.collect()} == clean and len(clean) < one.count()
    mix = stage["mixing"](spark, kept, sf).cache()
    size, largest, taken = Counter(), Counter(), Counter()
    for r in kept.collect():
        n = len(words_of(r["text"]))
        size[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in mix.collect():
        taken[r["source"]] += len(words_of(r["text"]))
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in size)
    shards = stage["sharding"](spark, mix, sf)
    assert Counter(r["doc_id"] for r in shards.collect()) == Counter(r["doc_id"] for r in mix.collect())


def test_stages_take_hard_cases(spark, sf):
    hard = documents(spark, extra=False)
    for own in (hard, hard.where("doc_id = -1")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, own, sf)
            n = out.count()
            assert n <= 3 * own.count() and (name == "sharding" or out.columns == own.columns)
            assert name == "sharding" or {(r["doc_id"], r["text"]) for r in out.collect()} <= {(r["doc_id"], r["text"]) for r in own.collect()}


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)
