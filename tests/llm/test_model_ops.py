"""Embeddings, classifiers, chats and shards: brute force, held-out accuracy, exact round trips and hard cases."""

import itertools
import math
import random
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from fixtures import components, documents, prose, rows_of
from pyspark.sql import functions as F

from colloquy.llm import common, op2_embeddings, op4_quality, op5_chat, op6_toxicity, op10_sharding, subword


# --- embeddings


def plain_links(rows, cosine):
    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = []
    for i, j in itertools.combinations(range(n), 2):
        a, b = rows[i][1], rows[j][1]
        if usable(a) and usable(b) and len(a) == len(b):
            a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
            dot = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
            if dot >= cosine:
                links.append((i, j))
    own = components(n, links)
    degree = Counter(itertools.chain.from_iterable(links))
    names = {}
    for i in range(n):
        if rows[i][0] is not None:
            names[own[i]] = min(names.get(own[i], rows[i][0]), rows[i][0])
    out = Counter()
    for i in range(n):
        c = names.get(own[i]) if usable(rows[i][1]) else rows[i][0]
        out[rows[i][0], degree[i], c, rows[i][0] is not None and rows[i][0] == c] += 1
    return out


@pytest.mark.parametrize(("piece", "block"), [(4096, 16384), (20, 12), (40, 300)])
def test_embeddings(spark, piece, block):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8) for _ in range(120)]
    for spread in (0.02, 0.12, 0.25, 0.4):
        centre = rng.normal(size=8)
        centre /= np.linalg.norm(centre)
        vectors += [centre + spread * rng.normal(size=8) / math.sqrt(8) for _ in range(40)]
    vectors += [vectors[0] * 5] * 3 + [-vectors[1], rng.normal(size=3), rng.normal(size=3), np.ones(3) * 1e-200, np.ones(3) * 1e200]
    rows = [(i, [float(x) for x in v], "l", 1) for i, v in enumerate(vectors)]
    rows += [(900, None, "l", 1), (901, [], "l", 1), (902, [0.0] * 8, "l", 1), (903, [float("nan")] + [1.0] * 7, "l", 1), (904, [None] + [1.0] * 7, "l", 1), (905, [float("inf")] + [1.0] * 7, "l", 1), (None, rows[0][1], "l", 1), rows[5], (None, None, None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string, unit int")
    got = Counter(tuple(r) for r in op2_embeddings.near_vectors(table, piece=piece, block=block, sample=50).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == plain_links([(r[0], r[1]) for r in rows], 0.9)


def test_leaves():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(300, 4))
    points /= np.linalg.norm(points, axis=1)[:, None]
    above, owner = op2_embeddings.nets(points, 0.4)
    assert (owner[owner] == owner).all() and np.linalg.norm(points - points[owner], axis=1).max() <= 0.2 + 1e-9
    assert (above[above] == above).all() and (above[owner] == above).all() and np.linalg.norm(points[owner] - points[above], axis=1).max() <= 0.4 + 1e-9
    assert set(above) <= set(owner)


def test_embeddings_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op2_embeddings.near_vectors(table).count() == 0


# --- classifiers


def labelled(spark, n=500):
    """Toxic documents hold a few words of one stem with endings that differ between documents; poor ones are full of signs."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        w = prose(rng, rng.randrange(30, 200)).split()
        if poor:
            w = [x + rng.choice(["$$$", "%%%"]) for x in w]
        if toxic:
            for _ in range(max(1, len(w) // 30)):
                w[rng.randrange(len(w))] = "grobl" + "".join(rng.choice("abcdefg") for _ in range(3))
        docs.append((i, " ".join(w), "en", "s", 0, "clash"))
        labels.append((i, int(not poor), int(toxic)))
    labels += [(0, None, None), (None, 1, 1), (n + 5, 1, 0), labels[3]]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers(spark, kind):
    import zlib

    docs, labels = labelled(spark)
    if kind == "quality":
        model = op4_quality.quality_model(docs, labels)
        got, parts, part = op4_quality.quality_scores(docs, model), 5, 0
    else:
        model = op6_toxicity.toxicity_model(docs, labels)
        got, parts, part = op6_toxicity.toxicity_scores(docs, model), 4, 2
    rows = got.join(labels.where("doc_id < 500 and quality is not null").distinct(), "doc_id").collect()
    assert got.count() == 500 and all((zlib.crc32(str(r["doc_id"]).encode()) % parts == part) == r["held_out"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r[kind] for r in held]) >= 0.85
    if kind == "toxic":
        kept = op6_toxicity.without_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == got.where("score < 0.3").count()


def test_classifier_hard_cases(spark):
    docs, labels = labelled(spark, 60)
    model = op6_toxicity.toxicity_model(docs, labels)
    hard = documents(spark)
    got = op6_toxicity.toxicity_scores(hard, model)
    assert got.count() == hard.count() and got.where("score is null or predicted is null or held_out is null").count() == 0
    blank = {r["score"] for r in got.where("doc_id in (4, 5, 6)").collect()}
    assert len(blank) == 1
    assert op6_toxicity.toxicity_scores(hard.where("doc_id = -1"), model).count() == 0
    untrained = op4_quality.quality_model(hard, labels.where("doc_id = -1"))
    assert {r["score"] for r in op4_quality.quality_scores(hard, untrained).collect()} == {0.5}
    assert op6_toxicity.without_toxic(hard, untrained, op4_quality.SHAPE).count() == hard.count()


def test_label_is_no_input(spark):
    """Scores depend on the text alone."""
    docs, labels = labelled(spark, 80)
    model = op4_quality.quality_model(docs, labels)
    same = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("de").alias("lang"), F.lit("z").alias("source"))
    a = {r["doc_id"]: r["score"] for r in op4_quality.quality_scores(docs, model).collect()}
    assert all(a[r["doc_id"] - 1000] == r["score"] for r in op4_quality.quality_scores(same, model).collect())


def test_long_texts_are_learnt(spark, monkeypatch):
    """A text is learnt from whole, however long: slices of any size give the passages and counts of the whole text."""
    rng = random.Random(13)
    texts = [prose(rng, 4000, 3000), " ".join(rng.choice(["so", "so", "Very", "well-known", "x", "...", "é"]) for _ in range(1500)), "one", " \n ", "x" * 5000 + " y", None]
    for shape in (op4_quality.SHAPE, op6_toxicity.SHAPE):
        for text in texts:
            whole = subword.text_bags(text, shape)
            for size in (1, 7, 100, 2500):
                monkeypatch.setattr(subword, "LEARN_BYTES", size)
                cut = subword.text_bags(text, shape)
                monkeypatch.undo()
                assert [(i.tolist(), n.tolist()) for i, n in cut] == [(i.tolist(), n.tolist()) for i, n in whole]
    docs, labels = labelled(spark, 40)
    long = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.repeat(F.concat("text", F.lit(" ")), F.lit(2000))).otherwise(F.col("text")))
    assert long.where("octet_length(text) > 200000").count() == 1
    got = subword.sample(long, labels, "toxic", F.lit(True), {0: 100, 1: 100}).collect()
    assert max(len(r["text"]) for r in got) > 200_000 and len(got) == 40
    bounded = subword.sample(docs, labels, "toxic", F.lit(True), {0: 100, 1: 100}, 4000).collect()
    for y in (0, 1):
        assert 0 < sum(len(r["text"].encode()) for r in bounded if r["label"] == y) <= 4000
    assert len(bounded) < 40 and set(bounded) <= set(subword.sample(docs, labels, "toxic", F.lit(True), {0: 100, 1: 100}).collect())
    few = subword.sample(long, labels, "toxic", F.lit(True), {0: 100, 1: 100}, 1_000_000).collect()
    assert len(few) == 39 and max(len(r["text"]) for r in few) < 125_000


def test_memory_does_not_follow_long_texts(monkeypatch):
    """Learning from long texts and scoring them takes arrays of a piece's size, and the scores are those of the whole text."""
    rng = random.Random(14)
    some = prose(rng, 3000, 3000).split()

    def long_text(blank):
        return blank.join(rng.choice(some) for _ in range(450_000))

    def peak(of):
        tracemalloc.start()
        got = of()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    for shape in (op4_quality.SHAPE, op6_toxicity.SHAPE):
        weight = np.random.default_rng(3).normal(size=1 << shape.buckets).astype(np.float32)
        model = subword.Model(weight, 0.1)
        for blank in (" ", "\n"):
            text = long_text(blank)
            column = pa.array([None, text, "a few words"], pa.string())
            assert 2_500_000 < len(text)
            got, most = peak(lambda column=column, model=model, shape=shape: subword.scores(column, model, shape))
            assert most < 110_000_000
        with monkeypatch.context() as m:
            m.setattr(subword, "LEARN_BYTES", 10_000_000)
            assert subword.scores(column, model, shape).tolist() == got.tolist()
        for text in ["so so so Very well-known x x ... é\té " * 30, "y" * 5000 + "\ny " + "z" * 300, "...,", " \n"]:
            whole = subword.scores(pa.array([text, "x"]), model, shape)
            for size in (1, 7, 100):
                with monkeypatch.context() as m:
                    m.setattr(subword, "LEARN_BYTES", size)
                    assert subword.scores(pa.array([text, "x"]), model, shape).tolist() == whole.tolist()
        texts, untaught = [long_text(" ")] * 6, replace(shape, rounds=0, steps=0)
        _, most = peak(lambda texts=texts, shape=untaught: subword.train(texts, np.array([0, 1] * 3), shape))
        assert most < 130_000_000


def test_scores_by_hand(spark):
    """Scores of the folded model, feature by feature in plain Python."""
    docs, labels = labelled(spark, 60)
    for op, shape in ((op4_quality, op4_quality.SHAPE), (op6_toxicity, op6_toxicity.SHAPE)):
        model = op4_quality.quality_model(docs, labels) if op is op4_quality else op6_toxicity.toxicity_model(docs, labels)
        got = {r["doc_id"]: r["score"] for r in subword.scored(docs, model, shape).collect()}
        for r in docs.collect():
            best = -math.inf
            w = (r["text"].lower() if shape.lower else r["text"]).split()
            if shape.words == common.ALNUM_WORDS:
                w = "".join(c if c.isalnum() else " " for c in " ".join(w)).split()
            if shape.once:
                w = [x for i, x in enumerate(w) if not i or x != w[i - 1]]
            for a in range(0, len(w), shape.passage or len(w)):
                own = w[a : a + (shape.passage or len(w))]
                before = w[a - 1] if a else None
                bag = []
                for i, x in enumerate(own):
                    data = np.frombuffer(x.encode(), np.uint8)
                    h = common.word_hashes(data, np.array([0]), np.array([len(data)]))
                    bag.append(subword._bucket(h, shape.buckets)[0])
                    if shape.pairs and (i or before is not None):
                        y = np.frombuffer((own[i - 1] if i else before).encode(), np.uint8)
                        p = h + np.uint64(3) * common.word_hashes(y, np.array([0]), np.array([len(y)]))
                        bag.append(subword._bucket(np.array([1], np.uint64) if (own[i - 1] if i else before) == x else p, shape.buckets)[0])
                    edged = f" {x} ".encode()
                    for n in subword.GRAMS:
                        for k in range(len(edged) - n + 1):
                            bag.append(subword._bucket(np.array([int.from_bytes(edged[k : k + n], "little") + n], np.uint64), shape.buckets)[0])
                best = max(best, sum(float(model.weight[f]) for f in bag) / max(len(bag), shape.least) + model.bias)
            assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-best)), abs=1e-6)


def test_held_out_rows_are_not_learnt(spark):
    docs, labels = labelled(spark, 120)
    flipped = labels.withColumn("toxic", F.when(subword.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = op6_toxicity.toxicity_model(docs, labels), op6_toxicity.toxicity_model(docs, flipped)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


# --- chats


def legal(roles):
    own = roles[1:] if roles[:1] == ["system"] else roles
    return not own or (len(own) % 2 == 0 and own == ["user", "assistant"] * (len(own) // 2))


def plain_cost(numbers):
    """Cheapest repair by trying every choice for each turn."""
    follows = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
    best = {0: 0}
    for n in numbers:
        nxt = {}
        for old, c in best.items():
            for new in (1, 2, 3):
                change = 0 if new == n else op5_chat.MEND if n == 0 else op5_chat.RELABEL
                ways = [change] * ((old, new) in follows) + [change + op5_chat.MERGE] * (old == new) + [change + op5_chat.INSERT for p in (2, 3) if (old, p) in follows and (p, new) in follows]
                for w in ways:
                    nxt[new] = min(nxt.get(new, 1 << 30), c + w)
        best = nxt
    return min(c + op5_chat.end_costs()[s] for s, c in best.items())


def plain_repair(numbers):
    """Every sequence of moves is tried: the cheapest, then the one that prefers earlier moves turn by turn."""
    follows = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
    ways = [(0, (), 0, ())]  # cost, preferences, state, turns as (role, merged, put in before)
    for n in numbers:
        nxt = []
        for cost, rank, old, said in ways:
            for new in (1, 2, 3):
                change = 0 if new == n else op5_chat.MEND if n == 0 else op5_chat.RELABEL
                if (old, new) in follows:
                    nxt.append((cost + change, (*rank, (change, 0, old, new)), new, (*said, (new, False, 0))))
                if old == new:
                    nxt.append((cost + change + op5_chat.MERGE, (*rank, (change + op5_chat.MERGE, 1, old, new)), new, (*said, (new, True, 0))))
                for p in (2, 3):
                    if (old, p) in follows and (p, new) in follows:
                        nxt.append((cost + change + op5_chat.INSERT, (*rank, (change + op5_chat.INSERT, 2, old, new)), new, (*said, (new, False, p))))
        ways = nxt
    ends = {1: (2 * op5_chat.INSERT, (2, 3)), 2: (op5_chat.INSERT, (3,)), 3: (0, ())}
    least = min(c + ends[s][0] for c, _, s, _ in ways)
    state = min(s for c, _, s, _ in ways if c + ends[s][0] == least)
    _, said = min((r, t) for c, r, s, t in ways if s == state and c + ends[s][0] == least)
    return least, said, ends[state][1]


def plain_rendered(turns):
    """turns: (number of the role, text)."""
    names = {1: "system", 2: "user", 3: "assistant"}
    least, said, put = plain_repair([n for n, _ in turns])
    out = []
    for (new, merged, before), (_, text) in zip(said, turns):
        if before:
            out.append([before, []])
        if merged:
            out[-1][1].append(text)
        else:
            out.append([new, [text]])
    out += [[p, []] for p in put]
    return least, "".join(f"<|{names[r]}|>\n" + "\n".join(t) + "<|end|>\n" for r, t in out)


NUMBER = {"system": 1, "user": 2, "assistant": 3}


def plain_order(rows):
    return sorted((r[1] is not None, r[1] or 0, NUMBER.get((r[2] or "").strip().lower(), 0), r[3] or "") for r in rows)


def chat_rows(rng):
    rows = []
    for conv in range(60):
        for t in range(rng.randrange(1, 7)):
            rows.append((conv, t, rng.choice(["user", "assistant", "system", " User ", "bot", None]), rng.choice([f"t{t}", None, "", "two\nlines", "<|end|>"]), "x", 1))
    rows += [(70, None, "user", "a", "x", 1), (70, None, "user", "a", "x", 1), (None, 1, "user", "q", "x", 1), (None, 2, "assistant", "r", "x", 1), (71, 1, None, None, None, None)]
    return rows


CHAT = "conv_id long, turn long, role string, text string, rendered string, cost int"


def test_chats(spark):
    rows = chat_rows(random.Random(9))
    rows += [(80, t, "user" if t % 3 else "assistant", "long " * 50, "x", 1) for t in range(400)]
    table = spark.createDataFrame(rows, CHAT)
    got = {r["conv_id"]: r for r in op5_chat.repaired_parts(table)[0].collect()}
    assert len(got) == len({r[0] for r in rows}) == op5_chat.format_chats(table).count()
    for conv, found in got.items():
        own = plain_order([r for r in rows if r[0] == conv])
        assert found["opens"] and found["closes"] and found["part"] == 0 and not any(t["joins"] for t in found["turns"])
        assert legal([t["role"] for t in found["turns"]])
        assert found["cost"] == plain_cost([r[2] for r in own])
        assert sum(t["n_source"] for t in found["turns"]) == len(own)
        assert "\n".join(t["text"] for t in found["turns"]).split() == " ".join(r[3] for r in own).split()
    assert op5_chat.format_chats(table.where("conv_id = -1")).count() == 0


def test_chat_rendering(spark):
    """The rendered conversation by trying every repair."""
    rows = chat_rows(random.Random(10))
    got = {r["conv_id"]: (r["cost"], r["rendered"]) for r in op5_chat.format_chats(spark.createDataFrame(rows, CHAT)).collect()}
    assert got == {c: plain_rendered([(r[2], r[3]) for r in plain_order([r for r in rows if r[0] == c])]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize(("turns", "chars"), [(50_000, 16_000_000), (7, 16_000_000), (50_000, 300)])
def test_chat_partitions(spark, monkeypatch, turns, chars):
    """The same rows however the input is dealt; a long conversation is cut by its own turns, and the parts join."""
    monkeypatch.setattr(op5_chat, "STRETCH", turns)
    monkeypatch.setattr(op5_chat, "STRETCH_CHARS", chars)
    rng = random.Random(11)
    rows = chat_rows(rng) + [(90, t % 37, rng.choice(["user", "assistant", "bot"]), f"turn {t} " + "x" * rng.randrange(60), "x", 1) for t in range(90)]
    table = spark.createDataFrame(rows, CHAT)
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows_of(op5_chat.format_chats(table.repartition(n))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    whole = {r["conv_id"]: r for r in op5_chat.format_chats(table).collect()}
    assert len(whole) == len(found[0]) == len({r[0] for r in rows})
    order = plain_order([r for r in rows if r[0] == 90])
    starts, begun, upto = [], None, 0
    for i, r in enumerate(order):
        if (at := (i // turns, upto // chars)) != begun:
            starts.append(i)
            begun = at
        upto += len(r[3])
    parts = op5_chat.repaired_parts(table)[1]
    cut = sorted(r["part"] for r in parts.collect() if r["conv_id"] == 90) if parts else [0]
    assert cut == starts and (len(starts) > 1) == (turns < 90 or chars < 1000)
    own = whole[90]
    blocks = own["rendered"].split("<|end|>\n")
    assert legal([b[2 : b.index("|>")] for b in blocks[:-1]]) and blocks[-1] == "" and own["n_turns"] == len(blocks) - 1
    assert own["cost"] == plain_cost([r[2] for r in order]) and own["n_source"] == 90
    assert [w for w in own["rendered"].replace("<|end|>\n", " ").split() if not w.startswith("<|")] == " ".join(r[3] for r in order).split()
    monkeypatch.undo()
    plain = {r["conv_id"]: r for r in op5_chat.format_chats(table).collect()}
    assert whole == plain


def test_chat_legal_stays(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = op5_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["cost"], r["rendered"]) for r in got] == [(0, "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n")]


def test_chat_stretches():
    """A conversation in any pieces is repaired at the same cost, and the pieces join to a legal whole."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        roles = rng.integers(0, 4, rng.integers(1, 12))
        cuts = sorted({0, len(roles), *rng.integers(0, len(roles) + 1, 2).tolist()})
        pieces = [roles[a:b] for a, b in itertools.pairwise(cuts)]
        states, cost = op5_chat.border_states([op5_chat.least_matrix(p) for p in pieces])
        assert cost == plain_cost(roles.tolist())
        turns = []
        for i, p in enumerate(pieces):
            turns += op5_chat.repaired_stretch(p.tolist(), ["x"] * len(p), states[i], op5_chat.only(states[i + 1]), i == len(pieces) - 1)
        assert legal([role for role, _, _, joins in turns if not joins])


# --- shards


def test_sharding(spark, tmp_path):
    docs = documents(spark)
    store = op10_sharding.sharded(docs, str(tmp_path / "s"), arrivals=3, target=20_000, base=1000, fan_in=2)
    assert rows_of(store.read()) == rows_of(docs)
    now = store.manifest()
    assert sum(s["rows"] for s in now["shards"]) == docs.count() and not store._runs(now["shards"])
    small = Counter(s["tier"] for s in now["shards"] if 2 * s["bytes"] < 20_000)
    assert all(n < 2 for n in small.values())
    placed = store.placed()
    assert Counter(r["doc_id"] for r in placed.collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {s["shard"]: s["rows"] for s in now["shards"]}


def plain_compaction(sizes, target, base, fan_in):
    """Sizes after merging tier by tier, where a merge has the size of its parts together, from the newest rule to the last."""
    tier = lambda n: max([0] + [k for k in range(1, 60) if base * fan_in**k <= n])
    shards, at = [(i, n) for i, n in enumerate(sizes)], len(sizes)
    while True:
        made, gone = [], set()
        for t in sorted({tier(n) for _, n in shards}):
            own = [s for s in shards if 2 * s[1] < target and tier(s[1]) == t]
            if len(own) < fan_in:
                continue
            run = []
            for s in [*own, None]:
                if s is None or (run and sum(n for _, n in run) + s[1] > target):
                    if len(run) > 1:
                        made.append(sum(n for _, n in run))
                        gone |= {i for i, _ in run}
                    run = []
                if s:
                    run.append(s)
        if not made:
            return sorted(n for _, n in shards)
        shards = [s for s in shards if s[0] not in gone] + [(at + i, n) for i, n in enumerate(made)]
        at += len(made)


def test_tiers(spark, tmp_path):
    """Which shards are merged, against a plain version, with ties in size and one that is most of everything."""
    rng = random.Random(12)
    for case in range(60):
        target, base, fan_in = rng.choice([50, 200, 1000]), rng.choice([1, 5]), rng.choice([2, 3, 4])
        sizes = [rng.choice([rng.randrange(1, 30), 7, 7, rng.randrange(1, 2 * target)]) for _ in range(rng.randrange(1, 40))] + [5000] * (case % 2)
        store = op10_sharding.ShardStore(spark, str(tmp_path / f"t{case}"), target, base, fan_in)
        shards = [{"shard": f"{0:08d}-{i:05d}", "bytes": n, "tier": store._tier(n)} for i, n in enumerate(sizes)]
        version = 0
        while runs := store._runs(shards):
            version += 1
            gone = {s["shard"] for run in runs for s in run}
            merged = [sum(s["bytes"] for s in run) for run in runs]
            assert all(n <= target for n in merged)
            shards = [s for s in shards if s["shard"] not in gone] + [{"shard": f"{version:08d}-{i:05d}", "bytes": n, "tier": store._tier(n)} for i, n in enumerate(merged)]
        assert sorted(s["bytes"] for s in shards) == plain_compaction(sizes, target, base, fan_in)


def test_sharding_hot_rows(spark, tmp_path):
    """Rows of one doc_id (or none) that are most of the table, and an empty table."""
    rows = [(7, "same text " * 20)] * 300 + [(None, "t")] * 100 + [(i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    store = op10_sharding.sharded(docs, str(tmp_path / "h"), arrivals=3, target=4000, base=500, fan_in=2)
    assert rows_of(store.read()) == rows_of(docs) and store.placed().count() == len(rows)
    assert not store._runs(store.manifest()["shards"])
    none = op10_sharding.sharded(docs.limit(0), str(tmp_path / "n"))
    assert none.read().count() == 0 and none.placed().count() == 0 and none.read().columns == docs.columns


def test_sharding_versions(spark, tmp_path):
    docs = documents(spark, extra=False)
    store = op10_sharding.ShardStore(spark, str(tmp_path / "v"), 1 << 20, 1000, 2)
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    store.append(docs.where("doc_id = -1"))
    assert store.read().count() == 0 and store.read().columns == docs.columns
    store.append(docs)
    store.append(docs)
    before = store.version()
    assert store.compact() > before and store.read(before).count() == 2 * docs.count() == store.read().count()
    with pytest.raises(op10_sharding.CommitConflict):
        store._commit(before, None, [])
    assert store.read().count() == 2 * docs.count()
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))
    docs.write.parquet(f"{store.root}/data/lost")  # a writer that never committed
    assert store.read().count() == 2 * docs.count()
    assert store.vacuum() > 0 and store.read().count() == 2 * docs.count()
    with pytest.raises(ValueError):
        op10_sharding.ShardStore(spark, str(tmp_path / "w"), fan_in=1)
