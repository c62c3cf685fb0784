"""Licenses, SimHash, decontamination, mixing and substring dedup against plain versions, on every hard case."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import components, documents, lower, prose, rows_of, simhash, words_of
from pyspark.sql import functions as F

from colloquy.llm import common, op1_licenses, op3_simhash, op7_decontamination, op8_mixing, op9_substring


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def alnum(text):
    out, word = [], ""
    for c in lower(text):
        if c.isascii() and not c.isalnum():
            out.append(word)
            word = ""
        else:
            word += c
    return [w for w in [*out, word] if w]


def test_words_and_hashes():
    texts = ["a  bb\nc", "", "dd", "é x", "bb c"]
    import pyarrow as pa

    (_, _, data, offsets), *rest = list(common.text_slices(pa.array([*texts, None])))
    assert not rest
    starts, ends, first = common.word_spans(data, offsets)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["a", "bb", "c", "dd", "é", "x", "bb", "c"]
    assert first.tolist() == [0, 3, 3, 4, 6, 8, 8]
    hashes = common.word_hashes(data, starts, ends)
    assert hashes[1] == hashes[6] and len(set(hashes.tolist())) == 6
    pairs = common.gram_hashes(hashes, 2)
    assert pairs[1] == pairs[6] and len(set(pairs.tolist())) == 6
    assert common.starts_inside(first, 2, 8).tolist() == [True, True, False, False, True, False, True]


# --- licenses


def license_rows(text):
    w = alnum(text)
    at = [(i, label) for label, p in op1_licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({n for _, n in at}))


def test_licenses(spark, docs):
    more = ["Released under the MIT License. MIT-LICENSE", "gnu General\nPublic license; apache license", "Licensed under the dear Apache License, Version 2.0", "mit", "MİT License", "K mit license", "x" * 50_000 + " mit license"]
    own = docs.select("doc_id", "text", "size").union(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(more)], "doc_id long, text string, size int"))
    got = op1_licenses.scan_licenses(own).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r["doc_id"], *license_rows(r["text"])) for r in own.collect())
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[102]["labels"] == "apache" and by_id[102]["score"] == 1.0 and by_id[103]["labels"] == ""
    assert by_id[104]["n_base"] == 0 and by_id[105]["first_word"] == 1


def test_license_spans(spark):
    """Words put into or left out of a template don't hide it; half of it isn't enough."""
    full = op1_licenses.TEMPLATES[1][1].split()
    texts = [" ".join(full[:9] + ["surely"] + full[9:]), " ".join(full[:7] + full[8:]), " ".join(full[:9]), "all rights reserved", "all rights not reserved"]
    got = {r["doc_id"]: r for r in op1_licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(5)] == ["mit", "mit", "", "proprietary", ""]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_licenses_native(spark, docs):
    plan = op1_licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- SimHash


def plain_components(rows):
    fps = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    own, names = components(len(fps), links), defaultdict(list)
    for i, c in enumerate(own):
        if rows[i][0] is not None:
            names[c].append(rows[i][0])
    return Counter((rows[i][0], f"{fps[i]:016x}", min(names[own[i]], default=None)) for i in range(len(fps)))


@pytest.mark.parametrize("hot", [64, 0])
def test_simhash(spark, docs, hot):
    rng = random.Random(1)
    base = [f"v{i}" for i in range(300)]
    near = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = f"n{i}"
        near.append((200 + i, " ".join(w)))
    own = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    got = op3_simhash.near_duplicates(own, hot)
    got = Counter((r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in got.collect())
    assert got == plain_components([(r["doc_id"], r["text"]) for r in own.collect()])


def test_simhash_links_all(spark):
    """Every pair at two bits or fewer is connected, wherever the bits are, by either way."""
    rng = random.Random(2)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        fps |= {f, *(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(6)), f ^ 0b111}
    fps = sorted(fps)
    table = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    for hot in (64, 1):
        links = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in op3_simhash.links(table, hot).collect()}
        assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
        place = {f: i for i, f in enumerate(fps)}
        got = components(len(fps), [(place[a], place[b]) for a, b in links])
        assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))


def test_golay():
    bits, error = op3_simhash.golay_tables()
    assert (error[1:] > 0).all()
    v = np.random.default_rng(0).integers(0, 1 << 23, 500)
    near = op3_simhash.nearest_codewords(v, bits, error)
    code = {}
    for w in range(4096):
        c = w << 11
        left = 0
        for i in range(23):
            left ^= int(bits[i]) if c >> i & 1 else 0
        code[w] = c ^ left
    assert all(bin(int(x) ^ code[int(n)]).count("1") <= 3 for x, n in zip(v, near))


def plain_deduplicated(rows):
    """rows (doc_id, text) that stay: of each component one with the smallest id, and which ids and texts it may be."""
    fps = [simhash(t) for _, t in rows]
    own = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    groups = defaultdict(list)
    for i, c in enumerate(own):
        groups[c].append(rows[i])
    out = []
    for g in groups.values():
        first = min((d for d, _ in g if d is not None), default=None)
        out.append((first, {t for d, t in g if d == first}))
    return out


def test_deduplicated(spark, docs):
    """One row of each component, also where one id is on unlike texts, copies have no id, and rows repeat."""
    rng = random.Random(21)
    unlike = [prose(rng, 200) for _ in range(4)]
    more = [(300, unlike[0]), (300, unlike[1]), (300, unlike[1]), (301, unlike[2]), (None, unlike[3]), (None, unlike[3]), (None, unlike[3]), (302, None), (5, unlike[0] + " x"), (303, unlike[2])]
    own = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    kept = op3_simhash.deduplicated(own)
    assert kept.columns == own.columns and kept.schema == own.schema
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = plain_deduplicated([(r["doc_id"], r["text"]) for r in own.collect()])
    assert Counter(d for d, _ in got) == Counter(d for d, _ in want)
    for d, texts in want:
        assert any(g[0] == d and g[1] in texts for g in got)
    assert sorted(map(str, got)) == sorted(map(str, ((r["doc_id"], r["text"]) for r in op3_simhash.deduplicated(own.repartition(7)).collect())))
    assert rows_of(kept) == rows_of(op3_simhash.deduplicated(own.repartition(3), hot=0))


def test_deduplicated_keeps_unlike_texts(spark):
    texts = ["alpha beta gamma delta epsilon", "one two three four five six", "red green blue yellow black"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    assert Counter(r["text"] for r in op3_simhash.deduplicated(docs).collect()) == Counter(texts)


# --- decontamination


def test_contamination(spark, docs):
    rng = random.Random(3)
    items = [prose(rng, n, 10_000) for n in (5, 6, 9, 20, 60, 120)] + ["only three words", None, "", "!!!"]
    texts = []
    for item in items[:6]:
        w = item.split()
        for k in range(0, max(2, len(w) // 4), 2):
            for i in range(0, k):
                w[i] = "other"
            texts.append(prose(rng, 3000, 5000) + " " + " ".join(w).upper().replace(" ", ", ") + " " + prose(rng, 10))
    texts.append("x only Three words y")
    own = docs.select("doc_id", "text").union(spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(0, items[0], 2), (None, items[1], 3)], "item_id long, text string, doc_id int")
    want = Counter()
    for r in own.collect():
        w = alnum(r["text"])
        for b in bench.collect():
            v = alnum(b["text"])
            n = min(5, len(v))
            if n:
                a, c = ({tuple(x[i : i + n]) for i in range(len(x) - n + 1)} for x in (v, w))
                if len(a & c) >= 0.8 * len(a) - 1e-9:
                    want[r["doc_id"], b["item_id"], len(a), len(a & c)] += 1
    for block in (op7_decontamination.BLOCK, 60):
        got = op7_decontamination.contamination(own, bench, block=block)
        assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got.collect()) == want
    assert len(want) > 10
    clean = op7_decontamination.decontaminated(own, bench)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in own.collect() if r["doc_id"] not in {k[0] for k in want})
    assert op7_decontamination.decontaminated(docs, bench.where("item_id = 99")).count() == docs.count()


# --- mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level >= 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full


def test_mixing(spark, docs):
    rng = random.Random(5)
    more = [(1000 + i, prose(rng, rng.randrange(1, 60)), rng.choice(["s1", "s1", "s1", "s4", "s5", "empty"]), 1) for i in range(600)]
    more = [(i, None if s == "empty" else t, s, n) for i, t, s, n in more]
    own = docs.select("doc_id", "text", "source", "size").union(spark.createDataFrame(more, "doc_id long, text string, source string, size int"))
    got = op8_mixing.mixed(own).collect()
    assert len(got) == own.count()
    sizes, taken, largest, target = Counter(), Counter(), Counter(), {}
    source_of = {(r["doc_id"]): r["source"] for r in own.collect()}
    for r in own.collect():
        n = len(words_of(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        s = source_of[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert rows_of(op8_mixing.mixed(own.repartition(5))) == rows_of(op8_mixing.mixed(own))
    mixed = op8_mixing.mix_documents(own)
    assert mixed.columns == own.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == sum((Counter({r["doc_id"]: r["copies"]}) for r in got if r["copies"]), Counter())


def duck_rows(docs, sql, tmp_path):
    """Rows of a query's SQL over these documents, as (columns in order of their names)."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(v for _, v in sorted(zip(names, r))) for r in found.fetchall()), key=str)


def test_mixing_ties(spark, tmp_path):
    """Null ids, one id on all rows and repeated rows: sources still come within half a document of their targets."""
    rng = random.Random(6)
    rows = [(None, prose(rng, 10), "a") for _ in range(600)] + [(1, prose(rng, 10), "b") for _ in range(400)] + [(2, "x y z " * 5, "c")] * 300 + [(None, None, "c")] * 5
    rows += [(1000 + i, prose(rng, rng.randrange(1, 40)), "d") for i in range(200)] + [(None, "t " * 7, "e")] * 40 + [(7, "u " * 3, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = op8_mixing.mixed(docs).collect()
    sizes, largest = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
        largest[s] = max(largest[s], len(words_of(t)))
    want = plain_targets(sizes)
    taken, of = Counter(), {(d, len(words_of(t)), sizes[s]): s for d, t, s in rows}
    for r in got:
        s = of[r["doc_id"], r["size"], r["source_size"]]
        taken[s] += r["taken"]
        assert 0 <= r["copies"] <= 3 and r["target"] == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    mixed = op8_mixing.mix_documents(docs)
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(words_of(r["text"]))
    assert words == +taken and mixed.columns == docs.columns
    out = op8_mixing.mixed(docs)
    assert rows_of(out) == rows_of(op8_mixing.mixed(docs.repartition(3)))
    assert sorted((tuple(r[c] for c in sorted(out.columns)) for r in got), key=str) == duck_rows(docs, op8_mixing.OP8_SQL, tmp_path)


def test_mixing_probabilities(spark):
    """Who is drawn depends on a document's own probability and not on its random number alone."""
    docs = spark.createDataFrame([(i, "w " * (2 if i % 2 else 50), "a" if i < 2000 else "b") for i in range(4000)], "doc_id long, text string, source string")
    for at in (0, 2000):
        got = [r for r in op8_mixing.mixed(docs).collect() if at <= r["doc_id"] < at + 2000]
        whole = min(r["copies"] for r in got)
        share = {n: sum(r["copies"] > whole for r in got if r["size"] == n) / 1000 for n in (2, 50)}
        assert 0.1 < share[50] < share[2] - 0.1 < 0.9


# --- substrings


def plain_substring(rows, window):
    split = [(d, words_of(t)) for d, t in rows]
    n = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "gram", "bits"), [(35, 18, None), (35, 18, 4), (5, 3, 16), (4, 4, 10)])
def test_substring(spark, docs, window, gram, bits):
    got = Counter(tuple(r) for r in op9_substring.without_repeats(docs, window, gram, bits).collect())
    assert got == plain_substring([(r["doc_id"], r["text"]) for r in docs.collect()], window)


def test_substring_very_long(spark):
    """Texts of 60,000 words that share passages with themselves, each other and short ones."""
    rng = random.Random(12)
    passage, once = prose(rng, 50, 9999), prose(rng, 34, 9999)
    long = [" ".join([prose(rng, 30_000, 9999), passage, prose(rng, 29_900, 9999), passage if i else once, once]) for i in range(2)]
    rows = [(1, long[0]), (2, long[1]), (3, passage), (4, once), (None, "x " + passage + " y"), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n_words int, kept string")
    got = Counter(tuple(r) for r in op9_substring.without_repeats(docs).collect())
    assert got == plain_substring(rows, 35)
    assert {r[0]: r[2] for r in got} == {1: 50, 2: 100, 3: 50, 4: 0, None: 50, 5: 0, 6: 0}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_substring_tells_words_apart(spark):
    """Two long words that a polynomial hash modulo a power of two can't tell apart, in windows that differ in that word alone."""
    a, b = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    head = " ".join(f"h{i}" for i in range(34))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"x {head} {a} y"), (4, f"{b} {head}"), (5, f"{a} {head}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in op9_substring.without_repeats(docs).collect())
    assert got == plain_substring(rows, 35)
    assert {r[0]: r[2] for r in got} == {1: 35, 2: 0, 3: 35, 4: 0, 5: 0}
    one = op9_substring.without_repeats(docs.where("doc_id < 3")).collect()
    assert [r["n_removed"] for r in one] == [0, 0] and len(data) == 2049


def test_substring_forged_hashes(spark, docs, monkeypatch):
    """Hashes that are all alike choose all windows and decide nothing."""
    monkeypatch.setattr(op9_substring, "gram_hashes", lambda words, n: np.zeros(max(0, len(words) - n + 1), np.uint64))
    own = docs.limit(20)
    rows = [(r["doc_id"], r["text"]) for r in own.collect()]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    run = op9_substring._candidates(type("Shared", (), {"value": [np.full(2, 255, np.uint8)] * 2})(), 4, 35, 18)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([t or "" for _, t in rows])], ["doc_id", "text_key", "text"])
    seen = defaultdict(set)
    for out in run(iter([batch])):
        for r in out.to_pylist():
            w = words_of(rows[r["text_key"]][1])
            for i, d in enumerate(r["windows"]):
                seen[d["a"], d["b"]].add(tuple(w[r["start"] + i : r["start"] + i + 35]))
    assert table.count() == len(rows) and seen and all(len(v) == 1 for v in seen.values())


def test_first_minimum():
    v = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 18):
        assert op9_substring.first_minimum(v, k).tolist() == [i + int(v[i : i + k].argmin()) for i in range(200 - k + 1)]


# --- empty tables


def test_empty(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op1_licenses.scan_licenses(empty).count() == 0
    assert op3_simhash.near_duplicates(empty).count() == 0 and op3_simhash.deduplicated(empty).count() == 0
    assert op7_decontamination.contamination(empty, bench).count() == 0
    assert op8_mixing.mixed(empty).count() == 0 and op8_mixing.mix_documents(empty).count() == 0
    assert op9_substring.without_repeats(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 480)] + [(900, i) for i in range(600, 700)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    own = components(1000, pairs)
    first = {}
    for i in range(1000):
        first.setdefault(own[i], i)
    assert got == {i: first[own[i]] for i in {x for p in pairs if p[0] != p[1] for x in p}}
    assert common.components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
