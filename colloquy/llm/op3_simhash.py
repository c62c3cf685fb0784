"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint: A-Z lower-cased, words split at ASCII white space, all 3-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 with seed 42 of each; a bit is 1 if it is set in over half of them. Two texts link when
their fingerprints differ in at most two bits; a component is all that links reach.

Candidate search: the 64 bits are cut into segments of 23, 23 and 18 bits (the last padded with zeros) that lie on a ring. Two
errors leave some segment without error whose successor on the ring has at most one. So a fingerprint is stored under three
keys: a segment as it is, with the index of the codeword of the (23, 12) Golay code nearest to the next segment. It is looked up
under that segment with the codewords nearest to the next segment and to its 23 neighbours, which are one or six codewords. If
the next segments differ in at most one bit, the stored codeword is among those looked up, so no link is lost. Candidates are
verified by counting differing bits.

Equal fingerprints are grouped first, so copies of a text cost one fingerprint. A key under which more than HOT fingerprints are
stored is not joined: fingerprints stored or looked up there are grouped by each of their 65 variants with at most one bit
flipped, and linked to the smallest in a group. Fingerprints at two bits or fewer share a variant, and sharing one means two bits
or fewer, so this is exact and linear in the group's size, and no group has more than 65 fingerprints.

Nulls: a null text has fingerprint zero; a null doc_id takes its component from the other documents and is never its name
(null if there are none). A very long text is counted in runs of RUN shingles, whole. Repeated rows are returned as often as they
are given; rows of one doc_id with different texts are rows of their own. An empty table gives no rows. Extra columns are ignored,
and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import SPACE_WORDS, components, free_name, spaced, text_slices, word_spans

SHINGLE = 3
SEED = 42
MOST_BITS = 2
HOT = 64
#: Shingles that 16-bit counters can hold.
RUN = 60_000


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run hashes[first[i]:first[i+1]], the bits set in over half of it. Empty runs give zero."""
    size = np.diff(first)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    cuts = [np.arange(a, b, RUN) for a, b in zip(first[full].tolist(), first[full + 1].tolist(), strict=True)]
    begin = np.concatenate(cuts)
    owner = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
    lane = np.uint64(0x0001000100010001)
    for j in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lane, begin)
        for k in range(4):
            n = np.add.reduceat((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF), owner)
            out[full] |= (2 * n > size[full].astype(np.uint64)).astype(np.uint64) << np.uint64(16 * k + j)
    return out


def simhash(column: pa.Array) -> np.ndarray:
    """Fingerprints of a column of texts."""
    out = np.zeros(len(column), np.uint64)
    for a, b, data, offsets in text_slices(column):
        starts, ends, first = word_spans(data, offsets, SPACE_WORDS)
        if not len(starts):
            continue
        text, starts, ends = spaced(data, starts, ends, lower=True)
        size = np.diff(first)
        n = np.where(size == 0, 0, np.maximum(1, size - SHINGLE + 1))
        begin = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
        to = at + np.minimum(SHINGLE, np.repeat(size, n)) - 1
        spans = map(slice, starts[at].tolist(), ends[to].tolist())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)), np.uint64, len(at))
        out[a:b] = majority(hashes, begin)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(simhash(batch.column(2)).view(np.int64))], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): the 64 bits as a signed long, and a hash of the text by which rows of one doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


# --- the binary Golay code of length 23 ----------------------------------------------------------

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each of the 23 bits, and for each remainder the one error of at most three bits that gives it."""
    bit = []
    for i in range(23):
        v = 1 << i
        for j in range(22, 10, -1):
            if v >> j & 1:
                v ^= GENERATOR << (j - 11)
        bit.append(v)
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[bit[a]] = 1 << a
        for b in range(a):
            error[bit[a] ^ bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[bit[a] ^ bit[b] ^ bit[c]] = 1 << a | 1 << b | 1 << c
    return np.array(bit), error


def nearest_codewords(values: np.ndarray, bits: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit value."""
    left = np.zeros_like(values)
    for i in range(23):
        left ^= np.where(values >> i & 1, bits[i], 0)
    return (values ^ error[left]) >> 11


def golay_keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(keys, row) under which fingerprints are stored, and (keys, row) under which they are looked up."""
    bits, error = golay_tables()
    segment = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    row = np.arange(len(fps))
    store, probe = [], []
    for i, exact in enumerate(segment):
        then = segment[(i + 1) % 3]
        head = (np.int64(i) << 35) | (exact << 12)
        near = nearest_codewords(then, bits, error)
        store.append((head | near, row))
        each = np.sort(np.stack([near, *[nearest_codewords(then ^ (1 << k), bits, error) for k in range(23)]], 1), 1)
        new = np.ones(each.shape, bool)
        new[:, 1:] = each[:, 1:] != each[:, :-1]
        r, c = np.nonzero(new)
        probe.append((head[r] | each[r, c], r))
    return tuple(tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (store, probe))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(all_fps), 50_000):
            fps = all_fps[a : a + 50_000]
            for stored, (keys, row) in zip((True, False), golay_keys(fps.view(np.uint64)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[row]), pa.array(np.full(len(row), stored))], ["key", "fp", "stored"])


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that connect all that are at MOST_BITS bits or fewer."""
    keys = staged(fps.mapInArrow(_keys, "key long, fp long, stored boolean"))
    store, probe = keys.where("stored").select("key", F.col("fp").alias("a")), keys.where("not stored").select("key", F.col("fp").alias("b"))
    crowded = staged(store.groupBy("key").count().where(F.col("count") > hot).select("key"))
    found = store.join(crowded, "key", "left_anti").join(probe, "key").where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(64)])
    near = keys.join(crowded, "key", "left_semi").select("fp").distinct()
    near = near.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("variant"))
    group = near.groupBy("variant").agg(F.min("fp").alias("a"))
    near = near.join(group, "variant").select("a", F.col("fp").alias("b")).where("a <> b")
    return found.select("a", "b").union(near)


def _groups(given: DataFrame, hot: int) -> DataFrame:
    """(fp, component, component_id) for the distinct fingerprints of given (doc_id, fp): the smallest fingerprint and the smallest
    doc_id of all that links reach."""
    first = staged(given.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = components(links(first.select("fp"), hot))
    linked = staged(linked.join(first, linked["id"] == first["fp"]).select("fp", "component", "first_id"))
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(smallest, "component").select("fp", "component", "component_id")
    alone = F.col("component").isNull()
    name = first.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(alone, F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"))
    return staged(name)


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    given = staged(fingerprints(docs))
    return given.join(_groups(given, hot), "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Exactly one row of each component; the columns stay.

    It is the row with the smallest doc_id (null last); of several texts with that id, the one with the smallest hash; of rows that
    repeat both, the one whose other columns have the smallest hash. Rows of one doc_id that aren't near each other all stay.
    Texts are compared with the keys of rows that go, a table of two numbers a row; only rows that repeat a doc_id and a text are
    grouped.
    """
    given = staged(fingerprints(docs))
    rows = given.join(_groups(given, hot), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    per = rows.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    chosen = staged(per.groupBy("component").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.min_by("n", "text_key").alias("n")))
    of, key = free_name(docs, "of"), free_name(docs, "of_key")
    named = chosen.select(F.col("doc_id").alias(of), F.col("text_key").alias(key), "n")
    gone = given.select("doc_id", "text_key").distinct().join(named, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("text_key") == F.col(key)), "left_anti")
    twice = staged(named.where("n > 1").select(of, key))
    marked = staged(gone.toDF(of, key).union(twice))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key))
    once = docs.join(marked, same, "left_anti")
    hashable = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = docs.join(twice, same, "left_semi").groupBy(F.col("doc_id").alias(of), F.xxhash64("text").alias(key))
    first = own.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable)).alias("row"))
    return once.select(*docs.columns).union(first.select("row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
