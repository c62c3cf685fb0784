"""Exact substring dedup with a count-min prefilter.

A word goes if it lies in a window of 35 consecutive words whose word sequence starts anywhere else too, in the same document or
another. Windows are judged on the input.

1. Every window is keyed by its minimizer: of its runs of 18 words, the one with the smallest hash (the first on ties). The same
   window has the same minimizer wherever it starts, at another position each time, so the number of positions chosen with a
   minimizer's hash is never less than the number of windows that equal one of them. Each task counts the positions of its
   documents in a count-min sketch, of which it passes on the cells that it touched; blocks of cells are merged one after the
   other. The merged sketch says "once" or "more", in one bit a cell, and estimates a window by the least of its cells.
2. Windows estimated to repeat are grouped exactly, by digests of the words themselves (BLAKE2b, 128 bits, of the words joined by
   one space); the hashes of the first step choose and never decide. It is done in runs: the consecutive windows of a document
   that share a minimizer are one row with the digest of all their words and one for each window, and equal runs become one row
   with a count. A run found twice repeats as a whole. The windows of the others are looked up among all windows.
3. The marked windows go back to their documents, which drop the words these cover.

The sketch's width follows the size of the texts up to 2**MOST_BITS cells a row, so what is sent to the executors has a fixed
bound (2 rows of 2**MOST_BITS bits). Beyond that more windows are estimated to repeat; the result stays the same. Hot windows
meet as counts or in joins that Spark can split; no task gathers the documents that share one.

Nulls: a null text has no words and is kept as the empty text; a null doc_id is returned as it is. Repeated rows are copies of
each other like any two documents. A very long text is cut and hashed on its own, whole; so is a very long word. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import gram_hashes, mix, spaced, starts_inside, text_slices, word_hashes, word_spans

WINDOW = 35
#: Words of a minimizer; a window holds WINDOW - GRAM + 1 of them.
GRAM = 18
SKETCH_ROWS = 2
LEAST_BITS, MOST_BITS = 16, 28
BLOCK_BITS = 20
#: Positions that a task counts before it passes cells on.
FLUSH = 1_000_000


def first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, where its smallest one is (the first on ties)."""
    at = np.arange(len(values))
    covered = 1
    while covered < width:
        step = min(covered, width - covered)
        right = values[step:] < values[: len(values) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        values = np.where(right, values[step:], values[: len(values) - step])
        covered += step
    return at


def window_runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows of a slice of documents in runs with one minimizer.

    Gives starts and ends of all words, index of each valid window's first word, where runs begin among these, the minimizer's
    hash for each run, and for each document the index of its first word.
    """
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    valid = np.flatnonzero(starts_inside(first, window, len(words)))
    if not len(valid):
        return starts, ends, valid, valid, np.zeros(0, np.uint64), first
    grams = gram_hashes(words, gram)
    at = first_minimum(grams, window - gram + 1)[valid]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return starts, ends, valid, begin, grams[at[begin]], first


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x632BE59BD9B4E019) * np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def _touched(bits: int, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own = np.concatenate(keys)
        for row in range(SKETCH_ROWS):
            cell, n = np.unique(cells(own, row, bits), return_counts=True)
            cuts = np.flatnonzero(np.diff(cell >> BLOCK_BITS, prepend=-1))
            blocks, out = (cell[cuts] >> BLOCK_BITS).tolist(), []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True):
                c = (cell[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint32)
                out.append((c[n[a:b] == 1].tobytes(), c[n[a:b] > 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array([x for x, _ in out]), pa.array([x for _, x in out])], ["sketch_row", "block", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                keys.append(window_runs(data, offsets, window, gram)[4])
                n += len(keys[-1])
                if n >= FLUSH:
                    yield from flush(keys)
                    keys, n = [], 0
        if n:
            yield from flush(keys)

    return run


def _merged(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = 1 << min(bits, BLOCK_BITS)

    def done(at: tuple[int, int], count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(count > 1).tobytes()])], ["sketch_row", "block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count = None, np.zeros(size, np.uint8)
        for batch in batches:
            for row, block, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, block) != at:
                    if at:
                        yield done(at, count)
                    at, count = (row, block), np.zeros(size, np.uint8)
                c = np.frombuffer(once, np.uint32)
                count[c] = np.minimum(count[c] + 1, 2)
                count[np.frombuffer(more, np.uint32)] = 2
        if at:
            yield done(at, count)

    return run


def sketch(texts: DataFrame, bits: int, window: int = WINDOW, gram: int = GRAM) -> list[np.ndarray]:
    """For each row of the merged sketch, one bit a cell: was it counted more than once? texts: one column."""
    touched = texts.mapInArrow(_touched(bits, window, gram), "sketch_row int, block int, once binary, more binary")
    blocks = touched.repartition("sketch_row", "block").sortWithinPartitions("sketch_row", "block").mapInArrow(_merged(bits), "sketch_row int, block int, bits binary")
    width = (1 << bits) // 8
    out = [np.zeros(width, np.uint8) for _ in range(SKETCH_ROWS)]
    for row, block, packed in blocks.toLocalIterator():
        at = block << (BLOCK_BITS - 3)
        out[row][at : at + len(packed)] = np.frombuffer(packed, np.uint8)
    return out


def _repeated(keys: np.ndarray, rows: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for row, packed in enumerate(rows):
        cell = cells(keys, row, bits)
        out &= (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def digests(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two longs for each text[begin:end]."""
    own = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(own), np.int64).reshape(-1, 2)


def _candidates(shared, bits: int, window: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            doc, text_key = batch.column(0), batch.column(1)
            for a, _, data, offsets in text_slices(batch.column(2)):
                starts, ends, valid, begin, keys, first = window_runs(data, offsets, window, gram)
                pick = np.flatnonzero(_repeated(keys, rows, bits))
                if not len(pick):
                    continue
                size = np.diff(np.append(begin, len(valid)))[pick]
                upto = np.cumsum(size)
                at = valid[np.arange(upto[-1]) + np.repeat(begin[pick] - (upto - size), size)]
                text, starts, ends = spaced(data, starts, ends)
                each = digests(text, starts[at], ends[at + window - 1])
                start = valid[begin[pick]]
                run_digest = digests(text, starts[start], ends[start + size + window - 2])
                of = np.searchsorted(first, start, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        doc.take(pa.array(a + of)),
                        text_key.take(pa.array(a + of)),
                        pa.array((start - first[of]).astype(np.int32)),
                        pa.array(run_digest[:, 0]),
                        pa.array(run_digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.append(0, upto).astype(np.int32)), pa.StructArray.from_arrays([pa.array(each[:, 0]), pa.array(each[:, 1])], ["a", "b"])),
                    ],
                    ["doc_id", "text_key", "start", "a", "b", "windows"],
                )

    return run


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(2)
            for a, b, data, offsets in text_slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                cover = np.zeros(len(starts) + 1, np.int64)
                own = marks.slice(a, b - a)
                n_marks = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                if len(flat):
                    base = np.repeat(first[:-1], n_marks) + flat.field(0).to_numpy()
                    mask = flat.field(1).to_numpy()
                    for i in range(int(mask.max()).bit_length()):
                        at = base[(mask >> i & 1).astype(bool)] + i
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                total = np.concatenate([[0], np.cumsum(keep)])[first]
                text, begin, end = spaced(data, starts[keep], ends[keep])
                digests = [hashlib.sha256(text[begin[i] : end[j - 1]] if j > i else b"").hexdigest() for i, j in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(n - np.diff(total)), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, mask): bit i of mask marks the window at word start + i. docs: doc_id, text_key, text."""
    if bits is None:
        n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, int(n // 8).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(sketch(docs.select("text"), bits, window, gram))
    found = staged(docs.mapInArrow(_candidates(shared, bits, window, gram), "doc_id long, text_key long, start int, a long, b long, windows array<struct<a:bigint,b:bigint>>"))
    runs = staged(found.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("windows").alias("windows")))
    each = runs.select("a", "b", "n", F.posexplode("windows").alias("i", "w")).select("a", "b", "n", "i", F.col("w.a").alias("wa"), F.col("w.b").alias("wb"))
    again = staged(each.groupBy("wa", "wb").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1").select("wa", "wb"))
    single = each.where("n = 1").join(again, ["wa", "wb"]).groupBy("a", "b").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    whole = runs.where("n > 1").select("a", "b", F.expr("shiftleft(1L, size(windows)) - 1").alias("mask"))
    marks = staged(whole.union(single))
    return found.select("doc_id", "text_key", "start", "a", "b").join(marks, ["a", "b"]).select("doc_id", "text_key", "start", "mask")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs (doc_id, text)."""
    given = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    marks = repeated_windows(given, window, gram, bits)
    marks = staged(marks.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "mask")).alias("marks")))
    marks = marks.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "marks")
    both = given.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    none = F.array().cast("array<struct<start:int,mask:bigint>>")
    return both.select("doc_id", "text", F.coalesce("marks", none).alias("marks")).mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(s)) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM rep, (SELECT unnest(range(0, 35)) AS k)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
  SELECT a.doc_id, count(*) FILTER (g.i IS NULL) AS n, string_agg(a.word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS t
  FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
