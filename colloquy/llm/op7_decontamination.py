"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is found in a document that holds at least `threshold` of the item's distinct shingles of five words. Words are runs
of letters and digits with A-Z lower-cased, so punctuation and case don't hide a passage.

Items are partitioned by size (the power of two of their shingle count). An item with n shingles is searched by its bottom-k
MinHash sketch with k = n - ceil(threshold * n) + 1 shingles: a document that holds threshold * n of them misses at most
n - ceil(threshold * n), so at least one of the k is there and no item is lost, however long the document. The largest hash in a
partition's sketches bounds which hashes of a document need to be looked up at all. Candidates are counted over all shingles of
the item and then verified on the words themselves.

Documents are never shuffled: each task gets the sketches of a block of items and reads its own documents. Items come in blocks
of at most BLOCK shingles, so what is sent to the executors has a fixed bound; a larger benchmark takes more passes, one after the
other: what a block but the last gives is written to the shared folder, and its sketches go before those of the next are made.

Nulls: a null text or item has no words and matches nothing; null ids are returned as they are. An item of fewer than five words
is one shingle of all its words. Repeated items and documents are matched row by row. Empty tables give no rows. Extra columns
are kept by `decontaminated` and ignored by `contamination`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

from .common import ALNUM_WORDS, LOWER, gram_hashes, starts_inside, text_slices, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
#: Shingles of test items that one pass over the documents looks for.
BLOCK = 1_000_000


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    text = LOWER[data].tobytes()
    return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class Items:
    """A block of test items with their sketches, as sent to the executors."""

    def __init__(self, rows: list[tuple[int | None, str]], shingle: int, threshold: float) -> None:
        self.threshold = threshold
        self.ids: list[int | None] = []
        self.texts: list[set[bytes]] = []
        self.need: list[int] = []
        by_part: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM_WORDS)
            if not len(starts):
                continue
            n = min(shingle, len(starts))
            distinct = np.unique(gram_hashes(word_hashes(data, starts, ends, lower=True), n))
            need = int(np.ceil(round(threshold * len(distinct), 9)))
            sketch = distinct[: len(distinct) - need + 1]
            by_part.setdefault((n, len(distinct).bit_length()), []).append((sketch, distinct, len(self.ids)))
            self.ids.append(item_id)
            self.texts.append(_shingles(_words(data, starts, ends), n))
            self.need.append(need)
        self.parts = [self._part(n, own) for (n, _), own in sorted(by_part.items())]

    @staticmethod
    def _part(n: int, own: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[int, int, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        hashes = np.concatenate([s for s, _, _ in own])
        items = np.concatenate([np.full(len(s), i) for s, _, i in own])
        order = np.argsort(hashes, kind="stable")
        return n, int(hashes.max()), hashes[order], items[order], {i: d for _, d, i in own}

    def found(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, shingles of the item, shingles found) over a slice of documents."""
        starts, ends, first = word_spans(data, offsets, ALNUM_WORDS)
        if not len(starts):
            return
        words = word_hashes(data, starts, ends, lower=True)
        doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        grams: dict[int, np.ndarray] = {}
        for n, bound, sketch, items, full in self.parts:
            if n not in grams:
                h = gram_hashes(words, n)
                grams[n] = np.where(starts_inside(first, n, len(words)), h, np.uint64(2**64 - 1))
            h = grams[n]
            at = np.flatnonzero(h <= np.uint64(bound))
            lo = np.searchsorted(sketch, h[at])
            hit = sketch[np.minimum(lo, len(sketch) - 1)] == h[at]
            at = at[hit]
            lo, hi = np.searchsorted(sketch, h[at]), np.searchsorted(sketch, h[at], "right")
            pairs = {(d, int(i)) for d, a, b in zip(doc_of[at].tolist(), lo.tolist(), hi.tolist(), strict=True) for i in items[a:b]}
            spans: dict[int, tuple[np.ndarray, set[bytes]]] = {}
            for d, i in sorted(pairs):
                if d not in spans:
                    a, b = first[d], first[d + 1]
                    spans[d] = np.unique(gram_hashes(words[a:b], n)), set()
                own, said = spans[d]
                if np.isin(full[i], own, assume_unique=True).sum() < self.need[i]:
                    continue
                if not said:
                    said |= _shingles(_words(data, starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]), n)
                both = len(self.texts[i] & said)
                if both >= self.need[i]:
                    yield d, i, len(self.texts[i]), both


def item_blocks(items: DataFrame, shingle: int, threshold: float, block: int) -> Iterator[Items]:
    """Blocks of items with at most `block` words together (or one longer item), read one after the other."""
    rows: list[tuple[int | None, str]] = []
    size = 0
    for item_id, text in items.where("text is not null").select("item_id", "text").toLocalIterator():
        n = len(text) // 2 + 1
        if rows and size + n > block:
            yield Items(rows, shingle, threshold)
            rows, size = [], 0
        rows.append((item_id, text))
        size += n
    if rows:
        yield Items(rows, shingle, threshold)


def _sent(spark: SparkSession, items: Items):
    """A block's arrays and sets for the tasks: plain values, as workers needn't have this package."""
    return spark.sparkContext.broadcast(dict(vars(items)))


def _received(block) -> Items:
    items = Items.__new__(Items)
    vars(items).update(block.value)
    return items


def _matches(block) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _received(block)
        for batch in batches:
            ids, rows = batch.column(0), []
            for a, _, data, offsets in text_slices(batch.column(1)):
                rows += [(a + d, items.ids[i], n, both, both / n) for d, i, n, both in items.found(data, offsets)]
            if rows:
                at, item, n, both, share = (list(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(both, pa.int64()), pa.array(share, pa.float64())],
                    ["doc_id", "item_id", "n_shingles", "n_found", "containment"],
                )

    return run


def _block_after_block(spark: SparkSession, items: DataFrame, shingle: int, threshold: float, block: int) -> Iterator[tuple[object, bool]]:
    """(broadcast block, is it the last one); a block that isn't goes when the next is asked for."""
    blocks = item_blocks(items.select(F.col("item_id").cast("long"), "text"), shingle, threshold, block)
    own = next(blocks, None)
    while own is not None:
        sent = _sent(spark, own)
        own = next(blocks, None)
        yield sent, own is None
        if own is not None:
            sent.destroy()


def contamination(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) for each document and item whose shingles it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
    out = spark.createDataFrame([], schema)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    for sent, last in _block_after_block(spark, items, shingle, threshold, block):
        found = given.mapInArrow(_matches(sent), schema)
        out = out.union(found if last else staged(found))
    return out


def _clean(block, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _received(block)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, _, data, offsets in text_slices(batch.column(at)):
                for d, *_ in items.found(data, offsets):
                    keep[a + d] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows of docs that hold no item; the columns stay."""
    for sent, last in _block_after_block(docs.sparkSession, items, shingle, threshold, block):
        kept = docs.mapInArrow(_clean(sent, docs.columns.index("text")), docs.schema)
        docs = kept if last else staged(kept)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Exact containment without any sketch, joined on the shingles themselves.
OP7_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), i5 AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i : i + least(5, len(w)) - 1], ' '))) AS s FROM iw WHERE len(w) > 0
), d5 AS (
  SELECT DISTINCT doc_id, k.n, unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: array_to_string(w[i : i + k.n - 1], ' '))) AS s FROM dw, (SELECT DISTINCT n FROM i5) k
), c AS (SELECT item_id, count(*) AS n FROM i5 GROUP BY item_id)
SELECT d5.doc_id, i5.item_id, any_value(c.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / any_value(c.n)::DOUBLE AS containment
FROM i5 JOIN d5 ON i5.s = d5.s AND i5.n = d5.n JOIN c ON c.item_id = i5.item_id
GROUP BY d5.doc_id, i5.item_id HAVING count(*) >= ceil(round(0.8 * any_value(c.n), 9))
"""
