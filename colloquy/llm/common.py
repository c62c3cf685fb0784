"""What several operators share: byte-level words and hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.staging import staged

SPACE_WORDS = 1
ALNUM_WORDS = 2
#: Bytes of text that a task works on at once; one longer document is worked on alone.
SLICE_BYTES = 2_000_000


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# --- words as byte spans -------------------------------------------------------------------------


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.arange(256)
    space = ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    low = np.where((b >= 0x41) & (b <= 0x5A), b + 32, b).astype(np.uint8)
    alnum = ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    return space, low, alnum[low]


_SPACE, LOWER, _ALNUM = _tables()


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into them) for slices of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bytes(kind: int) -> np.ndarray:
    """For each byte: is it part of words?"""
    return _SPACE if kind == SPACE_WORDS else _ALNUM


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: int = SPACE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_bytes(kind)[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The given words (in order) with one space after each, and where they start and end there."""
    length = ends - starts
    new_end = np.cumsum(length + 1) - 1
    out = np.full(int(new_end[-1]) + 1 if len(starts) else 0, 0x20, np.uint8)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    place = np.ones(len(out), bool)
    place[new_end] = False
    out[place] = (LOWER[data] if lower else data)[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return out.tobytes(), new_end - length, new_end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each span: differences of prefix sums of a polynomial modulo 2**64."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_inverse(base), n + 1)[starts])


_BYTE_BASE, _WORD_BASE = 0x9E6C63D0876A9A35, 0xD1342543DE82EF95


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words; the same in every task."""
    codes = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return _rolling(codes, starts, ends, _BYTE_BASE)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words: one for each start, whichever document it lies in."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(m)
    return _rolling(words, at, at + n, _WORD_BASE)


def starts_inside(first_word: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each run of n words over a slice of documents: does it lie within one document?"""
    m = max(0, total - n + 1)
    end_of = np.repeat(first_word[1:], np.diff(first_word))
    return np.arange(m) + n <= end_of[:m]


# --- parts of long conversations -------------------------------------------------------------------


def numbered_parts(rows: DataFrame, order: list[Column], most: int, most_chars: int) -> DataFrame:
    """rows (conv_id, text, ...) with `place`, a number that rises in the given order, and `part`, the number of the first turn of
    the part of its conversation that a row belongs to; parts end where a conversation reaches a multiple of `most` turns or
    `most_chars` characters.

    A range sort deals rows by the order, which begins with conv_id; what stands before a task's first row of a conversation is the
    sum over the tasks before it, of which there is one row each.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("task", F.shiftright("place", 33)))
    within = Window.partitionBy("conv_id", "task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sums = staged(sums.select(F.col("conv_id").alias("of"), F.col("task").alias("of_task"), F.coalesce(F.sum("n").over(before), zero).alias("n"), F.coalesce(F.sum("chars").over(before), zero).alias("chars")))
    at = dealt.select("conv_id", "task", "place", F.length("text").alias("own"))
    at = at.withColumn("nth", F.count("*").over(within)).withColumn("upto", F.coalesce(F.sum("own").over(within), zero))
    at = at.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("task") == F.col("of_task")))
    at = at.withColumn("nth", F.col("nth") + F.col("n")).withColumn("cut", F.struct(F.floor(F.col("nth") / most), F.floor((F.col("upto") + F.col("chars")) / most_chars)))
    at = staged(at.select("conv_id", F.col("place").alias("of_place"), "nth", "cut"))
    first = at.groupBy("conv_id", "cut").agg(F.min("nth").alias("part"))
    first = first.select(F.col("conv_id").alias("of"), F.col("cut").alias("of_cut"), "part")
    named = at.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("of_cut"))).select("of_place", "part")
    return dealt.join(named, F.col("place") == F.col("of_place")).drop("of_place", "task")


# --- connected components ------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (a, b): component is the smallest id that can be reached.

    Alternating large and small stars: each round is two grouped minimums and two joins over the edges, so no vertex's
    neighbours are gathered in one place: the minimums are tables of their own, so that Spark can split a vertex with very many
    edges in the joins. Each round's edges go to a table in the shared folder, and rounds go on until nothing changes; their number
    grows with the logarithm of a component's length.
    """
    e = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select("b", "a")).toDF("v", "n")
        low = staged(both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = both.where("n > v").join(low, "v").select(F.col("m").alias("a"), F.col("n").alias("b"))
        large = staged(large.where("a <> b").distinct())
        down = staged(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(down, "b")
        small = small.select(F.col("m").alias("a"), "b").union(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        e = staged(small.where("a <> b").distinct())
        n, s = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == before:
            return e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(e.select("a", "a").distinct())
        before = (n, s)
