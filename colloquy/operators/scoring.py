"""Scores over rows: document frequencies, proximity and cosines of bags and vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.hits import coverages, rarity_weight
from colloquy.functions.text import round3
from colloquy.plans.plan import Plan

#: Vectors of a block, and the parts that the queries of a search are dealt into before they are cut into blocks.
BLOCK = 1024
QUERY_PARTS = 4


def relevance(question: Column, answer: Column) -> Column:
    """The mean of both matches."""
    return round3((question + answer) / 2)


def retrieval_score(question: Column, answer: Column) -> Column:
    """Three parts of the better match and one of the weaker."""
    return round3(0.75 * F.greatest(question, answer) + 0.25 * F.least(question, answer))


def places(text: Column, term: str, most: int = 80) -> Column:
    """Offsets from 0 of a term's first places, which may overlap: the text is cut before each of them."""
    pieces = F.slice(F.split(text, f"(?={re.escape(term)})"), 1, most + 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.when(F.startswith(p, F.lit(term)), F.array_append(s["found"], s["at"])).otherwise(s["found"]).alias("found"))
    return F.slice(F.aggregate(pieces, begin, step, lambda s: s["found"]), 1, most)


def nearest_span(text: Column, terms: list[str], gap: int = 180) -> Column:
    """struct(start, end) of the tightest span with the first two terms at most `gap` characters apart; null if there is none.

    Places are found once for a text: they are bound to a lambda's variable, as functions of arrays aren't shared otherwise. A
    caller that filters on the result does best to explode it (`spans`), which a filter isn't pushed through.
    """
    core = [t for t in terms if t][:2]
    if not core:
        return F.lit(None).cast("struct<start:int,end:int>")
    have = F.lit(True)
    for t in core:
        have = have & F.contains(text, F.lit(t))
    first = places(text, core[0])
    if len(core) == 1:
        at = F.get(first, 0)
        return F.when(have, F.struct(at.alias("start"), (at + len(core[0])).alias("end")))
    second = places(text, core[1])

    def span(a: Column, b: Column) -> Column:
        start, end = F.least(a, b), F.greatest(a + len(core[0]), b + len(core[1]))
        return F.struct((end - start).alias("width"), start.alias("start"), end.alias("end"))

    # Of the second term's places only the last one up to a place of the first and the first one after it can make the tightest span.
    def nearest(a: Column, others: Column) -> Column:
        close = F.array(F.array_max(F.filter(others, lambda b: b <= a)), F.array_min(F.filter(others, lambda b: b > a)))
        return F.transform(F.array_compact(close), lambda b: span(a, b))

    apart = lambda s: s["width"] - len(core[0]) - len(core[1]) <= gap
    best = lambda p: F.array_min(F.filter(F.flatten(F.transform(p["a"], lambda a: nearest(a, p["b"]))), apart))
    bound = F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), best)
    ends = F.transform(bound, lambda s: F.when(s.isNotNull(), F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(have, F.get(ends, 0))


def spans(text: Column, terms: list[str], gap: int = 180) -> Column:
    """nearest_span as a row, or no row where there is none."""
    return F.explode(F.array_compact(F.array(nearest_span(text, terms, gap))))


def rarity_weights(documents: DataFrame, text: str, plan: Plan, runs: dict | None = None) -> list[float]:
    """A weight for each concept of the plan: the fewer documents half cover it, the higher. One aggregation."""
    cover = documents.select(coverages(F.col(text), list(plan.groups), runs).alias("c"))
    having = [F.count_if(F.col("c")[i] >= 0.5).alias(f"n{i}") for i in range(len(plan.groups))]
    row = cover.agg(F.count("*").alias("n"), *having).select(*[rarity_weight(F.col("n"), F.col(f"n{i}")) for i in range(len(plan.groups))]).first()
    return [float(x) for x in row]


def bag_cosine(left: DataFrame, left_key: str, right: DataFrame, right_key: str, token: str = "token", n: str = "n") -> DataFrame:
    """(left_key, right_key, cosine) of bags (key, token, n) that share a token; the norms come from all tokens of a bag."""
    norm = lambda bag, key: bag.groupBy(key).agg(F.sqrt(F.sum(F.col(n) * F.col(n)).cast("double")).alias(f"_{key}_norm"))
    a, b = left.select(left_key, token, F.col(n).alias("_a")), right.select(right_key, token, F.col(n).alias("_b"))
    dots = a.join(b, token).groupBy(left_key, right_key).agg(F.sum(F.col("_a") * F.col("_b")).alias("_dot"))
    dots = dots.join(norm(left, left_key), left_key).join(norm(right, right_key), right_key)
    return dots.select(left_key, right_key, (F.col("_dot") / (F.col(f"_{left_key}_norm") * F.col(f"_{right_key}_norm"))).alias("cosine"))


def vector_cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a literal query; 0 if either has no length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda a, x: a + x
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(length > 0, dot / length).otherwise(F.lit(0.0))


def vector_blocks(rows: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """(ids, width, data): at most BLOCK vectors of one width, in order of their ids, as unit vectors; one without length stays 0.

    Rows without an id or a vector are in no block.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                ids, lists = own.column(0).to_numpy(zero_copy_only=False), own.column(1)
                widths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(widths) - widths
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    at = at[np.argsort(ids[at], kind="stable")]
                    v = flat[starts[at][:, None] + np.arange(w)].astype(np.float64)
                    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
                    v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at]], pa.list_(pa.int64())), pa.array([int(w)], pa.int32()), pa.array([v.tobytes()], pa.binary())], [f"{prefix}_ids", f"{prefix}_width", f"{prefix}_data"])

    own = rows.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return own.mapInArrow(pack, f"{prefix}_ids array<bigint>, {prefix}_width int, {prefix}_data binary")


def nearest_vectors(rows: DataFrame, queries: DataFrame, key: str, vector: str, n: int = 8) -> DataFrame:
    """(query, key, cosine) with the n rows nearest to each query, other rows than its own; ties by the id.

    Blocks of queries meet all blocks of rows, as matrix products in tasks; each pair of blocks gives at most n rows a query, and
    a rank over these decides. Cosines are compared to 9 digits; vectors of another width are no neighbours. An id names one
    row. No queries, or no other rows, give no rows.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if b["q_width"] != b["r_width"]:
                    continue
                asks, ids = np.array(b["q_ids"], np.int64), np.array(b["r_ids"], np.int64)
                q, r = (np.frombuffer(b[f"{x}_data"], np.float64).reshape(len(i), -1) for x, i in (("q", asks), ("r", ids)))
                cosines = np.round(q @ r.T, 9)
                cosines[asks[:, None] == ids] = -np.inf
                order = np.argsort(-cosines, axis=1, kind="stable")[:, :n]
                found = np.take_along_axis(cosines, order, axis=1)
                keep = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks, keep.sum(axis=1))), pa.array(ids[order][keep]), pa.array(found[keep])], ["query", key, "cosine"])

    pairs = vector_blocks(rows, key, vector, "r").crossJoin(vector_blocks(queries.repartition(QUERY_PARTS), key, vector, "q"))
    near = pairs.mapInArrow(best, f"query bigint, `{key}` bigint, cosine double")
    along = Window.partitionBy("query").orderBy(F.desc("cosine"), key)
    return near.withColumn("_nth", F.row_number().over(along)).where(F.col("_nth") <= n).drop("_nth")
