"""Embedding whitening by cyclic Jacobi rotations of an exact covariance.

Entries become whole numbers, x = floor(64 * entry) + 1000000, so sums and products are exact and results don't depend on how rows
are dealt to tasks. One pass over the table adds up each dimension; a second adds up the products of what is left after subtracting
the rounded mean m. With y = x - m, n vectors and s the sum of y, the covariance is (n * sum(y y') - s s') / n**2, which Python's
integers give exactly and one division rounds. Tasks send one number for each dimension, or pair of dimensions, to a grouped sum; the
driver gets as many numbers as a covariance matrix has, whatever the number of rows.

There, rotations make off-diagonal entries vanish, pair after pair in sweeps over all pairs (disjoint pairs of a sweep at once), until
each is below the rounding error of its own row and column, which keeps small eigenvalues as accurate as large ones. The eigenvectors,
by falling eigenvalue and divided by its root, are the whitening matrix that is sent to the tasks. A third pass measures the
covariance of what comes out.

Nulls: a vector that is null or holds null or non-finite entries is left out; a null vec_id is returned as it is. Empty vectors and,
if lengths differ, those of another length than the commonest (of several, the longest) are left out too. Entries beyond 2**34 count as
2**34. Directions in which vectors don't vary, or by less than the rounding of the largest variance, can't be whitened and give no
component, so a single row or equal rows give no rows.
Repeated rows count each. An empty table gives no rows. Extra columns are ignored. A sum of squares that a long can't hold is null in
the query's `deviation`; the operator's is a decimal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.staging import staged

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries lie within this bound.
MOST = 1 << 40
_EPS = float(np.finfo(np.float64).eps)
_KIND = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """n vectors were fitted; sums of x by dimension; eigenvalues of the kept components, falling; unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows whose vectors can be used."""
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: F.coalesce(F.abs(c) <= float(np.finfo(np.float64).max), F.lit(False)))
    return out.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    c = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], _KIND)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors, its number of rows (at -1) and sums by dimension."""
    total: dict[int, list] = {}
    for batch in batches:
        vectors = batch.column(0)
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            x = scaled(vectors.filter(pa.array(sizes == dim)), dim)
            own = total.setdefault(dim, [0, np.zeros(dim, object)])
            own[0] += len(x)
            own[1] += x.sum(0).astype(object)
    for dim, (n, sums) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), pa.array(range(-1, dim), pa.int32()), decimals([n, *sums])], ["dim", "at", "value"])


class Products:
    """Exact sums of y y' over blocks of whole rows y."""

    def __init__(self, dim: int) -> None:
        self.whole, self.part, self.reach = np.zeros((dim, dim), object), np.zeros((dim, dim), np.int64), 0

    def add(self, y: np.ndarray) -> None:
        square = max(1, int(np.abs(y).max(initial=0)) ** 2)
        at_once = (1 << 53) // square
        if not at_once:  # not even one product is exact in double precision
            self.whole += y.astype(object).T @ y.astype(object)
            return
        for a in range(0, len(y), at_once):
            f = y[a : a + at_once].astype(np.float64)
            if self.reach + len(f) * square >= 1 << 62:
                self.whole += self.part.astype(object)
                self.part[:], self.reach = 0, 0
            self.part += (f.T @ f).astype(np.int64)
            self.reach += len(f) * square

    def total(self) -> np.ndarray:
        return self.whole + self.part.astype(object)


def _products(dim: int, centre: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = Products(dim), 0
        for batch in batches:
            sums.add(scaled(batch.column(0), dim) - np.array(centre, np.int64))
            rows += batch.num_rows
        if rows:
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(i * dim + j), decimals(sums.total()[i, j].tolist())], ["cell", "value"])

    return run


def rounds_of_pairs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n indices in rounds of disjoint pairs, as in a tournament."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < n]
        out.append((np.array([a for a, _ in pairs], dtype=np.int64), np.array([b for _, b in pairs], dtype=np.int64)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    a, v = matrix.astype(np.float64).copy(), np.eye(len(matrix))
    floor = _EPS**2 * float(np.abs(a).max(initial=0))
    schedule = rounds_of_pairs(len(a))
    for _ in range(sweeps):
        turned = False
        for p, q in schedule:
            off = a[p, q]
            need = (np.abs(off) > _EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))) & (np.abs(off) > floor)
            if not need.any():
                continue
            turned, p, q, off = True, p[need], q[need], off[need]
            at_p, at_q = a[p, p], a[q, q]
            tau = (at_q - at_p) / (2 * off)
            t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1, tau))
            c = 1 / np.hypot(1, t)
            s = t * c
            for m in (a, a.T, v):
                own, other = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * own - s * other, s * own + c * other
            a[p, q] = a[q, p] = 0
            a[p, p], a[q, q] = at_p - t * off, at_q + t * off
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(v))] < 0, -1.0, 1.0)
    return np.diag(a)[order], v


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as long integers if they fit, else Python's."""
    reach = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    return n * x - np.array(sums, np.int64) if reach < 1 << 62 else n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int]:
    """Sums of the squares of each row, exact."""
    reach = int(np.abs(d).max(initial=0)) ** 2 * d.shape[1]
    return ((d * d) if reach < 1 << 62 else d.astype(object) ** 2).sum(1).tolist()


def _projected(shared, measure: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, matrix = shared.value
        dim, k = matrix.shape
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            d = centred(scaled(batch.column(0), dim), n, sums)
            z = (d.astype(np.float64) / n) @ matrix
            if measure:
                one = np.concatenate([z, np.ones((len(z), 1))], 1)
                total += one.T @ one
            else:
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1), decimals(squares(d)), flat], ["vec_id", "deviation", "whitened"])
        if measure and total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

    return run


def _sent(spark: SparkSession, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    """What tasks need: dimension times component numbers, whatever the number of rows."""
    return spark.sparkContext.broadcast((n, sums, vectors / np.sqrt(values)))


def whitening(embeddings: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits the whitening of all usable vectors; None if nothing varies."""
    given = usable(embeddings)
    parts = staged(given.select("vector").mapInArrow(_sums, "dim int, at int, value decimal(38,0)"))
    most = parts.where("at = -1").groupBy("dim").agg(F.sum("value").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not most:
        return None
    dim, n = most["dim"], int(most["n"])
    by_dim = parts.where((F.col("dim") == dim) & (F.col("at") >= 0)).groupBy("at").agg(F.sum("value").alias("value")).collect()
    sums = [int(r["value"]) for r in sorted(by_dim, key=lambda r: r["at"])]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    own = given.where(F.size("vector") == dim).select("vector", "vec_id")
    cells = own.select("vector").mapInArrow(_products(dim, centre), "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    v = np.zeros((dim, dim))
    for r in cells:
        i, j = divmod(r["cell"], dim)
        v[i, j] = v[j, i] = (n * int(r["value"]) - rest[i] * rest[j]) / (n * n)
    values, vectors = jacobi(v)
    kept = values[:components] > dim * _EPS * max(values[0], 0)
    values, vectors = values[:components][kept], vectors[:, :components][:, kept]
    if not len(values):
        return None
    shared = _sent(embeddings.sparkSession, n, sums, values, vectors)
    k = len(values) + 1
    found = own.mapInArrow(_projected(shared, True), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k * k)
    for r in found:
        total[r["cell"]] = r["value"]
    total = total.reshape(k, k) / n
    error = np.abs(total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(k - 1)).max()
    return Whitening(n, sums, float(np.trace(v)), values, vectors, float(error))


def whitened(embeddings: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) for every usable vector of the fitted length: whitened has one number for each component."""
    own = usable(embeddings).where(F.size("vector") == len(fitted.sums)).select("vector", "vec_id")
    shared = _sent(embeddings.sparkSession, fitted.n, fitted.sums, fitted.values, fitted.vectors)
    return own.mapInArrow(_projected(shared, False), "vec_id long, deviation decimal(38,0), whitened array<double>")


def whitening_rows(embeddings: DataFrame) -> DataFrame:
    """A row for each usable vector and component, numbered from 1."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = whitening(embeddings)
    if fitted is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    share = F.array(*[F.lit(float(x)) for x in fitted.explained])
    rows = whitened(embeddings, fitted).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(fitted.identity_error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
