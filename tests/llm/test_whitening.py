"""Whitening against exact integers and numpy's eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest

from colloquy.llm import op12_whitening as op

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def plain(rows):
    """(n, exact deviations by place, V) of vectors of one length."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * c - s for c, s in zip(v, sums)] for v in x]
    v = [[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(len(sums))] for i in range(len(sums))]
    return n, [sum(c * c for c in r) for r in d], d, np.array(v)


def check(got, ids, rows, components=op.COMPONENTS):
    n, deviation, d, v = plain(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(v))
    z = (np.array(d, float) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(ids) * k and len(by) == len(set(ids)) * k
    own = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    sign = np.sign((own * z).sum(0))
    np.testing.assert_allclose(own * sign, z, atol=1e-7)
    for i, dev in zip(ids, deviation):
        for c in range(k):
            r = by[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, dev) and r["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] < 1e-9
    mean = own.mean(0)
    assert np.abs((own - mean).T @ (own - mean) / len(own) - np.eye(k)).max() < 1e-9


def test_query(spark, sf):
    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r["embedding"] is not None]
    check(op.op12_whitening(spark, sf).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_hard_rows(spark):
    """Nulls, non-finite entries, other lengths, repeated rows, far means, small variances and clashing columns."""
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 5)) * [100, 10, 1, 0.5, 0.05] + [1e4, -1e4, 0, 3, 900]) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(7, good[7].tolist())] * 2 + [(None, good[9].tolist())]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [math.nan] * 5), (903, [1.0, math.inf, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0]), (906, [9.0] * 6)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows + bad], SCHEMA).repartition(5)
    got = [r for r in op.whitening_rows(table).collect()]
    assert {r["vec_id"] for r in got} == {r[0] for r in rows}
    n, _, _, v = plain([r[1] for r in rows])
    assert {r["n"] for r in got} == {n} and len(got) == 5 * len(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-6)
    unique = [r for r in rows[:300] if r[0] not in (7, 9)]
    own = {(r["vec_id"], r["component"]): r for r in got}
    again = {(r["vec_id"], r["component"]): r for r in op.whitening_rows(table.repartition(2)).collect()}
    assert all(own[i, c]["whitened"] == again[i, c]["whitened"] and own[i, c]["deviation"] == again[i, c]["deviation"] for i, _ in unique for c in range(1, 6))


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        got = op.whitening_rows(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = spark.createDataFrame([(i, [float(i), 5.0, -float(i)], 1, "") for i in range(4)], SCHEMA)
    got = op.whitening_rows(flat).collect()
    assert [r["component"] for r in got] == [1] * 4 and all(r["explained"] == pytest.approx(1) for r in got)
    huge = spark.createDataFrame([(1, [1e300, 0.0], 1, ""), (2, [-1e300, 1.0], 1, ""), (3, [0.0, 2.0], 1, "")], SCHEMA)
    got = {r["vec_id"]: r for r in op.whitening_rows(huge).collect()}
    assert len(got) == 3 and got[1]["deviation"] is None and got[3]["deviation"] == 36864


def test_ties_of_length(spark):
    rows = [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0, 5.0]), (4, [1.0, 0.0, 9.0])]
    assert {r["vec_id"] for r in op.whitening_rows(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)).collect()} == {3, 4}


def test_jacobi():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        m = rng.normal(size=(n, n))
        m = m @ m.T
        values, vectors = op.jacobi(m)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-9)
        np.testing.assert_allclose(vectors @ np.diag(values) @ vectors.T, m, atol=1e-10 * values[0])
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    pairs = [(int(a), int(b)) for p, q in op.rounds_of_pairs(7) for a, b in zip(p, q)]
    assert sorted(pairs) == [(a, b) for a in range(7) for b in range(a + 1, 7)]
    # graded by 1e-9 on each side: the small eigenvalue keeps its digits
    scale = np.array([1, 1e-4, 1e-9])
    a = np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]]) * np.outer(scale, scale)
    exact = float(np.linalg.det(np.array([[1, 0.5, 0.25], [0.5, 1, 0.5], [0.25, 0.5, 1]]))) * float((scale**2).prod())
    values, _ = op.jacobi(a)
    assert values.prod() == pytest.approx(exact, rel=1e-12)
    assert op.jacobi(np.zeros((4, 4)))[0].tolist() == [0] * 4


def test_exact_products():
    rng = np.random.default_rng(2)
    for reach in (3, 10**5, 10**8, 1 << 41):
        y = rng.integers(-reach, reach, (40, 3))
        sums = op.Products(3)
        for part in (y[:7], y[7:], y[:0]):
            sums.add(part)
        assert (sums.total() == y.astype(object).T @ y.astype(object)).all()
        d = op.centred(y, 10**9, [5, -7, 1 << 60])
        assert [[int(c) for c in r] for r in d] == [[10**9 * int(c) - s for c, s in zip(r, [5, -7, 1 << 60])] for r in y]
        assert op.squares(d) == [sum(int(c) ** 2 for c in r) for r in d]
