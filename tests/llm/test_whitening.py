"""Whitening against numpy's eigenvectors, and the Jacobi-Davidson search against known spectra."""

import math

import numpy as np
import pytest

from helixframe.llm import queries, whitening

from ..conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, id string, y int, component int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4) for i, v in rows], SCHEMA)


def brute(rows, k=32):
    """(id, deviation) of the rows that stay, whitened rows, explained shares and the fit's size."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in kept], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    y = (x - 1000000) - (sums - n * 1000000) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    return [(i, int(d)) for (i, _), d in zip(kept, ((n * x - sums) ** 2).sum(axis=1))], y @ vector / np.sqrt(value), value / np.trace(y.T @ y / n), n


def compare(got, rows, k=32):
    ids, white, explained, n = brute(rows, k)
    k = len(explained)
    assert len(got) == len(ids) * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(ids)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9
    for c in range(1, k + 1):
        mine = [r for r in got if r.component == c]
        assert {r.explained for r in mine} == {mine[0].explained}
        assert mine[0].explained == pytest.approx(explained[c - 1], rel=1e-10)
        a = np.array([w for _, w in sorted((r.vec_id, r.whitened) for r in mine)])
        b = np.array([w for _, w in sorted((i, w) for (i, _), w in zip(ids, white[:, c - 1]))])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7, c  # either sign; ids are unique here


def test_query_equals_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    compare(queries.QUERIES["op13_whitening"](spark, SMALL).collect(), rows)


def test_odd_rows_are_left_out_and_repeated_rows_count(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=5) * [3, 2, 1, 1, 0.5]]) for i in range(60)]
    rows += [(60, rows[0][1])] * 3 + [(5, rows[7][1])]
    odd = [(70, None), (71, [1.0, None, 0.0, 0.0, 0.0]), (72, [float("nan")] * 5), (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, [1.0]), (75, [])]
    got = whitening.whiten(frame(spark, rows + odd)).collect()
    assert not {r.vec_id for r in got} & {i for i, _ in odd}
    ids, white, explained, n = brute(rows)
    assert len(got) == len(rows) * 5 and got[0].n == len(rows)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == sorted(ids)
    top = sorted((r.vec_id, abs(r.whitened)) for r in got if r.component == 1)
    assert np.allclose([w for _, w in top], [w for _, w in sorted((i, abs(w)) for (i, _), w in zip(ids, white[:, 0]))])


def test_empty_and_flat_tables(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in flat] == [(None, 0, 0.0, 0.0)] * 4
    line = whitening.whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0])])).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: r.component)] == [False] * 3 + [True] * 3
    assert sorted(round(abs(r.whitened), 6) for r in line if r.whitened is not None) == [0.0, round(math.sqrt(1.5), 6), round(math.sqrt(1.5), 6)]
    with pytest.raises(Exception, match="beyond the range"):
        whitening.whiten(frame(spark, [(1, [0.0]), (2, [1e9])])).collect()


@pytest.mark.parametrize("values", [np.linspace(1, 2, 90), 1 / np.arange(1, 201), np.r_[np.full(12, 5.0), np.ones(50)], np.r_[np.ones(3), np.zeros(37)], np.ones(1)])
def test_leading_pairs_reach_double_precision(values):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(values), len(values))))[0]
    a = (q * values) @ q.T
    products = []
    found, vectors = whitening.leading_pairs(lambda b: products.append(b.shape) or a @ b, len(values), 32)
    want = np.sort(values)[::-1][:32]
    assert np.abs(found - want).max() <= 1e-13
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= 3e-14 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13


def test_minres_solves_a_shifted_system():
    r = np.random.default_rng(4)
    a = r.standard_normal((12, 12))
    a = a + a.T
    right = r.standard_normal((12, 3))
    shifts = np.array([0.3, -0.2, 1.5])
    x = whitening.minres(lambda b: a @ b, right, shifts, lambda b: b, 40)
    assert np.abs(a @ x - x * shifts - right).max() < 1e-8
