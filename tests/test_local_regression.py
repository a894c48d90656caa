"""Local regression against the plain definition over single points, and its use on bins."""

import math

import numpy as np
import pytest

from helixframe.operators import models


def plain(x, y, at, span):
    """For each place: the window moved point by point, tricube weights, and the weighted line."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(x)
    k = max(2, math.ceil(span * n))
    out = []
    for p in at:
        left = 0
        while left + k < n and (p > x[left + k - 1] or x[left + k] - p < p - x[left]):
            left += 1
        xs, ys = x[left : left + k], y[left : left + k]
        w = np.clip(1 - (np.abs(xs - p) / max(p - xs[0], xs[-1] - p)) ** 3, 0, None) ** 3
        slope, level = np.polyfit(xs - p, ys, 1, w=np.sqrt(w))
        out.append(level)
    return np.array(out)


def test_points_equal_the_definition():
    r = np.random.default_rng(2)
    x = r.permutation(np.pi * np.arange(1, 201) / 100)
    y = np.sin(x) + r.normal(0, 0.2, 200)
    assert np.abs(models.loess(x, y, x, 0.3) - plain(x, y, x, 0.3)).max() < 1e-9
    # windows chosen at knots: little is lost
    assert np.abs(models.loess(x, y, x, 0.3, step=0.01) - plain(x, y, x, 0.3)).mean() < 0.00155
    assert np.isfinite(models.loess(x, y, x, 0.3, rounds=3)).all()


def test_classes_stand_for_their_bins():
    r = np.random.default_rng(3)
    n = r.integers(1, 60, 40)
    gc = np.arange(30.0, 70.0)
    mean = np.cos(gc / 9)
    # bins of one class are alike here, so that their order does not matter
    bins_x, bins_y = np.repeat(gc, n), np.repeat(mean, n)
    got = models.loess(gc, mean, gc, 0.4, counts=n, step=1.0)
    assert np.abs(got - plain(bins_x, bins_y, gc, 0.4)).max() < 1e-9


def test_odd_inputs():
    assert models.loess(np.array([5.0]), np.array([2.0]), np.array([1.0, 9.0])).tolist() == [2.0, 2.0]
    heavy = models.loess(np.array([1.0, 2.0]), np.array([7.0, 9.0]), np.array([1.0]), 0.5, counts=np.array([90, 10]))
    assert heavy == pytest.approx([7.0])


def test_gc_is_taken_out_of_the_counts(spark):
    r = np.random.default_rng(4)
    rows = [("chr1" if i % 9 else "chrY", i * 10, int(g), float(np.exp(4 + 0.02 * g + r.normal(0, 0.05)))) for i, g in enumerate(r.integers(30, 70, 3000))] + [("chr1", 99_999, 50, 0.0)]
    df = spark.createDataFrame(rows, "chrom string, start_pos long, gc int, cnt double")
    out = models.normalize_gc_loess(df).toPandas()
    assert len(out) == 3001 and (out["cnt"] == 0).sum() == 1
    kept = out[out["cnt"] > 0]
    assert abs(np.corrcoef(kept["gc"], np.log(kept["cnt"]))[0, 1]) < 0.05
    assert np.median(np.log(kept["cnt"])) == pytest.approx(np.median(np.log([c for *_, c in rows if c > 0])), abs=0.02)
    assert models.normalize_gc_loess(df.filter("false")).count() == 0
