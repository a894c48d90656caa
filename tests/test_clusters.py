"""Distributed clusterings against the functions that hold a whole group, on groups small enough for both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import clusters, models

SCHEMA = "chrom string, start_pos long, maf double, coverage double, weight double"


def groups():
    """A large group with an outlier and two equal points, a small one, two points, and one point."""
    r = np.random.default_rng(3)
    rows = []
    for g, n in (("a", 200), ("b", 40), ("c", 2), ("d", 1)):
        xy = np.array([[0.1, 1.0], [0.3, 1.5], [0.45, 2.2]])[r.integers(0, 3, n)] + r.normal(0, 0.03, (n, 2))
        if n == 200:
            xy[5], xy[6] = [0.5, 30.0], xy[7]
        rows += [(g, i, float(xy[i, 0]), float(xy[i, 1]), 1.0 + i % 3) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def plane(spark):
    rows = spark.createDataFrame([*groups(), ("a", 900, None, 1.0, 1.0), ("e", 1, None, 2.0, 1.0)], SCHEMA)
    return clusters.plane(rows, F.col("chrom"), F.col("start_pos"), F.col("maf"), F.col("coverage"), F.col("weight")).cache()


def each():
    rows = groups()
    for g in "abcd":
        own = [r for r in rows if r[0] == g]
        yield g, np.array([r[2:4] for r in own]), np.array([r[4] for r in own])


def labels_of(df):
    found = {(r.grp, r.id): r.cluster for r in df.collect()}
    return lambda g, n: np.array([found.get((g, i), -1) for i in range(n)])


def test_nearest_by_growing_cells(plane):
    got = {(r.grp, r.id): r.v for r in clusters.nearest(plane, 10, fill=30, block=64).collect()}
    assert len(got) == 243
    for g, xy, _ in each():
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
        for i in range(len(xy)):
            assert np.allclose(got[g, i], np.sort(np.delete(d[i], i))[:10])


def test_density_peaks_equal_those_of_the_whole_matrix(plane):
    peaks = clusters.density(plane.drop("weight"), fill=60, block=64)
    got = labels_of(clusters.peak_labels(peaks, 2.0, F.lit(0.1)))
    for g, xy, _ in each():
        assert (got(g, len(xy)) == models.density_peaks(xy)).all()
    cut = {r.grp: r.distance for r in clusters.chosen_distance(peaks).collect()}
    swept = labels_of(clusters.peak_labels(peaks.join(clusters.chosen_distance(peaks), "grp"), 2.0, F.col("distance")))
    assert set(cut) == {"a", "b", "c"}
    for g, xy, _ in each():
        assert (swept(g, len(xy)) == models.density_sweep(xy)).all()


def test_mixture_by_grouped_sums(plane):
    got = labels_of(clusters.mixture(plane))
    for g, xy, w in each():
        places = np.quantile(xy, (np.arange(min(4, len(xy))) + 0.5) / 4, axis=0)
        assert (got(g, len(xy)) == models.gaussian_mixture(xy, w, places)["posterior"].argmax(axis=1)).all()


def test_mean_shift_by_grouped_sums(plane):
    got = labels_of(clusters.mean_shift_labels(plane.drop("weight"), 0.1))
    for g, xy, _ in each():
        assert (got(g, len(xy)) == models.mean_shift(xy, 0.1)[1]).all()


def test_a_wide_cluster_becomes_two(spark):
    r = np.random.default_rng(6)
    wide = [np.array([0.2, 1.0]), np.array([0.2, 1.9])]
    xy = np.concatenate([c + r.normal(0, 0.02, (60, 2)) for c in wide] + [np.array([0.45, 4.0]) + r.normal(0, 0.01, (80, 2))])
    rows = spark.createDataFrame([("a", i, float(x), float(y), 1.0) for i, (x, y) in enumerate(xy)], SCHEMA)
    points = clusters.plane(rows, F.col("chrom"), F.col("start_pos"), F.col("maf"), F.col("coverage"))
    peaks = clusters.density(points)
    # at this cut-off the two near clumps are one cluster
    first = clusters.peak_labels(peaks, 2.0, F.lit(1.0))
    before = labels_of(first)("a", 200)
    assert len(set(before[:120])) == 1 and len(set(before)) == 2
    after = labels_of(clusters.recluster(peaks, first))("a", 200)
    assert len(set(after[:60])) == len(set(after[60:120])) == len(set(after[120:])) == 1
    assert len(set(after)) == 3 and set(after[120:]) == set(before[120:])


def test_empty_planes_and_unknown_methods(spark):
    none = spark.createDataFrame([], SCHEMA)
    for method in ("mixture", "density", "mean_shift", "density_sweep", "reclustered"):
        assert models.cluster_segments(none, method).count() == 0
    assert models.neighbour_sums(none).count() == 0
    with pytest.raises(ValueError):
        models.cluster_segments(none, "guess")
    lone = spark.createDataFrame([("a", 5, None, 1.0, 1.0), ("a", 6, 0.2, 1.0, 1.0)], SCHEMA)
    got = {r.start_pos: r.cluster for r in models.cluster_segments(lone, "density").collect()}
    assert got == {5: -1, 6: -1}
