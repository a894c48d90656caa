"""Operators at sizes at which a step that grows with the square of a group does not end."""

import time

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from helixframe.operators import clusters, models, segmentation, selection
from helixframe.operators import segments as sg
from helixframe.plans import haplotype_queries

from .conftest import SMALL


def test_many_short_segments_are_absorbed_in_time_by_their_number():
    n = 60_000
    at = np.arange(n, dtype=np.int64) * 1000
    rows = pd.DataFrame({"chrom": "a", "start_pos": at, "end_pos": at + 1000, "cn": np.arange(n) % 4, "q": np.arange(n) % 7 / 1.0})
    began = time.perf_counter()
    assert len(sg._absorb(rows, 1500, 10_000)) == n  # none is long
    # the last one is long, but only the one eleven before it is so near that the ten between go along
    rows.loc[n - 1, "end_pos"] += 1000
    out = sg._absorb(rows, 1500, 10_000)
    assert len(out) == n - 11 and out["start_pos"].iloc[-1] == (n - 12) * 1000 and out["end_pos"].iloc[-1] == (n + 1) * 1000
    assert out["cn"].iloc[-1] == (n - 1) % 4
    assert time.perf_counter() - began < 30


def test_densities_cost_work_by_places_not_by_points(spark):
    """60,000 points at 36 places: all pairs would be 1.8 billion."""
    spots = np.array([(0.1 * k + 0.01 * i, 1.0 * k + 0.02 * j) for k in range(4) for i in range(3) for j in range(3)])
    n, m = 60_000, len(spots)
    rows = spark.range(n).select("id", F.expr(f"cast(id * 7 % {m} as int)").alias("p"))
    table = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)], "p int, x double, y double")
    points = clusters.plane(rows.join(table, "p"), F.lit("a"), F.col("id"), F.col("x"), F.col("y"))
    began = time.perf_counter()
    peaks = clusters.density(points)
    labels = {r.id: r.cluster for r in clusters.peak_labels(peaks, 2.0, F.lit(0.3)).collect()}
    assert time.perf_counter() - began < 60
    got = peaks.toPandas()
    heads = got[got["times"] > 0]
    assert len(got) == n and len(heads) == m and heads["times"].sum() == n
    times = np.bincount(np.arange(n) * 7 % m, minlength=m)
    d = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(axis=2))
    upper, left = np.triu_indices(m, 1), (0.02 * n * (n - 1) / 2) - (times * (times - 1) / 2).sum()
    order = np.argsort(d[upper])
    dc = 1e-12 if left < 0 else d[upper][order][np.searchsorted(np.cumsum((times[:, None] * times)[upper][order]), left, side="right")]
    rho = (np.exp(-((d / dc) ** 2)) * times).sum(axis=1) - 1
    assert np.allclose(got["rho"], rho[got["id"] * 7 % m])
    assert all(labels[i] == labels[i % m] for i in range(n))  # the same place
    assert len({labels[i] for i in range(m)}) == 4
    assert len({labels[i] for i in range(n) if i * 7 % m < 9}) == 1


def test_medians_of_many_lists_by_counts(spark):
    """Values far apart, equal ones, a gap in the middle of an even list, and a group without rows."""
    n = 6000
    r = np.random.default_rng(5)
    x = np.where(np.arange(n) % 2, 1e-9 * r.random(n), 5.0 + 1e-12 * r.random(n))
    x[:900] = 0.25
    own, times = np.arange(n) % 7 % 3, 1 + np.arange(n) % 3
    own[own == 2] = 3
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "cluster": own.astype(np.int32), "times": times})).repartition(5)
    power = np.array([1.0, 2.0, 0.5])

    def values(chunk, lists):
        return chunk["x"].to_numpy() ** power[lists, None]

    whole = x ** power[:, None]
    groups = [own == g for g in range(4)] + [own >= 0]
    sizes = np.array([times[g].sum() for g in groups])
    least = np.array([[w[g].min(initial=np.inf) for g in groups] for w in whole])
    most = np.array([[w[g].max(initial=0.0) for g in groups] for w in whole])
    got = selection.medians(rows, values, "cluster", sizes, least, most)
    want = np.array([[np.median(np.repeat(w[g], times[g])) if g.any() else 0.0 for g in groups] for w in whole])
    assert (got == want).all()
    # an even list whose middle numbers lie far apart
    two = spark.createDataFrame(pd.DataFrame({"x": np.r_[1 + 1e-13 * r.random(800), 9 + 1e-13 * r.random(800)], "cluster": np.zeros(1600, np.int32), "times": np.ones(1600, np.int64)}))
    x = two.toPandas()["x"].to_numpy()
    ends = np.full((1, 2), x.min()), np.full((1, 2), x.max())
    got = selection.medians(two, lambda chunk, lists: chunk["x"].to_numpy()[None], "cluster", np.array([1600, 1600]), *ends)
    assert (got == np.median(x)).all()


def test_silhouettes_by_blocks_equal_those_of_the_whole_matrix():
    r = np.random.default_rng(0)
    for n in (5, 30, 57, 200):
        xy, times = r.random((n, 2)), r.integers(1, 4, n)
        labels = np.array([r.integers(0, k, n) for k in (2, 3, 5, 1)], np.uint8)
        labels[2, 0] = 9  # may be alone in its cluster
        halves = [models.median_silhouettes(xy, times, labels, at, chunk=700) for at in (np.arange(n // 2), np.arange(n // 2, n))]
        sums, counts = (sum(h[i] for h in halves) for i in (0, 1))
        for j, own in enumerate(labels):
            want = models.silhouette(np.repeat(xy, times, axis=0), np.repeat(own.astype(int), times))
            assert np.isclose(sums[j] / counts[j] if counts[j] else 0.0, want, atol=1e-12)


def test_best_mixture_costs_work_by_places(spark):
    """A group as the plain search finds it, small ones, and 20,000 points at 80 places."""
    r = np.random.default_rng(2)
    own = {"a": np.array([[0.1, 1.0], [0.3, 1.5], [0.45, 2.2], [0.2, 2.4]])[r.integers(0, 4, 150)] + r.normal(0, 0.02, (150, 2)), "b": r.random((6, 2)), "c": r.random((2, 2)), "d": r.random((1, 2))}
    own["a"][7] = own["a"][3]
    spots = np.concatenate([np.array(c) + r.normal(0, 0.02, (20, 2)) for c in ((0.1, 1.0), (0.4, 1.6), (0.2, 2.2), (0.45, 3.0))])
    own["e"] = spots[np.arange(20_000) % 80]
    rows = pd.concat([pd.DataFrame({"chrom": g, "start_pos": np.arange(len(xy)), "maf": xy[:, 0], "coverage": xy[:, 1], "weight": 1.0 + np.arange(len(xy)) % 3}) for g, xy in own.items()])
    rows = pd.concat([rows, pd.DataFrame({"chrom": ["a"], "start_pos": [900], "coverage": [1.0], "weight": [1.0]})])
    rows["maf"] = rows["maf"].astype(object).where(rows["maf"].notna(), None)
    points = spark.createDataFrame(rows.to_dict("records"), "chrom string, start_pos long, maf double, coverage double, weight double")
    began = time.perf_counter()
    got = {(x.chrom, x.start_pos): x.cluster for x in models.cluster_segments(points, "best_mixture").collect()}
    assert time.perf_counter() - began < 60
    assert len(got) == len(rows) and got["a", 900] == -1
    for g in "abcd":
        assert [got[g, i] for i in range(len(own[g]))] == models.best_mixture(own[g], 1.0 + np.arange(len(own[g])) % 3).tolist()
    large = np.array([got["e", i] for i in range(20_000)])
    assert (large == large[np.arange(20_000) % 80]).all() and len(set(large)) >= 4


def test_sites_of_a_family_are_shuffled_once_before_they_are_copied(spark):
    """Neither the copies for each sample nor the genotypes of a site go through a shuffle."""
    plan = haplotype_queries.phased(spark, SMALL, 4)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in dealt if "sample" in line]
    assert len([line for line in dealt if "seg" in line]) == 1


def test_the_largest_arc_by_blocks_is_that_of_all_arcs():
    r = np.random.default_rng(1)
    for n in (1001, 1500, 5000):
        steps = np.r_[r.poisson(3, n // 2), r.poisson(4, n - n // 2)].astype(float)
        for x in (r.normal(0, 1, n), r.poisson(3, n).astype(float), steps, np.resize([1.0, 2.0, 0.0], n), (np.arange(n) == 7) * 100.0):
            s = np.concatenate([[0.0], np.cumsum(x - x.mean())])
            for least in (2, 5):
                assert segmentation._arcs_by_blocks(s, least) == segmentation._arcs_by_length(s, least)


def test_the_largest_arc_of_a_million_values():
    """All arcs would be 500 billion."""
    n = 1_000_000
    x = np.random.default_rng(4).poisson(10, n).astype(float)
    x[300_000:700_000] += 1
    began = time.perf_counter()
    _, i, j = segmentation.max_arc(x)
    segmentation._largest_short_arc(x)
    assert time.perf_counter() - began < 30
    assert abs(i - 300_000) < 200 and abs(j - 700_000) < 200
