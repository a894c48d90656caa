"""Statistical models: local regression, mixtures, mean shift, density peaks, likelihood tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.tables import written

from . import clusters as clusters_in
from .segmentation import negative_binomial
from .selection import chunks, medians


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.3, rounds: int = 0, counts: np.ndarray | None = None, step: float | None = None) -> np.ndarray:
    """Local linear regression with tricube weights on the nearest ``span`` of the points, at the places ``at``.

    With ``counts`` each x stands for so many points whose mean is y; a window that ends inside them
    takes them in part. A window is a stretch of neighbouring points; it moves right while the next
    point lies nearer than the leftmost. With ``step`` windows are chosen at knots of that distance
    from the least x on, and a place uses that of the last knot before it. ``rounds`` further fits
    down-weigh large residuals by the bisquare function. A window of one x gives its mean.
    """
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    n = np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    if total <= 1:
        return np.full(len(at), y[0] if len(y) else np.nan)
    k = max(2, min(total, math.ceil(span * total)))

    def point(i: np.ndarray) -> np.ndarray:
        return x[np.searchsorted(ends, i, "right")]

    def windows(places: np.ndarray) -> np.ndarray:
        """The first point of each place's window: the least from which moving on brings nothing nearer."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), total - k)
        while (low < high).any():
            mid = (low + high) // 2
            holds = (point(mid + k - 1) >= places) & (point(np.minimum(mid + k, total - 1)) + point(mid) >= 2 * places)
            low, high = np.where(holds | (low >= high), low, mid + 1), np.where(holds, mid, high)
        return low

    def fit(places: np.ndarray, robust: np.ndarray) -> np.ndarray:
        knots = places if step is None else x[0] + np.clip(np.floor((places - x[0]) / step + 1e-9), 0, np.floor((x[-1] - x[0]) / step + 1e-9)) * step
        out = np.empty(len(places))
        for i, (p, first) in enumerate(zip(places, windows(knots).tolist(), strict=True)):
            inside = np.minimum(ends, first + k) - np.maximum(ends - n, first)
            far = max(p - point(np.array(first)), point(np.array(first + k - 1)) - p)
            w = np.where(inside > 0, np.clip(1 - (np.abs(x - p) / (far if far > 0 else 1.0)) ** 3, 0, None) ** 3 * inside, 0.0) * robust
            if far <= 0 or w.sum() <= 0:
                w = np.where(inside > 0, inside, 0) * robust
            mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
            spread = (w * (x - mx) ** 2).sum()
            out[i] = my + ((w * (x - mx) * (y - my)).sum() / spread * (p - mx) if spread > 1e-12 else 0.0)
        return out

    robust = np.ones(len(x))
    for _ in range(rounds):
        r = np.abs(y - fit(x, robust))
        middle = np.median(np.repeat(r, n))
        if middle == 0:
            break
        robust = np.clip(1 - (r / (6 * middle)) ** 2, 0, None) ** 2
    return fit(np.asarray(at, float), robust)


def golden_section(f, low: float, high: float, tolerance: float = 1e-5) -> float:
    """Where a function of one valley is least."""
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def normalize_gc_loess(bins: DataFrame, span: float | None = None, spans: tuple[float, float] = (0.3, 0.75), tolerance: float = 1e-5) -> DataFrame:
    """Counts divided by a local regression of log counts on GC, scaled to the median of the logs.

    The regression is that of the single bins: as GC is a whole percent, sums by percent hold all it
    needs, and windows count bins. Only where a window ends inside a percent, its bins are taken in
    part by their mean instead of by their order. Without ``span`` a golden-section search takes the
    one after which a second regression varies least over the bins outside of chromosome Y. Bins
    without counts stay as they are.
    """
    logs = bins.filter("cnt > 0").select("gc", F.ln("cnt").alias("y"), F.lower("chrom").isin("chry", "y").alias("on_y"))
    autosomes = F.when(~F.col("on_y"), F.col("y"))
    table = logs.groupBy("gc").agg(F.avg("y").alias("m"), F.count("y").alias("n"), F.avg(autosomes).alias("ma"), F.count(autosomes).alias("na")).orderBy("gc").toPandas()  # at most one row for each percent
    if table.empty:
        return bins
    middle, middle_a = logs.agg(F.median("y"), F.median(autosomes)).collect()[0]
    x = table["gc"].to_numpy(float)
    every = np.arange(x[0], x[-1] + 1)

    def at_classes(gc: np.ndarray, mean: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
        return loess(gc, mean, gc, share, counts=n, step=1.0)

    if span is None:
        own = table[table["na"] > 0]
        gc, mean, n = own["gc"].to_numpy(float), own["ma"].to_numpy(float), own["na"].to_numpy(np.int64)

        def unevenness(share: float) -> float:
            again = at_classes(gc, mean - at_classes(gc, mean, n, share) + middle_a, n, share)
            centre = np.average(again, weights=n)
            return float(((again - centre) ** 2 * n).sum())

        low = max(2 / max(int(n.sum()), 1), spans[0])
        high = max(min(1.0, spans[1]), low)
        span = golden_section(unevenness, low, high, tolerance) if int(n.sum()) > 1 else high
    fitted = loess(x, table["m"].to_numpy(float), every, span, counts=table["n"].to_numpy(np.int64), step=1.0)
    factors = bins.sparkSession.createDataFrame(pd.DataFrame({"gc": every.astype("int32"), "f": np.exp(middle - fitted)}))
    joined = bins.join(F.broadcast(factors), "gc", "left")  # at most one row for each percent
    return joined.withColumn("cnt", F.col("cnt") * F.coalesce("f", F.lit(1.0))).select(bins.columns)


def gaussian_mixture(points: np.ndarray, weights: np.ndarray, means: np.ndarray, rounds: int = 30, tolerance: float = 2.5e-5, start: tuple[float, float] = (0.01, 0.01)) -> dict:
    """Weighted mixture of axis-aligned Gaussians by expectation and maximization from given means.

    Posteriors under 0.01 are left out, means of components lighter than 0.01 stay, variances keep
    above 1e-7. Returns shares, means, variances, posteriors and the mean log likelihood.
    """
    k = len(means)
    share, mean, var = np.full(k, 1 / k), means.astype(float).copy(), np.tile(np.array(start, float), (k, 1))
    last = -np.inf
    for _ in range(rounds):
        d = points[:, None, :] - mean[None]
        logs = -0.5 * (d * d / var[None]).sum(axis=2) - 0.5 * np.log(var).sum(axis=1) - math.log(2 * math.pi) + np.log(np.maximum(share, 1e-300))
        top = logs.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        post = np.exp(logs - norm[:, None])
        fit = float((norm * weights).sum() / weights.sum())
        used = np.where(post < 0.01, 0, post) * weights[:, None]
        total = used.sum(axis=0)
        share = total / weights.sum()
        for c in range(k):
            if total[c] > 0:
                if share[c] >= 0.01:
                    mean[c] = (used[:, c, None] * points).sum(axis=0) / total[c]
                var[c] = np.maximum((used[:, c, None] * (points - mean[c]) ** 2).sum(axis=0) / total[c], 1e-7)
        if abs(fit - last) < tolerance:
            break
        last = fit
    return {"share": share, "mean": mean, "var": var, "posterior": post, "fit": fit}


def mean_shift(points: np.ndarray, bandwidth: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(modes, label of each point) with a Gaussian kernel; seeds are the corners of occupied cells.

    Modes within one bandwidth are one; they are sorted, so that labels do not depend on order.
    """
    cell = 2 * bandwidth
    seeds = np.unique(np.trunc(points / cell), axis=0) * cell
    ends = []
    for seed in seeds:
        at = seed
        for _ in range(rounds):
            d2 = ((points - at) ** 2).sum(axis=1)
            near = d2 <= (3 * bandwidth) ** 2
            if not near.any():
                break
            w = np.exp(-0.5 * d2[near] / bandwidth**2)
            to = (w[:, None] * points[near]).sum(axis=0) / w.sum()
            moved = math.sqrt(float(((to - at) ** 2).sum()))
            at = to
            if moved < 1e-3 * bandwidth:
                break
        ends.append(at)
    modes: list[np.ndarray] = []
    for e in sorted(ends, key=lambda v: tuple(v)):
        if all(((e - m) ** 2).sum() > bandwidth**2 for m in modes):
            modes.append(e)
    centers = np.array(modes)
    label = ((points[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    return centers, label


def density_peaks(points: np.ndarray, share: float = 0.02, density: float = 2.0, distance: float = 0.1) -> np.ndarray:
    """Cluster of each point, -1 where there is none: centres are dense and far from denser points.

    Density sums exp(-(d/dc)^2) over the other points, dc the ``share`` quantile of distances; other
    points follow their nearest denser neighbour.
    """
    n = len(points)
    if n < 2:
        return np.full(n, -1)
    d = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(axis=2))
    upper = np.sort(d[np.triu_indices(n, 1)])
    dc = max(float(upper[min(int(len(upper) * share), len(upper) - 1)]), 1e-12)
    rho = np.exp(-((d / dc) ** 2)).sum(axis=1) - 1
    order = np.lexsort((np.arange(n), -rho))
    delta, parent, label = np.zeros(n), np.full(n, -1), np.full(n, -1)
    for r, i in enumerate(order):
        if r == 0:
            delta[i] = d[i].max()
            continue
        before = order[:r]
        k = before[int(d[i, before].argmin())]
        delta[i], parent[i] = d[i, k], k
    clusters = 0
    for i in order:
        if rho[i] > density and delta[i] > distance:
            label[i], clusters = clusters, clusters + 1
        elif parent[i] >= 0:
            label[i] = label[parent[i]]
    return label


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with medians of distances inside and between clusters."""
    d = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(axis=2))
    names = np.unique(labels[labels >= 0])
    scores = []
    for i in np.flatnonzero(labels >= 0):
        own = (labels == labels[i]) & (np.arange(len(points)) != i)
        others = [np.median(d[i, labels == c]) for c in names if c != labels[i]]
        if own.any() and others:
            a, b = float(np.median(d[i, own])), float(min(others))
            scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores)) if scores else 0.0


def best_mixture(points: np.ndarray, weights: np.ndarray, counts: tuple[int, ...] = (4, 5, 6, 7), starts: int = 10, far: float = 0.8, seed: int = 0) -> np.ndarray:
    """Labels of the mixture of greatest silhouette over numbers of clusters and seeded random starts.

    A start draws its means one by one from the points beyond the ``far`` quantile of distances from
    those drawn, or from all points where none is.
    """
    n, rng = len(points), np.random.default_rng(seed)
    d = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(axis=2))
    limit = np.quantile(d[np.triu_indices(n, 1)], far) if n > 1 else 0.0
    best, labels = -np.inf, np.zeros(n, int)
    for k in counts:
        for _ in range(starts if k <= n else 0):
            drawn: list[int] = []
            while len(drawn) < k:
                left = np.setdiff1d(np.arange(n), drawn)
                apart = left[(d[np.ix_(left, drawn)] > limit).all(axis=1)] if drawn else left
                drawn.append(int(rng.choice(apart if len(apart) else left)))
            found = gaussian_mixture(points, weights, points[drawn])["posterior"].argmax(axis=1)
            score = silhouette(points, found)
            if score > best:
                best, labels = score, found
    return labels


def best_weighting(coverage: np.ndarray, maf: np.ndarray, weights: np.ndarray, low: float, high: float, steps: int = 10, clusters: int = 6) -> float:
    """The weight of coverage against maf under which a mixture has the greatest likelihood; the first of equals."""
    best, chosen = -np.inf, low
    for w in low + np.arange(steps) * (high - low) / steps:
        xy = np.column_stack([maf, w * coverage])
        places = np.quantile(xy, (np.arange(clusters) + 0.5) / clusters, axis=0)
        fit = gaussian_mixture(xy, weights, places)["fit"]
        if fit > best:
            best, chosen = fit, float(w)
    return chosen


def density_sweep(points: np.ndarray, low: float = 0.01, high: float = 0.5, steps: int = 20, default: float = 0.1, most: int = 7) -> np.ndarray:
    """Density peaks at the cut-off of distance whose number of clusters most cut-offs give.

    The greatest such cut-off is taken. Where two or three numbers tie, it is the second that occurs
    from above if under ``most``, else the first; where more tie, ``default``.
    """
    cutoffs = [low + k * (high - low) / steps for k in range(steps)][::-1]
    sizes = [int(density_peaks(points, distance=c).max(initial=-1)) + 1 for c in cutoffs]
    times = {k: sizes.count(k) for k in dict.fromkeys(sizes)}
    modes = [k for k, v in times.items() if v == max(times.values())]
    if len(modes) > 3:
        return density_peaks(points, distance=default)
    wanted = modes[1] if len(modes) > 1 and modes[1] < most else modes[0]
    return density_peaks(points, distance=cutoffs[sizes.index(wanted)])


# ---------------------------------------------------------------- copy-number states and purity


def state_table(spark: SparkSession, highest: int = 6) -> DataFrame:
    """States (cn, mcc, maf): the major count is at least half; maf is the expected minor share."""
    rows = [(cn, m, (cn - m) / cn if cn else 0.5) for cn in range(highest + 1) for m in range((cn + 1) // 2, cn + 1)]
    return spark.createDataFrame(rows, "cn int, mcc int, maf double")


def purity_grid(spark: SparkSession, coverages: tuple[int, int], purities: tuple[int, int] = (20, 100), step: int = 1, purity_step: int = 1) -> DataFrame:
    """Candidate models: diploid coverage and purity in percent, each with its own step and its upper bound."""

    def places(bounds: tuple[int, int], by: int) -> list[int]:
        return sorted({*range(bounds[0], bounds[1] + 1, by), bounds[1]})

    a = spark.createDataFrame([(float(c),) for c in places(coverages, step)], "diploid double")
    b = spark.createDataFrame([(p / 100,) for p in places(purities, purity_step)], "purity double")
    return a.crossJoin(b)


def best_purity(segments: DataFrame, grid: DataFrame, states: DataFrame, maf_weight: float = 50.0, low: float = 1.5, high: float = 4.5) -> DataFrame:
    """The grid's model of least weighted distance of segments to their nearest state.

    ``segments`` has coverage, maf and weight; those without coverage or weight do not count. The
    candidates, whose number the grid bounds whatever the input, go to the segments, and each task
    gives its sums for each candidate. Models whose mean copy number lies outside ``low`` to
    ``high`` do not count. Ties go to the higher purity, then to the lower coverage.
    """
    spark = segments.sparkSession
    table = states.orderBy("cn", "mcc").toPandas()  # a few dozen states
    candidates = grid.orderBy("diploid", "purity").toPandas()  # bounded by the grid's ranges
    shared = spark.sparkContext.broadcast((candidates.to_numpy(float), table[["cn", "maf"]].to_numpy(float)))

    def partial(batches):
        (diploid, purity), (cn, maf) = (x.T for x in shared.value)
        mixed = purity[:, None] * cn + 2 * (1 - purity[:, None])
        mu = mixed / 2 * diploid[:, None]
        expect = (purity[:, None] * cn * maf + (1 - purity[:, None])) / np.maximum(mixed, 1e-9)
        sums = np.zeros((3, len(diploid)))
        for rows in batches:
            for c, f, w in zip(rows["coverage"].to_numpy(float), rows["maf"].to_numpy(float), rows["weight"].to_numpy(float), strict=True):
                cover = ((mu - c) / diploid[:, None]) ** 2
                d = 2 * cover if np.isnan(f) else cover + ((expect - f) * maf_weight / 50.0) ** 2
                near = d.argmin(axis=1)
                sums += np.stack([np.sqrt(d[np.arange(len(d)), near]) * w, cn[near] * w, np.full(len(d), w)])
        yield pd.DataFrame({"k": np.arange(len(diploid)), "d": sums[0], "c": sums[1], "w": sums[2]})

    rows = segments.select(*[F.col(c).cast("double").alias(c) for c in ("coverage", "maf", "weight")]).filter("coverage is not null and weight is not null")
    each = rows.mapInPandas(partial, "k long, d double, c double, w double").groupBy("k").agg(F.sum("d").alias("d"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    named = spark.createDataFrame(candidates.reset_index(names="k"))
    fit = named.join(each.filter("w > 0"), "k").select("diploid", "purity", (F.col("d") / F.col("w")).alias("deviation"), (F.col("c") / F.col("w")).alias("ploidy"))
    return fit.filter(F.col("ploidy").between(low, high)).orderBy(F.round("deviation", 9), F.desc("purity"), "diploid").limit(1)


def model_deviations(segments: DataFrame, grid: DataFrame, states: DataFrame, maf_weight: float = 50.0, heterogeneous: int = 3, enough: int = 100, most_clusters: int = 10) -> DataFrame:
    """(diploid, purity, ploidy, precision, accuracy, cluster_deviation, heterogeneous, deviation) of every model of the grid.

    ``segments`` has coverage, maf, weight and cluster (numbers from 0; null or negative: none).
    precision is the weighted distance of segments to their nearest state; accuracy that of each
    state to the mean of the segments nearest to it, a state without any maf among them counting as
    at maf 0. With over ``enough`` segments that have a maf, and under ``most_clusters`` clusters, the
    clusters count too: over states of under twice the mean coverage, cluster_deviation is the mean
    over clusters of their mean squared distances. A cluster is heterogeneous where its median is over
    that of all segments and its entropy over the median entropy; clusters of up to two segments have
    zeros. The deviation is the mean of precision and accuracy, or, where over ``heterogeneous``
    clusters are so, of all three. The entropy of a cluster of n segments sums -p ln p over the
    distinct major shares of their states, p being the share over n.

    Candidates and states are bounded by the grid. Equal segments of a cluster weigh as one. Segments are
    dealt to tasks, which give sums by candidate and state, and by candidate and cluster; the medians
    come from counts of distances (:func:`selection.medians`), so that no list of them is held.
    """
    spark = segments.sparkSession
    candidates = grid.orderBy("diploid", "purity").toPandas()
    table = states.orderBy("cn", "mcc").toPandas()  # a few dozen states
    rows = segments.select(*[F.col(c).cast("double").alias(c) for c in ("coverage", "maf", "weight")], F.col("cluster").cast("int").alias("cluster"))
    rows = rows.filter("coverage is not null and weight is not null").withColumn("cluster", F.greatest(F.coalesce("cluster", F.lit(-1)), F.lit(-1)))
    rows = written(rows.groupBy("coverage", "maf", "cluster").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("times")), "segments")
    known = F.col("cluster") >= 0
    about = rows.agg(
        (F.sum(F.col("weight") * F.col("coverage")) / F.sum("weight")).alias("mean"), F.coalesce(F.sum(F.when(F.col("maf").isNotNull(), F.col("times"))), F.lit(0)).alias("mafs"),
        F.coalesce(F.sum("times"), F.lit(0)).alias("n"), F.coalesce(F.max(F.when(known, F.col("cluster"))) + 1, F.lit(0)).alias("clusters"),
    ).collect()[0]
    diploid, purity = (candidates[c].to_numpy(float) for c in ("diploid", "purity"))
    cn, mcc, maf = (table[c].to_numpy(float) for c in ("cn", "mcc", "maf"))
    mixed = purity[:, None] * cn + 2 * (1 - purity[:, None])
    mu, expect = mixed / 2 * diploid[:, None], (purity[:, None] * cn * maf + (1 - purity[:, None])) / np.maximum(mixed, 1e-9)
    shared = spark.sparkContext.broadcast((diploid, mu, expect, cn))
    mean = about["mean"] or 0.0

    def nearest(chunk: pd.DataFrame, lists: np.ndarray, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates (rows) and segments (columns) the squared distance to the nearest state under a limit of coverage, and that state."""
        diploid, mu, expect, _ = shared.value
        c, f = (chunk[x].to_numpy(float) for x in ("coverage", "maf"))
        least, state = np.full((len(lists), len(c)), np.inf), np.zeros((len(lists), len(c)), np.int16)
        for i in range(mu.shape[1]):
            cover = ((mu[lists, i, None] - c) / diploid[lists, None]) ** 2
            d = np.where(np.isnan(f), 2 * cover, cover + ((expect[lists, i, None] - f) * maf_weight / 50.0) ** 2)
            d[mu[lists, i] >= limit] = np.inf
            nearer = d < least
            least[nearer], state[nearer] = d[nearer], i
        return least, state

    def sums(batches):
        size = shared.value[1].shape
        total = np.zeros((5, *size))
        for chunk in chunks(batches, size[0]):
            least, near = nearest(chunk, np.arange(size[0]))
            c, f, w = (chunk[x].to_numpy(float) for x in ("coverage", "maf", "weight"))
            each = np.column_stack([w, w * c, np.where(np.isnan(f), 0.0, w * f), np.where(np.isnan(f), 0.0, w)])
            root = np.sqrt(least)
            for i in range(size[1]):
                own = (near == i).astype(float)
                total[0, :, i] += (own * root) @ w
                total[1:, :, i] += (own @ each).T
        k, state = np.nonzero(total[1] > 0)
        yield pd.DataFrame({"k": k, "state": state} | {n: t[k, state] for n, t in zip("dwcfg", total, strict=True)})

    parts = rows.mapInPandas(sums, "k int, state int, d double, w double, c double, f double, g double")
    by_state = parts.groupBy("k", "state").agg(*[F.sum(c).alias(c) for c in "dwcfg"])
    named = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(diploid), dtype=np.int32), "diploid": diploid, "purity": purity}))
    expected = spark.createDataFrame(pd.DataFrame({
        "k": np.repeat(np.arange(len(diploid), dtype=np.int32), len(cn)), "state": np.tile(np.arange(len(cn), dtype=np.int32), len(diploid)), "mu": mu.ravel(), "expect": expect.ravel(), "cn": np.tile(cn, len(diploid)),
    }))
    joined = by_state.join(expected, ["k", "state"]).join(named, "k")
    centre = F.sqrt(F.pow((F.col("mu") - F.col("c") / F.col("w")) / F.col("diploid"), 2) + F.pow((F.col("expect") - F.when(F.col("g") > 0, F.col("f") / F.col("g")).otherwise(0.0)) * maf_weight / 50.0, 2))
    whole = F.sum("w")
    fits = joined.groupBy("k", "diploid", "purity").agg(
        (F.sum("d") / whole).alias("precision"), (F.sum(centre * F.col("w")) / whole).alias("accuracy"), (F.sum(F.col("cn") * F.col("w")) / whole).alias("ploidy")
    )
    plain = (F.col("precision") + F.col("accuracy")) / 2
    names = ["diploid", "purity", "ploidy", "precision", "accuracy", "cluster_deviation", "heterogeneous", "deviation"]
    if not (about["mafs"] > enough and about["n"] > enough and 0 < about["clusters"] < most_clusters):
        return fits.select("diploid", "purity", "ploidy", "precision", "accuracy", F.lit(0.0).alias("cluster_deviation"), F.lit(0).cast("long").alias("heterogeneous"), plain.alias("deviation")).select(names)

    count = about["clusters"]
    members = rows.filter(known)
    own = {r["cluster"]: r["n"] for r in members.groupBy("cluster").agg(F.sum("times").alias("n")).collect()}  # under most_clusters
    n = np.array([own.get(c, 0) for c in range(count)], np.int64)
    open_ = np.flatnonzero((mu < 2 * mean).any(axis=1))  # candidates with a state under the limit

    def about_clusters(batches):
        least, most = np.full((len(open_), count), np.inf), np.zeros((len(open_), count))
        total, seen = np.zeros((len(open_), count)), np.zeros((len(open_), count, shared.value[1].shape[1]), bool)
        for chunk in chunks(batches, len(open_)):
            d, state = nearest(chunk, open_, 2 * mean)
            cluster, times = chunk["cluster"].to_numpy(), chunk["times"].to_numpy(float)
            for c in np.unique(cluster):
                at = np.flatnonzero(cluster == c)
                least[:, c], most[:, c] = np.minimum(least[:, c], d[:, at].min(axis=1)), np.maximum(most[:, c], d[:, at].max(axis=1))
                total[:, c] += d[:, at] @ times[at]
                seen[np.arange(len(open_))[:, None], c, state[:, at]] = True
        i, c = np.nonzero(seen.any(axis=2))
        yield pd.DataFrame({"i": i, "cluster": c, "least": least[i, c], "most": most[i, c], "total": total[i, c], "states": [np.flatnonzero(v).tolist() for v in seen[i, c]]})

    parts = members.mapInPandas(about_clusters, "i int, cluster int, least double, most double, total double, states array<int>")
    parts = parts.groupBy("i", "cluster").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.array_distinct(F.flatten(F.collect_list("states"))).alias("states"))
    shape = (len(open_), count)
    least, most, means, entropy = np.full(shape, np.inf), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    share = np.array([m / c if c else 0.0 for c, m in zip(cn, mcc, strict=True)])
    for r in parts.collect():  # bounded by candidates and clusters
        at = r["i"], r["cluster"]
        least[at], most[at] = r["least"], r["most"]
        if n[at[1]] > 2:
            p = np.unique(share[r["states"]])
            p = p[p > 0] / n[at[1]]
            means[at], entropy[at] = r["total"] / n[at[1]], -float((p * np.log(p)).sum())
    least, most = (np.column_stack([x, y]) for x, y in ((least, least.min(axis=1, initial=np.inf)), (most, most.max(axis=1, initial=0.0))))
    middle = medians(members, lambda chunk, lists: nearest(chunk, open_[lists], 2 * mean)[0], "cluster", np.r_[n, n.sum()], least, most) if len(open_) else np.zeros((0, count + 1))
    # clusters of up to two segments, also those without one, have zeros
    median, mid_entropy = np.where(n > 2, middle[:, :-1], 0.0), np.median(entropy, axis=1)
    odd = ((median > middle[:, -1:]) & (entropy > mid_entropy[:, None])).sum(axis=1)
    overall = spark.createDataFrame(
        pd.DataFrame({"k": open_.astype(np.int32), "cluster_deviation": means.sum(axis=1) / count, "heterogeneous": odd.astype(np.int64)}), "k int, cluster_deviation double, heterogeneous long"
    )
    scored = fits.join(overall, "k", "left")
    # without a state under the limit every cluster is heterogeneous and the deviation has no bound
    scored = scored.withColumns({"cluster_deviation": F.coalesce("cluster_deviation", F.lit(float("inf"))), "heterogeneous": F.coalesce("heterogeneous", F.lit(2**31 - 1).cast("long"))})
    third = (F.col("precision") + F.col("accuracy") + F.col("cluster_deviation")) / 3
    return scored.withColumn("deviation", F.when(F.col("heterogeneous") > heterogeneous, third).otherwise(plain)).select(names)


def best_model(deviations: DataFrame, low: float = 1.5, high: float = 4.5) -> DataFrame:
    """The model of least deviation whose ploidy lies between ``low`` and ``high``; ties go to the higher purity, then the lower coverage."""
    return deviations.filter(F.col("ploidy").between(low, high)).orderBy(F.round("deviation", 9), F.desc("purity"), "diploid").limit(1)


def nearest_states(segments: DataFrame, states: DataFrame, key: list[str], diploid: float, purity: float = 1.0, maf_weight: float = 1.0) -> DataFrame:
    """Per segment the nearest state and the runner-up's distance; a missing maf counts coverage twice."""
    mixed = states.select(
        "cn", "mcc", (F.lit(diploid) / 2 * (F.lit(purity) * F.col("cn") + 2 * (1 - purity))).alias("mu"),
        ((purity * F.col("cn") * F.col("maf") + (1 - purity)) / F.greatest(purity * F.col("cn") + 2 * (1 - purity), F.lit(1e-9))).alias("expect"),
    )
    pairs = segments.crossJoin(F.broadcast(mixed))  # a few dozen states
    cover = F.pow((F.col("coverage") - F.col("mu")) / diploid, 2)
    allele = F.when(F.col("maf").isNull(), cover).otherwise(F.pow((F.col("maf") - F.col("expect")) * maf_weight, 2))
    rows = pairs.withColumn("d", F.round(F.sqrt(cover + allele), 9)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("d", "cn", "mcc"))).alias("v"))
    return rows.select(*key, F.get("v", F.lit(0))["cn"].alias("cn"), F.get("v", F.lit(0))["mcc"].alias("mcc"), F.get("v", F.lit(0))["d"].alias("distance"), F.get("v", F.lit(1))["d"].alias("second"))


def likelihood_table(spark: SparkSession, means: dict[str, float], variances: dict[str, float], highest: int = 5, size: int = 400) -> DataFrame:
    """(sample, cn, depth, p): negative binomial likelihood of a coverage in each copy-number state."""
    rows = []
    for sample, mean in means.items():
        for cn in range(highest + 1):
            p = negative_binomial(max(cn, 0.1) * mean / 2, variances[sample], size)
            rows.append(pd.DataFrame({"sample": sample, "cn": cn, "depth": np.arange(size), "p": p}))
    return spark.createDataFrame(pd.concat(rows, ignore_index=True)).withColumns({"cn": F.col("cn").cast("int"), "depth": F.col("depth").cast("int")})


# ---------------------------------------------------------------- clustering of segments

def _in_plane(points: DataFrame, by: str, scale: float, *more: str) -> DataFrame:
    """The points with maf and scaled coverage as the axes; ids order them by contig and place."""
    key = F.col("start_pos") if by == "chrom" else F.concat(F.col("chrom"), F.lit(":"), F.lpad(F.col("start_pos").cast("string"), 12, "0"))
    return clusters_in.plane(points, F.col(by), key, F.col("maf"), scale * F.col("coverage"), *map(F.col, more))


def cluster_segments(points: DataFrame, method: str = "mixture", by: str = "chrom", scale: float = 1.0, clusters: int = 4, bandwidth: float = 0.1) -> DataFrame:
    """Cluster of each segment in the plane of coverage (times ``scale``) and maf, apart for each ``by``.

    ``points`` has chrom, start_pos, coverage, maf and weight. ``method`` is mixture, density,
    mean_shift, density_sweep, which searches its cut-off, or reclustered, which then parts clusters
    of wide spread; these deal a group's points to cells and blocks or sum them by group. best_mixture
    searches the number of clusters; a task holds a group's places and a block of their distances. A
    missing maf gives -1.
    """
    flat = written(_in_plane(points, by, scale, "weight", "chrom", "start_pos"), "plane")
    slim = flat.select("grp", "id", "x", "y")
    if method == "mixture":
        labels = clusters_in.mixture(flat.select("grp", "id", "x", "y", "weight"), clusters)
    elif method == "best_mixture":
        labels = best_mixture_labels(flat.select("grp", "id", "x", "y", "weight"))
    elif method == "mean_shift":
        labels = clusters_in.mean_shift_labels(slim, bandwidth)
    elif method in ("density", "density_sweep", "reclustered"):
        peaks = clusters_in.density(slim)
        if method == "density":
            labels = clusters_in.peak_labels(peaks, 2.0, F.lit(bandwidth))
        else:
            found = peaks.join(clusters_in.chosen_distance(peaks), "grp")
            labels = clusters_in.peak_labels(found, 2.0, F.col("distance"))
            if method == "reclustered":
                labels = clusters_in.recluster(peaks, written(labels, "labels"))
    else:
        raise ValueError(f"no clustering called {method}")
    named = flat.select("grp", "id", "chrom", "start_pos").join(labels, ["grp", "id"])
    return points.select("chrom", "start_pos").join(named, ["chrom", "start_pos"], "left").select(
        "chrom", "start_pos", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
    )


def draw_starts(points: np.ndarray, limit: float, counts: tuple[int, ...], starts: int, seed: int) -> list[tuple[int, list[int]]]:
    """(number of clusters, points drawn as means) of each start, as of :func:`best_mixture`."""
    n, rng, out = len(points), np.random.default_rng(seed), []
    for k in counts:
        for _ in range(starts if k <= n else 0):
            drawn: list[int] = []
            left, far = np.ones(n, bool), np.ones(n, bool)
            while len(drawn) < k:
                apart = np.flatnonzero(left & far)
                drawn.append(int(rng.choice(apart if len(apart) else np.flatnonzero(left))))
                left[drawn[-1]] = False
                far &= np.sqrt(((points - points[drawn[-1]]) ** 2).sum(axis=1)) > limit
            out.append((k, drawn))
    return out


def median_silhouettes(points: np.ndarray, times: np.ndarray, labels: np.ndarray, at: np.ndarray, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Per labelling (rows of ``labels``) the sum of silhouettes of the points at the places ``at``, and their number.

    ``points`` are all places of a group, with ``times`` points each. A silhouette compares the medians
    of a point's distances to the others of its cluster and to those of the next cluster; points
    without either do not count. Distances are sorted once for all labellings, ``chunk`` of them at a time.
    """
    sums, counts = np.zeros(len(labels)), np.zeros(len(labels))
    step = max(1, chunk // len(points))
    sizes = [np.bincount(own, times).astype(np.int64) for own in labels]
    kind = np.int32 if times.sum() < 2**31 else np.int64
    for low in range(0, len(at), step):
        rows = at[low : low + step]
        dx, dy = points[rows, 0][:, None] - points[:, 0], points[rows, 1][:, None] - points[:, 1]
        d = np.sqrt(dx * dx + dy * dy)
        d[np.arange(len(rows)), rows] = -1.0  # a place comes first in its own order
        order = np.argsort(d, axis=1)
        d = np.take_along_axis(d, order, axis=1)
        d[:, 0] = 0.0
        weight, every = times[order].astype(kind), np.arange(len(rows))

        def middle(inside: np.ndarray, low: np.ndarray, high: np.ndarray, d=d, weight=weight, every=every) -> np.ndarray:
            """The mean of the distances of two ranks (from 0) among the places ``inside``."""
            through = np.cumsum(weight * inside, axis=1, dtype=kind)
            return (d[every, (through > low).argmax(axis=1)] + d[every, (through > high).argmax(axis=1)]) / 2

        for j, own in enumerate(labels):
            size = sizes[j]
            names = np.flatnonzero(size)
            if len(names) < 2:
                continue
            near, mine = own[order], own[rows]
            others = size[mine, None] - 1  # the point itself is the first of its cluster
            good = others[:, 0] > 0
            a = middle(near == mine[:, None], (others - 1) // 2 + 1, others // 2 + 1)
            b = np.full(len(rows), np.inf)
            for c in names:
                b = np.where(mine != c, np.minimum(b, middle(near == c, (size[c] - 1) // 2, size[c] // 2)), b)
            most = np.maximum(a, b)
            score = np.where(most > 0, (b - a) / np.where(most > 0, most, 1.0), 0.0)
            sums[j] += (score * times[rows])[good].sum()
            counts[j] += times[rows][good].sum()
    return sums, counts


def best_mixture_labels(rows: DataFrame, counts: tuple[int, ...] = (4, 5, 6, 7), starts: int = 10, far: float = 0.8, seed: int = 0, block: int = 1024) -> DataFrame:
    """(grp, id, cluster) of the mixture of greatest silhouette, as :func:`best_mixture` finds it for a group.

    ``rows`` has grp, id, x, y and weight. Points at one place weigh as one. The quantile of distances
    is counted in blocks of pairs, each start is fitted in a task of its own, which holds a group's places,
    and silhouettes are summed by blocks of places that meet all of their group. Scores are compared at
    nine decimals; of equal ones the first start's counts.
    """
    kind = dict(rows.dtypes)["id"]
    spots = written(clusters_in.places(rows), "places")
    total = spots.groupBy("grp").agg(F.sum("times").alias("total"))
    framed = spots.join(clusters_in.frames(spots), "grp").join(total, "grp")
    # the quantile lies between two distances in order
    virtual = (F.col("total") * (F.col("total") - 1) / 2 - 1) * far
    twice = framed.withColumn("of", F.col("grp")).withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("grp", F.concat_ws("/", "of", "next"))
    twice = written(twice, "framed")
    found = clusters_in.distance_at(twice, F.least(F.floor(virtual) + F.element_at(F.split("grp", "/"), -1).cast("int"), F.col("total") * (F.col("total") - 1) / 2 - 1), block)
    ends = found.join(twice.select("grp", "of", "next").distinct(), "grp").groupBy(F.col("of").alias("grp")).agg(
        F.min(F.when(F.col("next") == 0, F.col("d"))).alias("a"), F.min(F.when(F.col("next") == 1, F.col("d"))).alias("b")
    )
    t = virtual - F.floor(virtual)
    between = F.when(t >= 0.5, F.col("b") - (F.col("b") - F.col("a")) * (1 - t)).otherwise(F.col("a") + (F.col("b") - F.col("a")) * t)
    limits = total.join(ends, "grp", "left").select("grp", F.coalesce(between, F.lit(0.0)).alias("limit"))

    def draw(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("id")
        xy = points[["x", "y"]].to_numpy(float)
        drawn = draw_starts(xy, float(points["limit"].iloc[0]), counts, starts, seed)
        return pd.DataFrame({
            "grp": pd.Series([points["grp"].iloc[0]] * len(drawn), dtype=object), "start": pd.Series(range(len(drawn)), dtype="int32"),
            "mx": pd.Series([xy[d, 0].tolist() for _, d in drawn], dtype=object), "my": pd.Series([xy[d, 1].tolist() for _, d in drawn], dtype=object),
        })

    begun = rows.select("grp", "id", "x", "y").join(limits, "grp").groupBy("grp").applyInPandas(draw, "grp string, start int, mx array<double>, my array<double>")
    begun = written(begun, "starts")  # a row for each start

    def fit(points: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if not len(start) or not len(points):
            return pd.DataFrame({"grp": pd.Series(dtype=object), "id": points["id"].iloc[:0], "start": pd.Series(dtype="int32"), "cluster": pd.Series(dtype="int8")})
        points = points.sort_values("id")
        means = np.column_stack([start["mx"].iloc[0], start["my"].iloc[0]])
        post = gaussian_mixture(points[["x", "y"]].to_numpy(float), points["weight"].to_numpy(float), means)["posterior"]
        return pd.DataFrame({"grp": points["grp"], "id": points["id"], "start": start["start"].iloc[0], "cluster": post.argmax(axis=1).astype("int8")})

    each = spots.join(begun.select("grp", F.col("start").alias("run")), "grp")
    fitted = each.groupBy("grp", "run").cogroup(begun.groupBy("grp", "start")).applyInPandas(fit, f"grp string, id {kind}, start int, cluster byte")
    named = fitted.groupBy("grp", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "cluster"))), lambda v: v["cluster"].cast("int")).alias("labels"))
    named = written(spots.join(named, ["grp", "id"]), "labels")
    blocks = named.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = named.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def by_first(own: np.ndarray) -> np.ndarray:
        """Labels numbered in the order in which they first occur."""
        _, first, at = np.unique(own, return_index=True, return_inverse=True)
        return first.argsort().argsort()[at]

    def judge(points: pd.DataFrame) -> pd.DataFrame:
        labels = np.array(points["labels"].tolist(), np.uint8).T
        # equal divisions, whatever their clusters' numbers, are judged once
        once, which = np.unique(np.array([by_first(own) for own in labels], np.uint8), axis=0, return_inverse=True)
        at = np.flatnonzero(points["own"].to_numpy() == points["q"].iloc[0])
        sums, n = median_silhouettes(points[["x", "y"]].to_numpy(float), points["times"].to_numpy(), once, at)
        which = which.ravel()
        return pd.DataFrame({"grp": points["grp"].iloc[0], "start": np.arange(len(labels), dtype=np.int32), "score": sums[which], "n": n[which]})

    slim = dealt.select("grp", "q", "own", "id", "x", "y", "times", "labels")
    scores = slim.groupBy("grp", "q").applyInPandas(lambda p: judge(p.sort_values("id")), "grp string, start int, score double, n double")
    scores = scores.groupBy("grp", "start").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
    mean = F.round(F.when(F.col("n") > 0, F.col("score") / F.col("n")).otherwise(0.0), 9)
    best = scores.groupBy("grp").agg(F.max(F.struct(mean.alias("s"), (-F.col("start")).alias("minus"))).alias("m")).select("grp", (-F.col("m.minus")).alias("best"))
    chosen = named.join(best, "grp").select("grp", "x", "y", F.get("labels", F.col("best")).alias("cluster"))
    return rows.select("grp", "id", "x", "y").join(chosen, ["grp", "x", "y"], "left").select("grp", "id", F.coalesce("cluster", F.lit(0)).cast("int").alias("cluster"))


def neighbour_sums(points: DataFrame, k: int = 10, by: str = "chrom", fill: int = clusters_in.FILL, block: int = clusters_in.BLOCK) -> DataFrame:
    """Per segment (chrom, start_pos) the sum of distances to its ``k`` nearest others in the same group.

    Neighbours are sought in growing cells, so that a segment meets the points around it only.
    """
    flat = written(_in_plane(points, by, 1.0, "chrom", "start_pos"), "plane")
    near = clusters_in.nearest(flat.select("grp", "id", "x", "y"), k, fill, block)
    named = flat.select("grp", "id", "chrom", "start_pos").join(near, ["grp", "id"])
    return named.select("chrom", "start_pos", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("near"))


def cluster_spread(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: size, mean and median distance to its centre, and entropy of its shares of weight."""
    rows = points.join(clusters.filter("cluster >= 0"), ["chrom", "start_pos"])
    centre = rows.groupBy("chrom", "cluster").agg(F.avg("coverage").alias("cx"), F.avg("maf").alias("cy"), F.sum("weight").alias("total"))
    joined = rows.join(centre, ["chrom", "cluster"])
    d = F.sqrt(F.pow(F.col("coverage") - F.col("cx"), 2) + F.pow(F.col("maf") - F.col("cy"), 2))
    share = F.col("weight") / F.col("total")
    return joined.groupBy("chrom", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_distance"), F.median(d).alias("median_distance"), (-F.sum(share * F.ln(share))).alias("entropy")
    )
