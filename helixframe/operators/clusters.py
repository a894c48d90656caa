"""Clusters of points in a plane, by group, without a matrix of distances.

Points (coverage against minor allele share, say) are dealt to square cells. A point meets those of
the three by three cells around it; what these cannot settle is asked again in cells twice as wide,
until the cells around hold the answer for certain or the whole group. Cells with many points are
dealt in blocks, so that a task holds two blocks whatever a group's size. Mixtures and mean shift are
rounds of grouped sums.

Points come as (grp, id, x, y) from :func:`plane`; ids are unique inside a group, and their order
breaks ties. Points at the same place weigh as one point of so many, so that densities cost work with
the square of a group's places, not of its points.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.functions.tables import written

#: Points that a cell has on average, and points of a block.
FILL, BLOCK = 1024, 1024
#: A Gaussian's weight beyond so many widths is left out: it is under 1e-15.
REACH = 6.0
#: Places that a range of distances is counted in at a time.
PLACES = 16384
#: What is nearer than this share of a width meets for certain, also where a cell's number is rounded.
SURE = 1 - 1e-9


def plane(points: DataFrame, by: Column, key: Column, x: Column, y: Column, *more: Column) -> DataFrame:
    """(grp, id, x, y) and ``more`` of the points that have both axes; ``by`` becomes text, ``key`` keeps its type."""
    rows = points.select(by.cast("string").alias("grp"), key.alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), *more)
    return rows.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")


def places(rows: DataFrame) -> DataFrame:
    """(grp, x, y, id, times): each place with its first point and how many there are, and the sum of their weights if they have any."""
    return rows.groupBy("grp", "x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), *[F.sum(c).alias(c) for c in rows.columns if c == "weight"])


def frames(rows: DataFrame, fill: int = FILL) -> DataFrame:
    """Per group: its corner x0, y0, the ``extent`` of its longer side, the first cells' ``width``, and n."""
    ends = rows.groupBy("grp").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")
    )
    a, b = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    width = F.greatest(F.sqrt(a * b * fill / F.col("n")), F.greatest(a, b) * fill / F.col("n"), F.lit(1e-12))
    return ends.select("grp", "x0", "y0", F.greatest(a, b).alias("extent"), width.alias("width"), "n")


def _cell(width: Column) -> list[Column]:
    return [F.floor((F.col(c) - F.col(f"{c}0")) / width).alias(f"c{c}") for c in "xy"]


def meet(asking: DataFrame, asked: DataFrame, width: Column, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``fn`` gives for blocks of ``asking`` and ``asked`` rows of a group that lie in the same or adjacent cells.

    Both have grp, id, x, y and the group's x0, y0; further columns go along. Each pair of rows that
    is less than ``width`` apart meets exactly once.
    """
    own = asked.select("*", *_cell(width))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = asking.select("*", *_cell(width)).withColumn("step", F.explode(near))
    around = around.withColumns({"cx": F.col("cx") + F.col("step.i"), "cy": F.col("cy") + F.col("step.j")}).drop("step")
    cell = ["grp", "cx", "cy"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = blocks(own, "rs").join(blocks(around, "qs"), cell)  # only cells that both have

    def dealt(rows: DataFrame, mine: str, other: str, count_mine: str, count_other: str) -> DataFrame:
        rows = rows.join(sizes, cell)
        return rows.withColumns({
            mine: F.pmod(F.xxhash64("id"), F.col(count_mine)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(count_other) - 1)),
        }).drop("rs", "qs")

    names = StructType.fromDDL(schema).names
    both = dealt(around, "q", "r", "qs", "rs").withColumn("asks", F.lit(True)).unionByName(
        dealt(own, "r", "q", "rs", "qs").withColumn("asks", F.lit(False)), allowMissingColumns=True
    )

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy(bool)
        a, b = rows[asks].reset_index(drop=True), rows[~asks].reset_index(drop=True)
        return fn(a, b) if len(a) and len(b) else pd.DataFrame({c: pd.Series(dtype=object) for c in names})

    return both.groupBy(*cell, "q", "r").applyInPandas(one, schema)


def _shared(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of one block are in the other."""
    ids = {i: k for k, i in enumerate(b["id"])}
    own = np.array([ids.get(i, -1) for i in a["id"]])
    return np.flatnonzero(own >= 0), own[own >= 0]


def _distances(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Distances of the rows of two blocks; a point's to itself is not a number."""
    dx = a["x"].to_numpy()[:, None] - b["x"].to_numpy()
    dy = a["y"].to_numpy()[:, None] - b["y"].to_numpy()
    d = np.sqrt(dx * dx + dy * dy)
    d[_shared(a, b)] = np.nan
    return d


# ---------------------------------------------------------------- nearest neighbours


def nearest(rows: DataFrame, k: int, fill: int = FILL, block: int = BLOCK) -> DataFrame:
    """(grp, id, v): the ``k`` least distances of each point to others of its group, in order; fewer in small groups."""
    kind = dict(rows.dtypes)["id"]
    framed = written(rows.join(frames(rows, fill), "grp"), "framed")
    left, done, width = framed, None, F.col("width")

    def least(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = _distances(a, b)
        d[np.isnan(d)] = np.inf
        near = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
        return pd.DataFrame({"grp": a["grp"], "id": a["id"], "v": [v[np.isfinite(v)].tolist() for v in near]})

    while True:
        parts = meet(left, framed, width, least, f"grp string, id {kind}, v array<double>", block)
        found = parts.groupBy("grp", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("v"))), 1, k).alias("v"))
        joined = left.join(found, ["grp", "id"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<double>")))
        whole = width > F.col("extent")
        settled = written(joined.withColumn("sure", whole | ((F.size("v") == k) & (F.element_at("v", -1) <= width * SURE))), "nearest")
        sure = settled.filter("sure").select("grp", "id", "v")
        done = sure if done is None else done.unionByName(sure)
        left = settled.filter("not sure").drop("v", "sure")
        if left.isEmpty():
            return done
        width = width * 2


# ---------------------------------------------------------------- density peaks


def distance_at(framed: DataFrame, index: Column, block: int = BLOCK) -> DataFrame:
    """(grp, d): the distance of an ``index`` from 0 among a group's sorted pairs.

    Pairs closer than a width are counted, in ``PLACES`` places; the width doubles for groups in
    which there are too few. The place that holds the index is then counted in finer places, until
    all distances in it are equal. Pairs are never listed. ``framed`` has places; the pairs are those
    of their points, ``total`` in a group. ``index`` is an expression of a group's columns.
    """
    state = framed.filter("total > 1").select("grp", "width", index.cast("long").alias("index")).distinct().withColumns({"low": F.lit(0.0), "high": F.col("width") * SURE})
    state, done, waiting = written(state, "distance-ranges"), None, None

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        low, high, first = a["low"].iloc[0], a["high"].iloc[0], a["first"].iloc[0]
        d, own = _distances(a, b), _shared(a, b)
        weight = a["times"].to_numpy()[:, None] * b["times"].to_numpy().astype(float)
        d[own], weight[own] = 0.0, weight[own] - a["times"].to_numpy()[own[0]]  # of the points at a place
        inside = (d >= low) & ((d < high) if first else (d <= high)) & (weight > 0)  # a first range is half open
        d, weight = d[inside], weight[inside]
        place = np.minimum((d - low) / max(high - low, 1e-300) * PLACES, PLACES - 1).astype(np.int64)
        found = np.bincount(place, weight, PLACES)  # whole numbers under 2 ** 53
        least, most = np.full(PLACES, np.inf), np.full(PLACES, -np.inf)
        np.minimum.at(least, place, d)
        np.maximum.at(most, place, d)
        at = np.flatnonzero(found)
        return pd.DataFrame({
            "grp": pd.Series([a["grp"].iloc[0]] * len(at), dtype=object), "place": at, "pairs": found[at].astype(np.int64), "least": least[at], "most": most[at],
        })

    first = True
    while True:
        rows = framed.select("grp", "id", "x", "y", "times", "x0", "y0").join(state.withColumn("first", F.lit(first)), "grp")
        counted = meet(rows, rows, F.col("width"), count, "grp string, place long, pairs long, least double, most double", block)
        places = counted.groupBy("grp", "place").agg((F.sum("pairs") / 2).cast("long").alias("pairs"), F.min("least").alias("least"), F.max("most").alias("most"))
        listed = places.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("place", "pairs", "least", "most"))).alias("places"))  # PLACES at most
        zero = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
        step = F.aggregate("places", zero, lambda s, p: F.when(s["low"].isNotNull(), s).otherwise(F.when(
            s["before"] + p["pairs"] > F.col("index"), F.struct(s["before"].alias("before"), p["least"].alias("low"), p["most"].alias("high"))
        ).otherwise(F.struct((s["before"] + p["pairs"]).alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))))
        moved = written(state.join(listed, "grp", "left").withColumn("s", F.coalesce(step, zero)).select("grp", "width", "index", "s"), "distance-ranges")
        found = moved.filter("s.low = s.high").select("grp", F.col("s.low").alias("d"))
        done = found if done is None else done.unionByName(found)
        closer = moved.filter("s.low < s.high").select("grp", "width", (F.col("index") - F.col("s.before")).alias("index"), F.col("s.low").alias("low"), F.col("s.high").alias("high"))
        if first:
            # groups with enough pairs wait until all have them
            waiting = closer if waiting is None else waiting.unionByName(closer)
            wider = moved.filter("s.low is null").select("grp", (F.col("width") * 2).alias("width"), "index")
            state = wider.withColumns({"low": F.lit(0.0), "high": F.col("width") * SURE})
            if state.isEmpty():
                first, state = False, waiting
        else:
            state = closer
        if state.isEmpty():
            return done


def density(rows: DataFrame, share: float = 0.02, fill: int = FILL, block: int = BLOCK) -> DataFrame:
    """(grp, id, x, y, rho, delta, parent, times): local density, and the nearest denser point.

    rho sums exp(-(d / dc)^2) over a group's other points within ``REACH`` dc, dc being the ``share``
    quantile of its distances; it is rounded to nine decimals, and ties rank by id. The densest point
    has no parent and the greatest of its distances as delta. Groups of one point are left out.

    Of the points at a place only the first, whose ``times`` is their number, is sought a parent for;
    it is the parent of the others, which have a ``times`` of 0.
    """
    kind = dict(rows.dtypes)["id"]
    spots = written(places(rows), "places")
    total = spots.groupBy("grp").agg(F.sum("times").alias("total"))
    framed = written(spots.join(frames(spots, fill), "grp").join(total, "grp"), "framed")
    pairs = F.col("total") * (F.col("total") - 1) / 2
    index = F.least(F.floor(pairs * share), pairs - 1)
    scales = distance_at(framed, index, block).select("grp", F.greatest("d", F.lit(1e-12)).alias("dc"))
    scaled = framed.join(scales, "grp")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = _distances(a, b) / a["dc"].iloc[0]
        d[d > REACH] = np.nan
        return pd.DataFrame({"grp": a["grp"], "id": a["id"], "rho": np.nansum(np.exp(-(d * d)) * b["times"].to_numpy(), axis=1)})

    parts = meet(scaled, scaled, F.col("dc") * REACH / SURE, sums, f"grp string, id {kind}, rho double", block)
    rho = parts.groupBy("grp", "id").agg(F.sum("rho").alias("rho"))
    ranked = written(framed.join(rho, ["grp", "id"]).withColumn("rho", F.round(F.col("rho") + F.col("times") - 1, 9)), "density")
    # what counts as denser: a greater rho, or the same and an id before
    left, done, width = ranked, None, F.col("width")

    def denser(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = _distances(a, b)
        ra, rb = a["rho"].to_numpy()[:, None], b["rho"].to_numpy()
        ia, ib = a["id"].tolist(), b["id"].tolist()
        order = {i: k for k, i in enumerate(sorted(set(ia) | set(ib)))}
        na, nb = np.array([order[i] for i in ia])[:, None], np.array([order[i] for i in ib])
        d[~((rb > ra) | ((rb == ra) & (nb < na)))] = np.inf
        d[np.isnan(d)] = np.inf
        # of equally near points the densest, then the first
        turn = np.lexsort((nb, -rb))
        at = turn[np.argmin(d[:, turn], axis=1)]
        least = d[np.arange(len(a)), at]
        good = np.isfinite(least)
        return pd.DataFrame({"grp": a["grp"][good], "id": a["id"][good], "d": least[good], "rho": b["rho"].to_numpy()[at[good]], "parent": b["id"].to_numpy()[at[good]]})

    schema = f"grp string, id {kind}, d double, rho double, parent {kind}"
    while True:
        parts = meet(left, ranked, width, denser, schema, block)
        found = parts.groupBy("grp", "id").agg(F.min(F.struct("d", (-F.col("rho")).alias("r"), "parent")).alias("near"))
        joined = left.join(found, ["grp", "id"], "left")
        settled = written(joined.withColumn("sure", (width > F.col("extent")) | F.coalesce(F.col("near.d") <= width * SURE, F.lit(False))), "denser")
        sure = settled.filter("sure").drop("sure")
        done = sure if done is None else done.unionByName(sure)
        left = settled.filter("not sure").drop("near", "sure")
        if left.isEmpty():
            break
        width = width * 2
    tops = done.filter("near is null").select("grp", F.col("x").alias("tx"), F.col("y").alias("ty"))  # one for each group
    far = spots.join(tops, "grp").groupBy("grp").agg(F.max(F.sqrt((F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty")))).alias("far"))
    heads = done.join(far, "grp").select("grp", "x", "y", F.col("id").alias("head"), "rho", F.coalesce("near.d", "far").alias("delta"), "near.parent", "times")
    alone = F.col("id") == F.col("head")
    return written(rows.join(heads, ["grp", "x", "y"]).select(
        "grp", "id", "x", "y", "rho", F.when(alone, F.col("delta")).otherwise(0.0).alias("delta"),
        F.when(alone, F.col("parent")).otherwise(F.col("head")).alias("parent"), F.when(alone, F.col("times")).otherwise(0).alias("times"),
    ), "peaks")


def peak_labels(peaks: DataFrame, least_density: float, distance: Column) -> DataFrame:
    """(grp, id, cluster): centres have more than ``least_density`` and a delta over ``distance``; others follow their parents.

    Clusters are numbered by falling density of their centres; points that lead to no centre are -1.
    Parents are followed by jumping, so that rounds grow with the logarithm of the longest way; points
    at the place of another have its cluster.
    """
    centre = (F.col("rho") > least_density) & (F.col("delta") > distance)
    marked = peaks.filter("times > 0").withColumn("centre", centre)
    centres = marked.filter("centre").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct((-F.col("rho")).alias("r"), "id"))).alias("c"))  # a group's clusters
    numbers = centres.select("grp", F.posexplode("c").alias("cluster", "c")).select("grp", F.col("c.id").alias("to"), "cluster")
    ways = written(marked.select("grp", "id", F.when(F.col("centre"), F.col("id")).otherwise(F.col("parent")).alias("to")), "ways")
    while True:
        ahead = ways.select("grp", F.col("id").alias("to"), F.col("to").alias("then"))
        jumped = ways.join(ahead, ["grp", "to"], "left").select("grp", "id", "to", "then")
        jumped = written(jumped.select("grp", "id", F.col("to").alias("was"), F.when(F.col("to").isNotNull(), F.col("then")).alias("to")), "ways")
        moving = jumped.filter("not (was <=> to)").isEmpty()
        ways = jumped.drop("was")
        if moving:
            break
    found = ways.join(numbers, ["grp", "to"], "left").select("grp", F.col("id").alias("head"), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
    head = F.when(F.col("times") > 0, F.col("id")).otherwise(F.col("parent"))
    return peaks.select("grp", "id", head.alias("head")).join(found, ["grp", "head"]).select("grp", "id", "cluster")


def chosen_distance(peaks: DataFrame, least_density: float = 2.0, low: float = 0.01, high: float = 0.5, steps: int = 20, default: float = 0.1, most: int = 7) -> DataFrame:
    """(grp, distance): the cut-off whose number of clusters most of the swept cut-offs give, the greatest such.

    Where two or three numbers of clusters tie, it is the second that occurs from above if under
    ``most``, else the first; where more tie, ``default``.
    """
    cutoffs = [low + k * (high - low) / steps for k in range(steps)][::-1]
    dense = F.col("rho") > least_density
    counts = peaks.groupBy("grp").agg(F.array(*[F.count(F.when(dense & (F.col("delta") > c), 1)) for c in cutoffs]).alias("sizes"))

    def choose(sizes: pd.Series) -> pd.Series:
        out = []
        for row in sizes:
            row = [int(v) for v in row]
            times = {v: row.count(v) for v in dict.fromkeys(row)}
            modes = [v for v, t in times.items() if t == max(times.values())]
            if len(modes) > 3:
                out.append(default)
            else:
                out.append(cutoffs[row.index(modes[1] if len(modes) > 1 and modes[1] < most else modes[0])])
        return pd.Series(out, dtype="float64")

    return counts.select("grp", F.pandas_udf(choose, "double")("sizes").alias("distance"))


def recluster(peaks: DataFrame, labels: DataFrame, least_density: float = 2.0, share: float = 0.02, spread: float = 0.015, largest: float = 0.9, few: int = 4, fill: int = FILL, block: int = BLOCK, rounds: int = 10) -> DataFrame:
    """Labels in which clusters of wide spread are clustered again by themselves.

    A cluster's spread is the mean squared distance to its centroid. In a group of fewer than ``few``
    clusters whose spreads have a standard deviation over ``spread``, each cluster of at least their
    mean and of under ``largest`` of the points is clustered again by densities of its own points, with
    the root of its spread as the cut-off of distance. Its first part keeps the number, others follow the
    group's last cluster. This goes on with the new clusters, for ``rounds`` at most.
    """
    done, current = labels.filter("cluster < 0"), peaks.select("grp", "id", "x", "y").join(labels.filter("cluster >= 0"), ["grp", "id"])
    current = written(current, "clusters")
    for _ in range(rounds):
        centres = current.groupBy("grp", "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
        sizes = current.join(centres, ["grp", "cluster"]).groupBy("grp", "cluster").agg(F.avg(d2).alias("v"), F.count(F.lit(1)).alias("n"))
        overall = sizes.groupBy("grp").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("clusters"))
        wide = sizes.join(overall, "grp").filter((F.col("v") >= F.col("mean")) & (F.col("sd") > spread) & (F.col("n") < largest * F.col("total")) & (F.col("clusters") < few))
        wide = written(wide.select("grp", "cluster", F.sqrt("v").alias("distance")), "wide")
        if wide.isEmpty():
            break
        inside = wide.withColumn("inner", F.concat_ws("/", "grp", "cluster"))
        parts = current.join(inside, ["grp", "cluster"]).select(F.col("inner").alias("grp"), "id", "x", "y")
        inner = density(parts, share, fill, block).join(inside.select(F.col("inner").alias("grp"), "distance"), "grp")
        again = peak_labels(inner, least_density, F.col("distance")).withColumnsRenamed({"grp": "inner", "cluster": "part"}).join(inside, "inner")
        # parts of one cluster: the first keeps the number, others follow the group's last one
        counts = again.filter("part >= 0").select("grp", "cluster", "part").distinct()
        if counts.filter("part > 0").isEmpty():
            break
        order = F.array_sort(F.collect_list(F.when(F.col("part") > 0, F.struct("cluster", "part"))))
        last = current.groupBy("grp").agg(F.max("cluster").alias("last"))
        new = counts.groupBy("grp").agg(order.alias("o")).join(last, "grp").select("grp", "last", F.posexplode("o").alias("k", "o"))
        new = new.select("grp", F.col("o.cluster").alias("cluster"), F.col("o.part").alias("part"), (F.col("last") + 1 + F.col("k")).alias("number"))
        moved = again.join(new, ["grp", "cluster", "part"], "left").select("grp", "id", F.coalesce("number", "cluster").cast("int").alias("fresh"))
        current = current.join(moved, ["grp", "id"], "left").select("grp", "id", "x", "y", F.coalesce("fresh", "cluster").alias("cluster"))
        current = written(current, "clusters")
    return done.select("grp", "id", "cluster").unionByName(current.select("grp", "id", "cluster"))


# ---------------------------------------------------------------- mixtures and mean shift


def mixture(rows: DataFrame, clusters: int = 4, rounds: int = 30, tolerance: float = 2.5e-5, start: float = 0.01, chained: int = 3) -> DataFrame:
    """(grp, id, cluster) of a weighted mixture of axis-aligned Gaussians, by grouped sums.

    ``rows`` has a weight too. Means start at the (i + 1/2) / clusters quantiles of each axis, in a
    group of fewer points at as many of them as there are points. A round is one aggregation: sums of
    posteriors (those under 0.01 left out) by group. Means of components lighter than 0.01 stay,
    variances keep above 1e-7, and a group whose mean log likelihood moves by under ``tolerance`` stands
    still. ``chained`` rounds go into one job.
    """
    ks = range(clusters)
    at = [(i + 0.5) / clusters for i in ks]
    begin = rows.groupBy("grp").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("mx"), F.percentile("y", F.array(*map(F.lit, at))).alias("my"), F.count(F.lit(1)).alias("n"))
    k0 = F.least(F.col("n"), F.lit(clusters))
    state = begin.select(
        "grp", F.array(*[F.when(F.lit(i) < k0, 1 / k0).otherwise(0.0) for i in ks]).alias("share"), "mx", "my",
        *[F.array(*[F.lit(start)] * clusters).alias(c) for c in ("vx", "vy")], F.lit(float("-inf")).alias("last"), F.lit(False).alias("done"),
    )

    def log_density(i: int) -> str:
        return (
            f"-0.5 * ((x - mx[{i}]) * (x - mx[{i}]) / vx[{i}] + (y - my[{i}]) * (y - my[{i}]) / vy[{i}]) - 0.5 * (ln(vx[{i}]) + ln(vy[{i}]))"
            f" - {math.log(2 * math.pi)!r}D + ln(greatest(share[{i}], 1e-300D))"
        )

    def scored(state: DataFrame) -> DataFrame:
        """Rows with the log densities of the components and their sum."""
        logs = rows.join(state, "grp").withColumn("l", F.expr(f"array({', '.join(map(log_density, ks))})"))
        return logs.withColumn("norm", F.expr("array_max(l) + ln(aggregate(l, 0D, (s, v) -> s + exp(v - array_max(l))))"))

    names = ["share", "mx", "my", "vx", "vy"]
    used = [f"CASE WHEN exp(l[{i}] - norm) < 0.01 THEN 0D ELSE exp(l[{i}] - norm) END * weight" for i in ks]
    sums = [f"sum({used[i]} * {value}) AS {name}{i}" for i in ks for name, value in (("u", "1D"), ("ux", "x"), ("uy", "y"), ("uxx", "x * x"), ("uyy", "y * y"))]

    def mean(axis: str, i: int) -> str:
        return f"CASE WHEN u{i} > 0 AND u{i} / w >= 0.01 THEN u{axis}{i} / u{i} ELSE old.m{axis}[{i}] END"

    def variance(axis: str, i: int) -> str:
        """Squares about the mean from sums of squares."""
        return f"CASE WHEN u{i} > 0 THEN greatest((u{axis}{axis}{i} - 2 * m{axis}[{i}] * u{axis}{i} + m{axis}[{i}] * m{axis}[{i}] * u{i}) / u{i}, 1e-7D) ELSE old.v{axis}[{i}] END"

    means = ["*", f"array({', '.join(f'u{i} / w' for i in ks)}) AS share", *[f"array({', '.join(mean(a, i) for i in ks)}) AS m{a}" for a in "xy"]]
    spreads = ["*", *[f"array({', '.join(variance(a, i) for i in ks)}) AS v{a}" for a in "xy"]]
    # a group that stands still keeps all; posteriors are those from before the last step, as of a loop that ends on its fit
    kept = [
        "grp", *[f"IF(old.done, old.{c}, {c}) AS {c}" for c in names], "IF(old.done, old.last, fit) AS last",
        f"old.done OR abs(fit - old.last) < {tolerance!r}D AS done", f"IF(old.done, old.prior, struct({', '.join(f'old.{c} AS {c}' for c in names)})) AS prior",
    ]

    def moved(state: DataFrame) -> DataFrame:
        got = scored(state).groupBy("grp").agg(*map(F.expr, [
            "sum(weight) AS w", "sum(norm * weight) / sum(weight) AS fit", f"any_value(struct({', '.join(names)}, last, done, prior)) AS old", *sums
        ]))
        return got.selectExpr(*means).selectExpr(*spreads).selectExpr(*kept)

    state = state.withColumn("prior", F.struct(*names))
    for k in range(rounds):
        if k and k % chained == 0:
            state = written(state, "mixture")
            if state.filter("not done").isEmpty():
                break
        state = moved(state)
    final = written(state, "mixture").select("grp", "prior.*")
    logs = F.col("l")
    return scored(final).select("grp", "id", (F.array_position(logs, F.array_max(logs)) - 1).cast("int").alias("cluster"))


def mean_shift_labels(rows: DataFrame, bandwidth: float, rounds: int = 300, chained: int = 4) -> DataFrame:
    """(grp, id, cluster) by mean shift with a Gaussian kernel cut at three bandwidths.

    Seeds are the corners of a group's occupied cells of two bandwidths. A round moves each seed to
    the weighted mean of the points around it: seeds are joined with the points of adjacent cells,
    and partial sums are grouped by seed. Ends within one bandwidth of an earlier one, in order of the
    axes, are one mode; a point belongs to its nearest mode.
    """
    cell, reach = 2 * bandwidth, 3 * bandwidth

    def toward_zero(c: str) -> Column:
        q = F.col(c) / cell
        return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("double") * cell

    seeds = rows.select("grp", toward_zero("x").alias("sx"), toward_zero("y").alias("sy")).distinct()
    state = seeds.select("grp", F.struct("sx", "sy").alias("seed"), "sx", "sy", F.lit(False).alias("done"))
    keyed = rows.select("grp", "x", "y", F.floor(F.col("x") / reach).alias("cx"), F.floor(F.col("y") / reach).alias("cy"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def moved(state: DataFrame) -> DataFrame:
        # a seed that stands still keeps one row and is not moved
        around = state.withColumn("step", F.explode(F.when(F.col("done"), F.slice(near, 1, 1)).otherwise(near))).select(
            "grp", "seed", "sx", "sy", "done", (F.floor(F.col("sx") / reach) + F.col("step.i")).alias("cx"), (F.floor(F.col("sy") / reach) + F.col("step.j")).alias("cy")
        )
        dx, dy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
        d2 = dx * dx + dy * dy
        w = F.when(~F.col("done") & (d2 <= reach**2), F.exp(-0.5 * d2 / bandwidth**2))
        pairs = around.join(keyed, ["grp", "cx", "cy"], "left")
        sums = pairs.groupBy("grp", "seed").agg(
            F.any_value("sx").alias("sx"), F.any_value("sy").alias("sy"), F.any_value("done").alias("done"),
            F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy"),
        )
        nx, ny = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
        went = F.col("w").isNotNull()
        step = F.sqrt((nx - F.col("sx")) * (nx - F.col("sx")) + (ny - F.col("sy")) * (ny - F.col("sy")))
        return sums.select(
            "grp", "seed", F.when(went, nx).otherwise(F.col("sx")).alias("sx"), F.when(went, ny).otherwise(F.col("sy")).alias("sy"),
            (~went | (step < 1e-3 * bandwidth)).alias("done"),
        )

    for k in range(rounds):
        if k % chained == 0:
            state = written(state, "seeds")
            if state.filter("not done").isEmpty():
                break
        state = moved(state)

    def modes(ends: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[float, float]] = []
        for x, y in sorted(zip(ends["sx"], ends["sy"], strict=True)):
            if all((x - a) ** 2 + (y - b) ** 2 > bandwidth**2 for a, b in found):
                found.append((x, y))
        return pd.DataFrame({"grp": pd.Series([ends["grp"].iloc[0]] * len(found), dtype=object), "k": range(len(found)), "mx": [a for a, _ in found], "my": [b for _, b in found]})

    # a group's ends are at most as many as its occupied cells
    centres = state.groupBy("grp").applyInPandas(modes, "grp string, k int, mx double, my double")
    listed = written(centres.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "mx", "my"))).alias("modes")), "modes")

    def distance(m: Column) -> Column:
        return (F.col("x") - m["mx"]) * (F.col("x") - m["mx"]) + (F.col("y") - m["my"]) * (F.col("y") - m["my"])

    best = F.array_min(F.transform("modes", lambda m: F.struct(distance(m).alias("d"), m["k"].alias("k"))))
    return rows.join(listed, "grp").select("grp", "id", best["k"].alias("cluster"))
