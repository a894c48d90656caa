"""Steps of the tumour model: distances of models, refinement, a test against the reference, posterior calls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _length() -> Column:
    return F.col("end_pos") - F.col("start_pos")


def diploid_distance(calls: DataFrame, genome: float, highest: int = 10, amplified: float = 0.8) -> DataFrame:
    """One row: baseline, events and distance of a model from the diploid state.

    ``calls`` has start_pos, end_pos, cn. Events are copies off the baseline times length over ``genome``.
    The baseline is 2; where states of 3 to under ``highest`` copies hold over ``amplified`` of the called
    bases it is 4, which is an event of its own. The distance is 1 over the events, at most 1000.
    """
    def off(base: int) -> Column:
        return F.sum(F.abs(F.col("cn") - base) * _length())

    share = F.sum(F.when((F.col("cn") >= 3) & (F.col("cn") < highest), _length()).otherwise(0)) / F.sum(_length())
    sums = calls.agg(share.alias("share"), off(2).alias("two"), off(4).alias("four"))
    up = F.coalesce(F.col("share") > amplified, F.lit(False))
    events = F.when(up, 1 + F.col("four") / genome).otherwise(F.coalesce("two", F.lit(0)) / genome)
    out = sums.select(F.when(up, 4).otherwise(2).alias("baseline"), events.alias("events"))
    return out.withColumn("distance", 1 / F.greatest(F.lit(0.001), F.col("events")))


def model_distances(calls: DataFrame, genome: float, key: list[str]) -> DataFrame:
    """(model, other, distance) of two models each: the copies by which they differ, times length over ``genome``.

    ``calls`` has model, start_pos, end_pos, cn and ``key``, one row for each model and segment.
    """
    other = calls.select(*key, F.col("model").alias("other"), F.col("cn").alias("cn2"))
    pairs = calls.join(other, key).filter(F.col("model") < F.col("other"))
    return pairs.groupBy("model", "other").agg((F.sum(F.abs(F.col("cn") - F.col("cn2")) * _length()) / genome).alias("distance"))


def refine_even_maf(segments: DataFrame, points: DataFrame, key: list[str], weighting: float, prior: float = 1e7, least: float = 0.4) -> DataFrame:
    """``points`` (cn, mcc, coverage, maf; some dozens) with the maf of balanced states fitted to the segments.

    Each segment (coverage, maf, weight) goes to its nearest point, ties to fewer copies; those of a
    balanced point and of a maf of ``least`` or more move its maf, whose first value weighs ``prior``.
    """
    known = segments.filter("maf is not null and coverage is not null").select(*key, F.col("coverage").alias("c"), F.col("maf").alias("f"), "weight")
    pairs = known.crossJoin(F.broadcast(points.select("cn", "mcc", "coverage", "maf")))  # some dozens of points
    d = F.round(F.pow((F.col("c") - F.col("coverage")) * weighting, 2) + F.pow(F.col("f") - F.col("maf"), 2), 12)
    near = pairs.groupBy(*key).agg(F.min(F.struct(d.alias("d"), "cn", "mcc", "f", "weight")).alias("t")).select("t.*")
    even = F.col("mcc") * 2 == F.col("cn")
    moved = near.filter(even & (F.col("f") >= least)).groupBy("cn", "mcc").agg(F.sum(F.col("weight") * F.col("f")).alias("s"), F.sum("weight").alias("w"))
    fitted = (prior * F.col("maf") + F.coalesce("s", F.lit(0.0))) / (prior + F.coalesce("w", F.lit(0.0)))
    return points.join(moved, ["cn", "mcc"], "left").withColumn("maf", F.when(even, fitted).otherwise(F.col("maf"))).select(points.columns)


def clearly_altered(
    segments: DataFrame, windows: DataFrame, key: list[str], level: float, level_maf: float,
    least: int = 400_000, alone: float = 12.0, together: float = 5.0, bases: int = 50_000_000,
) -> DataFrame:
    """One row: whether a sample is clearly not all at its reference ploidy, with what that rests on.

    ``segments`` and ``windows`` (pieces of segments) have ``key``, start_pos, end_pos, coverage, maf and
    ref, any of the last two null; segments have a weight. Ref 0 and lengths under ``least`` do not
    count. The scale is the median relative deviation of windows from their segment. A segment is off
    where its deviation from ``level`` (of two copies) or, at ref 2, from ``level_maf`` exceeds ``alone``
    times the scale, or both exceed ``together`` times; the sample is where such segments weigh ``bases``.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.filter((F.coalesce("ref", F.lit(2)) != 0) & (_length() >= least))

    own = segments.select(*key, F.col("coverage").alias("c"), F.col("maf").alias("f"))
    near = counted(windows).join(own, key)
    scale = near.agg(
        F.median(F.when(F.col("c") != 0, F.abs(F.col("coverage") - F.col("c")) / F.col("c"))).alias("coverage_scale"),
        F.median(F.when(F.col("f") != 0, F.abs(F.col("maf") - F.col("f")) / F.col("f"))).alias("maf_scale"),
    )
    expected = level * F.coalesce("ref", F.lit(2)) / 2
    rows = counted(segments).crossJoin(F.broadcast(scale))  # one row
    z = F.abs(F.col("coverage") - expected) / expected
    y = F.when(F.col("ref") == 2, F.abs(F.col("maf") - level_maf) / level_maf)
    z, y = F.coalesce(z, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
    a, b = F.coalesce("coverage_scale", F.lit(math.inf)), F.coalesce("maf_scale", F.lit(math.inf))
    off = (z > alone * a) | (y > alone * b) | ((z > together * a) & (y > together * b))
    weighed = rows.agg(F.coalesce(F.sum(F.when(off, F.col("weight"))), F.lit(0.0)).alias("weight_off"))
    return scale.crossJoin(F.broadcast(weighed)).withColumn("altered", F.col("weight_off") >= bases)  # one row each


def posterior_calls(segments: DataFrame, components: DataFrame, key: list[str], diploid: float) -> DataFrame:
    """(key, cn, mcc, posterior) by the component of the greatest posterior, or by coverage where all vanish.

    ``components`` (some dozens) has cn, mcc, omega, the means maf and coverage, and v_maf, v_both, v_cov of
    their covariance. A missing maf counts as -1, which no component bears. Ties go to fewer copies.
    """
    rows = segments.select(*key, F.col("coverage").alias("c"), F.coalesce("maf", F.lit(-1.0)).alias("f"))
    pairs = rows.crossJoin(F.broadcast(components))  # some dozens
    x, y = F.col("f") - F.col("maf"), F.col("c") - F.col("coverage")
    det = F.col("v_maf") * F.col("v_cov") - F.col("v_both") * F.col("v_both")
    form = (F.col("v_cov") * x * x - 2 * F.col("v_both") * x * y + F.col("v_maf") * y * y) / det
    density = F.col("omega") * F.exp(-form / 2) / (2 * math.pi * F.sqrt(det))
    scored = pairs.withColumn("p", density)
    whole = F.sum("p").over(Window.partitionBy(*key))
    best = scored.withColumn("posterior", F.when(whole > 0, F.col("p") / whole).otherwise(0.0)).groupBy(*key).agg(
        F.min(F.struct((-F.round("posterior", 9)).alias("p"), "cn", "mcc", "c", "posterior")).alias("t")
    )
    plain = F.bround(2 * F.col("t.c") / diploid, 0).cast("int")
    found = F.col("t.p") < 0
    return best.select(
        *key, F.when(found, F.col("t.cn")).otherwise(plain).alias("cn"),
        F.when(found, F.col("t.mcc")).otherwise(F.floor(plain / 2).cast("int")).alias("mcc"), F.col("t.posterior").alias("posterior"),
    )
