"""Exact statistics as aggregates and windows: medians, deviations, quartiles, weighted quantiles."""

from __future__ import annotations

from collections.abc import Callable

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def middle(values: Column) -> Column:
    """Median of a sorted array: for an even number the mean of the two middle values."""
    n = F.size(values)
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return F.when(n > 0, (at(values, low) + at(values, high)) / 2)


def running_median(df: DataFrame, value: str, half: int, by: list[str], order: str, name: str) -> DataFrame:
    """Median of the rows from ``half`` before to ``half`` after, fewer at the ends."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return df.withColumn(name, middle(F.sort_array(F.collect_list(value).over(frame))))


def repeated_median(df: DataFrame, value: str, most: int, by: list[str], order: str) -> DataFrame:
    """Running medians of half width 1, 2 .. ``most``, one after the other; 0 changes nothing."""
    for half in range(1, most + 1):
        df = running_median(df, value, half, by, order, value)
    return df


def running_mean(df: DataFrame, value: str, by: list[str], order: str, name: str) -> DataFrame:
    """Mean of each row and its two neighbours; the rows at the ends stay as they are."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    inner = before.isNotNull() & after.isNotNull()
    return df.withColumn(name, F.when(inner, (before + F.col(value) + after) / 3).otherwise(F.col(value)))


def differences(df: DataFrame, value: str, by: list[str], order: str, lag: int = 1, name: str = "diff") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.col(value) - F.lag(value, lag).over(w))


def cumulative(df: DataFrame, value: str, by: list[str], order: str, name: str = "total") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def median_deviation(df: DataFrame, value: str, by: list[str], scale: float = 1.0) -> DataFrame:
    """Per group: median and the median absolute deviation from it, times ``scale``.

    1.4826 makes the deviation estimate a normal standard deviation.
    """
    middle_of = df.groupBy(*by).agg(F.median(value).alias("median"))
    joined = df.select(*by, value).join(middle_of, by)
    return joined.groupBy(*by).agg(
        F.first("median").alias("median"), (F.median(F.abs(F.col(value) - F.col("median"))) * scale).alias("mad")
    )


def quartiles_of(values: Column) -> Column:
    """struct(q1, q2, q3) of a sorted array.

    An even number is halved and each half's median taken; 4n+1 and 4n+3 values weigh neighbouring
    ranks by one and three quarters. One value is all three quartiles.
    """
    n = F.size(values)
    half = F.floor(n / 2)
    k = F.floor(n / 4)
    low_even = middle(F.slice(values, F.lit(1), F.greatest(half, F.lit(1)).cast("int")))
    high_even = middle(F.slice(values, (half + 1).cast("int"), F.greatest(half, F.lit(1)).cast("int")))
    low_one = at(values, k - 1) * 0.25 + at(values, k) * 0.75
    high_one = at(values, 3 * k) * 0.75 + at(values, 3 * k + 1) * 0.25
    low_three = at(values, k) * 0.75 + at(values, k + 1) * 0.25
    high_three = at(values, 3 * k + 1) * 0.25 + at(values, 3 * k + 2) * 0.75
    one = at(values, F.lit(0))
    q1 = F.when(n == 1, one).when(n % 2 == 0, low_even).when(n % 4 == 1, low_one).otherwise(low_three)
    q3 = F.when(n == 1, one).when(n % 2 == 0, high_even).when(n % 4 == 1, high_one).otherwise(high_three)
    return F.when(n > 0, F.struct(q1.alias("q1"), middle(values).alias("q2"), q3.alias("q3")))


def running(rows: DataFrame, by: list[str], value: str, weight: Column) -> DataFrame:
    """(by, value, weight, upto, whole) of the distinct values: the running weight in the order of values, and each group's.

    Rows are summed by value first. Values are then dealt by range, so that a window holds one range
    of them, and a scan of one row for each range gives what the ranges before it weigh.
    """
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(by)]
    keys = [f"__k{i}" for i in range(len(by))]
    slim = rows.groupBy(*names, F.col(value).alias("__v")).agg(F.sum(weight).alias("weight"))
    placed = written(slim.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()), "ranges")
    through = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*[F.col(k).alias(f"{k}p") for k in keys], F.col("__part").alias("__at")).agg(F.sum("weight").alias("__sum"))
    over = Window.partitionBy(*[f"{k}p" for k in keys])
    parts = parts.select(
        *[f"{k}p" for k in keys], "__at", F.sum("__sum").over(over.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.sum("__sum").over(over).alias("whole")
    )
    match = F.col("__part") == F.col("__at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}p"))
    joined = placed.withColumn("__upto", F.sum("weight").over(through)).join(parts, match)
    upto = F.col("__upto") + F.coalesce("__before", F.lit(0))
    return joined.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], F.col("__v").alias(value), "weight", upto.alias("upto"), "whole")


def at_ranks(df: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group its size n and, for each name, the value at a rank (from 0) that is a function of n; nulls do not count."""
    counted = running(df.filter(F.col(value).isNotNull()), by, value, F.lit(1))
    n = F.col("whole")
    found = [F.max(F.when((F.col("upto") - F.col("weight") <= rank(n)) & (rank(n) < F.col("upto")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return counted.groupBy(*by).agg(F.first("whole").alias("n"), *found)


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group q1, q2 and q3, by the rules of :func:`quartiles_of`, from values at ranks that no task holds all of."""
    half, quarter = (lambda n: F.floor(n / 2)), (lambda n: F.floor(n / 4))

    def rank(even: Callable, one: Callable, three: Callable) -> Callable[[Column], Column]:
        return lambda n: F.when(n == 1, 0).when(n % 2 == 0, even(n)).when(n % 4 == 1, one(n)).otherwise(three(n))

    ranks = {
        "a": rank(lambda n: F.floor((half(n) - 1) / 2), lambda n: quarter(n) - 1, quarter),
        "b": rank(lambda n: F.floor(half(n) / 2), quarter, lambda n: quarter(n) + 1),
        "c": lambda n: F.floor((n - 1) / 2), "d": half,
        "e": rank(lambda n: half(n) + F.floor((half(n) - 1) / 2), lambda n: 3 * quarter(n), lambda n: 3 * quarter(n) + 1),
        "f": rank(lambda n: half(n) + F.floor(half(n) / 2), lambda n: 3 * quarter(n) + 1, lambda n: 3 * quarter(n) + 2),
    }
    v = at_ranks(df, value, by, ranks)
    n = F.col("n")

    def between(low: str, high: str, one: float) -> Column:
        a, b = F.col(low), F.col(high)
        return F.when(n == 1, a).when(n % 2 == 0, (a + b) / 2).when(n % 4 == 1, a * one + b * (1 - one)).otherwise(a * (1 - one) + b * one)

    return v.select(*by, between("a", "b", 0.25).alias("q1"), ((F.col("c") + F.col("d")) / 2).alias("q2"), between("e", "f", 0.75).alias("q3"))


def weighted_quantile(df: DataFrame, value: str, weight: str, p: float, by: list[str], tie: str, name: str) -> DataFrame:
    """Per group the last value whose running share of weight is at most ``p``; 0 if there is none.

    Rows add up one by one, equal values in the order of ``tie``.
    """
    w = Window.partitionBy(*by).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    shares = df.withColumn("__share", F.sum(weight).over(w) / F.sum(weight).over(whole))
    return shares.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("__share") <= p, F.col(value))), F.lit(0.0)).alias(name))


def indexed_value(df: DataFrame, value: str, share: float, by: list[str], name: str) -> DataFrame:
    """Per group sorted[floor(n * share)], without interpolation."""
    return at_ranks(df, value, by, {name: lambda n: F.least(F.floor(n * share), n - 1)}).select(*by, name)


def weighted_moments(value: str, weight: str) -> dict[str, Column]:
    """Weighted mean and variance (by the sum of weights) as aggregates."""
    v, w = F.col(value), F.col(weight)
    mean = F.sum(v * w) / F.sum(w)
    return {"w_mean": mean, "w_var": F.sum(v * v * w) / F.sum(w) - mean * mean}


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is neither null, NaN nor infinite."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def local_deviation(df: DataFrame, value: str, by: list[str], order: str, width: int = 20) -> DataFrame:
    """Standard deviation of first differences in windows of ``width`` rows one after the other.

    Only full windows count. Returns the window number, its mean value and its deviation.
    """
    w = Window.partitionBy(*by).orderBy(order)
    steps = df.withColumns({"__d": F.lead(value).over(w) - F.col(value), "__i": F.row_number().over(w) - 1})
    steps = steps.withColumn("win", F.floor(F.col("__i") / width))
    return steps.groupBy(*by, "win").agg(
        F.stddev_samp("__d").alias("local_sd"), F.avg(value).alias("win_mean"), F.count("__d").alias("n")
    ).filter(F.col("n") == width).drop("n")


def inflation(trim: float, steps: int = 10_000) -> float:
    """One over the second moment of a standard normal cut off at ``trim`` on both sides, by the midpoint rule."""
    normal = NormalDist()
    edge = normal.inv_cdf(1 - trim)
    width = 2 * edge / steps
    moment = sum((x := -edge + (k + 0.5) * width) * x * normal.pdf(x) for k in range(steps)) * width / (1 - 2 * trim)
    return 1 / moment


def trimmed_variance(df: DataFrame, value: str, by: list[str], order: list[str], trim: float = 0.025) -> DataFrame:
    """Per group: half the mean square of the smallest 1 - 2 trim of the differences of neighbours, inflated.

    The last row of a contig and the first of the next are neighbours. Equal differences are counted
    once, so that ranks come from sums over distinct values.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    steps = df.withColumn("d", F.abs(F.col(value) - F.lag(value).over(w))).filter("d is not null")
    counts = steps.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(below), "keep": F.bround((1 - 2 * trim) * F.sum("n").over(Window.partitionBy(*by)), 0)})
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("keep") - (F.col("upto") - F.col("n"))))
    sums = ranked.groupBy(*by).agg(F.sum(taken * F.col("d") * F.col("d")).alias("s"), F.max("keep").alias("k"))
    return sums.select(*by, (F.lit(inflation(trim)) * F.col("s") / (2 * F.col("k"))).alias("variance"))


def rounded_index(df: DataFrame, value: str, share: float, by: list[str], name: str) -> DataFrame:
    """Per group sorted[round half even(n * share)], by running sums over distinct values."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counts.withColumns({"upto": F.sum("n").over(below), "at": F.least(F.bround(total * share, 0), total - 1)})
    return ranked.filter(F.col("upto") > F.col("at")).groupBy(*by).agg(F.min(value).alias(name))
