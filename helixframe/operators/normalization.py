"""Normalization of a sample's bins by control samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chrom", "start_pos", "end_pos"]


def in_all_samples(df: DataFrame) -> DataFrame:
    """Bins that every sample has; the counts of all samples as a map."""
    samples = df.agg(F.countDistinct("sample").alias("samples"))
    joined = df.groupBy(*KEY).agg(
        F.countDistinct("sample").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample", "cnt")))).alias("counts")
    )
    return joined.join(F.broadcast(samples)).filter("n = samples").drop("n", "samples")  # samples is one row


def ratios(sample: DataFrame, control: DataFrame, least: float = 0.0, most: float | None = None) -> DataFrame:
    """count / control count for the bins of both, where the control lies in [least, most]."""
    other = control.select(*KEY, F.col("cnt").alias("ref"))
    both = sample.join(other, KEY).filter((F.col("ref") > 0) & (F.col("ref") >= least))
    if most is not None:
        both = both.filter(F.col("ref") <= most)
    return both.withColumn("ratio", F.col("cnt") / F.col("ref")).drop("ref")


def library_ratios(sample: DataFrame, control: DataFrame) -> DataFrame:
    """Ratios divided by that of the two medians; bins with a control below 1 go."""
    medians = sample.agg(F.median("cnt").alias("a")).join(control.agg(F.median("cnt").alias("b")))
    both = ratios(sample, control, 1.0).join(F.broadcast(medians))  # one row
    return both.withColumn("ratio", F.col("ratio") * F.col("b") / F.col("a")).drop("a", "b")


def ratio_to_count(df: DataFrame, ploidy: str, scale: float = 40.0) -> DataFrame:
    return df.withColumn("cnt", F.col("ratio") * scale * F.col(ploidy) / 2)


def weighted_control(controls: DataFrame) -> DataFrame:
    """Average of control samples, each weighted by the inverse of its median."""
    medians = controls.groupBy("sample").agg(F.median("cnt").alias("m")).filter("m > 0")
    total = medians.agg(F.sum(1 / F.col("m")).alias("t"))
    weights = medians.join(F.broadcast(total)).select("sample", (1 / F.col("m") / F.col("t")).alias("w"))
    return controls.join(weights, "sample").groupBy(*KEY).agg(F.sum(F.col("w") * F.col("cnt")).alias("cnt"))


def best_control(sample: DataFrame, controls: DataFrame) -> DataFrame:
    """The control with the least mean squared log ratio of median-scaled counts, with that mean."""
    a = sample.crossJoin(F.broadcast(sample.agg(F.median("cnt").alias("am"))))  # one row
    b = controls.join(controls.groupBy("sample").agg(F.median("cnt").alias("bm")), "sample")
    both = a.select(*KEY, F.col("cnt").alias("x"), "am").join(b.select(*KEY, "sample", F.col("cnt").alias("y"), "bm"), KEY)
    log = F.ln((F.col("x") / F.col("am")) / (F.col("y") / F.col("bm")))
    usable = both.filter("x > 0 and y > 0 and am > 0 and bm > 0")
    means = usable.groupBy("sample").agg(F.avg(log * log).alias("msl"))
    first = Window.partitionBy(F.lit(0)).orderBy("msl", "sample")  # one row for each control
    return means.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def pca_control(sample: DataFrame, model: DataFrame, axes: list[str]) -> DataFrame:
    """Project the centred, median-scaled sample on orthonormal axes; values of 1 and more, rescaled.

    ``model`` has chrom, start_pos, end_pos, mean and the axes.
    """
    both = sample.join(model, KEY)
    scale = both.agg((F.median("cnt") / F.median("mean")).alias("s"))
    both = both.join(F.broadcast(scale)).withColumn("c", F.col("cnt") / F.col("s") - F.col("mean"))  # one row
    loads = both.agg(*[F.sum(F.col("c") * F.col(a)).alias(f"p_{a}") for a in axes])
    projected = both.join(F.broadcast(loads))
    value = F.col("mean")
    for a in axes:
        value = value + F.col(f"p_{a}") * F.col(a)
    return projected.select(*KEY, (F.greatest(value, F.lit(1.0)) * F.col("s")).alias("cnt"))
