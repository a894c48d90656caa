"""Filters on bins, and normalization by GC content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import intervals as iv

#: Fixed value: the 99 percent point of chi-square with one degree of freedom.
CHI_SQUARE_99 = 6.635


def differ(a: Column, b: Column) -> Column:
    """Whether two counts differ by a chi-square test; two zeros do not."""
    mean = (a + b) / 2
    return (mean > 0) & (((a - mean) * (a - mean) + (b - mean) * (b - mean)) / mean > CHI_SQUARE_99)


def drop_big(df: DataFrame, share: float = 0.98, by: list[str] | None = None) -> DataFrame:
    """Bins no longer than the one at ``share`` of the sorted sizes; one threshold for each group.

    The sorted rank comes from counts by size, of which there are few.
    """
    keys = by or []
    sized = df.withColumn("__size", F.col("end_pos") - F.col("start_pos"))
    counts = sized.groupBy(*keys, "__size").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = whole.orderBy("__size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(whole)})
    limit = ranked.filter(F.col("upto") > F.floor(F.col("all") * share)).groupBy(*keys).agg(F.min("__size").alias("__limit"))
    joined = sized.join(F.broadcast(limit), keys) if keys else sized.crossJoin(F.broadcast(limit))  # one row for each sample
    return joined.filter("__size <= __limit").select(df.columns)


def drop_outliers(df: DataFrame, value: str = "cnt", by: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Bins that resemble one of their two neighbours on the contig by :func:`differ`.

    A bin alone on its contig has no neighbour to resemble and goes; the only bin of a table stays.
    """
    w = Window.partitionBy(*by).orderBy("start_pos")
    x = F.col(value)
    alike = [F.coalesce(~differ(x, side(value).over(w)), F.lit(False)) for side in (F.lag, F.lead)]
    rows = df.withColumn("__alike", alike[0] | alike[1])
    many = df.select(F.lit(1).alias("__one")).limit(2).agg((F.count(F.lit(1)) > 1).alias("__many"))  # one row
    return rows.join(F.broadcast(many)).filter(F.col("__alike") | ~F.col("__many")).select(df.columns)


def autosomal(df: DataFrame, autosomes: tuple[str, ...]) -> DataFrame:
    """Rows on the contigs that are named as autosomes."""
    return df.filter(F.col("chrom").isin(list(autosomes)))


def counts_by_gc(bins: DataFrame, autosomes: tuple[str, ...], targets: DataFrame | None = None) -> DataFrame:
    """Number and median count of the autosomal bins of each GC class, on ``targets`` only where given."""
    kept = autosomal(bins, autosomes)
    if targets is not None:
        kept = iv.overlap_semi(kept, targets)
    return kept.groupBy("gc").agg(F.count(F.lit(1)).alias("bins"), F.median("cnt").alias("median_cnt"))


def drop_rare_gc(df: DataFrame, least: int = 10, most: int = 100, classes: int = 101, autosomes: tuple[str, ...] | None = None) -> DataFrame:
    """Bins of GC classes that hold min(most, max(least, bins / classes)) bins or more.

    With ``autosomes`` only their bins are counted; bins of all contigs stay or go by their class.
    """
    counts = (df if autosomes is None else autosomal(df, autosomes)).groupBy("gc").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    limit = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col("total") / classes)))
    kept = counts.join(F.broadcast(total)).filter(F.col("n") >= limit).select("gc")  # total is one row
    return df.join(F.broadcast(kept), "gc", "left_semi").select(df.columns)  # at most one row for each percent


def drop_unsteady(df: DataFrame, value: str = "cnt", factor: float = 2.0, least: float = 5.0, width: int = 20) -> DataFrame:
    """Bins outside windows whose local deviation exceeds ``factor`` times the average of the contigs'
    median absolute deviations, and whose mean exceeds ``least``."""
    local = stats.local_deviation(df, value, ["chrom"], "start_pos", width)
    spread = stats.median_deviation(local, "local_sd", ["chrom"]).agg(F.avg("mad").alias("typical"))
    bad = local.join(F.broadcast(spread)).filter((F.col("local_sd") > factor * F.col("typical")) & (F.col("win_mean") > least))
    w = Window.partitionBy("chrom").orderBy("start_pos")
    numbered = df.withColumn("win", F.floor((F.row_number().over(w) - 1) / width))
    return numbered.join(bad.select("chrom", "win"), ["chrom", "win"], "left_anti").select(df.columns)


def normalize_gc_median(df: DataFrame, value: str = "cnt", enough: int = 100, reach: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """value * overall median / median of the bin's GC class.

    A class of fewer than ``enough`` bins uses the weighted median of the classes within ``reach``
    percent, whose weight halves with every percent. Classes with median 0 leave the value.
    """
    keys = list(by)
    overall = df.groupBy(*keys).agg(F.median(value).alias("overall"))
    own = df.groupBy(*keys, "gc").agg(F.median(value).alias("med"), F.count(F.lit(1)).alias("n"))
    dense = own.filter(F.col("n") >= enough).select(*keys, "gc", "med")
    sparse = own.filter(F.col("n") < enough).select(*keys, F.col("gc").alias("want"))
    near = sparse.withColumn("gc", F.explode(F.sequence(F.col("want") - reach, F.col("want") + reach)))
    # bins are counted by value before they go to the classes around them
    counts = df.groupBy(*keys, "gc", value).agg(F.count(F.lit(1)).alias("c")).join(near, [*keys, "gc"])
    shares = stats.running(counts, [*keys, "want"], value, F.col("c") * F.pow(F.lit(0.5), F.abs(F.col("gc") - F.col("want"))))
    weighted = shares.filter("upto / whole >= 0.5").groupBy(*keys, F.col("want").alias("gc")).agg(F.min(value).alias("med"))
    medians = dense.unionByName(weighted.select(*keys, "gc", "med"))
    joined = df.join(medians, [*keys, "gc"], "left")
    joined = joined.join(overall, keys) if keys else joined.crossJoin(F.broadcast(overall))  # one row
    fixed = F.when(F.col("med") > 0, F.col(value) * F.col("overall") / F.col("med")).otherwise(F.col(value))
    return joined.withColumn(value, fixed).select(df.columns)


def normalize_gc_spread(df: DataFrame, value: str = "cnt", least: int = 10, excess: float = 2.0) -> DataFrame:
    """Scale each GC class's deviations from its median to the overall interquartile range.

    Done only where some class between 10 and 89 percent with ``least`` bins or more is more than
    ``excess`` times as wide as all bins.
    """
    groups = stats.quartiles(df, value, ["gc"]).withColumn("iqr", F.col("q3") - F.col("q1"))
    counts = df.groupBy("gc").agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("p"))
    every = every.select((F.col("p")[1] - F.col("p")[0]).alias("wide"))
    classes = groups.join(counts, "gc").join(F.broadcast(every))  # one row
    over = (F.col("gc").between(10, 89)) & (F.col("n") >= least) & (F.col("iqr") > excess * F.col("wide"))
    needed = classes.agg(F.coalesce(F.max(over), F.lit(False)).alias("needed"))
    known = classes.join(F.broadcast(needed)).select("gc", "q2", "iqr", "wide", "needed")
    joined = df.join(F.broadcast(known), "gc")  # at most one row for each percent
    scaled = F.col("q2") + (F.col(value) - F.col("q2")) * F.col("wide") / F.col("iqr")
    return joined.withColumn(value, F.when(F.col("needed") & (F.col("iqr") > 0), scaled).otherwise(F.col(value))).select(df.columns)
