"""Segments: ids from breakpoints, confidence intervals, merging, filters and statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv


def number_segments(bins: DataFrame, breakpoints: DataFrame, excluded: DataFrame, ploidy: DataFrame | None = None, max_gap: int = 1_000_000) -> DataFrame:
    """Bins with seg_idx: a new segment starts at a breakpoint, beyond the midpoint of an excluded
    interval, after a gap above ``max_gap``, and where the ploidy changes."""
    w = Window.partitionBy("chrom").orderBy("start_pos")
    marks = breakpoints.select("chrom", F.col("start_pos")).distinct().withColumn("__bp", F.lit(1))
    rows = bins.join(marks, ["chrom", "start_pos"], "left")
    rows = rows.withColumns({"__before": F.lag("end_pos").over(w), "__last": F.lag("start_pos").over(w)})
    mid = excluded.select("chrom", F.floor((F.col("start_pos") + F.col("end_pos")) / 2).cast("long").alias("pos"))
    steps = rows.filter("__last is not null").select("chrom", F.col("__last").alias("start_pos"), F.col("start_pos").alias("end_pos"))
    crossed = iv.points_in(mid, steps).select("chrom", F.col("end_pos_r").alias("start_pos")).distinct().withColumn("__cross", F.lit(1))
    rows = rows.join(crossed, ["chrom", "start_pos"], "left")
    new = F.col("__before").isNull() | F.col("__bp").isNotNull() | F.col("__cross").isNotNull()
    new = new | (F.col("start_pos") - F.col("__before") > max_gap)
    if ploidy is not None:
        inside = iv.best_overlap(bins.select("chrom", "start_pos", "end_pos"), ploidy, ["chrom", "start_pos"])
        rows = rows.join(inside.select("chrom", "start_pos", F.col("cn_r").alias("__cn")), ["chrom", "start_pos"], "left").fillna(2, ["__cn"])
        new = new | ~F.col("__cn").eqNullSafe(F.coalesce(F.lag("__cn").over(w), "__cn"))
    numbered = rows.withColumn("__new", new.cast("int")).withColumn("seg_idx", F.sum("__new").over(w) - 1)
    return numbered.select(*bins.columns, F.col("seg_idx").cast("long").alias("seg_idx"))


def from_breakpoints(points: DataFrame, sizes: DataFrame, few: int = 10) -> DataFrame:
    """Breakpoint bin numbers (chrom, idx) to segments of bin numbers; contigs with ``few`` bins or
    fewer, or fewer than two breakpoints, are one segment. ``sizes`` has chrom and bins."""
    counts = points.groupBy("chrom").agg(F.countDistinct("idx").alias("k"))
    plain = sizes.join(counts, "chrom", "left").withColumn("whole", (F.col("bins") <= few) | (F.coalesce("k", F.lit(0)) < 2))
    cut = points.select("chrom", "idx").distinct().join(plain.filter("not whole").select("chrom"), "chrom", "left_semi")
    starts = cut.union(plain.select("chrom", F.lit(0).cast("long"))).distinct()
    w = Window.partitionBy("chrom").orderBy("idx")
    return starts.join(sizes, "chrom").select(
        "chrom", F.col("idx").alias("first_bin"), (F.coalesce(F.lead("idx").over(w), F.col("bins")) - 1).alias("last_bin")
    )


def summarize(bins: DataFrame, by: tuple[str, ...] = ("chrom", "seg_idx"), trim: int = 0) -> DataFrame:
    """Segments with extent, number of bins, mean and median count; ``trim`` bins leave each side for
    trimmed_median where more than five are left."""
    grouped = bins.groupBy(*by).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("bins"),
        F.avg("cnt").alias("mean_cnt"), F.median("cnt").alias("median_cnt"), F.array_sort(F.collect_list(F.struct("start_pos", "cnt"))).alias("v"),
    )
    inner = F.slice("v", F.lit(trim + 1), F.greatest(F.size("v") - 2 * trim, F.lit(1)))
    used = F.when(F.size("v") - 2 * trim > 5, inner).otherwise(F.col("v"))
    values = F.sort_array(F.transform(used, lambda x: x["cnt"]))
    n = F.size(values)
    middle = (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2
    return grouped.withColumn("trimmed_median", middle).drop("v")


def with_confidence(bins: DataFrame) -> DataFrame:
    """Per segment (chrom, seg_idx) ci_pos and ci_end as (low, high): half the length of the bins on
    either side of a border; the own bin where the neighbour does not touch. Halves round away from 0."""
    w = Window.partitionBy("chrom").orderBy("start_pos")
    size = F.col("end_pos") - F.col("start_pos")
    rows = bins.withColumns({
        "size": size, "p_end": F.lag("end_pos").over(w), "n_start": F.lead("start_pos").over(w),
        "p_size": F.lag(size).over(w), "n_size": F.lead(size).over(w),
    })
    rows = rows.withColumns({
        "before": F.when(F.col("p_end") == F.col("start_pos"), F.col("p_size")).otherwise(F.col("size")),
        "after": F.when(F.col("n_start") == F.col("end_pos"), F.col("n_size")).otherwise(F.col("size")),
    })

    def half(x: Column) -> Column:
        return F.round(x / 2).cast("int")

    seg = rows.groupBy("chrom", "seg_idx").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        F.min(F.struct("start_pos", "before", "size")).alias("a"), F.max(F.struct("start_pos", "after", "size")).alias("b"),
    )
    return seg.select(
        "chrom", "seg_idx", "start_pos", "end_pos", (-half(F.col("a.before"))).alias("ci_pos_low"), half(F.col("a.size")).alias("ci_pos_high"),
        (-half(F.col("b.size"))).alias("ci_end_low"), half(F.col("b.after")).alias("ci_end_high"),
    )


def _absorb(parts: Iterator[pd.DataFrame] | pd.DataFrame, least: int, most_span: int) -> pd.DataFrame:
    """Left to right: a short segment joins the neighbour of higher q, ties to the one before.

    Neighbours are the nearest long segments. What lies between goes along, and what has grown is
    long, so the one before is the last long row kept and the one after never changes: time grows with the rows.
    """
    parts = parts.sort_values("start_pos").reset_index(drop=True)
    start, end, q = (parts[c].tolist() for c in ("start_pos", "end_pos", "q"))
    after, follow = [len(start)] * (len(start) + 1), len(start)
    for k in range(len(start) - 1, -1, -1):
        after[k] = follow = k if end[k] - start[k] >= least else follow
    kept: list[list] = []  # start, end, and the row that gives the rest
    before = -1  # where the last long one is
    at = 0
    while at < len(start):
        k = after[at]
        if k == at:
            before = len(kept)
            kept.append([start[at], end[at], at])
            at += 1
            continue
        sides = []
        if before >= 0 and start[at] - kept[before][1] <= most_span:
            sides.append((q[kept[before][2]], 1))
        if k < len(start) and start[k] - end[at] <= most_span:
            sides.append((q[k], -1))
        if not sides:
            kept.append([start[at], end[at], at])
            at += 1
        elif max(sides)[1] > 0:
            main = kept[before]
            main[1] = max(end[at], *(r[1] for r in kept[before:]))
            del kept[before + 1 :]
            at += 1
        else:
            before = len(kept)
            kept.append([start[at], max(end[at : k + 1]), k])
            at = k + 1
    rows = parts.iloc[[r[2] for r in kept]].reset_index(drop=True)
    rows["start_pos"], rows["end_pos"] = [r[0] for r in kept], [r[1] for r in kept]
    return rows


def merge_calls(segments: DataFrame, least: int = 50_000, most_span: int = 10_000, by: tuple[str, ...] = ("chrom",), barriers: DataFrame | None = None) -> DataFrame:
    """Absorb short segments, then merge neighbours of one copy number within ``most_span``.

    ``segments`` has chrom, start_pos, end_pos, cn, q. The first step depends on earlier ones, so it
    runs over a contig's segments in one task, in time by their number; the second is gaps and islands.
    Where ``barriers`` touch a gap, nothing merges across it.
    """
    columns = [*by, "start_pos", "end_pos", "cn", "q"]
    if "chrom" not in by:
        columns.insert(0, "chrom")
    rows = segments.select(*columns)
    schema = rows.schema
    merged = rows.groupBy(*by).applyInPandas(lambda p: _absorb(p, least, most_span), schema)
    w = Window.partitionBy(*by).orderBy("start_pos")
    joined = merged.withColumns({"__gap": F.lag("end_pos").over(w), "__same": F.lag("cn").over(w).eqNullSafe(F.col("cn"))})
    near = F.coalesce(F.col("__same") & (F.col("start_pos") - F.col("__gap") <= most_span), F.lit(False))
    if barriers is not None:
        gaps = joined.filter("__gap < start_pos").select("chrom", F.col("__gap").alias("start_pos"), F.col("start_pos").alias("end_pos"))
        barred = iv.overlap_semi(gaps, barriers).select("chrom", F.col("end_pos").alias("start_pos"), F.lit(True).alias("__bar")).distinct()
        joined = joined.join(barred, ["chrom", "start_pos"], "left")
        near = near & F.col("__bar").isNull()
    marked = joined.withColumn("__new", (~near).cast("int")).withColumn("__island", F.sum("__new").over(w))
    return marked.groupBy("chrom", *[b for b in by if b != "chrom"], "__island", "cn").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"),
        (F.sum(F.col("q") * (F.col("end_pos") - F.col("start_pos"))) / F.sum(F.col("end_pos") - F.col("start_pos"))).alias("q"),
        F.count(F.lit(1)).alias("pieces"),
    ).drop("__island")


def merge_samples(segments: DataFrame, q_limit: float) -> DataFrame:
    """Merge neighbours whose copy numbers agree in every sample and whose mean q exceeds the limit.

    ``segments`` is long: sample, chrom, start_pos, end_pos, cn, q; samples share their segments.
    """
    vectors = segments.groupBy("chrom", "start_pos", "end_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample", "cn"))), lambda x: x["cn"]).alias("cns"), F.avg("q").alias("q")
    )
    w = Window.partitionBy("chrom").orderBy("start_pos")
    same = (F.lag("cns").over(w) == F.col("cns")) & (F.lag("q").over(w) > q_limit) & (F.col("q") > q_limit)
    marked = vectors.withColumn("__new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("__i", F.sum("__new").over(w))
    return marked.groupBy("chrom", "__i", "cns").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.avg("q").alias("q"), F.count(F.lit(1)).alias("pieces")
    ).drop("__i")


def size_tag(size: int) -> str:
    """Name of a size filter in whole Mb, kb or bp."""
    for unit, name in ((1_000_000, "Mb"), (1_000, "kb")):
        if size % unit == 0:
            return f"L{size // unit}{name}"
    return f"L{size}bp"


def filter_tags(q: Column, length: Column, q_limit: int, size: int) -> Column:
    """Failed filters of a segment as an array; an empty one is PASS."""
    return F.array_compact(F.array(
        F.when(q < q_limit, F.lit(f"q{q_limit}")), F.when(length < size, F.lit(size_tag(size)))
    ))


def record_filter(filters: DataFrame, by: list[str]) -> DataFrame:
    """Filter of a record over its samples: PASS with any passing sample, else FailedFT."""
    passed = F.bool_or(F.size("filters") == 0)
    return filters.groupBy(*by).agg(F.when(passed, F.array().cast("array<string>")).otherwise(F.array(F.lit("FailedFT"))).alias("record_filters"))


def site_slice(sites: Column, least: int = 10, first: int = 3, last: int = 6) -> Column:
    """Allele counts without the outer ones: from ``least`` sites on, the first 3 and 6 in all go."""
    n = F.size(sites)
    return F.when(n >= least, F.slice(sites, F.lit(first + 1), F.greatest(n - last, F.lit(1)))).otherwise(sites)


def overall_ploidy(segments: DataFrame, by: list[str]) -> DataFrame:
    """Length-weighted mean copy number of passing segments."""
    size = F.col("end_pos") - F.col("start_pos")
    return segments.filter(F.size("filters") == 0).groupBy(*by).agg((F.sum(F.col("cn") * size) / F.sum(size)).alias("ploidy"))


def common_alternatives(segments: DataFrame, common: DataFrame, tolerance: int = 500, least: int = 1000) -> DataFrame:
    """Two layouts of every called segment that common variants touch: alt A as called, alt B cut.

    ``segments`` has seg_id, chrom, start_pos, end_pos. Cuts are the borders of common variants of
    ``least`` bases or more that lie inside the segment by more than ``tolerance``. Common variants
    that touch no segment come as layout B of a region of their own (seg_id null).
    """
    known = common.filter(F.col("end_pos") - F.col("start_pos") >= least).select("chrom", "start_pos", "end_pos").distinct()
    pairs = iv.overlap_join(segments.select("seg_id", "chrom", "start_pos", "end_pos"), known)
    inside = (F.col("p") > F.col("start_pos") + tolerance) & (F.col("p") < F.col("end_pos") - tolerance)
    cuts = pairs.withColumn("p", F.explode(F.array("start_pos_r", "end_pos_r"))).filter(inside).select("seg_id", "chrom", "end_pos", "p")
    touched = pairs.select("seg_id", "chrom", "start_pos", "end_pos").distinct()
    points = cuts.union(touched.select("seg_id", "chrom", "end_pos", F.col("start_pos").alias("p"))).distinct()
    w = Window.partitionBy("seg_id").orderBy("p")
    cut = points.select("seg_id", "chrom", F.lit("B").alias("alt"), F.col("p").alias("start_pos"), F.coalesce(F.lead("p").over(w), "end_pos").alias("end_pos"))
    whole = touched.select("seg_id", "chrom", F.lit("A").alias("alt"), "start_pos", "end_pos")
    alone = iv.overlap_anti(known, segments).select(F.lit(None).cast("long").alias("seg_id"), "chrom", F.lit("B").alias("alt"), "start_pos", "end_pos")
    return whole.unionByName(cut).unionByName(alone)


def normalized_track(bins: DataFrame, factor: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Track (chrom, start_pos, end_pos, value) of counts times ``factor`` (one row), of bins or of segments.

    With ``by`` the value is the median of a segment's bins, over its whole extent.
    """
    rows = bins.select("chrom", "start_pos", "end_pos", F.col("cnt").alias("value"))
    if by:
        rows = bins.groupBy(*by).agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.median("cnt").alias("value"))
    return rows.join(F.broadcast(factor)).select("chrom", "start_pos", "end_pos", (F.col("value") * F.col("factor")).alias("value"))


def common_segments(bins: DataFrame, common: DataFrame) -> DataFrame:
    """Segments of common variants that are given as bin numbers of a contig: chrom, first_bin, last_bin.

    The segment ends with its last bin, whose count is not part of it. Numbers beyond the contig's bins
    give no segment.
    """
    w = Window.partitionBy("chrom").orderBy("start_pos")
    numbered = bins.withColumn("i", F.row_number().over(w) - 1)
    wanted = common.withColumn("i", F.explode(F.sequence("first_bin", "last_bin")))
    inner = F.when(F.col("i") < F.col("last_bin"), F.col("cnt"))
    out = wanted.join(numbered, ["chrom", "i"]).groupBy("chrom", "first_bin", "last_bin").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(inner).alias("bins"), F.median(inner).alias("median_cnt"), F.count(F.lit(1)).alias("n")
    )
    return out.filter(F.col("n") == F.col("last_bin") - F.col("first_bin") + 1).select("chrom", "first_bin", "start_pos", "end_pos", "bins", "median_cnt")


def _apart(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["chrom", "start_pos", "end_pos"], "left_anti")


def merge_common(
    segments: DataFrame, common: DataFrame, bins: DataFrame | None = None, tolerance: int = 500, least: int = 1000, least_overlap: int = 10
) -> DataFrame:
    """Regions of called segments and common variants with their layouts: alt A as called, alt B by the common ones.

    Both sides have chrom, start_pos, end_pos, and neither overlaps itself. Rows are chrom, region (its
    least start), alt, start_pos, end_pos, is_common; a region of one layout has nothing to choose.

    * Common variants under ``least`` bases do not count.
    * A called segment with the borders of a common variant, or, where the variant has over four
      times ``tolerance``, within ``tolerance`` of them, gives way to it: layout B only.
    * Others that share over ``least_overlap`` bases form a region. Layout B has the common variants,
      the part of a called segment before its first one, and the part after it where it meets only
      one. With ``bins`` a part without any of them is left out.
    * A segment that outlasts a common variant which began in the segment before is cut at its end;
      the rest goes on as a segment of its own.
    """
    place = ["chrom", "start_pos", "end_pos"]
    called = segments.select(*place).distinct()
    known = common.filter(F.col("end_pos") - F.col("start_pos") >= least).select(*place).distinct()
    pairs = iv.overlap_join(called, known)
    off = F.greatest(F.abs(F.col("start_pos") - F.col("start_pos_r")), F.abs(F.col("end_pos") - F.col("end_pos_r")))
    alike = pairs.filter((off == 0) | ((off < tolerance) & (F.col("end_pos_r") - F.col("start_pos_r") > 4 * tolerance)))
    replaced = alike.select(*place).distinct()
    taken = alike.select("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos")).distinct()
    called, known = _apart(called, replaced), _apart(known, taken)

    first = F.min("start_pos").over(Window.partitionBy("chrom", "start_pos_r", "end_pos_r"))
    outlasts = (F.col("start_pos_r") <= F.col("start_pos")) & (F.col("end_pos_r") < F.col("end_pos")) & (F.col("first") < F.col("start_pos_r"))
    linked = iv.overlap_join(called, known).filter(F.col("overlap") > least_overlap).withColumn("first", first)
    cut = linked.filter(outlasts).groupBy(*place).agg(F.max("end_pos_r").alias("at"))
    called = called.join(cut, place, "left").select("chrom", F.explode(
        F.when(F.col("at").isNull(), F.array(F.struct("start_pos", "end_pos")))
        .otherwise(F.array(F.struct("start_pos", F.col("at").alias("end_pos")), F.struct(F.col("at").alias("start_pos"), "end_pos")))
    ).alias("s")).select("chrom", "s.*")

    order = Window.partitionBy("chrom").orderBy("start_pos", "end_pos", "is_common")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = called.withColumn("is_common", F.lit(False)).unionByName(known.withColumn("is_common", F.lit(True)))
    opens = reach.isNull() | (F.least(reach, "end_pos") - F.col("start_pos") <= least_overlap)
    placed = both.withColumn("opens", F.when(opens, F.col("start_pos"))).withColumn("region", F.last("opens", ignorenulls=True).over(order)).drop("opens")
    asis = placed.select("chrom", "region", F.when(F.col("is_common"), "B").otherwise("A").alias("alt"), "start_pos", "end_pos", "is_common")

    met = iv.overlap_join(placed.filter("not is_common").drop("is_common"), known).filter(F.col("overlap") > least_overlap)
    sides = met.groupBy("chrom", "region", "start_pos", "end_pos").agg(
        F.min("start_pos_r").alias("low"), F.max("end_pos_r").alias("high"), F.count(F.lit(1)).alias("n")
    )
    after = F.when(F.col("n") == 1, F.struct(F.col("high").alias("start_pos"), "end_pos"))
    parts = sides.select("chrom", "region", F.explode(F.array(F.struct("start_pos", F.col("low").alias("end_pos")), after)).alias("s"))
    parts = parts.select("chrom", "region", "s.*").filter("start_pos < end_pos")
    if bins is not None:
        parts = iv.overlap_semi(parts, bins)
    rest = parts.select("chrom", "region", F.lit("B").alias("alt"), "start_pos", "end_pos", F.lit(False).alias("is_common"))
    swapped = taken.select("chrom", F.col("start_pos").alias("region"), F.lit("B").alias("alt"), "start_pos", "end_pos", F.lit(True).alias("is_common"))
    return asis.unionByName(rest).unionByName(swapped)
