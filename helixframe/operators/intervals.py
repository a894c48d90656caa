"""Joins and set operations on intervals, as bucketed equi-joins and windows.

An interval join explodes each side to the buckets that it touches and joins on (chrom, bucket), so
that work spreads over the genome and not over a few contigs. A pair is emitted once, in the bucket
where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.tables import written

BUCKET = 10_000
#: Bases of a stretch in which rows are swept by one window.
STRETCH = 1_000_000


def swept(
    rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
    before: Column | None = None, after: Column | None = None, stretch: int = STRETCH,
) -> DataFrame:
    """``rows`` with values that depend on the rows before or after them in ``order``, apart for each of ``keys``.

    ``sums`` run up to each row, ``maxima`` over the rows before it (null at the first); ``before`` is
    a struct's value in the last row before, as column __before, and ``after`` the value in the next
    row, as __after. Rows must begin to be ordered by start_pos.

    Two levels: windows run inside stretches of a contig, and what a stretch takes over from those
    before comes from a scan of one row for each stretch. So no task holds a contig's rows. Rows are
    written first, as both levels read them.
    """
    sums, maxima = sums or {}, maxima or {}
    rows = written(rows, "sweep").withColumns({"__stretch": F.floor(F.col("start_pos") / stretch)} | {f"__{n}": c for n, c in (sums | maxima).items()})
    place = F.struct(*order)
    totals = [F.sum(f"__{n}").alias(f"__t_{n}") for n in sums] + [F.max(f"__{n}").alias(f"__t_{n}") for n in maxima]
    inside = Window.partitionBy(*keys, "__stretch").orderBy(*order)
    upto, past = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.sum(f"__{n}").over(upto) for n in sums} | {n: F.max(f"__{n}").over(past) for n in maxima}
    over = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    taken = [F.sum(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in sums] + [F.max(f"__t_{n}").over(earlier).alias(f"__c_{n}") for n in maxima]
    if before is not None:
        totals.append(F.max_by(before, place).alias("__last"))
        local["__before"] = F.lag(before).over(inside)
        taken.append(F.lag("__last").over(over).alias("__c_before"))
    if after is not None:
        totals.append(F.min_by(after, place).alias("__first"))
        local["__after"] = F.lead(after).over(inside)
        taken.append(F.lead("__first").over(over).alias("__c_after"))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    stretches = rows.groupBy(*named, F.col("__stretch").alias("__at")).agg(*totals).select(*[f"__k{i}" for i in range(len(keys))], "__at", *taken)
    match = F.col("__stretch") == F.col("__at")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.withColumns(local).join(stretches, match)
    whole = {n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"__c_{n}") for n in maxima}
    whole |= {c: F.coalesce(c, f"__c_{c[2:]}") for c in ("__before", "__after") if c in local}
    spare = [f"__{n}" for n in (*sums, *maxima)] + [c for c in stretches.columns] + ["__stretch"]
    return joined.withColumns(whole).drop(*spare)


def _bucketed(df: DataFrame, start: str, end: str, bucket: int) -> DataFrame:
    last = F.greatest(F.col(start), F.col(end) - 1)
    low = F.floor(F.col(start) / bucket).cast("long")
    return df.withColumn("__bucket", F.explode(F.sequence(low, F.floor(last / bucket).cast("long"))))


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(c if c == "chrom" else f"{c}{suffix}") for c in df.columns])


def overlap_join(left: DataFrame, right: DataFrame, suffix: str = "_r", bucket: int = BUCKET) -> DataFrame:
    """All pairs of overlapping intervals; the right side's columns bear ``suffix``. Adds overlap.

    Empty intervals overlap nothing.
    """
    other = _renamed(right, suffix)
    rs, re = f"start_pos{suffix}", f"end_pos{suffix}"
    a = _bucketed(left.filter("start_pos < end_pos"), "start_pos", "end_pos", bucket)
    b = _bucketed(other.filter(F.col(rs) < F.col(re)), rs, re, bucket)
    pairs = a.join(b, ["chrom", "__bucket"]).filter(
        (F.col("start_pos") < F.col(re)) & (F.col(rs) < F.col("end_pos"))
        & (F.floor(F.greatest("start_pos", rs) / bucket) == F.col("__bucket"))
    )
    return pairs.drop("__bucket").withColumn("overlap", F.least("end_pos", re) - F.greatest("start_pos", rs))


def _hit_keys(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    keys = left.select("chrom", "start_pos", "end_pos").distinct()
    return overlap_join(keys, right.select("chrom", "start_pos", "end_pos"), bucket=bucket).select(
        "chrom", "start_pos", "end_pos"
    ).distinct()


def overlap_semi(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of ``left`` that overlap some interval of ``right``."""
    return left.join(_hit_keys(left, right, bucket), ["chrom", "start_pos", "end_pos"], "left_semi")


def overlap_anti(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of ``left`` that overlap no interval of ``right``."""
    return left.join(_hit_keys(left, right, bucket), ["chrom", "start_pos", "end_pos"], "left_anti")


def overlap_flag(left: DataFrame, right: DataFrame, name: str = "on_target", bucket: int = BUCKET) -> DataFrame:
    """All rows of ``left`` with a flag for those that overlap some interval of ``right``."""
    hits = _hit_keys(left, right, bucket).withColumn("__hit", F.lit(True))
    joined = left.join(hits, ["chrom", "start_pos", "end_pos"], "left")
    return joined.withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__hit")


def points_in(points: DataFrame, spans: DataFrame, suffix: str = "_r", offset: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Pairs of a point (chrom, pos) and an interval with start <= pos - offset < end.

    ``offset`` 1 turns 1-based positions into 0-based ones.
    """
    other = _renamed(spans, suffix)
    rs, re = f"start_pos{suffix}", f"end_pos{suffix}"
    at = F.col("pos") - offset
    a = points.withColumn("__bucket", F.floor(at / bucket).cast("long"))
    b = _bucketed(other.filter(F.col(rs) < F.col(re)), rs, re, bucket)
    return a.join(b, ["chrom", "__bucket"]).filter((F.col(rs) <= at) & (at < F.col(re))).drop("__bucket")


def best_overlap(left: DataFrame, right: DataFrame, key: list[str], suffix: str = "_r", bucket: int = BUCKET) -> DataFrame:
    """For each key of ``left`` the interval of ``right`` with the longest overlap, ties to the first."""
    pairs = overlap_join(left, right, suffix, bucket)
    best = Window.partitionBy(*key).orderBy(F.desc("overlap"), f"start_pos{suffix}", f"end_pos{suffix}")
    return pairs.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def intersections(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row for each overlapping pair, with start and end of the piece in common."""
    pairs = overlap_join(left, right, "_r", bucket)
    piece = {"start_pos": F.greatest("start_pos", "start_pos_r"), "end_pos": F.least("end_pos", "end_pos_r")}
    return pairs.withColumns(piece).select(*left.columns)


def merge_intervals(df: DataFrame, gap: int = 0, by: list[str] | None = None, stretch: int | None = STRETCH) -> DataFrame:
    """Union of intervals: those that overlap or lie within ``gap`` become one, apart for each ``by``.

    Gaps and islands in two levels: a row starts an island where it begins beyond all ends before it.
    Islands of a stretch are found first. One that begins within reach of the stretches before belongs
    to the last island that was started there; reach and start come from a scan of one row for each stretch.
    Without ``stretch`` each of the keys goes through one window, which suits keys of few rows.
    """
    keys = ["chrom", *(by or [])]
    inside = Window.partitionBy(*keys, "__stretch").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("__stretch", F.floor(F.col("start_pos") / stretch) if stretch else F.lit(0))
    opened = rows.withColumn("__new", (reach.isNull() | (F.col("start_pos") > reach + gap)).cast("int")).withColumn("__island", F.sum("__new").over(inside))
    local = opened.groupBy(*keys, "__stretch", "__island").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("pieces")
    )
    if stretch is None:
        return local.drop("__stretch", "__island")
    local = written(local, "islands")
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)

    def taken(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """``rows`` with the greatest value of the stretches before, as ``name``."""
        each = rows.groupBy(*names, F.col("__stretch").alias("__at")).agg(F.max(value).alias("__v"))
        each = each.select(*[f"__k{i}" for i in range(len(keys))], "__at", F.max("__v").over(earlier).alias(name))
        match = F.col("__stretch") == F.col("__at")
        for i, k in enumerate(keys):
            match = match & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return rows.join(each, match).drop("__at", *[f"__k{i}" for i in range(len(keys))])

    reached = taken(local, F.col("end_pos"), "__reach")
    own = F.coalesce(F.col("start_pos") > F.col("__reach") + gap, F.lit(True))
    started = taken(reached.withColumn("__own", own), F.when(F.col("__own"), F.col("start_pos")), "__begin")
    first = F.when(F.col("__own"), F.col("start_pos")).otherwise(F.col("__begin")).alias("__first")
    return started.groupBy(*keys, first).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("pieces").alias("pieces")
    ).drop("__first")


def merge_equal(df: DataFrame, value: list[str], max_gap: int = 0, by: list[str] | None = None, stretch: int | None = STRETCH) -> DataFrame:
    """Neighbouring rows of equal ``value`` within ``max_gap`` become one row (values null-safe).

    Without ``stretch`` each of the keys goes through one window, which suits keys of few rows.
    """
    keys, order = ["chrom", *(by or [])], ["start_pos", "end_pos"]
    through = Window.partitionBy(*keys).orderBy(*order)
    before = F.struct("end_pos", *value)
    paired = swept(df, keys, order, before=before) if stretch else df.withColumn("__before", F.lag(before).over(through))
    same = F.col("start_pos") <= F.col("__before.end_pos") + max_gap
    for v in value:
        same = same & F.col(v).eqNullSafe(F.col(f"__before.{v}"))
    opens = (~F.coalesce(same, F.lit(False))).cast("int")
    islands = swept(paired, keys, order, sums={"__island": opens}) if stretch else paired.withColumn("__new", opens).withColumn("__island", F.sum("__new").over(through))
    return islands.groupBy(*keys, *value, "__island").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("pieces")
    ).drop("__island")


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """The parts of each contig (chrom, length) that no interval covers."""
    merged = merge_intervals(df).select("chrom", "start_pos", "end_pos")
    ends = genome.select("chrom", F.col("length").alias("start_pos"), F.col("length").alias("end_pos"))
    # merged intervals are disjoint, so the end before is the greatest one
    gaps = swept(merged.unionByName(ends), ["chrom"], ["start_pos", "end_pos"], maxima={"from_pos": F.col("end_pos")})
    gaps = gaps.withColumn("from_pos", F.coalesce("from_pos", F.lit(0)))
    return gaps.filter("from_pos < start_pos").select(
        "chrom", F.col("from_pos").cast("long").alias("start_pos"), F.col("start_pos").alias("end_pos")
    )


def breakpoint_union(df: DataFrame) -> DataFrame:
    """Pieces between all starts and ends of the intervals, where at least one interval lies.

    A sweep over the points: the running sum of +1 at starts and -1 at ends is the depth.
    """
    points = df.filter("start_pos < end_pos").select(
        "chrom", F.explode(F.array(F.struct(F.col("start_pos").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end_pos").alias("p"), F.lit(-1).alias("d")))).alias("e")
    )
    steps = points.groupBy("chrom", F.col("e.p").alias("start_pos")).agg(F.sum("e.d").alias("step"))
    found = swept(steps, ["chrom"], ["start_pos"], sums={"depth": F.col("step")}, after=F.col("start_pos"))
    return found.filter("depth > 0 and __after is not null").select("chrom", "start_pos", F.col("__after").alias("end_pos"), "depth")


def covered(left: DataFrame, right: DataFrame, name: str = "covered", disjoint: bool = False) -> DataFrame:
    """Rows of ``left`` with the number of their bases that ``right`` covers, each base once.

    ``disjoint`` says that no two intervals of ``right`` overlap, so that they need not be merged.
    """
    merged = right if disjoint else merge_intervals(right).select("chrom", "start_pos", "end_pos")
    keys = left.select("chrom", "start_pos", "end_pos").distinct()
    sums = overlap_join(keys, merged).groupBy("chrom", "start_pos", "end_pos").agg(F.sum("overlap").alias(name))
    return left.join(sums, ["chrom", "start_pos", "end_pos"], "left").fillna(0, [name])


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """What is left of the merged ``left`` after taking out ``right``."""
    a = breakpoint_union(merge_intervals(left).select("chrom", "start_pos", "end_pos").unionByName(
        merge_intervals(right).select("chrom", "start_pos", "end_pos")
    )).select("chrom", "start_pos", "end_pos")
    return merge_intervals(overlap_anti(overlap_semi(a, left), right)).select("chrom", "start_pos", "end_pos")


def majority_value(left: DataFrame, values: DataFrame, value: str, key: list[str], default: int = 2, levels: int = 5) -> DataFrame:
    """Per key of ``left``: the value of 0..levels-1 that covers most of its bases; ties to the least.

    Bases that no row of ``values`` covers count for ``default``.
    """
    known = values.filter(F.col(value).between(0, levels - 1)).select("chrom", "start_pos", "end_pos", value)
    sums = overlap_join(left.select(*key, "chrom", "start_pos", "end_pos"), known).groupBy(*key, f"{value}_r").agg(
        F.sum("overlap").alias("bases")
    ).withColumnRenamed(f"{value}_r", value)
    total = sums.groupBy(*key).agg(F.sum("bases").alias("bases"))
    rest = left.join(total, key, "left").select(
        *key, F.lit(default).cast("int").alias(value), (F.col("end_pos") - F.col("start_pos") - F.coalesce("bases", F.lit(0))).alias("bases")
    )
    all_sums = sums.unionByName(rest.filter("bases > 0")).groupBy(*key, value).agg(F.sum("bases").alias("bases"))
    best = all_sums.groupBy(*key).agg(F.max(F.struct(F.col("bases"), (-F.col(value)).alias("v"))).alias("top"))
    return left.join(best, key, "left").withColumn(value, F.coalesce(-F.col("top.v"), F.lit(default))).drop("top")


def value_pieces(left: DataFrame, values: DataFrame, value: str, key: list[str], default: int = 2) -> DataFrame:
    """Each interval of ``left`` cut into the pieces of equal value; gaps take ``default``.

    ``values`` must not overlap. Pieces are trimmed to the interval and maximal.
    """
    hits = overlap_join(left.select(*key, "chrom", "start_pos", "end_pos"), values.select("chrom", "start_pos", "end_pos", value))
    inner = hits.select(
        *key, "chrom", F.col("start_pos").alias("low"), F.col("end_pos").alias("high"),
        F.greatest("start_pos", "start_pos_r").alias("s"), F.least("end_pos", "end_pos_r").alias("e"), F.col(f"{value}_r").alias("v"),
    )
    order = Window.partitionBy(*key).orderBy("s")
    before = inner.select(*key, "chrom", F.coalesce(F.lag("e").over(order), "low").alias("s0"), F.col("s").alias("e0"))
    last = inner.groupBy(*key, "chrom").agg(F.max("e").alias("s0"), F.first("high").alias("e0"))
    none = left.join(inner.select(*key).distinct(), key, "left_anti").select(*key, "chrom", F.col("start_pos").alias("s0"), F.col("end_pos").alias("e0"))
    gaps = before.unionByName(last).unionByName(none).filter("s0 < e0").select(
        *key, "chrom", F.col("s0").alias("start_pos"), F.col("e0").alias("end_pos"), F.lit(default).cast("int").alias(value)
    )
    filled = inner.select(*key, "chrom", F.col("s").alias("start_pos"), F.col("e").alias("end_pos"), F.col("v").cast("int").alias(value))
    return merge_equal(filled.unionByName(gaps), [value], by=key, stretch=None).drop("pieces")


def windows_of(df: DataFrame, width: int, key: list[str]) -> DataFrame:
    """Intervals cut into windows of ``width`` from their start; the last one may be shorter."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("end_pos") - F.col("start_pos") - 1, F.lit(width).cast("long"))
    cut = df.filter("start_pos < end_pos").withColumn("__s", F.explode(starts))
    return cut.select(
        *key, "chrom", (F.col("start_pos") + F.col("__s")).alias("start_pos"),
        F.least(F.col("start_pos") + F.col("__s") + width, "end_pos").alias("end_pos"),
    )


def agnostic_chrom(chrom: Column) -> Column:
    """A contig's name without a leading chr, so that chr1 and 1 are one."""
    return F.regexp_replace(chrom, "^chr", "")


def assert_ordered(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``df``, failing at run time where start_pos falls in the order of the column ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    wrong = F.lag("start_pos").over(w) > F.col("start_pos")
    checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error("rows are not sorted by start_pos")).otherwise(F.col("start_pos"))
    return df.withColumn("start_pos", checked.cast("long"))


def assert_disjoint(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, failing at run time where two intervals of a key overlap."""
    w = Window.partitionBy(*keys).orderBy("start_pos", "end_pos")
    wrong = F.lag("end_pos").over(w) > F.col("start_pos")
    checked = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error("intervals overlap")).otherwise(F.col("start_pos"))
    return df.withColumn("start_pos", checked.cast("long"))
