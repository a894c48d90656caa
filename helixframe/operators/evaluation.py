"""Base-level accuracy of copy-number calls against a truth set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.functions.tables import written

from . import intervals as iv

#: The strata of truth by size, lower bounds in bases.
STRATA = [0, 5_000, 10_000, 100_000, 500_000]


def rounded_up(cn: Column) -> Column:
    """A stated copy number as a whole number, x.5 upwards."""
    return F.floor(cn + 0.5).cast("int")


def confusion(truth: DataFrame, calls: DataFrame, excluded: DataFrame, cap: int = 5, by: list[str] | None = None) -> DataFrame:
    """Bases by (known_cn, call_cn), without excluded bases; call_cn is null where nothing is called.

    Copy numbers above ``cap`` count as ``cap``. ``by`` names further columns of the truth.
    """
    keys = by or []
    keyed = truth.select("iv_id", "chrom", "start_pos", "end_pos", F.least("cn", F.lit(cap)).alias("known_cn"), *keys)
    calls = calls.select("chrom", "start_pos", "end_pos", F.least("cn", F.lit(cap)).alias("call_cn"))
    mask = written(iv.merge_intervals(excluded).select("chrom", "start_pos", "end_pos"), "mask")
    pairs = iv.overlap_join(keyed, calls)
    pieces = pairs.select(
        "iv_id", "chrom", F.greatest("start_pos", "start_pos_r").alias("start_pos"), F.least("end_pos", "end_pos_r").alias("end_pos"),
        "known_cn", F.col("call_cn_r").alias("call_cn"), *keys,
    )
    pieces = iv.covered(pieces, mask, "masked", disjoint=True).withColumn("bases", F.col("end_pos") - F.col("start_pos") - F.col("masked"))
    called = pieces.groupBy("known_cn", "call_cn", *keys).agg(F.sum("bases").alias("bases"))
    whole = iv.covered(keyed, mask, "masked", disjoint=True).withColumn("bases", F.col("end_pos") - F.col("start_pos") - F.col("masked"))
    touched = iv.merge_intervals(pieces.select("iv_id", "chrom", "start_pos", "end_pos"), by=["iv_id"], stretch=None).drop("pieces")
    touched = iv.covered(touched, mask, "masked", disjoint=True).groupBy("iv_id").agg(
        F.sum(F.col("end_pos") - F.col("start_pos") - F.col("masked")).alias("seen")
    )
    missed = whole.join(touched, "iv_id", "left").groupBy("known_cn", *keys).agg(
        F.sum(F.col("bases") - F.coalesce("seen", F.lit(0))).alias("bases")
    )
    missed = missed.select("known_cn", F.lit(None).cast("int").alias("call_cn"), *keys, "bases")
    return called.unionByName(missed).filter("bases > 0")


def of_least_size(rows: DataFrame, least: int) -> DataFrame:
    """Intervals of ``least`` bases or more."""
    return rows.filter(F.col("end_pos") - F.col("start_pos") >= least)


def worst_intervals(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Per known copy number the interval with the most bases not called so, and with the most called otherwise.

    Calls do not overlap each other; of equal intervals the least number is named.
    """
    pairs = iv.overlap_join(truth.select("iv_id", "chrom", "start_pos", "end_pos", "cn"), calls.select("chrom", "start_pos", "end_pos", "cn"))
    both = F.least("end_pos", "end_pos_r") - F.greatest("start_pos", "start_pos_r")
    right = F.col("cn_r") == F.col("cn")
    seen = pairs.groupBy("iv_id").agg(F.sum(F.when(right, both).otherwise(0)).alias("hit"), F.sum(F.when(~right, both).otherwise(0)).alias("wrong"))
    each = truth.join(seen, "iv_id", "left").select(
        "cn", "iv_id", (F.col("end_pos") - F.col("start_pos") - F.coalesce("hit", F.lit(0))).alias("missed"), F.coalesce("wrong", F.lit(0)).alias("wrong")
    )
    top = each.groupBy("cn").agg(
        F.max(F.struct("missed", (-F.col("iv_id")).alias("i"))).alias("a"), F.max(F.struct("wrong", (-F.col("iv_id")).alias("i"))).alias("b")
    )
    return top.select("cn", (-F.col("a.i")).alias("most_missed"), "a.missed", (-F.col("b.i")).alias("most_wrong"), "b.wrong")


def in_regions(truth: DataFrame, regions: DataFrame) -> DataFrame:
    """The parts of truth intervals inside regions of interest, each a row with an iv_id of its own."""
    inside = iv.overlap_join(truth, iv.merge_intervals(regions).select("chrom", "start_pos", "end_pos"))
    low = F.greatest("start_pos", "start_pos_r")
    return inside.withColumns({
        "iv_id": F.concat_ws(":", "iv_id", low), "start_pos": low, "end_pos": F.least("end_pos", "end_pos_r"),
    }).select(truth.columns)


def metrics(cube: DataFrame, ref: int | Column = 2, by: list[str] | None = None) -> DataFrame:
    """Accuracy, recall, precision, F1 and their direction, gain and loss forms, in percent.

    ``ref`` is the reference's copy number, or the cube's column that holds it.
    """
    b, known, call = F.col("bases"), F.col("known_cn"), F.col("call_cn")
    called = call.isNotNull()

    def part(test: Column) -> Column:
        return F.sum(F.when(test, b).otherwise(0)).cast("double")

    altered, altered_call = known != ref, called & (call != ref)
    same_side = ((known > ref) & (call > ref)) | ((known < ref) & (call < ref)) | ((known == ref) & (call == ref))
    sums = {
        "all_": part(called), "right": part(called & (known == call)), "side": part(called & same_side),
        "known_alt": part(altered), "call_alt": part(altered_call), "hit": part(altered & altered_call & (known == call)),
        "hit_side": part(altered & altered_call & same_side), "gain": part(known > ref), "gain_hit": part(called & (known > ref) & (call == known)),
        "gain_side": part(called & (known > ref) & (call > ref)), "gain_call": part(called & (call > ref)), "loss": part(known < ref),
        "loss_hit": part(called & (known < ref) & (call == known)), "loss_side": part(called & (known < ref) & (call < ref)), "loss_call": part(called & (call < ref)),
    }
    s = cube.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in sums.items()])

    def share(a: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.round(100 * F.col(a) / F.col(n), 6))

    out = {
        "accuracy": share("right", "all_"), "direction_accuracy": share("side", "all_"), "recall": share("hit", "known_alt"),
        "direction_recall": share("hit_side", "known_alt"), "precision": share("hit", "call_alt"), "direction_precision": share("hit_side", "call_alt"),
        "gain_recall": share("gain_hit", "gain"), "gain_direction_recall": share("gain_side", "gain"), "gain_precision": share("gain_hit", "gain_call"),
        "gain_direction_precision": share("gain_side", "gain_call"), "loss_recall": share("loss_hit", "loss"), "loss_direction_recall": share("loss_side", "loss"),
        "loss_precision": share("loss_hit", "loss_call"), "loss_direction_precision": share("loss_side", "loss_call"),
    }
    s = s.select(*(by or []), *[c.alias(n) for n, c in out.items()])
    r, p = F.col("recall"), F.col("precision")
    return s.withColumn("f1", F.when(r + p > 0, F.round(2 * r * p / (r + p), 6)))


def stratum(length: Column) -> Column:
    """Number of the size stratum of a truth interval."""
    out = F.lit(0)
    for k, low in enumerate(STRATA):
        out = F.when(length >= low, k).otherwise(out)
    return out


def event_accuracy(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean and upper median over truth intervals of the share of bases called with the right number."""
    right = iv.overlap_join(truth, calls.select("chrom", "start_pos", "end_pos", "cn")).filter("cn = cn_r")
    merged = iv.merge_intervals(right.select(
        "iv_id", "chrom", F.greatest("start_pos", "start_pos_r").alias("start_pos"), F.least("end_pos", "end_pos_r").alias("end_pos")
    ), by=["iv_id"], stretch=None).groupBy("iv_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("hit"))
    each = truth.join(merged, "iv_id", "left").select((F.coalesce("hit", F.lit(0)) / (F.col("end_pos") - F.col("start_pos"))).alias("share"))
    ranked = stats.running(each, [], "share", F.lit(1))
    return ranked.agg(
        (F.sum(F.col("share") * F.col("weight")) / F.sum("weight")).alias("mean_accuracy"),
        F.min(F.when(F.col("upto") > F.floor(F.col("whole") / 2), F.col("share"))).alias("median_accuracy"),
    )


def reference_ploidy(truth: DataFrame, ploidy: DataFrame, default: int = 2) -> DataFrame:
    """Length-weighted mean ploidy of each truth interval, rounded half to even."""
    pairs = iv.overlap_join(truth.select("iv_id", "chrom", "start_pos", "end_pos"), ploidy.select("chrom", "start_pos", "end_pos", "cn"))
    sums = pairs.groupBy("iv_id").agg(F.sum("overlap").alias("n"), F.sum(F.col("overlap") * F.col("cn_r")).alias("s"))
    length = F.col("end_pos") - F.col("start_pos")
    mean = (F.coalesce("s", F.lit(0)) + default * (length - F.coalesce("n", F.lit(0)))) / length
    return truth.join(sums, "iv_id", "left").select("iv_id", F.bround(mean, 0).cast("int").alias("ref_ploidy"))


def size_summary(truth: DataFrame) -> DataFrame:
    """Count, bases, mean and median size of truth intervals by copy number."""
    size = F.col("end_pos") - F.col("start_pos")
    return truth.groupBy("cn").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bases"), F.round(F.avg(size), 6).alias("mean_size"), F.median(size).alias("median_size")
    )
