"""Whole runs: germline, tumour-normal, pedigree, and accuracy evaluation.

Each is a function of DataFrames that returns a DataFrame; options are dataclasses, and a run may
override the options of single stages by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.functions.tables import written
from helixframe.operators import callers, cleaning, evaluation, haplotypes, models, normalization, quality, segmentation
from helixframe.operators import intervals as iv
from helixframe.operators import segments as sg


@dataclass(frozen=True)
class CleanOptions:
    gc: str = "median"  # median, loess or none
    drop_big: bool = True
    drop_outliers: bool = True
    drop_rare_gc: bool = True
    drop_unsteady: bool = False
    spread: bool = False
    smooth: int = 0


@dataclass(frozen=True)
class SegmentOptions:
    method: str = "hmm"  # haar, cbs, hmm or joint_hmm
    max_gap: int = 1_000_000
    undo: str = "none"  # none, prune or sd, for cbs
    germline: bool = True


@dataclass(frozen=True)
class CallOptions:
    highest: int = 6
    least_size: int = 10_000
    q_limit: int = 10
    merge_least: int = 50_000
    merge_span: int = 10_000
    purity: tuple[int, int] = (20, 100)


@dataclass(frozen=True)
class Options:
    clean: CleanOptions = field(default_factory=CleanOptions)
    segment: SegmentOptions = field(default_factory=SegmentOptions)
    call: CallOptions = field(default_factory=CallOptions)

    def override(self, stages: dict[str, dict]) -> Options:
        """Options with the named fields of the named stages replaced; None puts a default back."""
        out = self
        for stage, changes in stages.items():
            now = getattr(out, stage)
            plain = type(now)()
            values = {k: getattr(plain, k) if v is None else v for k, v in changes.items()}
            out = replace(out, **{stage: replace(now, **values)})
        return out


#: Ways to make a control sample from several, by name.
CONTROLS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "weighted_average": lambda sample, controls: normalization.weighted_control(controls),
    "best": lambda sample, controls: controls.join(
        F.broadcast(normalization.best_control(sample, controls).select("sample")), "sample", "left_semi"
    ).drop("sample"),
}


def clean(bins: DataFrame, options: CleanOptions) -> DataFrame:
    """Filters and GC normalization of one sample's bins."""
    if options.drop_outliers:
        bins = cleaning.drop_outliers(bins)
    if options.drop_big:
        bins = cleaning.drop_big(bins)
    if options.drop_unsteady:
        bins = cleaning.drop_unsteady(bins)
    if options.drop_rare_gc:
        bins = cleaning.drop_rare_gc(bins)
    if options.gc == "median":
        bins = cleaning.normalize_gc_median(bins)
    elif options.gc == "loess":
        bins = models.normalize_gc_loess(bins)
    if options.spread:
        bins = cleaning.normalize_gc_spread(bins)
    return stats.repeated_median(bins, "cnt", options.smooth, ["chrom"], "start_pos")


def segment(bins: DataFrame, excluded: DataFrame, options: SegmentOptions, ploidy: DataFrame | None = None) -> DataFrame:
    """Bins of samples with segment numbers; all samples share their breakpoints.

    Breakpoints of the samples are united, then excluded midpoints, gaps and changes of ploidy are
    added.
    """
    if options.method == "haar":
        starts = segmentation.segment_haar(bins, germline=options.germline)
    elif options.method == "cbs":
        starts = segmentation.segment_cbs(bins, undo=options.undo)
    elif options.method == "joint_hmm":
        starts = segmentation.state_segments(segmentation.segment_joint_hmm(bins), "state", ("chrom",))
    elif options.method == "hmm":
        starts = segmentation.state_segments(segmentation.segment_hmm(bins), "cn")
    else:
        raise ValueError(f"no segmentation called {options.method}")
    places = bins.select("chrom", "start_pos", "end_pos").distinct()
    return sg.number_segments(places, starts.select("chrom", "start_pos").distinct(), excluded, ploidy, options.max_gap)


def _points(bins: DataFrame, numbered: DataFrame, sites: DataFrame | None) -> DataFrame:
    """Segments with coverage, minor allele share and weight."""
    rows = bins.join(numbered.select("chrom", "start_pos", "seg_idx"), ["chrom", "start_pos"])
    segs = rows.groupBy("chrom", "seg_idx").agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.median("cnt").alias("coverage"), F.count(F.lit(1)).alias("bins")
    )
    if sites is None:
        return segs.withColumns({"maf": F.lit(None).cast("double"), "weight": (F.col("end_pos") - F.col("start_pos")).cast("double")})
    share = F.least("ref_count", "alt_count") / (F.col("ref_count") + F.col("alt_count"))
    deep = sites.filter("ref_count + alt_count >= 10").withColumn("share", share)
    inside = iv.points_in(deep, segs.select("chrom", "start_pos", "end_pos", "seg_idx"))
    mafs = inside.groupBy("chrom", F.col("seg_idx_r").alias("seg_idx")).agg(F.median("share").alias("maf"), F.count(F.lit(1)).alias("n"))
    joined = segs.join(mafs, ["chrom", "seg_idx"], "left")
    weight = (F.col("end_pos") - F.col("start_pos")) * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 10 + 0.1)
    return joined.withColumns({"maf": F.when(F.col("n") >= 10, F.col("maf")), "weight": weight.cast("double")}).drop("n")


def _finish(called: DataFrame, excluded: DataFrame, options: CallOptions) -> DataFrame:
    """Merge, score and filter the called segments."""
    margin = F.col("second") - F.col("distance")
    scored = called.withColumn("q", F.greatest(F.lit(1.0), F.least(F.lit(60.0), 60 * margin / F.greatest(F.col("second"), F.lit(1e-9)))))
    merged = sg.merge_calls(scored.select("chrom", "start_pos", "end_pos", "cn", "q"), options.merge_least, options.merge_span, barriers=excluded)
    tags = sg.filter_tags(F.col("q"), F.col("end_pos") - F.col("start_pos"), options.q_limit, options.least_size)
    return merged.withColumn("filters", tags)


def germline(bins: DataFrame, excluded: DataFrame, sites: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """Calls of one sample: chrom, start_pos, end_pos, cn, q, filters."""
    ready = clean(iv.overlap_anti(bins, excluded).select(bins.columns), options.clean)
    numbered = segment(ready.withColumn("sample", F.lit("sample")), excluded, options.segment)
    points = _points(ready, numbered, sites)
    diploid = ready.agg(F.median("cnt").alias("m")).first()["m"] or 1.0
    states = models.state_table(bins.sparkSession, options.call.highest)
    called = models.nearest_states(points, states, ["chrom", "seg_idx", "start_pos", "end_pos"], diploid)
    return _finish(called, excluded, options.call)


def somatic(tumour: DataFrame, excluded: DataFrame, sites: DataFrame | None = None, controls: DataFrame | None = None, control: str = "weighted_average", options: Options = Options()) -> DataFrame:
    """Calls of a tumour with estimated purity and diploid coverage; ``controls`` has a sample column."""
    bins = iv.overlap_anti(tumour, excluded).select(tumour.columns)
    if controls is not None:
        made = CONTROLS[control](bins, controls)
        bins = normalization.library_ratios(bins, made).withColumn("ploidy", F.lit(2))
        bins = normalization.ratio_to_count(bins, "ploidy").select(tumour.columns)
    ready = clean(bins, options.clean)
    numbered = segment(ready.withColumn("sample", F.lit("tumour")), excluded, options.segment)
    points = _points(ready, numbered, sites)
    middle = ready.agg(F.median("cnt").alias("m")).first()["m"] or 1.0
    spark = tumour.sparkSession
    states = models.state_table(spark, options.call.highest)
    low, high = max(1, int(0.5 * middle)), max(2, int(1.5 * middle) + 1)
    grid = models.purity_grid(spark, (low, high), options.call.purity)
    if sites is None:
        best = models.best_purity(points, grid, states).first()  # without allele shares only distances to states speak
    else:
        # clusters of segments, their coverage relative to two copies, weigh models where enough have an allele share
        relative = points.withColumn("coverage", F.col("coverage") / middle)
        clusters = models.cluster_segments(relative.withColumn("sample", F.lit("tumour")), "reclustered", by="sample")
        weighed = written(points.join(clusters, ["chrom", "start_pos"]), "usable")
        best = models.best_model(models.model_deviations(weighed, grid, states)).first()
    diploid, purity = (best["diploid"], best["purity"]) if best else (middle, 1.0)
    called = models.nearest_states(points, states, ["chrom", "seg_idx", "start_pos", "end_pos"], diploid, purity)
    # at the greatest state the depth may speak for more copies
    called = called.join(points.select("chrom", "seg_idx", "coverage"), ["chrom", "seg_idx"])
    more = quality.high_copy_number(F.col("coverage"), F.col("cn"), F.lit(2), diploid, purity, options.call.highest, 1 / diploid)
    called = called.withColumn("more", more).withColumn("cn", F.coalesce("more.cn", "cn")).drop("more", "coverage")
    shown = {"purity": F.lit(purity), "diploid": F.lit(diploid), "deviation": F.lit(best["deviation"] if best else None).cast("double")}
    return _finish(called, excluded, options.call).withColumns(shown)


def pedigree(bins: DataFrame, excluded: DataFrame, roles: dict[str, str], options: Options = Options(), highest: int = 4) -> DataFrame:
    """Joint calls of a trio's shared segments; ``roles`` names the samples as mother, father, proband."""
    trio = callers.roles_of(roles)
    if trio is None:
        raise ValueError("one mother, one father and one proband are needed")
    kept = iv.overlap_anti(bins, excluded).select(bins.columns)
    shared = normalization.in_all_samples(kept.drop("gc") if "gc" in kept.columns else kept).select("chrom", "start_pos", "end_pos")
    ready = kept.join(shared, ["chrom", "start_pos", "end_pos"], "left_semi")
    numbered = segment(ready, excluded, options.segment)
    rows = ready.join(numbered.select("chrom", "start_pos", "seg_idx"), ["chrom", "start_pos"])
    medians = rows.groupBy("sample", "chrom", "seg_idx").agg(F.median("cnt").alias("median_cnt"))
    profile = ready.groupBy("sample").agg(F.avg("cnt").alias("m"), F.var_samp("cnt").alias("v")).collect()  # a row for each sample
    spark = bins.sparkSession
    size = int(3 * max(r["m"] for r in profile)) + 2
    table = models.likelihood_table(spark, {r["sample"]: r["m"] for r in profile}, {r["sample"]: r["v"] for r in profile}, highest, size)
    depth = spark.createDataFrame([(r["sample"], r["m"]) for r in profile], "sample string, mean_depth double")
    calls = callers.trio_calls(callers.coverage_likelihoods(medians, table, depth), trio, ["chrom", "seg_idx"], highest)
    spans = numbered.groupBy("chrom", "seg_idx").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return spans.join(calls, ["chrom", "seg_idx"])


def family(bins: DataFrame, sites: DataFrame, excluded: DataFrame, mother: str, father: str, children: list[str], options: Options = Options(), highest: int = 4) -> DataFrame:
    """Phased joint calls of parents and any number of children on shared segments.

    ``bins`` and ``sites`` (ref_count, alt_count) have a sample column. One row for each segment and
    person: chrom, seg_idx, start_pos, end_pos, sample, cn, mcc, q, dq, filters. Genotypes are judged by
    a segment's sites and depth together, and by depth alone where a person has no site in it.
    """
    people = [mother, father, *children]
    kept = iv.overlap_anti(bins.filter(F.col("sample").isin(people)), excluded).select(bins.columns)
    shared = normalization.in_all_samples(kept.drop("gc") if "gc" in kept.columns else kept).select("chrom", "start_pos", "end_pos")
    ready = kept.join(shared, ["chrom", "start_pos", "end_pos"], "left_semi")
    numbered = written(segment(ready, excluded, options.segment).select("chrom", "start_pos", "end_pos", "seg_idx"), "family-segments")
    spans = numbered.groupBy("chrom", "seg_idx").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    medians = ready.join(numbered.select("chrom", "start_pos", "seg_idx"), ["chrom", "start_pos"]).groupBy("sample", "chrom", "seg_idx").agg(F.median("cnt").alias("median_cnt"))
    # a row for each person
    profile = {r["sample"]: r for r in ready.groupBy("sample").agg(F.avg("cnt").alias("m"), F.var_samp("cnt").alias("v")).collect()}
    counts = F.col("ref_count") + F.col("alt_count")
    reads = {r["sample"]: r["m"] for r in sites.filter(F.col("sample").isin(people)).groupBy("sample").agg(F.avg(counts).alias("m")).collect()}
    spark = bins.sparkSession
    size = int(3 * max(r["m"] for r in profile.values())) + 2
    table = models.likelihood_table(spark, {s: r["m"] for s, r in profile.items()}, {s: r["v"] for s, r in profile.items()}, highest, size)
    depth = spark.createDataFrame([(s, r["m"]) for s, r in profile.items()], "sample string, mean_depth double")
    key = ["sample", "chrom", "seg_idx"]
    coverage = callers.coverage_likelihoods(medians, table, depth).select(*key, "cn", "p")
    inside = iv.points_in(sites, spans).select("sample", "chrom", F.col("seg_idx_r").alias("seg_idx"), "ref_count", "alt_count")
    phased = None
    for who in people:
        own = haplotypes.depth_table(spark, max(reads.get(who, 1.0), 1.0) / 2, 20.0, highest)
        found = haplotypes.phased_likelihoods(inside.filter(F.col("sample") == who), key, own, highest)
        phased = found if phased is None else phased.unionByName(found)
    phased = written(phased, "family-phased")
    pairs = spark.createDataFrame([(a, b) for a in range(highest + 1) for b in range(highest + 1 - a)], "a int, b int")  # a dozen genotypes
    bare = medians.select(*key).join(phased.select(*key).distinct(), key, "left_anti").crossJoin(F.broadcast(pairs))
    phased = phased.unionByName(bare.select(*key, "a", "b", F.lit(0.0).alias("log_l"), F.lit(1).cast("long").alias("sites")))
    likelihoods = haplotypes.with_coverage(phased, coverage, key)
    calls = haplotypes.phased_family(likelihoods, mother, father, children, ["chrom", "seg_idx"]).drop("a", "b", "visited")
    tagged = spans.join(calls, ["chrom", "seg_idx"])
    tags = sg.filter_tags(F.col("q"), F.col("end_pos") - F.col("start_pos"), options.call.q_limit, options.call.least_size)
    return tagged.withColumn("filters", tags)


def evaluate(truth: DataFrame, calls: DataFrame, excluded: DataFrame, by_size: bool = False) -> DataFrame:
    """Accuracy of calls against the truth, whole or by size stratum of the truth."""
    if not by_size:
        return evaluation.metrics(evaluation.confusion(truth, calls, excluded))
    sized = truth.withColumn("stratum", evaluation.stratum(F.col("end_pos") - F.col("start_pos")))
    return evaluation.metrics(evaluation.confusion(sized, calls, excluded, by=["stratum"]), by=["stratum"])
