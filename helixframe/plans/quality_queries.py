"""Registered queries of qualities, predictors, model segments, allosomes and tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import binning, cleaning, evaluation, quality
from helixframe.operators import segments as sg
from helixframe.plans.count_queries import CUBE, ploidy
from helixframe.plans.interval_queries import MERGED
from helixframe.plans.segment_queries import TILED, tiled
from helixframe.sources import adapters as ad
from helixframe.sources.adapters import sql

QUERIES, ORACLES = {}, {}

#: Windows of bins as segments with their counts and the allele shares of the sites inside.
WINDOWS = """, w AS (SELECT chrom, start_pos // 20000 * 20000 AS start_pos, list(cnt ORDER BY start_pos) AS counts FROM bins GROUP BY 1, 2),
    v AS (SELECT chrom, pos // 20000 * 20000 AS start_pos, list(alt_count / (ref_count + alt_count) ORDER BY pos, alt_count, ref_count) AS freqs FROM sites WHERE ref_count + alt_count > 0 GROUP BY 1, 2),
    seg AS (SELECT w.chrom, w.start_pos, w.start_pos + CASE WHEN len(counts) > 1 THEN 20000 ELSE 4000 END AS end_pos, counts, coalesce(freqs, []) AS freqs,
        CAST(len(counts) * 3 % 19 AS INT) AS cn, CASE WHEN len(counts) % 3 > 0 THEN CAST(len(counts) % 3 AS INT) END AS mcc,
        len(counts) / 8.0 AS distance, len(counts) % 2 / 2.0 AS runner_up FROM w LEFT JOIN v USING (chrom, start_pos)),
    m AS (SELECT *, CASE WHEN len(counts) > 0 THEN list_avg(counts) ELSE 0 END AS bin_mean, CASE WHEN len(freqs) > 0 THEN list_avg(freqs) ELSE 0 END AS maf_mean FROM seg),
    p AS (SELECT *, log10(1 + len(counts)) AS log_bin_count, CASE WHEN len(counts) > 1 AND bin_mean != 0 THEN list_stddev_samp(counts) / bin_mean ELSE 0 END AS bin_cv,
        CASE WHEN len(freqs) > 1 AND maf_mean != 0 THEN list_stddev_samp(freqs) / maf_mean ELSE 0 END AS maf_cv, CASE WHEN cn >= 15 THEN log10(1 + len(counts)) ELSE 0 END AS amplified_bins,
        distance / greatest(1.0, cn - 4.0) AS model_distance, CASE WHEN runner_up = 0 THEN 0 ELSE distance / runner_up END AS distance_ratio,
        coalesce(CAST(mcc AS DOUBLE), ceil(cn / 2)) AS major_count FROM m)"""


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def windows(spark, sf_dir):
    bins, sites = ad.bins(spark, sf_dir), ad.sites(spark, sf_dir).filter("ref_count + alt_count > 0")
    w = bins.groupBy("chrom", F.expr("start_pos div 20000 * 20000").alias("start_pos")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "cnt"))), lambda x: x["cnt"]).alias("counts")
    )
    v = sites.groupBy("chrom", F.expr("pos div 20000 * 20000").alias("start_pos")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "alt_count", "ref_count"))), lambda x: x["alt_count"] / (x["ref_count"] + x["alt_count"])).alias("freqs")
    )
    n = F.size("counts")
    return w.join(v, ["chrom", "start_pos"], "left").select(
        "chrom", "start_pos", (F.col("start_pos") + F.when(n > 1, 20000).otherwise(4000)).alias("end_pos"), "counts",
        F.coalesce("freqs", F.array().cast("array<double>")).alias("freqs"), (n * 3 % 19).alias("cn"), F.when(n % 3 > 0, n % 3).alias("mcc"),
        (n / 8).alias("distance"), (n % 2 / 2).alias("runner_up"),
    )


@query("c13_quality_predictors", sql(WINDOWS + """ SELECT chrom, start_pos, CAST(len(counts) AS DOUBLE) AS bin_count, CAST(len(freqs) AS DOUBLE) AS maf_count, round(log_bin_count, 6) AS log_bin_count, round(bin_mean, 6) AS bin_mean,
    round(bin_cv, 6) AS bin_cv, round(maf_mean, 6) AS maf_mean, round(maf_cv, 6) AS maf_cv, round(log10(1 + maf_cv), 6) AS log_maf_cv, round(amplified_bins, 6) AS amplified_bins, round(model_distance, 6) AS model_distance,
    runner_up AS runner_up_distance, round(distance_ratio, 6) AS distance_ratio, CAST(cn AS DOUBLE) AS copy_number, major_count FROM p""", "bins", "sites"))
def c13(spark, sf_dir):
    """The fourteen predictors of a segment's quality."""
    out = quality.predictors(windows(spark, sf_dir))
    exact = ["bin_count", "maf_count", "runner_up_distance", "copy_number", "major_count"]
    near = ["log_bin_count", "bin_mean", "bin_cv", "maf_mean", "maf_cv", "log_maf_cv", "amplified_bins", "model_distance", "distance_ratio"]
    return out.select("chrom", "start_pos", *exact, *[F.round(c, 6).alias(c) for c in near])


@query("c12_quality_scores", sql(WINDOWS + """, s AS (SELECT chrom, start_pos, len(counts) AS n, exp(0.3 + 1.1 * log_bin_count - 0.4 * model_distance - 0.2 * distance_ratio) AS o,
        -2.0 + 0.1 * log_bin_count + 0.2 * model_distance + 0.05 * major_count - 0.3 * maf_mean - 0.1 * log10(1 + maf_cv) + amplified_bins AS l, amplified_bins FROM p),
    f AS (SELECT *, -10 * log10(1 - o / (o + 1)) AS g, -10 * log10(1 - o * exp(amplified_bins) / (o * exp(amplified_bins) + 1)) AS h FROM s)
    SELECT chrom, start_pos, CAST(greatest(2, least(40, round_even(g, 0))) AS INT) AS q_germline, CAST(greatest(2, least(60, round_even(h, 0))) AS INT) AS q_logistic,
        CASE WHEN n >= 100 THEN 61 ELSE CAST(round(-10 * log10(1 - 1 / (1 + exp(0.5532 - n * 0.147))), 0) AS INT) END AS q_bins, CAST(round(greatest(2, least(61, -11.9 - 11.4 * l)), 0) AS INT) AS q_linear FROM f""", "bins", "sites"))
def c12(spark, sf_dir):
    """Four forms of a segment's quality."""
    rows = quality.predictors(windows(spark, sf_dir))
    logistic = {"log_bin_count": 1.1, "model_distance": -0.4, "distance_ratio": -0.2}
    general = {"log_bin_count": 0.1, "model_distance": 0.2, "major_count": 0.05, "maf_mean": -0.3, "log_maf_cv": -0.1, "amplified_bins": 1.0}
    return rows.select(
        "chrom", "start_pos", quality.logistic_quality(logistic, 0.3, most=40).alias("q_germline"),
        quality.logistic_quality(logistic | {"amplified_bins": 1.0}, 0.3).alias("q_logistic"), quality.bin_count_quality().alias("q_bins"),
        quality.linear_quality(general, -2.0).alias("q_linear"),
    )


@query("f14_usable_segments", sql(WINDOWS + """, o AS (SELECT median(cnt) AS overall FROM bins),
    u AS (SELECT chrom, start_pos, end_pos - start_pos AS len, list_median(counts) AS coverage, len(freqs) AS n, list_sort(list_transform(freqs, lambda f: CASE WHEN f > 0.5 THEN 1 - f ELSE f END)) AS f FROM seg)
    SELECT chrom, start_pos, coverage, round(CASE WHEN n >= 5 THEN f[n // 2 + 1] END, 9) AS maf, round(len * least(1, n / 10), 6) AS weight FROM u, o WHERE len >= 5000 AND coverage <= 2 * overall""", "bins", "sites"))
def f14(spark, sf_dir):
    """Segments that the somatic model is fitted to."""
    overall = ad.bins(spark, sf_dir).agg(F.median("cnt")).first()[0]
    out = quality.usable_segments(windows(spark, sf_dir), 5, overall)
    return out.select("chrom", "start_pos", "coverage", F.round("maf", 9).alias("maf"), F.round("weight", 6).alias("weight"))


@query("f16_pruned_frequencies", sql(WINDOWS + """, f AS (SELECT chrom, start_pos, list_transform(freqs, lambda f: CASE WHEN f > 0.5 THEN 1 - f ELSE f END) AS f FROM seg),
    s AS (SELECT *, len(list_filter(f, lambda x: x > 0)) > 0.1 * len(f) OR len(list_filter(f, lambda x: x >= 0.2)) > 0 AS signal FROM f),
    k AS (SELECT chrom, start_pos, CASE WHEN signal THEN list_filter(f, lambda x: x > 0.1) ELSE f END AS kept FROM s)
    SELECT chrom, start_pos, CAST(len(kept) AS INT) AS n, round(coalesce(list_sum(kept), 0), 6) AS total FROM k""", "bins", "sites"))
def f16(spark, sf_dir):
    """Allele shares of segments after pruning (F16)."""
    rows = windows(spark, sf_dir).withColumn("kept", quality.pruned_frequencies(F.col("freqs")))
    return rows.select("chrom", "start_pos", F.size("kept").alias("n"), F.round(F.aggregate("kept", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("c08_diploid_frequency", sql("SELECT chrom, start_pos, round(0.5 - 1 / (3.352 * pow(cnt, 0.4747)), 9) AS maf FROM bins WHERE cnt > 0", "bins"))
def c08(spark, sf_dir):
    """Expected minor allele share at a depth."""
    return ad.bins(spark, sf_dir).filter("cnt > 0").select("chrom", "start_pos", F.round(quality.expected_diploid_frequency(F.col("cnt")), 9).alias("maf"))


@query("c09_folded_frequency", sql(""", d AS (SELECT DISTINCT cnt, cnt * (gc - 39) / 24.0 AS minor FROM bins WHERE cnt > 0),
    t AS (SELECT cnt, minor, unnest(range(0, CAST(floor(cnt) AS BIGINT) + 1)) AS i FROM d)
    SELECT cnt, minor, round(sum(least(i, cnt - i) * exp(lgamma(floor(cnt) + 1) - lgamma(i + 1) - lgamma(floor(cnt) - i + 1) + i * ln(minor / cnt) + (floor(cnt) - i) * ln(1 - minor / cnt))) / cnt, 6) AS maf FROM t GROUP BY 1, 2""", "bins"))
def c09(spark, sf_dir):
    """Expected share of the lesser allele count."""
    rows = ad.bins(spark, sf_dir).filter("cnt > 0").select("cnt", (F.col("cnt") * (F.col("gc") - 39) / 24.0).alias("minor")).distinct()
    return rows.select("cnt", "minor", F.round(quality.folded_frequency(F.col("minor"), F.col("cnt")), 6).alias("maf"))


@query("p05_high_copies", sql(""", e AS (SELECT chrom, start_pos, cnt, CAST(round_even((2 * cnt / 6.0 - 2 * 0.4) / 0.6, 0) AS INT) AS cn FROM bins)
    SELECT chrom, start_pos, cn, round(abs(cnt - 6.0 * (0.4 + 0.6 * cn / 2)) * 0.5, 6) AS distance FROM e WHERE cn > 8""", "bins"))
def p05(spark, sf_dir):
    """Copy numbers beyond the greatest state from depth and purity."""
    found = quality.high_copy_number(F.col("cnt"), F.lit(8), F.lit(2), 6.0, 0.6, 8, 0.5)
    rows = ad.bins(spark, sf_dir).withColumn("more", found).filter("more is not null")
    return rows.select("chrom", "start_pos", "more.cn", F.round("more.distance", 6).alias("distance"))


@query("m34_heterogeneous_calls", sql(WINDOWS + """, h AS (SELECT chrom, start_pos, 2 AS cn, 1 + len(counts) % 4 AS second_cn, CAST(len(counts) % 2 + 1 AS INT) AS mcc, 0.61 + len(counts) / 40.0 AS distance, 1.0 AS runner_up, 1 / (1 + exp(-(2.0 - 0.6 * len(counts)))) < 0.5 AS het FROM seg),
    s AS (SELECT *, het AND distance / runner_up > 0.7 AND second_cn IN (1, 3) AS swapped FROM h)
    SELECT chrom, start_pos, het AS heterogeneous, swapped, CAST(CASE WHEN swapped THEN second_cn ELSE cn END AS INT) AS cn, CAST(CASE WHEN swapped THEN cn ELSE second_cn END AS INT) AS second_cn, CAST(CASE WHEN swapped THEN 2 ELSE mcc END AS INT) AS mcc FROM s""", "bins", "sites"))
def m34(spark, sf_dir):
    """Heterogeneity by a logistic score and the swap of diploid calls."""
    n = F.size("counts")
    rows = windows(spark, sf_dir).withColumn("n", n.cast("double")).select(
        "chrom", "start_pos", F.lit(2).alias("cn"), (1 + n % 4).alias("second_cn"), (n % 2 + 1).alias("mcc"), (0.61 + n / 40).alias("distance"),
        F.lit(1.0).alias("runner_up"), quality.heterogeneous(quality.clonality({"n": -0.6}, 2.0)).alias("heterogeneous"),
    )
    out = quality.swap_states(rows, 0.6, 0.7)
    return out.select("chrom", "start_pos", "heterogeneous", "swapped", "cn", "second_cn", "mcc")


#: The last contig of the view stands for a sex chromosome.
AUTOSOMES = ("chr1", "chr2", "chr3", "chr4")


@query("f17_autosomal_bins", sql("SELECT chrom, count(*) AS bins FROM bins WHERE chrom != 'chr5' GROUP BY 1", "bins"))
def f17(spark, sf_dir):
    """Bins of autosomes."""
    return cleaning.autosomal(ad.bins(spark, sf_dir), AUTOSOMES).groupBy("chrom").agg(F.count(F.lit(1)).alias("bins"))


@query("f09_rare_gc_autosomes", sql("""
    SELECT * FROM tiles WHERE gc IN (SELECT gc FROM tiles WHERE chrom != 'chr5' GROUP BY gc HAVING count(*) >= least(100, greatest(10, (SELECT count(*) FROM tiles WHERE chrom != 'chr5') // 101)))""", "tiles"))
def f09(spark, sf_dir):
    """Bins of GC classes with enough autosomal bins."""
    return cleaning.drop_rare_gc(ad.tiles(spark, sf_dir), autosomes=AUTOSOMES)


@query("a11_counts_by_gc", sql("SELECT gc, count(*) AS bins, median(cnt) AS median_cnt FROM tiles t WHERE chrom != 'chr5' AND EXISTS (SELECT 1 FROM truth x WHERE x.chrom = t.chrom AND x.start_pos < t.end_pos AND t.start_pos < x.end_pos) GROUP BY 1", "tiles", "intervals"))
def a11(spark, sf_dir):
    """Counts of autosomal bins on target by GC class."""
    return cleaning.counts_by_gc(ad.tiles(spark, sf_dir), AUTOSOMES, ad.intervals(spark, sf_dir, "O"))


@query("a26_expected_count", sql("SELECT median(cnt) AS expected FROM bins WHERE chrom != 'chr5'", "bins"))
def a26(spark, sf_dir):
    """Median count of autosomal bins."""
    return cleaning.autosomal(ad.bins(spark, sf_dir), AUTOSOMES).agg(F.median("cnt").alias("expected"))


@query("a06_autosomal_rate", sql(""", u AS (SELECT DISTINCT sample, chrom, pos FROM alignments WHERE chrom != 'chr5'),
    r AS (SELECT sample, chrom, count(*) / (SELECT max(end_pos) FROM bins) AS rate FROM u GROUP BY 1, 2) SELECT CAST(floor(100 / median(rate)) AS INT) AS bin_size FROM r""", "alignments", "bins"))
def a06(spark, sf_dir):
    """Bin size from the autosomes' median hit rate."""
    reads = cleaning.autosomal(ad.alignments(spark, sf_dir), AUTOSOMES).select("sample", "chrom", "pos").distinct()
    bases = ad.bins(spark, sf_dir).agg(F.max("end_pos").alias("bases"))
    possible = ad.bins(spark, sf_dir).select("chrom").distinct().join(F.broadcast(bases))  # one row
    return binning.bin_size(binning.hit_rates(reads, possible, ["sample", "chrom"]))


@query("a36_trimmed_variance", sql(f""", d AS (SELECT sample, abs(cnt - lag(cnt) OVER (PARTITION BY sample ORDER BY chrom, start_pos)) AS d FROM sample_bins),
    r AS (SELECT sample, d, row_number() OVER (PARTITION BY sample ORDER BY d) AS n, count(*) OVER (PARTITION BY sample) AS all_ FROM d WHERE d IS NOT NULL)
    SELECT sample, round({stats.inflation(0.025)} * sum(d * d) / (2 * max(k)), 5) AS variance FROM (SELECT *, round_even(0.95 * all_, 0) AS k FROM r) WHERE n <= k GROUP BY 1""", "sample_bins"))
def a36(spark, sf_dir):
    """Variance from trimmed differences of neighbours."""
    out = stats.trimmed_variance(ad.sample_bins(spark, sf_dir), "cnt", ["sample"], ["chrom", "start_pos"])
    return out.select("sample", F.round("variance", 5).alias("variance"))


@query("a39_normalized_tracks", sql(""", f AS (SELECT 2 / median(cnt) AS f FROM bins),
    s AS (SELECT chrom, start_pos // 20000 AS seg, min(start_pos) AS start_pos, max(end_pos) AS end_pos, median(cnt) AS m FROM bins GROUP BY 1, 2)
    SELECT 'bin' AS track, chrom, start_pos, end_pos, round(cnt * f, 6) AS value FROM bins, f UNION ALL SELECT 'segment', chrom, start_pos, end_pos, round(m * f, 6) FROM s, f""", "bins"))
def a39(spark, sf_dir):
    """Coverage tracks of bins and of segments, times a factor."""
    bins = ad.bins(spark, sf_dir).withColumn("seg", F.expr("start_pos div 20000"))
    factor = bins.agg((2 / F.median("cnt")).alias("factor"))
    out = sg.normalized_track(bins, factor).withColumn("track", F.lit("bin")).unionByName(
        sg.normalized_track(bins, factor, ["chrom", "seg"]).withColumn("track", F.lit("segment"))
    )
    return out.withColumn("value", F.round("value", 6))


@query("j18_common_segments", sql(""", n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_pos) - 1 AS i FROM bins),
    c AS (SELECT DISTINCT chrom, CAST(cn * 3 AS BIGINT) AS a, CAST(cn * 3 + 4 AS BIGINT) AS b FROM excl),
    j AS (SELECT c.chrom, a, count(*) FILTER (WHERE i < b) AS bins, min(start_pos) AS start_pos, max(end_pos) AS end_pos, median(cnt) FILTER (WHERE i < b) AS median_cnt, count(*) AS n, any_value(b - a + 1) AS want FROM c JOIN n ON n.chrom = c.chrom AND i BETWEEN a AND b GROUP BY 1, 2)
    SELECT chrom, a AS first_bin, start_pos, end_pos, bins, median_cnt FROM j WHERE n = want""", "bins", "intervals"))
def j18(spark, sf_dir):
    """Segments of common variants given by numbers of bins."""
    common = ad.intervals(spark, sf_dir, "P").select("chrom", (F.col("cn") * 3).cast("long").alias("first_bin"), (F.col("cn") * 3 + 4).cast("long").alias("last_bin")).distinct()
    return sg.common_segments(ad.bins(spark, sf_dir), common)


@query("t05_distance_cutoff", sql("""
    SELECT chrom, (list(cnt ORDER BY cnt))[CAST(least(round_even(count(*) * 0.99, 0), count(*) - 1) AS BIGINT) + 1] AS cutoff FROM tiles GROUP BY 1""", "tiles"))
def t05(spark, sf_dir):
    """The value at 99 percent of the sorted ones, as the cutoff of nearest distances."""
    return stats.rounded_index(ad.tiles(spark, sf_dir), "cnt", 0.99, ["chrom"], "cutoff")


@query("t09_worst_intervals", sql("""
    , p AS (SELECT t.iv_id, t.cn, t.end_pos - t.start_pos AS len, coalesce(sum(least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos)) FILTER (WHERE c.cn = t.cn), 0) AS hit,
        coalesce(sum(least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos)) FILTER (WHERE c.cn != t.cn), 0) AS wrong FROM truth t LEFT JOIN calls c ON c.chrom = t.chrom AND c.start_pos < t.end_pos AND t.start_pos < c.end_pos GROUP BY 1, 2, 3),
    r AS (SELECT cn, iv_id, len - hit AS missed, wrong, row_number() OVER (PARTITION BY cn ORDER BY len - hit DESC, iv_id) AS a, row_number() OVER (PARTITION BY cn ORDER BY wrong DESC, iv_id) AS b FROM p)
    SELECT cn, max(iv_id) FILTER (WHERE a = 1) AS most_missed, max(missed) AS missed, max(iv_id) FILTER (WHERE b = 1) AS most_wrong, max(wrong) AS wrong FROM r GROUP BY 1""", "intervals"))
def t09(spark, sf_dir):
    """Known intervals with the most missed and the most wrongly called bases."""
    return evaluation.worst_intervals(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "F"))


@query("f19_least_size", sql("SELECT st, count(*) AS n, sum(end_pos - start_pos) AS bases FROM intervals WHERE st IN ('O', 'F') AND end_pos - start_pos >= 500 GROUP BY 1", "intervals"))
def f19(spark, sf_dir):
    """Known and called intervals of a least size."""
    kept = evaluation.of_least_size(ad.intervals(spark, sf_dir).filter("st in ('O', 'F')"), 500)
    return kept.groupBy("st").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


@query("f01_start_reads", sql("""SELECT sample, chrom, count(*) AS reads FROM alignments WHERE read_id % 16 != 0 AND NOT is_dup AND is_forward AND mate % 7 != 0 AND frag_len >= 135 AND (mate <= 3 OR read_id % 3 > 0) GROUP BY 1, 2""", "alignments"))
def f01(spark, sf_dir):
    """Reads that count by unique starts: mapped, passed, single, forward, primary, first block long, well paired."""
    reads = ad.alignments(spark, sf_dir).select(
        "sample", "chrom", "is_dup", "is_forward", (F.col("read_id") % 16 != 0).alias("is_pass"), (F.col("mate") % 7 != 0).alias("is_primary"),
        (F.col("mate") > 3).alias("is_paired"), (F.col("read_id") % 3 > 0).alias("is_proper"), F.array(F.struct(F.lit("M").alias("op"), (F.col("frag_len") - 100).alias("len"))).alias("cigar"),
    )
    return reads.filter(binning.start_read()).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("reads"))


@query("f02_fragment_reads", sql("SELECT sample, chrom, count(*) AS reads FROM alignments WHERE NOT is_dup AND mate % 7 != 0 AND read_id % 3 > 0 AND read_id % 16 != 0 AND mapq >= 3 AND mapq != 255 GROUP BY 1, 2", "alignments"))
def f02(spark, sf_dir):
    """Reads whose fragments count: both mapped, primary, well paired, of quality."""
    reads = ad.alignments(spark, sf_dir).select(
        "sample", "chrom", "is_dup", "mapq", (F.col("read_id") % 16 != 0).alias("is_pass"), (F.col("mate") % 7 != 0).alias("is_primary"), (F.col("read_id") % 3 > 0).alias("is_proper"),
    )
    return reads.filter(binning.fragment_read()).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("reads"))


@query("f04_pileup_bases", sql("SELECT sample, chrom, count(*) AS bases FROM alignments WHERE NOT is_dup AND mate % 7 != 0 AND mapq > 3 AND read_id % 41 >= 20 GROUP BY 1, 2", "alignments"))
def f04(spark, sf_dir):
    """Bases that count in a pileup: primary reads, not duplicate, of mapping and base quality."""
    reads = ad.alignments(spark, sf_dir).select("sample", "chrom", "is_dup", "mapq", (F.col("mate") % 7 != 0).alias("is_primary"), (F.col("read_id") % 41).alias("base_q"))
    return reads.filter(binning.pileup_base(3)).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("bases"))


@query("k04_sample_columns", sql("""
    SELECT chrom, start_pos, max(cnt) FILTER (WHERE sample = 's0') AS s0, max(cnt) FILTER (WHERE sample = 's1') AS s1, max(cnt) FILTER (WHERE sample = 's2') AS s2 FROM sample_bins GROUP BY 1, 2""", "sample_bins"))
def k04(spark, sf_dir):
    """Rows of samples to a column for each sample, as a record of several samples has."""
    rows = ad.sample_bins(spark, sf_dir).select("sample", "chrom", "start_pos", "cnt")
    return rows.groupBy("chrom", "start_pos").pivot("sample", ["s0", "s1", "s2"]).agg(F.first("cnt"))


#: The reference ploidy of each truth interval, and the cube of bases with it as its third axis.
PLOIDY_CUBE = CUBE + """, ploidy AS (SELECT chrom, start_pos, end_pos, cn FROM tiles WHERE gc % 2 = 0 QUALIFY row_number() OVER (PARTITION BY chrom, start_pos ORDER BY gc, cn) = 1),
    ro AS (SELECT t.iv_id, any_value(t.end_pos - t.start_pos) AS len, coalesce(sum(least(t.end_pos, p.end_pos) - greatest(t.start_pos, p.start_pos)) FILTER (WHERE p.chrom IS NOT NULL), 0) AS n,
        coalesce(sum((least(t.end_pos, p.end_pos) - greatest(t.start_pos, p.start_pos)) * p.cn) FILTER (WHERE p.chrom IS NOT NULL), 0) AS w
        FROM truth t LEFT JOIN ploidy p ON t.chrom = p.chrom AND t.start_pos < p.end_pos AND p.start_pos < t.end_pos GROUP BY 1),
    rp AS (SELECT iv_id, least(2, CAST(round_even((w + 2 * (len - n)) / len, 0) AS INT)) AS ref_ploidy FROM ro),
    cube3 AS (SELECT known_cn, call_cn, ref_ploidy, sum(bases) AS bases FROM open_ JOIN rp USING (iv_id) GROUP BY 1, 2, 3
        UNION ALL SELECT known_cn, NULL, ref_ploidy, sum(w.bases - coalesce(s.seen, 0)) FROM whole w LEFT JOIN seen s USING (iv_id) JOIN rp USING (iv_id) GROUP BY 1, 3)"""


def ploidy_cube(spark, sf_dir):
    truth = ad.intervals(spark, sf_dir, "O")
    ref = evaluation.reference_ploidy(truth, ploidy(spark, sf_dir)).select("iv_id", F.least(F.lit(2), "ref_ploidy").alias("ref_ploidy"))
    return evaluation.confusion(truth.join(ref, "iv_id"), ad.intervals(spark, sf_dir, "F"), ad.intervals(spark, sf_dir, "P"), by=["ref_ploidy"])


@query("e01_ploidy_cube", sql(PLOIDY_CUBE + " SELECT * FROM cube3 WHERE bases > 0", "tiles", "intervals"))
def e01_ploidy(spark, sf_dir):
    """Bases by known and called copy number and reference ploidy up to 2."""
    return ploidy_cube(spark, sf_dir)


@query("e02_allosome_metrics", sql(PLOIDY_CUBE + """, s AS (SELECT coalesce(sum(bases) FILTER (WHERE call_cn IS NOT NULL), 0) AS all_, coalesce(sum(bases) FILTER (WHERE call_cn = known_cn), 0) AS ok,
    coalesce(sum(bases) FILTER (WHERE known_cn != ref_ploidy), 0) AS ka, coalesce(sum(bases) FILTER (WHERE call_cn != ref_ploidy), 0) AS ca, coalesce(sum(bases) FILTER (WHERE known_cn != ref_ploidy AND call_cn != ref_ploidy AND call_cn = known_cn), 0) AS hit,
    coalesce(sum(bases) FILTER (WHERE known_cn > ref_ploidy), 0) AS ga, coalesce(sum(bases) FILTER (WHERE known_cn > ref_ploidy AND call_cn = known_cn), 0) AS gh FROM cube3)
    SELECT CASE WHEN all_ > 0 THEN round(100 * ok / all_, 6) END AS accuracy, CASE WHEN ka > 0 THEN round(100 * hit / ka, 6) END AS recall, CASE WHEN ca > 0 THEN round(100 * hit / ca, 6) END AS precision,
        CASE WHEN ga > 0 THEN round(100 * gh / ga, 6) END AS gain_recall FROM s""", "tiles", "intervals"))
def e02_ploidy(spark, sf_dir):
    """Accuracy against each interval's own reference ploidy."""
    return evaluation.metrics(ploidy_cube(spark, sf_dir), F.col("ref_ploidy")).select("accuracy", "recall", "precision", "gain_recall")


@query("e02_region_metrics", sql(TILED + """, roi AS (SELECT chrom, start_pos, end_pos FROM tiled WHERE cn != 1), """ + MERGED.format("roi", 0) + """,
    clipped AS (SELECT t.iv_id || ':' || greatest(t.start_pos, r.start_pos) AS iv_id, t.chrom, greatest(t.start_pos, r.start_pos) AS start_pos, least(t.end_pos, r.end_pos) AS end_pos, t.cn
        FROM truth t JOIN m_roi r ON t.chrom = r.chrom AND t.start_pos < r.end_pos AND r.start_pos < t.end_pos)""" + CUBE.replace("truth t", "clipped t") + """,
    s AS (SELECT coalesce(sum(bases) FILTER (WHERE call_cn IS NOT NULL), 0) AS all_, coalesce(sum(bases) FILTER (WHERE call_cn = known_cn), 0) AS ok,
        coalesce(sum(bases) FILTER (WHERE sign(call_cn - 2) = sign(known_cn - 2)), 0) AS side FROM cube)
    SELECT CASE WHEN all_ > 0 THEN round(100 * ok / all_, 6) END AS accuracy, CASE WHEN all_ > 0 THEN round(100 * side / all_, 6) END AS direction_accuracy FROM s""", "tiles", "intervals"))
def e02_regions(spark, sf_dir):
    """Accuracy inside regions of interest."""
    inside = evaluation.in_regions(ad.intervals(spark, sf_dir, "O"), tiled(spark, sf_dir).filter("cn != 1"))
    found = evaluation.confusion(inside, ad.intervals(spark, sf_dir, "F"), ad.intervals(spark, sf_dir, "P"))
    return evaluation.metrics(found).select("accuracy", "direction_accuracy")
