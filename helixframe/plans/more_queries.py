"""Registered queries of sample metrics, scalar functions, vectors and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import callers
from helixframe.operators import intervals as iv
from helixframe.operators import segments as sg
from helixframe.plans.interval_queries import MERGED
from helixframe.plans.segment_queries import FAMILY, TILED, family, tiled
from helixframe.sources import adapters as ad
from helixframe.sources import files
from helixframe.sources.adapters import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


@query("j16_common_alternatives", sql("""
    , common AS (SELECT DISTINCT chrom, start_pos, end_pos FROM excl WHERE end_pos - start_pos >= 400),
    pairs AS (SELECT c.iv_id, c.chrom, c.start_pos, c.end_pos, x.start_pos AS cs, x.end_pos AS ce FROM calls c JOIN common x ON c.chrom = x.chrom AND c.start_pos < x.end_pos AND x.start_pos < c.end_pos),
    points AS (SELECT DISTINCT iv_id, chrom, end_pos, p FROM (SELECT iv_id, chrom, start_pos, end_pos, unnest([cs, ce]) AS p FROM pairs) WHERE p > start_pos + 50 AND p < end_pos - 50
        UNION SELECT iv_id, chrom, end_pos, start_pos FROM pairs)
    SELECT iv_id AS seg_id, chrom, 'B' AS alt, p AS start_pos, coalesce(lead(p) OVER (PARTITION BY iv_id ORDER BY p), end_pos) AS end_pos FROM points
    UNION ALL SELECT DISTINCT iv_id, chrom, 'A', start_pos, end_pos FROM pairs
    UNION ALL SELECT NULL, x.chrom, 'B', x.start_pos, x.end_pos FROM common x WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.chrom = x.chrom AND c.start_pos < x.end_pos AND x.start_pos < c.end_pos)""", "intervals"))
def j16(spark, sf_dir):
    """Layouts of called segments with and without the borders of common variants."""
    calls = ad.intervals(spark, sf_dir, "F").withColumnRenamed("iv_id", "seg_id")
    return sg.common_alternatives(calls, ad.intervals(spark, sf_dir, "P"), tolerance=50, least=400)


@query("j16_merged_common", sql(f"""
    , {MERGED.format('calls', 0)}, {MERGED.format('excl', 0)},
    known AS (SELECT chrom, start_pos, end_pos FROM m_excl WHERE end_pos - start_pos >= 400),
    alike AS (SELECT c.chrom, c.start_pos, c.end_pos, x.start_pos AS cs, x.end_pos AS ce FROM m_calls c JOIN known x ON c.chrom = x.chrom AND (c.start_pos = x.start_pos AND c.end_pos = x.end_pos
        OR abs(c.start_pos - x.start_pos) < 150 AND abs(c.end_pos - x.end_pos) < 150 AND x.end_pos - x.start_pos > 600)),
    c1 AS (SELECT chrom, start_pos, end_pos FROM m_calls c WHERE NOT EXISTS (SELECT 1 FROM alike a WHERE a.chrom = c.chrom AND a.start_pos = c.start_pos AND a.end_pos = c.end_pos)),
    k1 AS (SELECT * FROM known k WHERE NOT EXISTS (SELECT 1 FROM alike a WHERE a.chrom = k.chrom AND a.cs = k.start_pos AND a.ce = k.end_pos)),
    ln AS (SELECT c.*, k.start_pos AS ks, k.end_pos AS ke FROM c1 c JOIN k1 k ON c.chrom = k.chrom AND least(c.end_pos, k.end_pos) - greatest(c.start_pos, k.start_pos) > 10),
    cut AS (SELECT chrom, start_pos, end_pos, max(ke) AS p FROM ln a WHERE ks <= start_pos AND ke < end_pos AND EXISTS (SELECT 1 FROM ln b WHERE b.chrom = a.chrom AND b.ks = a.ks AND b.ke = a.ke AND b.start_pos < b.ks) GROUP BY 1, 2, 3),
    c2 AS (SELECT chrom, start_pos, coalesce(p, end_pos) AS end_pos FROM c1 LEFT JOIN cut USING (chrom, start_pos, end_pos) UNION ALL SELECT chrom, p, end_pos FROM cut),
    u AS (SELECT *, false AS is_common FROM c2 UNION ALL SELECT *, true FROM k1),
    o AS (SELECT *, CASE WHEN coalesce(least(max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, is_common ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), end_pos) - start_pos <= 10
        OR row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, is_common) = 1, true) THEN start_pos END AS r FROM u),
    g AS (SELECT chrom, max(r) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos, is_common ROWS UNBOUNDED PRECEDING) AS region, start_pos, end_pos, is_common FROM o),
    h AS (SELECT g.chrom, region, g.start_pos, g.end_pos, min(k.start_pos) AS low, max(k.end_pos) AS high, count(*) AS n FROM g JOIN k1 k ON g.chrom = k.chrom AND least(g.end_pos, k.end_pos) - greatest(g.start_pos, k.start_pos) > 10 WHERE NOT is_common GROUP BY 1, 2, 3, 4)
    SELECT chrom, region, CASE WHEN is_common THEN 'B' ELSE 'A' END AS alt, start_pos, end_pos, is_common FROM g
    UNION ALL SELECT chrom, region, 'B', start_pos, low, false FROM h WHERE start_pos < low
    UNION ALL SELECT chrom, region, 'B', high, end_pos, false FROM h WHERE n = 1 AND high < end_pos
    UNION ALL SELECT chrom, cs, 'B', cs, ce, true FROM (SELECT DISTINCT chrom, cs, ce FROM alike)""", "intervals"))
def j16_merged(spark, sf_dir):
    """Regions of calls and common variants with the layouts to choose from."""
    calls, common = (iv.merge_intervals(ad.intervals(spark, sf_dir, st)) for st in "FP")
    return sg.merge_common(calls, common, tolerance=150, least=400)


@query("p19_best_alternative", sql(TILED + """, s AS (SELECT chrom, start_pos // 10000 AS region, CASE WHEN cn % 2 = 0 THEN 'A' ELSE 'B' END AS alt, round(sum(ln(q + 1)), 6) AS log_l FROM tiled GROUP BY 1, 2, 3)
    SELECT chrom, region, alt, log_l FROM (SELECT *, row_number() OVER (PARTITION BY chrom, region ORDER BY log_l DESC, alt) AS n FROM s) WHERE n = 1""", "tiles"))
def p19(spark, sf_dir):
    """The likelier of two sets of segments in a region."""
    rows = tiled(spark, sf_dir).select("chrom", F.expr("start_pos div 10000").alias("region"), F.when(F.col("cn") % 2 == 0, "A").otherwise("B").alias("alt"), F.ln(F.col("q") + 1).alias("log_l"))
    rows = rows.groupBy("chrom", "region", "alt").agg(F.round(F.sum("log_l"), 6).alias("log_l"))
    return callers.best_alternative(rows, ["chrom", "region"])


@query("a25_trimmed_sites", sql("""
    , l AS (SELECT chrom, pos // 20000 AS seg, list(alt_count ORDER BY pos) AS v FROM sites GROUP BY 1, 2)
    SELECT chrom, seg, len(v) AS sites, list_sum(CASE WHEN len(v) >= 10 THEN v[4:4 + greatest(len(v) - 6, 1) - 1] ELSE v END) AS alt_sum FROM l""", "sites"))
def a25(spark, sf_dir):
    """Allele counts without the outer sites of a segment."""
    rows = ad.sites(spark, sf_dir).groupBy("chrom", F.expr("pos div 20000").alias("seg")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "alt_count"))), lambda x: x["alt_count"]).alias("v"))
    kept = sg.site_slice(F.col("v"))
    return rows.select("chrom", "seg", F.size("v").alias("sites"), F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("alt_sum"))


@query("a27_sample_metrics", sql("""
    SELECT sample, median(cnt) AS median_coverage, round(var_samp(cnt), 6) AS variance, round(max(cnt) + 10, 6) AS max_coverage FROM sample_bins GROUP BY 1""", "sample_bins"))
def a27(spark, sf_dir):
    """Median, variance and greatest coverage of samples."""
    return ad.sample_bins(spark, sf_dir).groupBy("sample").agg(
        F.median("cnt").alias("median_coverage"), F.round(F.var_samp("cnt"), 6).alias("variance"), F.round(F.max("cnt") + 10, 6).alias("max_coverage")
    )


@query("a37_frequency_histogram", sql("""
    SELECT t.cn, CAST(round(100 * s.alt_count / (s.ref_count + s.alt_count)) AS INT) AS percent, count(*) AS n FROM sites s JOIN truth t ON s.chrom = t.chrom AND t.start_pos <= s.pos AND s.pos < t.end_pos
    WHERE s.ref_count + s.alt_count >= 10 GROUP BY 1, 2""", "sites", "intervals"))
def a37(spark, sf_dir):
    """Histogram of allele shares by known copy number."""
    deep = ad.sites(spark, sf_dir).filter("ref_count + alt_count >= 10")
    inside = iv.points_in(deep, ad.intervals(spark, sf_dir, "O"))
    percent = F.round(100 * F.col("alt_count") / (F.col("ref_count") + F.col("alt_count"))).cast("int")
    return inside.groupBy(F.col("cn_r").alias("cn"), percent.alias("percent")).agg(F.count(F.lit(1)).alias("n"))


@query("a40_chromosome_count", sql(TILED + """, c AS (SELECT chrom, sum(cn * (end_pos - start_pos)) / sum(end_pos - start_pos) AS m FROM tiled WHERE q >= 3 GROUP BY 1) SELECT round(sum(m), 6) AS chromosomes FROM c""", "tiles"))
def a40(spark, sf_dir):
    """Estimated number of chromosomes: sum over contigs of the length-weighted mean copy number."""
    size = F.col("end_pos") - F.col("start_pos")
    means = tiled(spark, sf_dir).filter("q >= 3").groupBy("chrom").agg((F.sum(F.col("cn") * size) / F.sum(size)).alias("m"))
    return means.agg(F.round(F.sum("m"), 6).alias("chromosomes"))


@query("a41_site_depth", sql("""SELECT t.cn, median(s.ref_count + s.alt_count) AS depth FROM sites s JOIN truth t ON s.chrom = t.chrom AND t.start_pos <= s.pos AND s.pos < t.end_pos GROUP BY 1""", "sites", "intervals"))
def a41(spark, sf_dir):
    inside = iv.points_in(ad.sites(spark, sf_dir), ad.intervals(spark, sf_dir, "O"))
    return inside.groupBy(F.col("cn_r").alias("cn")).agg(F.median(F.col("ref_count") + F.col("alt_count")).alias("depth"))


@query("f15_enough_sites", sql("""
    , s AS (SELECT filt AS sample, chrom, pos // 50000 AS seg, count(*) FILTER (WHERE ref_count + alt_count >= 4) AS n FROM sites GROUP BY 1, 2, 3)
    SELECT chrom, seg, bool_and(n >= 10) AS enough FROM s GROUP BY 1, 2""", "sites"))
def f15(spark, sf_dir):
    """Whether every sample has ten sites of depth four in a segment."""
    each = ad.sites(spark, sf_dir).groupBy(F.col("filt").alias("sample"), "chrom", F.expr("pos div 50000").alias("seg")).agg(F.count_if(F.col("ref_count") + F.col("alt_count") >= 4).alias("n"))
    return each.groupBy("chrom", "seg").agg(F.bool_and(F.col("n") >= 10).alias("enough"))


@query("c11_phred", sql(TILED + " SELECT chrom, start_pos, round(least(60, -10 * log10(greatest(pow(10, -q), 1e-6))) + 0.0, 6) AS q FROM tiled", "tiles"))
def c11(spark, sf_dir):
    return tiled(spark, sf_dir).select("chrom", "start_pos", F.round(callers.phred(F.pow(F.lit(10.0), -F.col("q")), 60), 6).alias("q"))


@query("c14_vectors", sql("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm, round(list_dot_product(e, list_reverse(e)), 4) AS dot FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""", "bins"))
def c14(spark, sf_dir):
    """Norm of a vector and dot product with its reverse."""
    rows = ad.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    add = lambda a, x: a + x
    norm = F.sqrt(F.aggregate(F.transform("e", lambda x: x * x), F.lit(0.0), add))
    dot = F.aggregate(F.zip_with("e", F.reverse("e"), lambda x, y: x * y), F.lit(0.0), add)
    return rows.select("vec_id", F.round(norm, 4).alias("norm"), F.round(dot, 4).alias("dot"))


@query("c16_t_statistic", sql(TILED + FAMILY + " SELECT sample, chrom, round((avg(q) - 4) / (stddev_samp(q) / sqrt(count(*))), 6) AS t FROM fam GROUP BY 1, 2", "tiles"))
def c16(spark, sf_dir):
    """One-sample t statistic of the scores."""
    rows = family(spark, sf_dir).groupBy("sample", "chrom")
    return rows.agg(F.round((F.avg("q") - 4) / (F.stddev_samp("q") / F.sqrt(F.count(F.lit(1)))), 6).alias("t"))


@query("t02_best_states", sql(TILED + FAMILY + """ SELECT chrom, start_pos, sample, rank FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY q DESC, cn, sample) AS rank FROM fam) WHERE rank <= 2""", "tiles"))
def t02(spark, sf_dir):
    """Best and second-best rows of a segment."""
    w = Window.partitionBy("chrom", "start_pos").orderBy(F.desc("q"), "cn", "sample")
    return family(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("chrom", "start_pos", "sample", "rank")


@query("m23_supported_labels", sql(TILED + """, l AS (SELECT chrom, cn, lag(cn) OVER w AS a, lead(cn) OVER w AS b FROM tiled WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)) SELECT DISTINCT chrom, cn FROM l WHERE cn = a AND cn = b""", "tiles"))
def m23(spark, sf_dir):
    """Labels that three windows in a row bear."""
    w = Window.partitionBy("chrom").orderBy("start_pos")
    rows = tiled(spark, sf_dir).withColumns({"a": F.lag("cn").over(w), "b": F.lead("cn").over(w)})
    return rows.filter("cn = a and cn = b").select("chrom", "cn").distinct()


@query("k21_frequency_track", sql("""SELECT chrom, pos - 1 AS start_pos, pos AS end_pos, round(alt_count / (ref_count + alt_count), 6) AS value FROM sites WHERE ref_count + alt_count > 0""", "sites"))
def k21(spark, sf_dir):
    """Allele frequencies as a track."""
    rows = ad.sites(spark, sf_dir).filter("ref_count + alt_count > 0").withColumn("baf", F.round(F.col("alt_count") / (F.col("ref_count") + F.col("alt_count")), 6))
    return files.frequency_track(rows)


@query("w13_merged_extent", sql(TILED + " SELECT chrom, cn, min(start_pos) AS start_pos, max(end_pos) AS end_pos, round(median(cnt), 6) AS median_cnt FROM tiled GROUP BY 1, 2", "tiles"))
def w13(spark, sf_dir):
    """Extent and median of all segments of one call."""
    return tiled(spark, sf_dir).groupBy("chrom", "cn").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.round(F.median("cnt"), 6).alias("median_cnt"))


@query("a34_regional_variability", sql("""
    , n AS (SELECT chrom, (row_number() OVER (PARTITION BY chrom ORDER BY start_pos) - 1) // 50 AS win, cnt FROM bins) SELECT chrom, win, round(mad(cnt) / median(cnt), 6) AS variability FROM n GROUP BY 1, 2 HAVING median(cnt) > 0""", "bins"))
def a34(spark, sf_dir):
    """Median deviation over median in windows of bins."""
    w = Window.partitionBy("chrom").orderBy("start_pos")
    rows = ad.bins(spark, sf_dir).withColumn("win", F.floor((F.row_number().over(w) - 1) / 50))
    out = stats.median_deviation(rows, "cnt", ["chrom", "win"]).filter("median > 0")
    return out.select("chrom", "win", F.round(F.col("mad") / F.col("median"), 6).alias("variability"))
