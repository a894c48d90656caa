"""Registered queries of statistics, cleaning, normalization and smoothing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import stats
from helixframe.operators import cleaning, normalization
from helixframe.sources import adapters as ad
from helixframe.sources.adapters import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


@query("s01_bins", sql("SELECT * FROM bins", "bins"))
def s01(spark, sf_dir):
    """The bins as they are read."""
    return ad.bins(spark, sf_dir)


@query("w01_running_median", sql("""
    SELECT chrom, start_pos, median(cnt) OVER (PARTITION BY chrom ORDER BY start_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth FROM bins""", "bins"))
def w01(spark, sf_dir):
    return stats.running_median(ad.bins(spark, sf_dir), "cnt", 2, ["chrom"], "start_pos", "smooth").select("chrom", "start_pos", "smooth")


@query("w02_repeated_median", sql(""", one AS (SELECT chrom, start_pos, median(cnt) OVER (PARTITION BY chrom ORDER BY start_pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS cnt FROM bins),
    two AS (SELECT chrom, start_pos, median(cnt) OVER (PARTITION BY chrom ORDER BY start_pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cnt FROM one)
    SELECT chrom, start_pos, median(cnt) OVER (PARTITION BY chrom ORDER BY start_pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS cnt FROM two""", "bins"))
def w02(spark, sf_dir):
    return stats.repeated_median(ad.bins(spark, sf_dir), "cnt", 3, ["chrom"], "start_pos").select("chrom", "start_pos", "cnt")


@query("w03_running_mean", sql("""
    SELECT chrom, start_pos, round(CASE WHEN lag(cnt) OVER w IS NULL OR lead(cnt) OVER w IS NULL THEN cnt
        ELSE (lag(cnt) OVER w + cnt + lead(cnt) OVER w) / 3 END, 6) AS smooth FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)""", "bins"))
def w03(spark, sf_dir):
    smooth = stats.running_mean(ad.bins(spark, sf_dir), "cnt", ["chrom"], "start_pos", "smooth")
    return smooth.select("chrom", "start_pos", F.round("smooth", 6).alias("smooth"))


@query("w04_differences", sql("""
    SELECT chrom, start_pos, cnt - lag(cnt) OVER w AS diff, cnt - lag(cnt, 3) OVER w AS diff3, sum(cnt) OVER (PARTITION BY chrom ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS total
    FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)""", "bins"))
def w04(spark, sf_dir):
    """First and third differences and the running sum."""
    out = stats.differences(ad.bins(spark, sf_dir), "cnt", ["chrom"], "start_pos")
    out = stats.cumulative(stats.differences(out, "cnt", ["chrom"], "start_pos", 3, "diff3"), "cnt", ["chrom"], "start_pos")
    return out.select("chrom", "start_pos", "diff", "diff3", "total")


@query("a17_medians", sql("""SELECT gc, median(cnt) AS median, count(*) AS n FROM bins GROUP BY gc""", "bins"))
def a17(spark, sf_dir):
    """Medians and counts by GC class."""
    return ad.bins(spark, sf_dir).groupBy("gc").agg(F.median("cnt").alias("median"), F.count(F.lit(1)).alias("n"))


@query("a18_median_deviation", sql("""SELECT chrom, median(cnt) AS median, round(mad(cnt), 6) AS mad FROM bins GROUP BY chrom""", "bins"))
def a18(spark, sf_dir):
    out = stats.median_deviation(ad.bins(spark, sf_dir), "cnt", ["chrom"])
    return out.select("chrom", "median", F.round("mad", 6).alias("mad"))


@query("a19_quartiles", sql(""", l AS (SELECT gc, list(cnt ORDER BY cnt) AS v, count(*) AS n FROM tiles GROUP BY gc)
    SELECT gc, CASE WHEN n = 1 THEN v[1] WHEN n % 2 = 0 THEN list_median(v[1:n // 2]) WHEN n % 4 = 1 THEN v[n // 4] * 0.25 + v[n // 4 + 1] * 0.75
        ELSE v[n // 4 + 1] * 0.75 + v[n // 4 + 2] * 0.25 END AS q1, list_median(v) AS q2,
        CASE WHEN n = 1 THEN v[1] WHEN n % 2 = 0 THEN list_median(v[n // 2 + 1:n]) WHEN n % 4 = 1 THEN v[3 * (n // 4) + 1] * 0.75 + v[3 * (n // 4) + 2] * 0.25
        ELSE v[3 * (n // 4) + 2] * 0.25 + v[3 * (n // 4) + 3] * 0.75 END AS q3 FROM l""", "tiles"))
def a19(spark, sf_dir):
    return stats.quartiles(ad.tiles(spark, sf_dir), "cnt", ["gc"])


@query("a20_weighted_quantiles", sql(""", s AS (SELECT chrom, cnt, sum(gc) OVER (PARTITION BY chrom ORDER BY cnt, start_pos ROWS UNBOUNDED PRECEDING) * 1.0 / sum(gc) OVER (PARTITION BY chrom) AS share FROM bins)
    SELECT chrom, coalesce(max(cnt) FILTER (WHERE share <= 0.5), 0) AS w_median, coalesce(max(cnt) FILTER (WHERE share <= 0.75), 0) - coalesce(max(cnt) FILTER (WHERE share <= 0.25), 0) AS w_iqr FROM s GROUP BY 1""", "bins"))
def a20(spark, sf_dir):
    bins = ad.bins(spark, sf_dir)
    parts = [stats.weighted_quantile(bins, "cnt", "gc", p, ["chrom"], "start_pos", f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75))]
    joined = parts[0].join(parts[1], "chrom").join(parts[2], "chrom")
    return joined.select("chrom", F.col("q1").alias("w_median"), (F.col("q2") - F.col("q0")).alias("w_iqr"))


@query("a21_moments", sql("""
    SELECT gc, round(avg(cnt), 6) AS mean, round(stddev_samp(cnt), 6) AS sd, round(var_samp(cnt), 6) AS var, round(stddev_pop(cnt) / avg(cnt), 6) AS cv,
        round(sum(cnt * w) / sum(w), 6) AS w_mean, round(sum(cnt * cnt * w) / sum(w) - pow(sum(cnt * w) / sum(w), 2), 6) AS w_var
    FROM (SELECT *, CAST(end_pos - start_pos AS DOUBLE) AS w FROM bins) GROUP BY gc""", "bins"))
def a21(spark, sf_dir):
    """Mean, deviation, variance, coefficient of variation and weighted moments by GC class."""
    rows = ad.bins(spark, sf_dir).withColumn("w", (F.col("end_pos") - F.col("start_pos")).cast("double"))
    out = rows.groupBy("gc").agg(
        F.avg("cnt").alias("mean"), F.stddev_samp("cnt").alias("sd"), F.var_samp("cnt").alias("var"),
        (F.stddev_pop("cnt") / F.avg("cnt")).alias("cv"), *[c.alias(n) for n, c in stats.weighted_moments("cnt", "w").items()],
    )
    return out.select("gc", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


LOCAL = """, d AS (SELECT chrom, cnt, lead(cnt) OVER w - cnt AS d, (row_number() OVER w - 1) // 20 AS win FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    loc AS (SELECT chrom, win, stddev_samp(d) AS local_sd, avg(cnt) AS win_mean FROM d GROUP BY 1, 2 HAVING count(d) = 20)"""


@query("a22_local_deviation", sql(LOCAL + " SELECT chrom, win, round(local_sd, 6) AS local_sd, round(win_mean, 6) AS win_mean FROM loc", "bins"))
def a22(spark, sf_dir):
    out = stats.local_deviation(ad.bins(spark, sf_dir), "cnt", ["chrom"], "start_pos")
    return out.select("chrom", "win", F.round("local_sd", 6).alias("local_sd"), F.round("win_mean", 6).alias("win_mean"))


@query("t06_indexed_value", sql(""", l AS (SELECT chrom, list(cnt ORDER BY cnt) AS v, count(*) AS n FROM tiles GROUP BY 1)
    SELECT chrom, v[least(CAST(floor(n * 0.9) AS INT), n - 1) + 1] AS p90 FROM l""", "tiles"))
def t06(spark, sf_dir):
    return stats.indexed_value(ad.tiles(spark, sf_dir), "cnt", 0.9, ["chrom"], "p90")


@query("f07_big_bins", sql(""", s AS (SELECT list(end_pos - start_pos ORDER BY end_pos - start_pos) AS v, count(*) AS n FROM bins)
    SELECT b.* FROM bins b, s WHERE b.end_pos - b.start_pos <= v[CAST(floor(n * 0.98) AS INT) + 1]""", "bins"))
def f07(spark, sf_dir):
    return cleaning.drop_big(ad.bins(spark, sf_dir))


@query("f08_outlier_bins", sql(""", n AS (SELECT *, lag(cnt) OVER w AS a, lead(cnt) OVER w AS b FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    t AS (SELECT *, CASE WHEN cnt + a > 0 THEN (pow(cnt - (cnt + a) / 2, 2) + pow(a - (cnt + a) / 2, 2)) / ((cnt + a) / 2) ELSE CASE WHEN a IS NULL THEN NULL ELSE 0 END END AS x,
        CASE WHEN cnt + b > 0 THEN (pow(cnt - (cnt + b) / 2, 2) + pow(b - (cnt + b) / 2, 2)) / ((cnt + b) / 2) ELSE CASE WHEN b IS NULL THEN NULL ELSE 0 END END AS y FROM n)
    SELECT chrom, start_pos, end_pos, gc, cnt FROM t WHERE x <= 6.635 OR y <= 6.635""", "bins"))
def f08(spark, sf_dir):
    """Bins that resemble a neighbour."""
    return cleaning.drop_outliers(ad.bins(spark, sf_dir))


@query("f09_rare_gc", sql("""
    SELECT * FROM tiles WHERE gc IN (SELECT gc FROM tiles GROUP BY gc HAVING count(*) >= least(100, greatest(10, (SELECT count(*) FROM tiles) // 101)))""", "tiles"))
def f09(spark, sf_dir):
    return cleaning.drop_rare_gc(ad.tiles(spark, sf_dir))


@query("f10_unsteady_bins", sql(LOCAL + """, typ AS (SELECT avg(m) AS t FROM (SELECT chrom, mad(local_sd) AS m FROM loc GROUP BY 1)),
    bad AS (SELECT chrom, win FROM loc, typ WHERE local_sd > 2 * t AND win_mean > 5),
    b AS (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY start_pos) - 1) // 20 AS win FROM bins)
    SELECT chrom, start_pos, cnt FROM b WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.chrom = b.chrom AND bad.win = b.win)""", "bins"))
def f10(spark, sf_dir):
    return cleaning.drop_unsteady(ad.bins(spark, sf_dir)).select("chrom", "start_pos", "cnt")


@query("f18_finite_values", sql("""SELECT chrom, start_pos, round(ln(cnt), 6) AS log_cnt FROM bins WHERE cnt > 0 AND ln(cnt) < 'inf'::DOUBLE""", "bins"))
def f18(spark, sf_dir):
    logs = ad.bins(spark, sf_dir).withColumn("log_cnt", F.when(F.col("cnt") > 0, F.ln("cnt")).otherwise(F.lit(float("-inf"))))
    return stats.finite(logs, "log_cnt").select("chrom", "start_pos", F.round("log_cnt", 6).alias("log_cnt"))


@query("a13_gc_median", sql("""
    SELECT chrom, start_pos, round(CASE WHEN m.med > 0 THEN cnt * (SELECT median(cnt) FROM bins) / m.med ELSE cnt END, 6) AS cnt
    FROM bins JOIN (SELECT gc, median(cnt) AS med FROM bins GROUP BY gc) m USING (gc)""", "bins"))
def a13(spark, sf_dir):
    """GC-median normalization where every class has enough bins."""
    return cleaning.normalize_gc_median(ad.bins(spark, sf_dir), enough=1).select("chrom", "start_pos", F.round("cnt", 6).alias("cnt"))


@query("a13_gc_median_sparse", sql(""", own AS (SELECT gc, median(cnt) AS med, count(*) AS n FROM tiles GROUP BY gc),
    r AS (SELECT o.gc AS want, t.gc, t.cnt, pow(0.5, abs(t.gc - o.gc)) AS w FROM own o JOIN tiles t ON t.gc BETWEEN o.gc - 10 AND o.gc + 10 WHERE o.n < 100),
    s AS (SELECT want, cnt, sum(w) OVER (PARTITION BY want ORDER BY cnt, gc ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY want) AS share FROM r),
    med AS (SELECT gc, med FROM own WHERE n >= 100 UNION ALL SELECT want, min(cnt) FROM s WHERE share >= 0.5 GROUP BY want)
    SELECT t.chrom, t.start_pos, t.gc, round(sum(t.cnt * (SELECT median(cnt) FROM tiles) / med.med), 4) AS cnt FROM tiles t JOIN med USING (gc) GROUP BY 1, 2, 3""", "tiles"))
def a13_sparse(spark, sf_dir):
    """GC-median normalization with neighbouring classes for sparse ones, summed over equal keys."""
    out = cleaning.normalize_gc_median(ad.tiles(spark, sf_dir))
    return out.groupBy("chrom", "start_pos", "gc").agg(F.round(F.sum("cnt"), 4).alias("cnt"))


@query("a15_gc_spread", sql(""", l AS (SELECT gc, list(cnt ORDER BY cnt) AS v, count(*) AS n FROM bins GROUP BY gc),
    q AS (SELECT gc, n, CASE WHEN n = 1 THEN v[1] WHEN n % 2 = 0 THEN list_median(v[1:n // 2]) WHEN n % 4 = 1 THEN v[n // 4] * 0.25 + v[n // 4 + 1] * 0.75 ELSE v[n // 4 + 1] * 0.75 + v[n // 4 + 2] * 0.25 END AS q1,
        list_median(v) AS q2, CASE WHEN n = 1 THEN v[1] WHEN n % 2 = 0 THEN list_median(v[n // 2 + 1:n]) WHEN n % 4 = 1 THEN v[3 * (n // 4) + 1] * 0.75 + v[3 * (n // 4) + 2] * 0.25 ELSE v[3 * (n // 4) + 2] * 0.25 + v[3 * (n // 4) + 3] * 0.75 END AS q3 FROM l),
    wide AS (SELECT quantile_cont(cnt, 0.75) - quantile_cont(cnt, 0.25) AS wide FROM bins),
    need AS (SELECT bool_or(gc BETWEEN 10 AND 89 AND n >= 10 AND q3 - q1 > 1.05 * wide) AS needed FROM q, wide)
    SELECT chrom, start_pos, round(CASE WHEN needed AND q3 - q1 > 0 THEN q2 + (cnt - q2) * wide / (q3 - q1) ELSE cnt END, 6) AS cnt FROM bins JOIN q USING (gc), wide, need""", "bins"))
def a15(spark, sf_dir):
    """GC classes scaled to the overall interquartile range."""
    out = cleaning.normalize_gc_spread(ad.bins(spark, sf_dir), excess=1.05)
    return out.select("chrom", "start_pos", F.round("cnt", 6).alias("cnt"))


def pair(spark, sf_dir):
    rows = ad.sample_bins(spark, sf_dir)
    return rows.filter("sample = 's0'").drop("sample"), rows.filter("sample != 's0'")


@query("a12_shared_bins", sql("""
    SELECT chrom, start_pos, end_pos, max(cnt) FILTER (WHERE sample = 's0') AS s0, max(cnt) FILTER (WHERE sample = 's1') AS s1, max(cnt) FILTER (WHERE sample = 's2') AS s2
    FROM sample_bins GROUP BY 1, 2, 3 HAVING count(DISTINCT sample) = 3""", "sample_bins"))
def a12(spark, sf_dir):
    """Bins that all samples have, with each one's count."""
    out = normalization.in_all_samples(ad.sample_bins(spark, sf_dir))
    return out.select("chrom", "start_pos", "end_pos", *[F.col("counts")[s].alias(s) for s in ("s0", "s1", "s2")])


@query("j10_ratios", sql("""
    SELECT a.chrom, a.start_pos, round(a.cnt / b.cnt, 6) AS ratio FROM sample_bins a JOIN sample_bins b USING (chrom, start_pos, end_pos)
    WHERE a.sample = 's0' AND b.sample = 's1' AND b.cnt BETWEEN 2 AND 30""", "sample_bins"))
def j10(spark, sf_dir):
    """Raw ratios to a control within bounds."""
    sample, controls = pair(spark, sf_dir)
    out = normalization.ratios(sample, controls.filter("sample = 's1'"), 2, 30)
    return out.select("chrom", "start_pos", F.round("ratio", 6).alias("ratio"))


@query("a30_library_ratios", sql("""
    SELECT a.chrom, a.start_pos, round(a.cnt / b.cnt * (SELECT median(cnt) FROM sample_bins WHERE sample = 's1') / (SELECT median(cnt) FROM sample_bins WHERE sample = 's0') * 40 * 2 / 2, 6) AS cnt
    FROM sample_bins a JOIN sample_bins b USING (chrom, start_pos, end_pos) WHERE a.sample = 's0' AND b.sample = 's1' AND b.cnt >= 1""", "sample_bins"))
def a30(spark, sf_dir):
    """Ratios for library size as counts of a diploid scale."""
    sample, controls = pair(spark, sf_dir)
    out = normalization.library_ratios(sample, controls.filter("sample = 's1'")).withColumn("ploidy", F.lit(2))
    return normalization.ratio_to_count(out, "ploidy").select("chrom", "start_pos", F.round("cnt", 6).alias("cnt"))


@query("a28_weighted_control", sql(""", m AS (SELECT sample, median(cnt) AS m FROM sample_bins WHERE sample != 's0' GROUP BY 1), w AS (SELECT sample, 1 / m / (SELECT sum(1 / m) FROM m) AS w FROM m)
    SELECT chrom, start_pos, round(sum(w * cnt), 6) AS cnt FROM sample_bins JOIN w USING (sample) GROUP BY 1, 2""", "sample_bins"))
def a28(spark, sf_dir):
    _, controls = pair(spark, sf_dir)
    return normalization.weighted_control(controls).select("chrom", "start_pos", F.round("cnt", 6).alias("cnt"))


@query("a29_best_control", sql(""", m AS (SELECT sample, median(cnt) AS m FROM sample_bins GROUP BY 1)
    SELECT b.sample, round(avg(pow(ln((a.cnt / ma.m) / (b.cnt / mb.m)), 2)), 6) AS msl FROM sample_bins a JOIN sample_bins b USING (chrom, start_pos, end_pos)
    JOIN m ma ON ma.sample = a.sample JOIN m mb ON mb.sample = b.sample WHERE a.sample = 's0' AND b.sample != 's0' GROUP BY 1 ORDER BY 2, 1 LIMIT 1""", "sample_bins"))
def a29(spark, sf_dir):
    sample, controls = pair(spark, sf_dir)
    return normalization.best_control(sample, controls).select("sample", F.round("msl", 6).alias("msl"))


@query("a32_pca_control", sql(""", model AS (SELECT chrom, start_pos, end_pos, cnt AS mean, CASE WHEN gc % 2 = 0 THEN 1 ELSE -1 END / sqrt((SELECT count(*) FROM bins)) AS axis FROM bins),
    sam AS (SELECT s.chrom, s.start_pos, s.end_pos, s.cnt, m.mean, m.axis FROM sample_bins s JOIN model m USING (chrom, start_pos, end_pos) WHERE s.sample = 's0'),
    sc AS (SELECT median(cnt) / median(mean) AS s FROM sam), p AS (SELECT sum((cnt / s - mean) * axis) AS p FROM sam, sc)
    SELECT chrom, start_pos, round(greatest(mean + p * axis, 1) * s, 6) AS cnt FROM sam, sc, p""", "bins", "sample_bins"))
def a32(spark, sf_dir):
    """A control from the projection on a model's axis."""
    sample, _ = pair(spark, sf_dir)
    bins = ad.bins(spark, sf_dir)
    total = bins.agg(F.sqrt(F.count(F.lit(1))).alias("r"))
    axis = F.when(F.col("gc") % 2 == 0, 1).otherwise(-1) / F.col("r")
    model = bins.join(F.broadcast(total)).select("chrom", "start_pos", "end_pos", F.col("cnt").alias("mean"), axis.alias("axis"))  # one row
    return normalization.pca_control(sample, model, ["axis"]).select("chrom", "start_pos", F.round("cnt", 6).alias("cnt"))
