"""Registered queries of the tumour model's steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import models, somatic
from helixframe.plans.model_queries import POINTS, STATES, points
from helixframe.plans.segment_queries import TILED
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


#: The given tables hold some megabases only; this stands for the genome.
GENOME = 1e6


@query("m30_diploid_distance", sql(TILED + f""", r AS (SELECT * FROM tiled UNION ALL SELECT chrom, start_pos, end_pos, 4, q, cnt FROM tiled, range(12)),
    s AS (SELECT 'plain' AS model, sum(CASE WHEN cn >= 3 AND cn < 10 THEN end_pos - start_pos ELSE 0 END) / sum(end_pos - start_pos) AS share, sum(abs(cn - 2) * (end_pos - start_pos)) AS two, sum(abs(cn - 4) * (end_pos - start_pos)) AS four FROM tiled
        UNION ALL SELECT 'amplified', sum(CASE WHEN cn >= 3 AND cn < 10 THEN end_pos - start_pos ELSE 0 END) / sum(end_pos - start_pos), sum(abs(cn - 2) * (end_pos - start_pos)), sum(abs(cn - 4) * (end_pos - start_pos)) FROM r),
    e AS (SELECT model, CASE WHEN share > 0.8 THEN 4 ELSE 2 END AS baseline, CASE WHEN share > 0.8 THEN 1 + four / {GENOME} ELSE two / {GENOME} END AS events FROM s)
    SELECT model, baseline, round(events, 6) AS events, round(1 / greatest(0.001, events), 6) AS distance FROM e""", "tiles"))
def m30(spark, sf_dir):
    """Distance of the calls, as they are and amplified, from the diploid state."""
    rows = ad.tiles(spark, sf_dir).groupBy("chrom", "start_pos", "end_pos").agg(F.min("cn").alias("cn"))
    more = rows.unionByName(rows.withColumn("cn", F.lit(4)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12)))).drop("k"))
    out = None
    for name, calls in (("plain", rows), ("amplified", more)):
        one = somatic.diploid_distance(calls, GENOME).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("model", "baseline", F.round("events", 6).alias("events"), F.round("distance", 6).alias("distance"))


@query("m30_model_distances", sql(TILED + f""", m AS (SELECT CAST(m AS INT) AS model, chrom, start_pos, end_pos, (cn * (m + 1) + m) % 5 AS cn FROM tiled, range(4) x(m))
    SELECT a.model, b.model AS other, round(sum(abs(a.cn - b.cn) * (a.end_pos - a.start_pos)) / {GENOME}, 6) AS distance FROM m a JOIN m b ON a.chrom = b.chrom AND a.start_pos = b.start_pos AND a.model < b.model GROUP BY 1, 2""", "tiles"))
def m30_models(spark, sf_dir):
    """Distances between four models of the same segments."""
    rows = ad.tiles(spark, sf_dir).groupBy("chrom", "start_pos", "end_pos").agg(F.min("cn").alias("cn"))
    rows = rows.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("cn", (F.col("cn") * (F.col("model") + 1) + F.col("model")) % 5)
    return somatic.model_distances(rows, GENOME, ["chrom", "start_pos"]).withColumn("distance", F.round("distance", 6))


@query("m31_refined_states", sql(TILED + POINTS + f""", {STATES}, mp AS (SELECT CAST(cn AS INT) AS cn, CAST(mcc AS INT) AS mcc, 100.0 * cn AS coverage, maf FROM states),
    d AS (SELECT p.chrom, p.start_pos, p.maf AS f, p.weight, s.cn, s.mcc, round(pow((p.coverage - s.coverage) * 0.005, 2) + pow(p.maf - s.maf, 2), 12) AS d FROM pts p, mp s WHERE p.maf IS NOT NULL),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY d, cn, mcc) AS i FROM d) WHERE i = 1),
    w AS (SELECT cn, mcc, sum(weight * f) AS s, sum(weight) AS w FROM n WHERE mcc * 2 = cn AND f >= 0.4 GROUP BY 1, 2)
    SELECT cn, mcc, round(CASE WHEN mcc * 2 = cn THEN (20.0 * maf + coalesce(s, 0)) / (20.0 + coalesce(w, 0)) ELSE maf END, 9) AS maf FROM mp LEFT JOIN w USING (cn, mcc)""", "tiles"))
def m31(spark, sf_dir):
    """Minor shares of balanced states fitted to the segments."""
    states = models.state_table(spark).withColumn("coverage", 100.0 * F.col("cn"))
    out = somatic.refine_even_maf(points(spark, sf_dir), states, ["chrom", "start_pos"], 0.005, prior=20.0)
    return out.select("cn", "mcc", F.round("maf", 9).alias("maf"))


@query("m33_clearly_altered", sql(TILED + POINTS + """, s AS (SELECT chrom, start_pos // 20000 AS k, min(start_pos) AS start_pos, max(start_pos) + 1000 AS end_pos, avg(coverage) AS coverage, avg(maf) AS maf, sum(weight) AS weight, CASE WHEN start_pos // 20000 % 4 < 3 THEN CAST(start_pos // 20000 % 3 AS INT) END AS ref FROM pts GROUP BY chrom, start_pos // 20000),
    w AS (SELECT chrom, start_pos // 20000 AS k, start_pos // 4000 AS j, min(start_pos) AS start_pos, max(start_pos) + 1000 AS end_pos, avg(coverage) AS coverage, avg(maf) AS maf, CASE WHEN start_pos // 20000 % 4 < 3 THEN CAST(start_pos // 20000 % 3 AS INT) END AS ref FROM pts GROUP BY chrom, start_pos // 20000, start_pos // 4000),
    c AS (SELECT median(abs(w.coverage - s.coverage) / s.coverage) AS cs, median(abs(w.maf - s.maf) / s.maf) AS ms FROM w JOIN s USING (chrom, k) WHERE coalesce(w.ref, 2) != 0 AND w.end_pos - w.start_pos >= 3000),
    z AS (SELECT s.*, cs, ms, abs(coverage - 190.0 * coalesce(ref, 2) / 2) / (190.0 * coalesce(ref, 2) / 2) AS z, CASE WHEN ref = 2 THEN coalesce(abs(maf - 0.27) / 0.27, 0) ELSE 0 END AS y FROM s, c WHERE coalesce(ref, 2) != 0 AND s.end_pos - s.start_pos >= 3000)
    SELECT round(any_value(cs), 9) AS coverage_scale, round(any_value(ms), 9) AS maf_scale, round(coalesce(sum(weight) FILTER (WHERE z > 1.2 * cs OR y > 1.2 * ms OR (z > 0.5 * cs AND y > 0.5 * ms)), 0), 6) AS weight_off,
        coalesce(sum(weight) FILTER (WHERE z > 1.2 * cs OR y > 1.2 * ms OR (z > 0.5 * cs AND y > 0.5 * ms)), 0) >= 100 AS altered FROM z""", "tiles"))
def m33(spark, sf_dir):
    """Whether the sample is clearly not all at its reference ploidy (M33), with limits for short contigs."""
    rows = points(spark, sf_dir).withColumns({"k": F.expr("start_pos div 20000"), "j": F.expr("start_pos div 4000")})

    def grouped(*by):
        ref = F.when(F.col("k") % 4 < 3, (F.col("k") % 3).cast("int"))
        return rows.groupBy("chrom", *by).agg(
            F.min("start_pos").alias("start_pos"), (F.max("start_pos") + 1000).alias("end_pos"), F.avg("coverage").alias("coverage"),
            F.avg("maf").alias("maf"), F.sum("weight").alias("weight"),
        ).withColumn("ref", ref)

    out = somatic.clearly_altered(grouped("k"), grouped("k", "j"), ["chrom", "k"], 190.0, 0.27, least=3000, alone=1.2, together=0.5, bases=100)
    return out.select(F.round("coverage_scale", 9).alias("coverage_scale"), F.round("maf_scale", 9).alias("maf_scale"), F.round("weight_off", 6).alias("weight_off"), "altered")


@query("p06_posterior_calls", sql(TILED + POINTS + f""", {STATES}, g AS (SELECT CAST(cn AS INT) AS cn, CAST(mcc AS INT) AS mcc, 1.0 / (cn + 1) AS omega, maf, 60.0 * cn AS coverage, 0.002 + 0.001 * mcc AS v_maf, 0.05 * cn AS v_both, 90.0 + 10 * cn AS v_cov FROM states),
    d AS (SELECT p.chrom, p.start_pos, p.coverage AS c, g.cn, g.mcc, omega * exp(-((v_cov * pow(coalesce(p.maf, -1) - g.maf, 2) - 2 * v_both * (coalesce(p.maf, -1) - g.maf) * (p.coverage - g.coverage) + v_maf * pow(p.coverage - g.coverage, 2)) / (v_maf * v_cov - v_both * v_both)) / 2) / (2 * pi() * sqrt(v_maf * v_cov - v_both * v_both)) AS p FROM pts p, g),
    w AS (SELECT *, sum(p) OVER (PARTITION BY chrom, start_pos) AS whole FROM d),
    b AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY CASE WHEN whole > 0 THEN round(p / whole, 9) ELSE 0 END DESC, cn, mcc) AS i FROM w)
    SELECT chrom, start_pos, CASE WHEN whole > 0 AND round(p / whole, 9) > 0 THEN cn ELSE CAST(round_even(2 * c / 120.0, 0) AS INT) END AS cn,
        CASE WHEN whole > 0 AND round(p / whole, 9) > 0 THEN mcc ELSE CAST(round_even(2 * c / 120.0, 0) AS INT) // 2 END AS mcc, round(CASE WHEN whole > 0 THEN p / whole ELSE 0 END, 6) AS posterior FROM b WHERE i = 1""", "tiles"))
def p06(spark, sf_dir):
    """Calls by the greatest posterior of a mixture, by coverage where all vanish."""
    cn, mcc = F.col("cn"), F.col("mcc")
    parts = models.state_table(spark).select(
        "cn", "mcc", (1.0 / (cn + 1)).alias("omega"), "maf", (60.0 * cn).alias("coverage"), (0.002 + 0.001 * mcc).alias("v_maf"), (0.05 * cn).alias("v_both"), (90.0 + 10 * cn).alias("v_cov")
    )
    out = somatic.posterior_calls(points(spark, sf_dir), parts, ["chrom", "start_pos"], 120.0)
    return out.withColumn("posterior", F.round("posterior", 6))
