"""Registered queries of segments and variant records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import vcf
from helixframe.operators import intervals as iv
from helixframe.operators import segments as sg
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


#: Distinct tiles with one copy number and score each.
TILED = """, tiled AS (SELECT chrom, start_pos, end_pos, min(cn) AS cn, max(q) AS q, avg(cnt) AS cnt FROM tiles GROUP BY 1, 2, 3)"""


def tiled(spark, sf_dir):
    return ad.tiles(spark, sf_dir).groupBy("chrom", "start_pos", "end_pos").agg(
        F.min("cn").alias("cn"), F.max("q").alias("q"), F.avg("cnt").alias("cnt")
    )


SEGMENTED = """, marked AS (SELECT b.*, CASE WHEN lag(b.end_pos) OVER w IS NULL OR b.gc = 45 OR b.start_pos - lag(b.end_pos) OVER w > 4400
        OR EXISTS (SELECT 1 FROM excl e WHERE e.chrom = b.chrom AND (e.start_pos + e.end_pos) // 2 >= b.last AND (e.start_pos + e.end_pos) // 2 < b.start_pos)
        THEN 1 ELSE 0 END AS opens FROM (SELECT *, lag(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS last FROM bins) b WINDOW w AS (PARTITION BY b.chrom ORDER BY b.start_pos)),
    seg AS (SELECT chrom, start_pos, end_pos, gc, cnt, sum(opens) OVER (PARTITION BY chrom ORDER BY start_pos) - 1 AS seg_idx FROM marked)"""


def segmented(spark, sf_dir):
    bins = ad.bins(spark, sf_dir)
    breaks = bins.filter("gc = 45").select("chrom", "start_pos")
    return sg.number_segments(bins, breaks, ad.intervals(spark, sf_dir, "P"), max_gap=4400)


@query("w06_segment_ids", sql(SEGMENTED + " SELECT chrom, start_pos, seg_idx FROM seg", "bins", "intervals"))
def w06(spark, sf_dir):
    """Segment numbers from breakpoints, excluded midpoints and gaps."""
    return segmented(spark, sf_dir).select("chrom", "start_pos", "seg_idx")


@query("w07_breakpoint_segments", sql(""", n AS (SELECT chrom, gc, row_number() OVER (PARTITION BY chrom ORDER BY start_pos) - 1 AS idx, count(*) OVER (PARTITION BY chrom) AS bins FROM bins),
    s AS (SELECT DISTINCT chrom, idx, bins FROM n WHERE gc = 45 OR idx = 0)
    SELECT chrom, idx AS first_bin, coalesce(lead(idx) OVER (PARTITION BY chrom ORDER BY idx), bins) - 1 AS last_bin FROM s""", "bins"))
def w07(spark, sf_dir):
    """Breakpoints to ranges of bins."""
    from pyspark.sql import Window

    w = Window.partitionBy("chrom").orderBy("start_pos")
    numbered = ad.bins(spark, sf_dir).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    sizes = numbered.groupBy("chrom").agg(F.count(F.lit(1)).alias("bins"))
    return sg.from_breakpoints(numbered.filter("gc = 45").select("chrom", "idx"), sizes)


@query("a24_segment_summary", sql(SEGMENTED + """ SELECT chrom, seg_idx, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS bins, round(avg(cnt), 6) AS mean_cnt, median(cnt) AS median_cnt FROM seg GROUP BY 1, 2""", "bins", "intervals"))
def a24(spark, sf_dir):
    """Extent, mean and median of segments."""
    out = sg.summarize(segmented(spark, sf_dir))
    return out.select("chrom", "seg_idx", "start_pos", "end_pos", "bins", F.round("mean_cnt", 6).alias("mean_cnt"), "median_cnt")


@query("a14_confidence_intervals", sql(SEGMENTED + """, t AS (SELECT *, end_pos - start_pos AS size, lag(end_pos) OVER w AS pe, lead(start_pos) OVER w AS ns, lag(end_pos - start_pos) OVER w AS ps, lead(end_pos - start_pos) OVER w AS nz FROM seg WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    u AS (SELECT *, CASE WHEN pe = start_pos THEN ps ELSE size END AS before, CASE WHEN ns = end_pos THEN nz ELSE size END AS after FROM t)
    SELECT chrom, seg_idx, CAST(-round(arg_min(before, start_pos) / 2) AS INT) AS ci_pos_low, CAST(round(arg_min(size, start_pos) / 2) AS INT) AS ci_pos_high,
        CAST(-round(arg_max(size, start_pos) / 2) AS INT) AS ci_end_low, CAST(round(arg_max(after, start_pos) / 2) AS INT) AS ci_end_high FROM u GROUP BY 1, 2""", "bins", "intervals"))
def a14(spark, sf_dir):
    return sg.with_confidence(segmented(spark, sf_dir)).drop("start_pos", "end_pos")


@query("w09_equal_calls", sql(TILED + """, m AS (SELECT *, CASE WHEN lag(cn) OVER w = cn AND start_pos - lag(end_pos) OVER w <= 0 THEN 0 ELSE 1 END AS o FROM tiled WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start_pos) AS island FROM m)
    SELECT chrom, cn, min(start_pos) AS start_pos, max(end_pos) AS end_pos, round(avg(q), 6) AS q, count(*) AS pieces FROM i GROUP BY chrom, cn, island""", "tiles"))
def w09(spark, sf_dir):
    """Neighbouring equal calls merged; no segment is short enough to be absorbed."""
    out = sg.merge_calls(tiled(spark, sf_dir).select("chrom", "start_pos", "end_pos", "cn", "q"), least=500, most_span=0)
    return out.select("chrom", "cn", "start_pos", "end_pos", F.round("q", 6).alias("q"), "pieces")


@query("w09_absorbed_calls")
def w09_absorb(spark, sf_dir):
    """Short segments absorbed left to right by their better neighbour."""
    return sg.merge_calls(tiled(spark, sf_dir).select("chrom", "start_pos", "end_pos", "cn", "q"), least=1500, most_span=10_000)


@query("w10_barred_merge", sql(TILED + """, m AS (SELECT *, lag(cn) OVER w AS pc, lag(end_pos) OVER w AS pe FROM (SELECT * FROM tiled t WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.chrom = t.chrom AND x.start_pos < t.end_pos AND t.start_pos < x.end_pos)) WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    n AS (SELECT *, CASE WHEN pc = cn AND start_pos - pe <= 5000 AND NOT EXISTS (SELECT 1 FROM excl e WHERE m.pe < m.start_pos AND e.chrom = m.chrom AND m.pe < e.end_pos AND e.start_pos < m.start_pos) THEN 0 ELSE 1 END AS o FROM m),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start_pos) AS island FROM n)
    SELECT chrom, cn, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS pieces FROM i GROUP BY chrom, cn, island""", "tiles", "intervals"))
def w10(spark, sf_dir):
    """Equal calls of tiles without known variants, merged over gaps that no excluded interval touches."""
    free = iv.overlap_anti(tiled(spark, sf_dir), ad.intervals(spark, sf_dir, "O"))
    rows = free.select("chrom", "start_pos", "end_pos", "cn", "q")
    out = sg.merge_calls(rows, least=1, most_span=5000, barriers=ad.intervals(spark, sf_dir, "P"))
    return out.select("chrom", "cn", "start_pos", "end_pos", "pieces")


FAMILY = """, fam AS (SELECT 's' || CAST(s AS VARCHAR) AS sample, chrom, start_pos, end_pos, CAST((cn * (s + 1)) % 3 AS INT) AS cn, q + s AS q FROM tiled, range(3) r(s))"""


def family(spark, sf_dir):
    """Three samples over the same tiles."""
    rows = tiled(spark, sf_dir).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), "chrom", "start_pos", "end_pos", ((F.col("cn") * (F.col("s") + 1)) % 3).cast("int").alias("cn"), (F.col("q") + F.col("s")).alias("q"))


@query("w14_family_merge", sql(TILED + FAMILY + """, v AS (SELECT chrom, start_pos, end_pos, list(cn ORDER BY sample) AS cns, avg(q) AS q FROM fam GROUP BY 1, 2, 3),
    m AS (SELECT *, CASE WHEN lag(cns) OVER w = cns AND lag(q) OVER w > 2 AND q > 2 THEN 0 ELSE 1 END AS o FROM v WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start_pos) AS island FROM m)
    SELECT chrom, array_to_string(cns, ',') AS cns, min(start_pos) AS start_pos, max(end_pos) AS end_pos, round(avg(q), 6) AS q, count(*) AS pieces FROM i GROUP BY chrom, cns, island""", "tiles"))
def w14(spark, sf_dir):
    """Neighbours merged where all samples agree."""
    out = sg.merge_samples(family(spark, sf_dir), 2.0)
    return out.select("chrom", F.array_join("cns", ",").alias("cns"), "start_pos", "end_pos", F.round("q", 6).alias("q"), "pieces")


@query("f11_filter_tags", sql(TILED + """ SELECT chrom, start_pos, concat_ws(',', CASE WHEN q < 3 THEN 'q3' END, CASE WHEN (end_pos - start_pos) * (cn + 1) < 2000 THEN 'L2kb' END) AS filters FROM tiled""", "tiles"))
def f11(spark, sf_dir):
    """Failed filters of segments with size names."""
    rows = tiled(spark, sf_dir)
    tags = sg.filter_tags(F.col("q"), (F.col("end_pos") - F.col("start_pos")) * (F.col("cn") + 1), 3, 2000)
    return rows.select("chrom", "start_pos", F.array_join(tags, ",").alias("filters"))


@query("f13_record_filter", sql(TILED + FAMILY + """ SELECT chrom, start_pos, CASE WHEN bool_or(q >= 5) THEN '' ELSE 'FailedFT' END AS record_filters FROM fam GROUP BY 1, 2""", "tiles"))
def f13(spark, sf_dir):
    rows = family(spark, sf_dir).withColumn("filters", sg.filter_tags(F.col("q"), F.lit(10_000_000), 5, 1000))
    out = sg.record_filter(rows, ["chrom", "start_pos"])
    return out.select("chrom", "start_pos", F.array_join("record_filters", ",").alias("record_filters"))


@query("k06_overall_ploidy", sql(TILED + FAMILY + """ SELECT sample, round(sum(cn * (end_pos - start_pos)) / sum(end_pos - start_pos), 6) AS ploidy FROM fam WHERE q >= 3 GROUP BY 1""", "tiles"))
def k06(spark, sf_dir):
    """Overall ploidy of passing segments."""
    rows = family(spark, sf_dir).withColumn("filters", sg.filter_tags(F.col("q"), F.lit(10_000_000), 3, 1000))
    return sg.overall_ploidy(rows, ["sample"]).select("sample", F.round("ploidy", 6).alias("ploidy"))


@query("a42_fraction_abnormal", sql(TILED + """ SELECT chrom, round(sum(CASE WHEN cn != 2 OR coalesce(CASE WHEN q > 3 THEN CAST(floor(cn / 2 + 0.5) AS INT) END, 1) != 1 THEN end_pos - start_pos ELSE 0 END) / sum(end_pos - start_pos), 6) AS abnormal FROM tiled GROUP BY 1""", "tiles"))
def a42(spark, sf_dir):
    """Share of bases off the diploid state."""
    mcc = F.when(F.col("q") > 3, F.floor(F.col("cn") / 2 + 0.5).cast("int"))
    size = F.col("end_pos") - F.col("start_pos")
    odd = (F.col("cn") != 2) | (F.coalesce(mcc, F.lit(1)) != 1)
    return tiled(spark, sf_dir).groupBy("chrom").agg(F.round(F.sum(F.when(odd, size).otherwise(0)) / F.sum(size), 6).alias("abnormal"))


KIND = "CASE WHEN cn < 2 THEN 'loss' WHEN cn > 2 THEN 'gain' ELSE 'reference' END"


@query("c18_cnv_type", sql(TILED + f""", r AS (SELECT *, CAST(start_pos // 1000 % 3 AS INT) AS ref, CASE WHEN q > 3 THEN CAST(floor(cn / 2 + 0.5) AS INT) + CAST(start_pos // 1000 % 2 AS INT) END AS mcc FROM tiled)
    SELECT chrom, start_pos, CASE WHEN cn < ref THEN 'loss' WHEN cn > ref THEN 'gain' WHEN ref = 2 AND cn = 2 AND mcc = 2 THEN 'loh' ELSE 'reference' END AS kind FROM r""", "tiles"))
def c18(spark, sf_dir):
    """Kind of variant from copy number, major count and reference."""
    ref = F.expr("cast(start_pos div 1000 % 3 as int)")
    mcc = F.when(F.col("q") > 3, F.floor(F.col("cn") / 2 + 0.5).cast("int") + F.expr("cast(start_pos div 1000 % 2 as int)"))
    return tiled(spark, sf_dir).select("chrom", "start_pos", vcf.cnv_type(F.col("cn"), mcc, ref).alias("kind"))


@query("k08_record_type", sql(TILED + FAMILY + f""", k AS (SELECT chrom, start_pos, list_distinct(list(kind)) AS ks FROM (SELECT *, {KIND} AS kind FROM fam) WHERE kind != 'reference' GROUP BY 1, 2)
    SELECT t.chrom, t.start_pos, CASE WHEN k.ks IS NULL THEN 'reference' WHEN len(k.ks) = 1 THEN k.ks[1] ELSE 'complex' END AS kind FROM tiled t LEFT JOIN k USING (chrom, start_pos)""", "tiles"))
def k08(spark, sf_dir):
    rows = family(spark, sf_dir).withColumn("kind", vcf.cnv_type(F.col("cn"), F.lit(None), F.lit(2)))
    return rows.groupBy("chrom", "start_pos").agg(vcf.record_type(F.collect_list("kind")).alias("kind"))


@query("k09_alleles_and_genotypes", sql(TILED + FAMILY + """, a AS (SELECT *, CASE WHEN cn = 0 THEN [0, 0] WHEN cn = 1 THEN [0, 1] WHEN cn = 2 THEN [1, 1] ELSE [-1, 2147483647] END AS al FROM fam),
    b AS (SELECT chrom, start_pos, list_sort(list_distinct(list_filter(flatten(list(al)), lambda x: x != 1 AND x != -1))) AS nums FROM a GROUP BY 1, 2)
    SELECT a.chrom, a.start_pos, a.sample, array_to_string(list_transform(b.nums, lambda x: CASE WHEN x = 2147483647 THEN '<DUP>' ELSE '<CN' || CAST(x AS VARCHAR) || '>' END), ',') AS alt,
        array_to_string(list_transform(a.al, lambda x: CASE WHEN x = 1 THEN '0' WHEN x = -1 THEN '.' ELSE CAST(list_position(b.nums, x) AS VARCHAR) END), '/') AS gt
    FROM a JOIN b USING (chrom, start_pos)""", "tiles"))
def k09(spark, sf_dir):
    """Alternate alleles of a record and each sample's genotype."""
    rows = family(spark, sf_dir).withColumn("alleles", vcf.allele_numbers(F.col("cn"), F.lit(None), F.lit(2)))
    alts = rows.groupBy("chrom", "start_pos").agg(vcf.alt_alleles(F.collect_list("alleles")).alias("alts"))
    joined = rows.join(alts, ["chrom", "start_pos"])
    return joined.select("chrom", "start_pos", "sample", F.array_join("alts", ",").alias("alt"), vcf.genotype(F.col("alleles"), F.col("alts")).alias("gt"))


@query("k10_info_column", sql(TILED + """ SELECT chrom, CASE WHEN cn = 2 THEN start_pos + 1 ELSE greatest(start_pos, 1) END AS pos,
    'SVTYPE=CNV;END=' || CAST(end_pos AS VARCHAR) || ';CNVLEN=' || CAST(end_pos - start_pos AS VARCHAR) || CASE WHEN q > 4 THEN ';SUBCLONAL' ELSE '' END AS info FROM tiled""", "tiles"))
def k10(spark, sf_dir):
    rows = tiled(spark, sf_dir).withColumn("alts", F.when(F.col("cn") == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("<CN0>"))))
    info = vcf.info_column(F.col("end_pos"), F.col("end_pos") - F.col("start_pos"), subclonal=F.col("q") > 4)
    return rows.select("chrom", vcf.position_column(F.col("start_pos"), F.col("alts")).alias("pos"), info.alias("info"))


@query("s08_parsed_records", sql(TILED + """ SELECT chrom, start_pos AS pos, CAST(end_pos AS VARCHAR) AS "end", CAST(cn AS VARCHAR) AS cn, CASE WHEN cn > 2 THEN NULL ELSE '0/1' END AS gt FROM tiled""", "tiles"))
def s08(spark, sf_dir):
    """Record lines parsed to columns and maps."""
    gt = F.when(F.col("cn") > 2, "CN:.").otherwise("GT:CN")
    value = F.when(F.col("cn") > 2, F.col("cn").cast("string")).otherwise(F.concat(F.lit("0/1:"), F.col("cn").cast("string")))
    line = F.concat_ws("\t", "chrom", "start_pos", F.lit("."), F.lit("N"), F.lit("<CN0>"), F.lit("."), F.lit("PASS"), F.concat(F.lit("SVTYPE=CNV;END="), "end_pos"), F.when(F.col("cn") > 2, "CN").otherwise("GT:CN"), value)
    rows = vcf.parse_info(tiled(spark, sf_dir).select(line.alias("value")))
    return rows.select("chrom", "pos", F.col("info")["END"].alias("end"), F.col("sample")["CN"].alias("cn"), F.col("sample")["GT"].alias("gt"))


@query("w11_equal_ploidy", sql(TILED + """, m AS (SELECT *, CASE WHEN lag(cn) OVER w = cn AND start_pos <= lag(end_pos) OVER w THEN 0 ELSE 1 END AS o FROM tiled WINDOW w AS (PARTITION BY chrom ORDER BY start_pos)),
    i AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY start_pos) AS island FROM m)
    SELECT chrom, cn, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS pieces FROM i WHERE cn != 2 GROUP BY chrom, cn, island""", "tiles"))
def s14(spark, sf_dir):
    """Adjacent intervals of one ploidy merged, checked to be disjoint, without ploidy 2."""
    rows = iv.assert_disjoint(tiled(spark, sf_dir).select("chrom", "start_pos", "end_pos", "cn"), ["chrom"])
    return iv.merge_equal(rows, ["cn"]).filter("cn != 2").select("chrom", "cn", "start_pos", "end_pos", "pieces")
