"""Registered queries of counting, sites and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import binning, evaluation
from helixframe.operators import intervals as iv
from helixframe.plans.interval_queries import MERGED, ploidy
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


USABLE = ", usable AS (SELECT * FROM alignments WHERE is_forward AND NOT is_dup AND mapq >= 3 AND mapq != 255), hits AS (SELECT chrom, pos, CAST(least(255, count(*)) AS INT) AS hits FROM usable GROUP BY 1, 2)"


def hits(spark, sf_dir):
    return binning.position_hits(binning.usable_starts(ad.alignments(spark, sf_dir)))


@query("f01_usable_reads", sql(USABLE + " SELECT sample, chrom, count(*) AS n FROM usable GROUP BY 1, 2", "alignments"))
def f01(spark, sf_dir):
    """Reads that pass the flags, by sample and contig."""
    return binning.usable_starts(ad.alignments(spark, sf_dir)).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n"))


@query("a10_position_hits", sql(USABLE + " SELECT chrom, pos, hits FROM hits", "alignments"))
def a10(spark, sf_dir):
    return hits(spark, sf_dir)


@query("a02_truncated_counts", sql(USABLE + """ SELECT b.chrom, b.start_pos, coalesce(sum(least(2, h.hits)) FILTER (WHERE h.hits IS NOT NULL), 0) AS count FROM bins b LEFT JOIN hits h
    ON h.chrom = b.chrom AND h.pos >= b.start_pos AND h.pos < b.end_pos GROUP BY 1, 2""", "alignments", "bins"))
def a02(spark, sf_dir):
    """Hits in bins, each position at most twice (A02; A01 with stated bins)."""
    return binning.counted(ad.bins(spark, sf_dir), hits(spark, sf_dir), 2).select("chrom", "start_pos", "count")


@query("a05_observed_vs_expected_gc", sql("""
    SELECT gc, round((h / sum(h) OVER ()) / (n / sum(n) OVER ()), 6) AS ratio FROM (SELECT gc, count(*) AS n, greatest(sum(cnt), 1) AS h FROM bins GROUP BY 1)""", "bins"))
def a05(spark, sf_dir):
    return binning.observed_vs_expected(ad.bins(spark, sf_dir)).select("gc", F.round("ratio", 6).alias("ratio"))


@query("a03_gc_weighted_counts", sql(USABLE + """, exp AS (SELECT gc, (h / sum(h) OVER ()) / (n / sum(n) OVER ()) AS expected FROM (SELECT gc, count(*) AS n, greatest(sum(cnt), 1) AS h FROM bins GROUP BY 1))
    SELECT b.chrom, b.start_pos, coalesce(round_even(sum(least(10.0, h.hits / e.expected)) FILTER (WHERE h.hits IS NOT NULL), 0), 0) AS count FROM bins b JOIN exp e USING (gc) LEFT JOIN hits h
    ON h.chrom = b.chrom AND h.pos >= b.start_pos AND h.pos < b.end_pos GROUP BY 1, 2""", "alignments", "bins"))
def a03(spark, sf_dir):
    """Hits weighted by what their bin's GC class lets expect."""
    bins = ad.bins(spark, sf_dir)
    expected = binning.observed_vs_expected(bins).withColumnRenamed("ratio", "expected")
    return binning.weighted_counts(bins, hits(spark, sf_dir), expected).select("chrom", "start_pos", "count")


@query("a01_mappable_bins", sql(USABLE + f""", {MERGED.format('truth', 0)},
    runs AS (SELECT *, end_pos - start_pos AS len, coalesce(sum(end_pos - start_pos) OVER (PARTITION BY chrom ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m_truth),
    ends AS (SELECT chrom, unnest(range(CAST(before // 5000 + 1 AS BIGINT), CAST((before + len) // 5000 + 1 AS BIGINT))) AS k, start_pos, before FROM runs WHERE (before + len) // 5000 > before // 5000),
    spans AS (SELECT chrom, k - 1 AS bin, start_pos + k * 5000 - before AS end_pos FROM ends),
    full_ AS (SELECT chrom, bin, coalesce(lag(end_pos) OVER (PARTITION BY chrom ORDER BY bin), 0) AS start_pos, end_pos FROM spans),
    at_ AS (SELECT h.chrom, (r.before + h.pos - r.start_pos) // 5000 AS bin, sum(least(10, h.hits)) AS count FROM hits h JOIN runs r ON h.chrom = r.chrom AND h.pos >= r.start_pos AND h.pos < r.end_pos GROUP BY 1, 2)
    SELECT f.chrom, f.start_pos, f.end_pos, coalesce(a.count, 0) AS count FROM full_ f LEFT JOIN at_ a ON a.chrom = f.chrom AND a.bin = f.bin""", "alignments", "intervals"))
def a01(spark, sf_dir):
    """Bins of equally many mappable bases."""
    mappable = iv.merge_intervals(ad.intervals(spark, sf_dir, "O")).drop("pieces")
    return binning.fixed_possible_bins(mappable, hits(spark, sf_dir), 5000)


@query("a04_gc_percent", sql("""
    SELECT seq_id, s AS start_pos, CAST(floor(100 * length(regexp_replace(w, '[^GCgc]', '', 'g')) / length(regexp_replace(w, '[^ACGTacgt]', '', 'g'))) AS INT) AS gc
    FROM (SELECT seq_id, s, substr(seq, CAST(s + 1 AS BIGINT), 500) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq), 1), 500)) AS s FROM sequences))
    WHERE length(regexp_replace(w, '[^ACGTacgt]', '', 'g')) > 0""", "sequences"))
def a04(spark, sf_dir):
    return binning.gc_percent(ad.sequences(spark, sf_dir), 500)


@query("a06_bin_size", sql(USABLE + """, rate AS (SELECT sample, chrom, count(*) / (SELECT max(end_pos) FROM bins) AS rate FROM (SELECT DISTINCT sample, chrom, pos FROM usable) GROUP BY 1, 2)
    SELECT CAST(floor(100 / median(rate)) AS INT) AS bin_size, round(median(rate), 9) AS rate FROM rate""", "alignments", "bins"))
def a06(spark, sf_dir):
    """Bin size from the median hit rate of all samples and contigs."""
    reads = binning.usable_starts(ad.alignments(spark, sf_dir))
    bases = ad.bins(spark, sf_dir).agg(F.max("end_pos").alias("bases"))
    possible = ad.bins(spark, sf_dir).select("chrom").distinct().join(F.broadcast(bases))  # one row
    rates = binning.hit_rates(reads.select("sample", "chrom", "pos").distinct(), possible, ["sample", "chrom"])
    return binning.bin_size(rates).join(F.broadcast(rates.agg(F.round(F.median("rate"), 9).alias("rate"))))


@query("a08_mean_fragment", sql("SELECT round(avg(m), 6) AS mean_fragment FROM (SELECT chrom, avg(frag_len) AS m FROM alignments WHERE frag_len > 0 GROUP BY 1)", "alignments"))
def a08(spark, sf_dir):
    return binning.fragment_mean(ad.alignments(spark, sf_dir)).select(F.round("mean_fragment", 6).alias("mean_fragment"))


@query("a09_bases_in_regions", sql(USABLE + f""", {MERGED.format('truth', 0)}
    SELECT h.chrom, count(*) AS n FROM hits h JOIN m_truth t ON h.chrom = t.chrom AND h.pos >= t.start_pos AND h.pos < t.end_pos GROUP BY 1""", "alignments", "intervals"))
def a09(spark, sf_dir):
    return binning.set_bases(hits(spark, sf_dir), ad.intervals(spark, sf_dir, "O"))


@query("j06_fragments", sql("""
    SELECT read_id, sample, chrom, min(pos) AS start_pos, min(pos) + max(frag_len) AS end_pos FROM alignments GROUP BY 1, 2, 3
    HAVING bool_and(NOT is_dup AND mapq >= 3 AND mapq != 255)""", "alignments"))
def j06(spark, sf_dir):
    """Fragments whose mates all pass."""
    out = binning.fragments(ad.alignments(spark, sf_dir), ["read_id", "sample"])
    return out.select("read_id", "sample", "chrom", "start_pos", "end_pos")


@query("j24_pileup", sql("""
    SELECT s.chrom, s.pos, a.read_id, CASE WHEN s.pos < a.pos + 30 THEN 5 + s.pos - a.pos ELSE 35 + s.pos - a.pos - 40 END AS read_offset
    FROM sites s JOIN alignments a ON s.chrom = a.chrom AND s.pos >= a.pos AND s.pos < a.pos + 100 AND NOT (s.pos >= a.pos + 30 AND s.pos < a.pos + 40) WHERE a.mapq > 3""", "sites", "alignments"))
def j24(spark, sf_dir):
    """Reads over sites through an alignment of 5S30M10D60M."""
    ops = [("S", 5), ("M", 30), ("D", 10), ("M", 60)]
    cigar = F.array(*[F.struct(F.lit(o).alias("op"), F.lit(n).alias("len")) for o, n in ops])
    reads = ad.alignments(spark, sf_dir).withColumn("cigar", cigar)
    return binning.pileup(reads, ad.sites(spark, sf_dir).select("chrom", "pos")).select("chrom", "pos", "read_id", "read_offset")


@query("c02_allele_frequency", sql("""
    , a AS (SELECT *, substr('ATGC', CAST(1 + pos // 200 % 4 AS INT), 1) AS ref, substr('ATGC', CAST(1 + pos // 800 % 4 AS INT), 1) AS alt FROM sites),
    f AS (SELECT *, CASE WHEN ref_count + alt_count >= 1 THEN CASE WHEN instr('ATGC', ref) <= instr('ATGC', alt) THEN alt_count / (ref_count + alt_count) ELSE ref_count / (ref_count + alt_count) END END AS b FROM a)
    SELECT chrom, pos, ref, alt, round(b, 6) AS baf, round(CASE WHEN b > 0.5 THEN 1 - b ELSE b END, 6) AS maf FROM f""", "sites"))
def c02(spark, sf_dir):
    """B-allele frequency and its fold."""
    letter = "substr('ATGC', cast(1 + pos div {} % 4 as int), 1)"
    rows = ad.sites(spark, sf_dir).withColumns({"ref": F.expr(letter.format(200)), "alt": F.expr(letter.format(800))})
    baf = binning.b_allele_frequency(F.col("ref"), F.col("alt"), F.col("ref_count"), F.col("alt_count"))
    rows = rows.withColumn("b", baf)
    return rows.select("chrom", "pos", "ref", "alt", F.round("b", 6).alias("baf"), F.round(binning.minor_frequency(F.col("b")), 6).alias("maf"))


@query("f03_site_filter", sql("""
    SELECT chrom, pos, ref_count, alt_count FROM sites WHERE filt IN ('click', 'view', 'purchase') AND ref_count + alt_count > 0 AND alt_count > 0""", "sites"))
def f03(spark, sf_dir):
    """Sites that pass their filter with reads of the alternate allele."""
    rows = ad.sites(spark, sf_dir).filter(F.col("filt").isin("click", "view", "purchase"))
    return rows.filter("ref_count + alt_count > 0 and alt_count > 0").select("chrom", "pos", "ref_count", "alt_count")


CUBE = f""", {MERGED.format('excl', 0)},
    pieces AS (SELECT t.iv_id, t.chrom, greatest(t.start_pos, c.start_pos) AS s, least(t.end_pos, c.end_pos) AS e, least(t.cn, 5) AS known_cn, least(c.cn, 5) AS call_cn
        FROM truth t JOIN calls c ON t.chrom = c.chrom AND t.start_pos < c.end_pos AND c.start_pos < t.end_pos),
    open_ AS (SELECT p.*, p.e - p.s - coalesce((SELECT sum(least(p.e, x.end_pos) - greatest(p.s, x.start_pos)) FROM m_excl x WHERE x.chrom = p.chrom AND p.s < x.end_pos AND x.start_pos < p.e), 0) AS bases FROM pieces p),
    isl AS (SELECT *, sum(o) OVER (PARTITION BY iv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY iv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS o FROM pieces)),
    touched AS (SELECT iv_id, chrom, min(s) AS s, max(e) AS e FROM isl GROUP BY iv_id, chrom, island),
    seen AS (SELECT iv_id, sum(e - s - coalesce((SELECT sum(least(p.e, x.end_pos) - greatest(p.s, x.start_pos)) FROM m_excl x WHERE x.chrom = p.chrom AND p.s < x.end_pos AND x.start_pos < p.e), 0)) AS seen FROM touched p GROUP BY 1),
    whole AS (SELECT t.iv_id, least(t.cn, 5) AS known_cn, t.end_pos - t.start_pos - coalesce((SELECT sum(least(t.end_pos, x.end_pos) - greatest(t.start_pos, x.start_pos)) FROM m_excl x WHERE x.chrom = t.chrom AND t.start_pos < x.end_pos AND x.start_pos < t.end_pos), 0) AS bases FROM truth t),
    cube AS (SELECT known_cn, call_cn, sum(bases) AS bases FROM open_ GROUP BY 1, 2 HAVING sum(bases) > 0
        UNION ALL SELECT known_cn, NULL, sum(w.bases - coalesce(s.seen, 0)) FROM whole w LEFT JOIN seen s USING (iv_id) GROUP BY 1)"""


def cube(spark, sf_dir):
    return evaluation.confusion(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "F"), ad.intervals(spark, sf_dir, "P"))


@query("e01_confusion_cube", sql(CUBE + " SELECT * FROM cube WHERE bases > 0", "intervals"))
def e01(spark, sf_dir):
    """Bases by known and called copy number, exclusions taken out."""
    return cube(spark, sf_dir)


@query("e02_metrics", sql(CUBE + """, s AS (SELECT sum(bases) FILTER (WHERE call_cn IS NOT NULL) AS all_, coalesce(sum(bases) FILTER (WHERE call_cn = known_cn), 0) AS ok,
    sum(bases) FILTER (WHERE known_cn != 2) AS ka, sum(bases) FILTER (WHERE call_cn != 2) AS ca, coalesce(sum(bases) FILTER (WHERE known_cn != 2 AND call_cn = known_cn), 0) AS hit FROM cube)
    SELECT round(100 * ok / all_, 6) AS accuracy, round(100 * hit / ka, 6) AS recall, round(100 * hit / ca, 6) AS precision FROM s""", "intervals"))
def e02(spark, sf_dir):
    """The headline metrics; tests cover all fifteen."""
    return evaluation.metrics(cube(spark, sf_dir)).select("accuracy", "recall", "precision")


@query("e03_event_accuracy", sql("""
    , right_ AS (SELECT t.iv_id, greatest(t.start_pos, c.start_pos) AS s, least(t.end_pos, c.end_pos) AS e FROM truth t JOIN calls c ON t.chrom = c.chrom AND t.cn = c.cn AND t.start_pos < c.end_pos AND c.start_pos < t.end_pos),
    isl AS (SELECT *, sum(o) OVER (PARTITION BY iv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY iv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS o FROM right_)),
    hit AS (SELECT iv_id, sum(e - s) AS hit FROM (SELECT iv_id, min(s) AS s, max(e) AS e FROM isl GROUP BY iv_id, island) GROUP BY 1),
    each AS (SELECT coalesce(hit, 0) / (end_pos - start_pos) AS share FROM truth LEFT JOIN hit USING (iv_id))
    SELECT round(avg(share), 6) AS mean_accuracy, round((list(share ORDER BY share))[count(*) // 2 + 1], 6) AS median_accuracy FROM each""", "intervals"))
def e03(spark, sf_dir):
    out = evaluation.event_accuracy(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "F"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("e04_size_strata", sql("""
    SELECT CASE WHEN n >= 500000 THEN 4 WHEN n >= 100000 THEN 3 WHEN n >= 10000 THEN 2 WHEN n >= 5000 THEN 1 ELSE 0 END AS stratum, count(*) AS n_intervals, sum(n) AS bases
    FROM (SELECT 100 * (end_pos - start_pos) AS n FROM truth) GROUP BY 1""", "intervals"))
def e04(spark, sf_dir):
    rows = ad.intervals(spark, sf_dir, "O").withColumn("n", 100 * (F.col("end_pos") - F.col("start_pos")))
    return rows.groupBy(evaluation.stratum(F.col("n")).alias("stratum")).agg(F.count(F.lit(1)).alias("n_intervals"), F.sum("n").alias("bases"))


@query("e06_truth_summary", sql("SELECT cn, count(*) AS n, sum(end_pos - start_pos) AS bases, round(avg(end_pos - start_pos), 6) AS mean_size, median(end_pos - start_pos) AS median_size FROM truth GROUP BY 1", "intervals"))
def e06(spark, sf_dir):
    return evaluation.size_summary(ad.intervals(spark, sf_dir, "O"))


@query("e07_reference_ploidy", sql("""
    , ploidy AS (SELECT chrom, start_pos, end_pos, cn FROM tiles WHERE gc % 2 = 0 QUALIFY row_number() OVER (PARTITION BY chrom, start_pos ORDER BY gc, cn) = 1),
    s AS (SELECT t.iv_id, any_value(t.end_pos - t.start_pos) AS len, coalesce(sum(least(t.end_pos, p.end_pos) - greatest(t.start_pos, p.start_pos)) FILTER (WHERE p.chrom IS NOT NULL), 0) AS n,
        coalesce(sum((least(t.end_pos, p.end_pos) - greatest(t.start_pos, p.start_pos)) * p.cn) FILTER (WHERE p.chrom IS NOT NULL), 0) AS w
        FROM truth t LEFT JOIN ploidy p ON t.chrom = p.chrom AND t.start_pos < p.end_pos AND p.start_pos < t.end_pos GROUP BY 1)
    SELECT iv_id, CAST(round_even((w + 2 * (len - n)) / len, 0) AS INT) AS ref_ploidy FROM s""", "tiles", "intervals"))
def e07(spark, sf_dir):
    return evaluation.reference_ploidy(ad.intervals(spark, sf_dir, "O"), ploidy(spark, sf_dir))


@query("s15_truth_rounding", sql("SELECT iv_id, CAST(floor(cn / 2 + 0.5) AS INT) AS cn FROM truth WHERE end_pos - start_pos >= 300", "intervals"))
def s15(spark, sf_dir):
    """Truth of a least size with fractional copy numbers rounded, halves upwards."""
    rows = ad.intervals(spark, sf_dir, "O").filter("end_pos - start_pos >= 300")
    return rows.select("iv_id", evaluation.rounded_up(F.col("cn") / 2).alias("cn"))
