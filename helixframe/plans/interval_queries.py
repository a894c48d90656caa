"""Registered queries of the interval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import intervals as iv
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


GENOME = "genome AS (SELECT 'chr' || CAST(i AS VARCHAR) AS chrom, CAST(100000 + (SELECT count(*) FROM orders) * 130 AS BIGINT) AS length FROM range(1, 6) t(i))"
#: Merged truth, calls and exclusions as further common table expressions.
MERGED = """m_{0} AS (SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS pieces FROM (
    SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_pos > max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {1} OR lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos) IS NULL
            THEN 1 ELSE 0 END AS opens FROM {0})) GROUP BY chrom, island)"""


def genome(spark, sf_dir):
    """Five contigs that reach beyond the last interval."""
    length = ad.read(spark, sf_dir, "orders").agg((F.lit(100000) + F.count(F.lit(1)) * 130).cast("long").alias("length"))
    names = spark.range(1, 6).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"))
    return names.join(F.broadcast(length))  # one row


@query("j01_overlap_join", sql("""
    SELECT t.iv_id, c.iv_id AS iv_id_r, t.chrom, least(t.end_pos, c.end_pos) - greatest(t.start_pos, c.start_pos) AS overlap
    FROM truth t JOIN calls c ON t.chrom = c.chrom AND t.start_pos < c.end_pos AND c.start_pos < t.end_pos""", "intervals"))
def j01(spark, sf_dir):
    """Pairs of truth and call intervals with the length of their overlap."""
    pairs = iv.overlap_join(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "F"))
    return pairs.select("iv_id", "iv_id_r", "chrom", "overlap")


@query("j02_excluded_bins", sql("""
    SELECT * FROM bins b WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.chrom = b.chrom
        AND b.start_pos < e.end_pos AND e.start_pos < b.end_pos)""", "bins", "intervals"))
def j02(spark, sf_dir):
    """Bins that touch no excluded interval."""
    return iv.overlap_anti(ad.bins(spark, sf_dir), ad.intervals(spark, sf_dir, "P"))


@query("j03_sites_in_intervals", sql("""
    SELECT s.chrom, s.pos, s.ref_count, s.alt_count, t.iv_id AS iv_id_r
    FROM sites s JOIN truth t ON s.chrom = t.chrom AND t.start_pos <= s.pos AND s.pos < t.end_pos
    WHERE s.ref_count + s.alt_count >= 10""", "sites", "intervals"))
def j03(spark, sf_dir):
    """Sites of depth 10 or more with the intervals that they lie in."""
    deep = ad.sites(spark, sf_dir).filter("ref_count + alt_count >= 10")
    return iv.points_in(deep, ad.intervals(spark, sf_dir, "O")).select("chrom", "pos", "ref_count", "alt_count", "iv_id_r")


@query("j04_on_target_bins", sql("""
    SELECT * FROM bins b WHERE EXISTS (SELECT 1 FROM truth e WHERE e.chrom = b.chrom
        AND b.start_pos < e.end_pos AND e.start_pos < b.end_pos)""", "bins", "intervals"))
def j04(spark, sf_dir):
    """Bins that touch a target region."""
    return iv.overlap_semi(ad.bins(spark, sf_dir), ad.intervals(spark, sf_dir, "O"))


@query("j05_target_flags", sql("""
    SELECT b.chrom, b.start_pos, b.cnt, EXISTS (SELECT 1 FROM truth e WHERE e.chrom = b.chrom
        AND b.start_pos < e.end_pos AND e.start_pos < b.end_pos) AS on_target FROM bins b""", "bins", "intervals"))
def j05(spark, sf_dir):
    """All bins with a flag for those on target."""
    flagged = iv.overlap_flag(ad.bins(spark, sf_dir), ad.intervals(spark, sf_dir, "O"))
    return flagged.select("chrom", "start_pos", "cnt", "on_target")


@query("j07_best_bin", sql("""
    SELECT iv_id, bin_start, overlap FROM (
        SELECT c.iv_id, b.start_pos AS bin_start, least(b.end_pos, c.end_pos) - greatest(b.start_pos, c.start_pos) AS overlap,
               row_number() OVER (PARTITION BY c.iv_id ORDER BY least(b.end_pos, c.end_pos) - greatest(b.start_pos, c.start_pos) DESC, b.start_pos) AS n
        FROM calls c JOIN bins b ON c.chrom = b.chrom AND c.start_pos < b.end_pos AND b.start_pos < c.end_pos) WHERE n = 1""",
    "bins", "intervals"))
def j07(spark, sf_dir):
    """For each fragment the bin with the longest overlap."""
    best = iv.best_overlap(ad.intervals(spark, sf_dir, "F"), ad.bins(spark, sf_dir), ["iv_id"])
    return best.select("iv_id", F.col("start_pos_r").alias("bin_start"), "overlap")


@query("j08_intersections", sql("""
    SELECT b.chrom, greatest(b.start_pos, t.start_pos) AS start_pos, least(b.end_pos, t.end_pos) AS end_pos, b.gc, b.cnt
    FROM bins b JOIN truth t ON b.chrom = t.chrom AND b.start_pos < t.end_pos AND t.start_pos < b.end_pos""", "bins", "intervals"))
def j08(spark, sf_dir):
    """The pieces of bins inside target regions."""
    return iv.intersections(ad.bins(spark, sf_dir), ad.intervals(spark, sf_dir, "O").drop("cn", "st")).select(
        "chrom", "start_pos", "end_pos", "gc", "cnt"
    )


@query("j09_mask_subtraction", sql(f""",
    {MERGED.format('excl', 0)}, {MERGED.format('truth', 0)}
    SELECT chrom, sum(bases) AS bases FROM (
        SELECT chrom, end_pos - start_pos AS bases FROM m_truth
        UNION ALL SELECT t.chrom, -(least(t.end_pos, e.end_pos) - greatest(t.start_pos, e.start_pos)) FROM m_truth t
        JOIN m_excl e ON t.chrom = e.chrom AND t.start_pos < e.end_pos AND e.start_pos < t.end_pos) GROUP BY chrom""", "intervals"))
def j09(spark, sf_dir):
    """Bases of the target left after the mask is taken out, by contig."""
    left = iv.subtract(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "P"))
    return left.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("bases"))


_PLOIDY = """, ploidy AS (SELECT chrom, start_pos, end_pos, cn FROM tiles WHERE gc % 2 = 0 QUALIFY
    row_number() OVER (PARTITION BY chrom, start_pos ORDER BY gc, cn) = 1)"""


def ploidy(spark, sf_dir):
    """Disjoint ploidy intervals from the tiles."""
    return ad.tiles(spark, sf_dir).filter("gc % 2 = 0").groupBy("chrom", "start_pos", "end_pos").agg(
        F.min(F.struct("gc", "cn")).alias("t")
    ).select("chrom", "start_pos", "end_pos", F.col("t.cn").alias("cn"))


@query("j11_majority_ploidy", sql(_PLOIDY + """,
    known AS (SELECT c.iv_id, p.cn, sum(least(c.end_pos, p.end_pos) - greatest(c.start_pos, p.start_pos)) AS bases
        FROM calls c JOIN ploidy p ON c.chrom = p.chrom AND c.start_pos < p.end_pos AND p.start_pos < c.end_pos GROUP BY 1, 2),
    every AS (SELECT * FROM known UNION ALL SELECT c.iv_id, 2, (c.end_pos - c.start_pos) - coalesce((SELECT sum(bases) FROM known k WHERE k.iv_id = c.iv_id), 0)
        FROM calls c),
    summed AS (SELECT iv_id, cn, sum(bases) AS bases FROM every WHERE bases > 0 GROUP BY 1, 2)
    SELECT iv_id, cn FROM (SELECT *, row_number() OVER (PARTITION BY iv_id ORDER BY bases DESC, cn) AS n FROM summed) WHERE n = 1""",
    "tiles", "intervals"))
def j11(spark, sf_dir):
    """The reference ploidy that covers most of each call; 2 where nothing is stated."""
    calls = ad.intervals(spark, sf_dir, "F").drop("cn")
    return iv.majority_value(calls, ploidy(spark, sf_dir), "cn", ["iv_id"]).select("iv_id", F.col("cn").cast("int").alias("cn"))


@query("j12_uniform_ploidy", sql(_PLOIDY + """
    SELECT c.iv_id, count(DISTINCT p.cn) < 2 AS uniform FROM calls c LEFT JOIN ploidy p
    ON c.chrom = p.chrom AND c.start_pos < p.end_pos AND p.start_pos < c.end_pos GROUP BY 1""", "tiles", "intervals"))
def j12(spark, sf_dir):
    """Whether fewer than two ploidies occur in each call."""
    calls = ad.intervals(spark, sf_dir, "F").select("iv_id", "chrom", "start_pos", "end_pos")
    found = iv.overlap_join(calls, ploidy(spark, sf_dir)).groupBy("iv_id").agg((F.countDistinct("cn_r") < 2).alias("uniform"))
    return calls.select("iv_id").join(found, "iv_id", "left").select("iv_id", F.coalesce("uniform", F.lit(True)).alias("uniform"))


@query("j13_agnostic_contigs", sql("""
    SELECT s.bare AS chrom, count(*) AS n FROM (SELECT replace(chrom, 'chr', '') AS bare, pos FROM sites) s
    JOIN (SELECT DISTINCT replace(chrom, 'chr', '') AS bare FROM bins) b ON s.bare = b.bare GROUP BY 1""", "sites", "bins"))
def j13(spark, sf_dir):
    """Sites joined to contigs whose names may lack the prefix."""
    named = ad.bins(spark, sf_dir).select(iv.agnostic_chrom(F.col("chrom")).alias("chrom")).distinct()
    sites = ad.sites(spark, sf_dir).withColumn("chrom", iv.agnostic_chrom(F.col("chrom")))
    return sites.join(named, "chrom").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("j14_ploidy_pieces", sql(_PLOIDY + """,
    points AS (SELECT c.iv_id, c.chrom, unnest([greatest(c.start_pos, p.start_pos), least(c.end_pos, p.end_pos)]) AS pt
        FROM calls c JOIN ploidy p ON c.chrom = p.chrom AND c.start_pos < p.end_pos AND p.start_pos < c.end_pos
        UNION ALL SELECT iv_id, chrom, unnest([start_pos, end_pos]) FROM calls),
    cuts AS (SELECT iv_id, chrom, pt AS start_pos, lead(pt) OVER (PARTITION BY iv_id ORDER BY pt) AS end_pos FROM (SELECT DISTINCT * FROM points)),
    pieces AS (SELECT u.iv_id, u.chrom, u.start_pos, u.end_pos, coalesce(p.cn, 2) AS cn FROM cuts u LEFT JOIN ploidy p
        ON u.chrom = p.chrom AND u.start_pos < p.end_pos AND p.start_pos < u.end_pos WHERE u.end_pos IS NOT NULL),
    marked AS (SELECT *, sum(opens) OVER (PARTITION BY iv_id ORDER BY start_pos) AS island FROM (SELECT *,
        CASE WHEN lag(cn) OVER (PARTITION BY iv_id ORDER BY start_pos) = cn THEN 0 ELSE 1 END AS opens FROM pieces))
    SELECT iv_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos, cn FROM marked GROUP BY iv_id, island, cn""",
    "tiles", "intervals"))
def j14(spark, sf_dir):
    """Calls cut into maximal pieces of one reference ploidy."""
    calls = ad.intervals(spark, sf_dir, "F").drop("cn")
    return iv.value_pieces(calls, ploidy(spark, sf_dir), "cn", ["iv_id"]).select("iv_id", "start_pos", "end_pos", "cn")


@query("j15_truth_lookup", sql("""
    SELECT iv_id, known_cn FROM (SELECT c.iv_id, t.cn AS known_cn,
        row_number() OVER (PARTITION BY c.iv_id ORDER BY t.start_pos, t.iv_id) AS n
        FROM calls c JOIN truth t ON c.chrom = t.chrom AND c.start_pos < t.end_pos AND t.start_pos < c.end_pos
        WHERE 2 * (least(c.end_pos, t.end_pos) - greatest(c.start_pos, t.start_pos)) >= c.end_pos - c.start_pos) WHERE n = 1""", "intervals"))
def j15(spark, sf_dir):
    """The first truth interval that covers half of a call or more."""
    pairs = iv.overlap_join(ad.intervals(spark, sf_dir, "F"), ad.intervals(spark, sf_dir, "O"))
    half = pairs.filter("2 * overlap >= end_pos - start_pos")
    first = half.groupBy("iv_id").agg(F.min(F.struct("start_pos_r", "iv_id_r", "cn_r")).alias("t"))
    return first.select("iv_id", F.col("t.cn_r").alias("known_cn"))


@query("j17_bin_index", sql(""", numbered AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_pos) - 1 AS idx FROM bins)
    SELECT c.iv_id, min(b.idx) AS first_bin, max(b.idx) AS last_bin FROM calls c JOIN numbered b
    ON c.chrom = b.chrom AND c.start_pos < b.end_pos AND b.start_pos < c.end_pos GROUP BY 1""", "bins", "intervals"))
def j17(spark, sf_dir):
    """Genomic intervals as ranges of bin numbers."""
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("start_pos")
    numbered = ad.bins(spark, sf_dir).withColumn("idx", F.row_number().over(order) - 1)
    pairs = iv.overlap_join(ad.intervals(spark, sf_dir, "F"), numbered.select("chrom", "start_pos", "end_pos", "idx"))
    return pairs.groupBy("iv_id").agg(F.min("idx_r").alias("first_bin"), F.max("idx_r").alias("last_bin"))


@query("j23_forbidden_gaps", sql(""", gaps AS (SELECT chrom, end_pos AS gap_start, lead(start_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS gap_end FROM bins)
    SELECT chrom, gap_start, gap_end, EXISTS (SELECT 1 FROM excl e WHERE e.chrom = g.chrom AND g.gap_start < e.end_pos AND e.start_pos < g.gap_end) AS forbidden
    FROM gaps g WHERE gap_end > gap_start""", "bins", "intervals"))
def j23(spark, sf_dir):
    """Gaps between neighbouring bins that an excluded interval touches."""
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("start_pos")
    gaps = ad.bins(spark, sf_dir).select("chrom", F.col("end_pos").alias("start_pos"), F.lead("start_pos").over(order).alias("end_pos"))
    flagged = iv.overlap_flag(gaps.filter("start_pos < end_pos"), ad.intervals(spark, sf_dir, "P"), "forbidden")
    return flagged.select("chrom", F.col("start_pos").alias("gap_start"), F.col("end_pos").alias("gap_end"), "forbidden")


@query("w08_breakpoint_union", sql(""", points AS (SELECT chrom, unnest([start_pos, end_pos]) AS p, unnest([1, -1]) AS d FROM calls),
    steps AS (SELECT chrom, p, sum(d) AS step FROM points GROUP BY 1, 2),
    swept AS (SELECT chrom, p AS start_pos, lead(p) OVER w AS end_pos, sum(step) OVER w AS depth FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY p))
    SELECT chrom, start_pos, end_pos, depth FROM swept WHERE depth > 0 AND end_pos IS NOT NULL""", "intervals"))
def w08(spark, sf_dir):
    """Pieces between all breakpoints of overlapping segments."""
    return iv.breakpoint_union(ad.intervals(spark, sf_dir, "F"))


@query("w11_merged_intervals", sql(f""", {MERGED.format('calls', 50)} SELECT chrom, start_pos, end_pos, pieces FROM m_calls""", "intervals"))
def w11(spark, sf_dir):
    """Calls within 50 bases of each other as one interval."""
    return iv.merge_intervals(ad.intervals(spark, sf_dir, "F"), 50)


@query("w12_complement", sql(f""", {GENOME}, {MERGED.format('excl', 0)},
    ends AS (SELECT chrom, start_pos, end_pos FROM m_excl UNION ALL SELECT chrom, length, length FROM genome),
    gaps AS (SELECT chrom, coalesce(lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos), 0) AS start_pos, start_pos AS end_pos FROM ends)
    SELECT * FROM gaps WHERE start_pos < end_pos""", "intervals"))
def w12(spark, sf_dir):
    """The callable part of every contig: what no excluded interval covers."""
    return iv.complement(ad.intervals(spark, sf_dir, "P"), genome(spark, sf_dir))


@query("w15_segment_windows", sql("""
    SELECT iv_id, chrom, s AS start_pos, least(s + 250, end_pos) AS end_pos
    FROM (SELECT iv_id, chrom, end_pos, unnest(range(start_pos, end_pos, 250)) AS s FROM calls)""", "intervals"))
def w15(spark, sf_dir):
    """Segments cut into windows of 250 bases."""
    return iv.windows_of(ad.intervals(spark, sf_dir, "F"), 250, ["iv_id"])


@query("w17_callability", sql(f""", {GENOME}, {MERGED.format('excl', 0)}, {MERGED.format('calls', 0)},
    total AS (SELECT g.chrom, max(g.length) - coalesce(sum(e.end_pos - e.start_pos), 0) AS callable FROM genome g LEFT JOIN m_excl e ON g.chrom = e.chrom GROUP BY 1),
    used AS (SELECT c.chrom, sum(c.end_pos - c.start_pos) AS called FROM m_calls c GROUP BY 1),
    lost AS (SELECT c.chrom, sum(least(c.end_pos, e.end_pos) - greatest(c.start_pos, e.start_pos)) AS masked FROM m_calls c JOIN m_excl e
        ON c.chrom = e.chrom AND c.start_pos < e.end_pos AND e.start_pos < c.end_pos GROUP BY 1)
    SELECT t.chrom, t.callable, u.called - coalesce(l.masked, 0) AS called, round((u.called - coalesce(l.masked, 0)) / t.callable, 6) AS callability
    FROM total t JOIN used u USING (chrom) LEFT JOIN lost l USING (chrom)""", "intervals"))
def w17(spark, sf_dir):
    """Share of each contig's callable bases that is called."""
    open_ = iv.complement(ad.intervals(spark, sf_dir, "P"), genome(spark, sf_dir))
    open_ = iv.covered(open_, ad.intervals(spark, sf_dir, "F"), "called")
    sums = open_.groupBy("chrom").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("callable"), F.sum("called").alias("called"))
    return sums.withColumn("callability", F.round(F.col("called") / F.col("callable"), 6))


@query("e05_excluded_bases", sql(f""", {MERGED.format('excl', 0)}
    SELECT t.iv_id, coalesce(sum(least(t.end_pos, e.end_pos) - greatest(t.start_pos, e.start_pos)) FILTER (WHERE e.chrom IS NOT NULL), 0) AS excluded_bases
    FROM truth t LEFT JOIN m_excl e ON t.chrom = e.chrom AND t.start_pos < e.end_pos AND e.start_pos < t.end_pos GROUP BY 1""", "intervals"))
def e05(spark, sf_dir):
    """Excluded bases of each truth interval."""
    return iv.covered(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "P"), "excluded_bases").select("iv_id", "excluded_bases")


@query("f20_mappable_truth", sql(f""", {MERGED.format('excl', 0)},
    masked AS (SELECT t.iv_id, any_value(t.cn) AS cn, any_value(t.end_pos - t.start_pos) AS len,
        coalesce(sum(least(t.end_pos, e.end_pos) - greatest(t.start_pos, e.start_pos)) FILTER (WHERE e.chrom IS NOT NULL), 0) AS n
        FROM truth t LEFT JOIN m_excl e ON t.chrom = e.chrom AND t.start_pos < e.end_pos AND e.start_pos < t.end_pos GROUP BY 1)
    SELECT iv_id, cn FROM masked WHERE cn = 2 OR n < 0.8 * len""", "intervals"))
def f20(spark, sf_dir):
    """Truth without the altered intervals that are masked to 80 percent or more."""
    masked = iv.covered(ad.intervals(spark, sf_dir, "O"), ad.intervals(spark, sf_dir, "P"), "masked")
    return masked.filter("cn = 2 or masked < 0.8 * (end_pos - start_pos)").select("iv_id", "cn")


@query("u01_set_tests", sql("""
    SELECT NOT EXISTS (SELECT chrom FROM calls EXCEPT SELECT chrom FROM bins) AS subset,
           (SELECT count(*) FROM (SELECT chrom FROM calls INTERSECT SELECT chrom FROM bins)) AS shared,
           (SELECT count(*) FROM (SELECT chrom, cn FROM calls UNION SELECT chrom, cn FROM truth)) AS kinds""", "bins", "intervals"))
def u01(spark, sf_dir):
    """Set operations on contigs: subset test, intersection, and union of distinct rows."""
    calls, truth = ad.intervals(spark, sf_dir, "F"), ad.intervals(spark, sf_dir, "O")
    known = ad.bins(spark, sf_dir).select("chrom").distinct()
    used = calls.select("chrom").distinct()
    odd = used.join(known, "chrom", "left_anti").agg((F.count(F.lit(1)) == 0).alias("subset"))
    shared = used.join(known, "chrom", "left_semi").agg(F.count(F.lit(1)).alias("shared"))
    kinds = calls.select("chrom", "cn").union(truth.select("chrom", "cn")).distinct().agg(F.count(F.lit(1)).alias("kinds"))
    return odd.join(F.broadcast(shared)).join(F.broadcast(kinds))  # one row each


@query("k07_unknown_contigs", sql("""
    SELECT DISTINCT chrom FROM calls c WHERE lower(chrom) NOT IN (SELECT lower(chrom) FROM tiles WHERE cn > 0 AND chrom != 'chr3')""", "tiles", "intervals"))
def k07(spark, sf_dir):
    """Contigs of calls that the genome does not name, letter case aside."""
    known = ad.tiles(spark, sf_dir).filter("cn > 0 and chrom != 'chr3'").select(F.lower("chrom").alias("k")).distinct()
    used = ad.intervals(spark, sf_dir, "F").select("chrom").distinct()
    return used.join(known, F.lower("chrom") == F.col("k"), "left_anti")
