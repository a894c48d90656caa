"""Registered queries of phased genotypes and of a trio's joint call, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import haplotypes
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


#: Reads of one copy, the size of their negative binomial, and the deepest count of a site.
MEAN, SIZE, DEEPEST = 9.0, 20.0, 60


def _nb(k: str, copies: str) -> str:
    mu = f"(greatest({copies}, 0.1) * {MEAN})"
    return f"exp(lgamma({k} + {SIZE}) - lgamma({k} + 1) - lgamma({SIZE}) + {SIZE} * ln({SIZE} / ({SIZE} + {mu})) + {k} * ln({mu} / ({SIZE} + {mu})))"


#: The sites of three samples, and each segment's depth as the median of theirs.
FAMILY_SITES = """, fam AS (SELECT 's' || CAST(s AS VARCHAR) AS sample, chrom, pos // 50000 AS seg, CAST((ref_count * (s + 2)) % 23 AS INT) AS x, CAST((alt_count + 3 * s) % 19 AS INT) AS y FROM sites, range(3) r(s))"""
PHASED = FAMILY_SITES + f""", gt AS (SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM range(5) i(a), range(5) j(b) WHERE a + b <= 4),
    one AS (SELECT x, y, exp(w + x * ln(0.01) + y * ln(0.99)) + exp(w + y * ln(0.01) + x * ln(0.99)) AS e FROM (SELECT DISTINCT x, y, lgamma(x + y + 1) - lgamma(x + 1) - lgamma(y + 1) AS w FROM fam)),
    lx AS (SELECT x, y, a, b, ln(greatest(1e-300, CASE WHEN a + b = 0 THEN {_nb('(x + y)', '0')} WHEN a > 0 AND b > 0 THEN ({_nb('x', 'a')} * {_nb('y', 'b')} + {_nb('y', 'a')} * {_nb('x', 'b')}) / 3 + {_nb('(x + y)', '(a + b)')} * e / 6
        ELSE {_nb('(x + y)', '(a + b)')} * e END)) AS l FROM one, gt),
    ph AS (SELECT sample, chrom, seg, a, b, sum(l) AS log_l, count(*) AS sites FROM fam JOIN lx USING (x, y) GROUP BY 1, 2, 3, 4, 5)"""
JOINED = PHASED + f""", cov AS (SELECT sample, chrom, seg, CAST(cn AS INT) AS cn, {_nb('d', 'cn')} AS p FROM (SELECT sample, chrom, seg, floor(median(x + y)) AS d FROM fam GROUP BY 1, 2, 3), range(5) c(cn)),
    ends AS (SELECT sample, chrom, seg, max(log_l) FILTER (WHERE a = 1 AND b = 1) AS even, max(log_l) FILTER (WHERE abs(a - b) = 2 AND a + b = 2) AS lost, min(log_l) AS lowest FROM ph GROUP BY 1, 2, 3),
    jl AS (SELECT sample, chrom, seg, a, b, CASE WHEN abs(a - b) = 2 AND a + b = 2 AND even >= lost THEN lowest ELSE log_l END / sites + ln(greatest(p, 1e-300)) AS log_l
        FROM ph JOIN ends USING (sample, chrom, seg) JOIN cov USING (sample, chrom, seg) WHERE cn = a + b)"""


def family_sites(spark, sf_dir, samples=3):
    """The sites of so many samples, dealt by segment before they are copied for each sample."""
    rows = ad.sites(spark, sf_dir).select("chrom", F.expr("pos div 50000").alias("seg"), "ref_count", "alt_count").repartition("chrom", "seg")
    rows = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return rows.select(
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), "chrom", "seg",
        (F.col("ref_count") * (F.col("s") + 2) % 23).alias("ref_count"), ((F.col("alt_count") + 3 * F.col("s")) % 19).alias("alt_count"),
    )


KEY = ["sample", "chrom", "seg"]


def phased(spark, sf_dir, samples=3):
    table = haplotypes.depth_table(spark, MEAN, SIZE, 4, DEEPEST)
    return haplotypes.phased_likelihoods(family_sites(spark, sf_dir, samples), KEY, table, 4, DEEPEST)


def joined(spark, sf_dir, samples=3):
    """Likelihoods of sites and of depth together."""
    table = haplotypes.depth_table(spark, MEAN, SIZE, 4, DEEPEST)
    depth = family_sites(spark, sf_dir, samples).groupBy(*KEY).agg(F.floor(F.median(F.col("ref_count") + F.col("alt_count"))).cast("int").alias("d"))
    states = depth.crossJoin(F.broadcast(table)).select(*KEY, F.posexplode("p").alias("cn", "of"), "d")  # one row
    missing = F.raise_error(F.lit("a segment's depth lies beyond the table of likelihoods"))
    coverage = states.select(*KEY, "cn", F.coalesce(F.get("of", F.col("d")), missing).alias("p"))
    return haplotypes.with_coverage(phased(spark, sf_dir, samples), coverage, KEY)


@query("p09_phased_likelihoods", sql(PHASED + " SELECT sample, chrom, seg, a, b, round(log_l, 4) AS log_l, sites FROM ph", "sites"))
def p09(spark, sf_dir):
    """Log likelihoods of phased genotypes from allele counts."""
    return phased(spark, sf_dir).withColumn("log_l", F.round("log_l", 4))


@query("p12_joined_likelihoods", sql(JOINED + " SELECT sample, chrom, seg, a, b, round(log_l, 5) AS log_l FROM jl", "sites"))
def p12(spark, sf_dir):
    """Likelihoods of sites and depth as one, lost haplotypes held down."""
    return joined(spark, sf_dir).withColumn("log_l", F.round("log_l", 5))


@query("p11_phased_trio", sql(JOINED + """, r AS (SELECT *, round(log_l, 6) AS l FROM jl),
    t AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom, seg ORDER BY l DESC, a, b) AS n FROM r),
    w AS (SELECT sample, chrom, seg, max(l) AS top, sum(exp(l - m)) AS whole FROM (SELECT *, max(l) OVER (PARTITION BY sample, chrom, seg) AS m FROM r) GROUP BY 1, 2, 3),
    j AS (SELECT m.chrom, m.seg, m.a AS ma, m.b AS mb, f.a AS fa, f.b AS fb, c.a AS ca, c.b AS cb, m.l AS ml, f.l AS fl, c.l AS cl,
            round(m.l + f.l + c.l + CASE WHEN c.a IN (m.a, m.b, f.a, f.b) AND c.b IN (m.a, m.b, f.a, f.b) THEN 1.0 ELSE 1e-5 END, 6) AS l
        FROM t m JOIN t f ON m.chrom = f.chrom AND m.seg = f.seg JOIN t c ON m.chrom = c.chrom AND m.seg = c.seg
        WHERE m.sample = 's0' AND f.sample = 's1' AND c.sample = 's2' AND m.n <= 5 AND f.n <= 5 AND c.n <= 5),
    z AS (SELECT *, max(l) OVER (PARTITION BY chrom, seg) AS best FROM j),
    s AS (SELECT chrom, seg, sum(exp(l - best)) AS total, coalesce(sum(exp(l - best)) FILTER (WHERE ca + cb > 2 AND ma + mb <= 2 AND fa + fb <= 2), 0) AS up, coalesce(sum(exp(l - best)) FILTER (WHERE ca + cb < 2 AND ma + mb >= 2 AND fa + fb >= 2), 0) AS down FROM z GROUP BY 1, 2),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, seg ORDER BY l DESC, ma, mb, fa, fb, ca, cb) AS n FROM j) WHERE n = 1),
    q AS (SELECT chrom, seg, ma + mb AS mother, fa + fb AS father, ca + cb AS child, greatest(ma, mb) AS mother_mcc, greatest(fa, fb) AS father_mcc, greatest(ca, cb) AS child_mcc, total, up, down,
            least(60, -10 * log10(greatest(1 - exp(ml - x.top) / x.whole, 1e-6))) + 0.0 AS q_mother, least(60, -10 * log10(greatest(1 - exp(fl - y.top) / y.whole, 1e-6))) + 0.0 AS q_father,
            least(60, -10 * log10(greatest(1 - exp(cl - v.top) / v.whole, 1e-6))) + 0.0 AS q_child
        FROM b JOIN s USING (chrom, seg) JOIN w x USING (chrom, seg) JOIN w y USING (chrom, seg) JOIN w v USING (chrom, seg) WHERE x.sample = 's0' AND y.sample = 's1' AND v.sample = 's2'),
    d AS (SELECT *, CASE WHEN child > 2 AND mother <= 2 AND father <= 2 THEN 1 - up / (total - down) WHEN child < 2 AND mother >= 2 AND father >= 2 THEN 1 - down / (total - up) END AS rest FROM q)
    SELECT chrom, seg, mother, father, child, mother_mcc, father_mcc, child_mcc, round(q_mother, 3) AS q_mother, round(q_father, 3) AS q_father, round(q_child, 3) AS q_child,
        round(CASE WHEN rest IS NOT NULL AND least(q_mother, q_father, q_child) >= 1 THEN least(60, 2 * least(60, -10 * log10(greatest(rest, 1e-6)))) END, 3) AS dq FROM d""", "sites"))
def p11(spark, sf_dir):
    """Joint phased call of a trio with a rate of new haplotypes."""
    out = haplotypes.phased_trio(joined(spark, sf_dir), {"mother": "s0", "father": "s1", "child": "s2"}, ["chrom", "seg"], q_limit=1.0)
    return out.withColumns({c: F.round(c, 3) for c in ("q_mother", "q_father", "q_child", "dq")})


#: Two children beside the parents: every joint state of the three best genotypes of each.
FAMILY = JOINED.replace("range(3) r(s)", "range(4) r(s)") + """, r AS (SELECT *, round(log_l, 6) AS l, a + b AS cn FROM jl),
    t AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom, seg ORDER BY l DESC, a, b) AS n, max(l) OVER (PARTITION BY sample, chrom, seg) AS top FROM r),
    j AS (SELECT m.chrom, m.seg, m.a AS ma, m.b AS mb, f.a AS fa, f.b AS fb, c.a AS ca, c.b AS cb, d.a AS da, d.b AS db,
            round(m.l + f.l + round(c.l + CASE WHEN c.a IN (m.a, m.b, f.a, f.b) AND c.b IN (m.a, m.b, f.a, f.b) THEN 1.0 ELSE 1e-5 END, 6) + round(d.l + CASE WHEN d.a IN (m.a, m.b, f.a, f.b) AND d.b IN (m.a, m.b, f.a, f.b) THEN 1.0 ELSE 1e-5 END, 6), 6) AS l
        FROM t m JOIN t f ON m.chrom = f.chrom AND m.seg = f.seg JOIN t c ON m.chrom = c.chrom AND m.seg = c.seg JOIN t d ON m.chrom = d.chrom AND m.seg = d.seg
        WHERE m.sample = 's0' AND f.sample = 's1' AND c.sample = 's2' AND d.sample = 's3' AND m.n <= 3 AND f.n <= 3 AND c.n <= 3 AND d.n <= 3),
    z AS (SELECT *, exp(l - max(l) OVER (PARTITION BY chrom, seg)) AS e FROM j),
    sm AS (SELECT chrom, seg, sum(e) AS total, coalesce(sum(e) FILTER (WHERE ca + cb > 2 AND ma + mb <= 2 AND fa + fb <= 2), 0) AS up2, coalesce(sum(e) FILTER (WHERE ca + cb < 2 AND ma + mb >= 2 AND fa + fb >= 2), 0) AS down2,
        coalesce(sum(e) FILTER (WHERE da + db > 2 AND ma + mb <= 2 AND fa + fb <= 2), 0) AS up3, coalesce(sum(e) FILTER (WHERE da + db < 2 AND ma + mb >= 2 AND fa + fb >= 2), 0) AS down3 FROM z GROUP BY 1, 2),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, seg ORDER BY l DESC, ma, mb, fa, fb, ca, cb, da, db) AS n FROM j) WHERE n = 1),
    o AS (SELECT chrom, seg, 's0' AS sample, ma AS a, mb AS b FROM b UNION ALL SELECT chrom, seg, 's1', fa, fb FROM b UNION ALL SELECT chrom, seg, 's2', ca, cb FROM b UNION ALL SELECT chrom, seg, 's3', da, db FROM b),
    q AS (SELECT chrom, seg, sample, o.a, o.b, least(60, -10 * log10(greatest(sum(CASE WHEN t.cn != o.a + o.b THEN exp(t.l - t.top) ELSE 0 END) / sum(exp(t.l - t.top)), 1e-6))) + 0.0 AS q FROM o JOIN t USING (chrom, seg, sample) GROUP BY 1, 2, 3, 4, 5),
    w AS (SELECT k.*, sm.total, CASE k.sample WHEN 's2' THEN up2 ELSE up3 END AS up, CASE k.sample WHEN 's2' THEN down2 ELSE down3 END AS down, least(k.q, m.q, f.q) AS lowest, x.a + x.b AS sibling,
            (k.a IN (m.a, m.b) AND k.b IN (f.a, f.b)) OR (k.a IN (f.a, f.b) AND k.b IN (m.a, m.b)) AS shared
        FROM q k JOIN sm USING (chrom, seg) JOIN q m ON m.chrom = k.chrom AND m.seg = k.seg AND m.sample = 's0' JOIN q f ON f.chrom = k.chrom AND f.seg = k.seg AND f.sample = 's1'
        JOIN q x ON x.chrom = k.chrom AND x.seg = k.seg AND x.sample = CASE k.sample WHEN 's2' THEN 's3' ELSE 's2' END)"""


@query("p11_phased_family", sql(FAMILY + """ SELECT chrom, seg, sample, a + b AS cn, greatest(a, b) AS mcc, round(q, 3) AS q, round(CASE WHEN sample IN ('s2', 's3') AND a + b != 2 AND NOT shared AND sibling = 2 AND lowest > 0.5
        THEN least(60, 2 * least(60, -10 * log10(greatest(CASE WHEN a + b > 2 THEN 1 - up / (total - down) ELSE 1 - down / (total - up) END, 1e-6)))) END, 3) AS dq FROM w""", "sites"))
def p11_family(spark, sf_dir):
    """Joint phased call of parents and two children, by bounded search."""
    out = haplotypes.phased_family(joined(spark, sf_dir, 4), "s0", "s1", ["s2", "s3"], ["chrom", "seg"], q_limit=0.5)
    return out.drop("a", "b", "visited").withColumns({"q": F.round("q", 3), "dq": F.round("dq", 3)})


@query("p16_shared_phased", sql(FAMILY + " SELECT chrom, seg, sample, a, b, shared FROM w WHERE sample IN ('s2', 's3')", "sites"))
def p16(spark, sf_dir):
    """Whether each child's called haplotypes come one from each parent."""
    called = haplotypes.phased_family(joined(spark, sf_dir, 4), "s0", "s1", ["s2", "s3"], ["chrom", "seg"]).select("chrom", "seg", "sample", "a", "b")
    pair = called.filter("sample in ('s0', 's1')").groupBy("chrom", "seg").pivot("sample", ["s0", "s1"]).agg(F.first(F.struct("a", "b")))
    children = called.filter("sample in ('s2', 's3')").join(pair, ["chrom", "seg"])
    shared = haplotypes.shared_phased(F.struct("a", "b"), F.col("s0"), F.col("s1"))
    return children.select("chrom", "seg", "sample", "a", "b", shared.alias("shared"))
