"""Registered queries of k-mers, segmentation, models and callers."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.tables import written
from helixframe.operators import callers, clusters, kmers, models, segmentation
from helixframe.plans.segment_queries import SEGMENTED, TILED, segmented, tiled
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


def kmer_views(view: str, k: int) -> str:
    """SQL of the canonical k-mers of a view of sequences."""
    return f""", p AS (SELECT seq_id, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM {view} WHERE length(seq) >= {k}),
    k AS (SELECT seq_id, pos, upper(substr(seq, CAST(pos + 1 AS BIGINT), {k})) AS w FROM p),
    c AS (SELECT seq_id, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM k WHERE regexp_full_match(w, '[ACGT]+')),
    one AS (SELECT kmer FROM c GROUP BY 1 HAVING count(*) = 1)"""


@query("c22_canonical_kmers", sql(kmer_views("sequences", 5) + " SELECT kmer, count(*) AS n FROM c GROUP BY 1", "sequences"))
def c22(spark, sf_dir):
    """Counts of canonical 5-mers."""
    return kmers.kmer_counts(ad.sequences(spark, sf_dir), 5)


@query("x01_unique_kmers", sql(kmer_views("contigs", 35) + " SELECT seq_id, count(*) AS kmers, count(*) FILTER (WHERE kmer IN (FROM one)) AS unique_kmers FROM c GROUP BY 1", "contigs"))
def x01(spark, sf_dir):
    """K-mers of 35 letters of each sequence that occur once over all sequences."""
    contigs = ad.contigs(spark, sf_dir)
    single = kmers.unique_places(contigs, 35).groupBy("seq_id").agg(F.count(F.lit(1)).alias("single"))
    rows = kmers.kmers_of(contigs, 35).join(single, "seq_id", "left")
    return rows.select("seq_id", F.col("n").alias("kmers"), F.coalesce("single", F.lit(0)).alias("unique_kmers"))


@query("x02_cased_sequences", sql(kmer_views("contigs", 35) + """, u AS (SELECT seq_id, pos FROM c WHERE kmer IN (FROM one)),
    l AS (SELECT seq_id, substr(seq, CAST(pos + 1 AS BIGINT), 1) AS letter, pos FROM (SELECT seq_id, seq, unnest(range(0, length(seq))) AS pos FROM contigs)),
    d AS (SELECT l.seq_id, string_agg(CASE WHEN u.pos IS NULL THEN lower(letter) ELSE upper(letter) END, '' ORDER BY l.pos) AS seq FROM l LEFT JOIN u USING (seq_id, pos) GROUP BY 1)
    SELECT seq_id, coalesce(d.seq, c.seq) AS seq FROM contigs c LEFT JOIN d USING (seq_id)""", "contigs"))
def x02(spark, sf_dir):
    """Sequences with upper case where a unique k-mer of 35 letters starts."""
    return kmers.cased(ad.contigs(spark, sf_dir), 35)


@query("m06_haar_segments")
def m06(spark, sf_dir):
    """Breakpoints by unbalanced Haar wavelets."""
    return segmentation.segment_haar(ad.sample_bins(spark, sf_dir), lowest=0.5)


@query("m07_cbs_segments")
def m07(spark, sf_dir):
    """Breakpoints by circular binary segmentation."""
    return segmentation.segment_cbs(ad.sample_bins(spark, sf_dir), undo="sd")


#: Bins in order with the log likelihoods of their count in five states, the best paths and the way back.
MARKOV = """, pr AS (SELECT sample, median(cnt) / 2 AS h, pow(quantile_cont(cnt, 0.75) - quantile_cont(cnt, 0.25), 2) AS v FROM sample_bins GROUP BY 1),
    bo AS (SELECT sample, chrom, start_pos, end_pos, row_number() OVER (PARTITION BY sample, chrom ORDER BY start_pos) AS i, count(*) OVER (PARTITION BY sample, chrom) AS n,
        h, v, greatest(0, least(round_even(cnt, 0), greatest(2, CAST(round_even(5 * h, 0) AS INT) + 1) - 1)) AS k FROM sample_bins JOIN pr USING (sample)),
    mu AS (SELECT *, greatest(cn, 0.1) * h AS mu FROM bo, range(5) t(cn) WHERE n > 10),
    nr AS (SELECT *, CASE WHEN v > mu THEN greatest(mu * mu / greatest(v - mu, 1e-9), 2.0) ELSE 1e6 END AS r FROM mu),
    em AS (SELECT sample, chrom, i, n, list(ln(greatest(exp(lgamma(k + r) - lgamma(k + 1) - lgamma(r) + r * ln(r / (r + mu)) + k * ln(mu / (r + mu))), 1e-300)) ORDER BY cn) AS l FROM nr GROUP BY 1, 2, 3, 4),
    vt AS (SELECT sample, chrom, i, n, list_transform(l, lambda x: x - ln(5)) AS best, CAST([] AS INT[]) AS back FROM em WHERE i = 1
        UNION ALL SELECT sample, chrom, i, n, list_transform([1, 2, 3, 4, 5], lambda j: list_max(ways[j]) + l[j]), list_transform([1, 2, 3, 4, 5], lambda j: list_position(ways[j], list_max(ways[j])))
        FROM (SELECT em.*, list_transform([1, 2, 3, 4, 5], lambda j: list_transform([1, 2, 3, 4, 5], lambda f: vt.best[f] + CASE WHEN f = j THEN ln(CAST(0.99 AS DOUBLE)) ELSE ln((1 - CAST(0.99 AS DOUBLE)) / 4) END)) AS ways
            FROM vt JOIN em ON vt.sample = em.sample AND vt.chrom = em.chrom AND em.i = vt.i + 1)),
    tb AS (SELECT sample, chrom, i, list_position(best, list_max(best)) AS s FROM vt WHERE i = n
        UNION ALL SELECT vt.sample, vt.chrom, vt.i - 1, vt.back[tb.s] FROM tb JOIN vt ON vt.sample = tb.sample AND vt.chrom = tb.chrom AND vt.i = tb.i WHERE vt.i > 1),
    st AS (SELECT bo.*, CAST(coalesce(tb.s - 1, 2) AS BIGINT) AS cn FROM bo LEFT JOIN tb USING (sample, chrom, i)),
    ch AS (SELECT *, CASE WHEN lag(cn) OVER (PARTITION BY sample, chrom ORDER BY i) IS NOT DISTINCT FROM cn THEN 0 ELSE 1 END AS o FROM st),
    rn AS (SELECT *, sum(o) OVER (PARTITION BY sample, chrom ORDER BY i) AS run FROM ch)
    SELECT sample, chrom, cn, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS bins FROM rn GROUP BY sample, chrom, cn, run"""


@query("m14_hmm_segments", sql(MARKOV, "sample_bins").replace("WITH ", "WITH RECURSIVE ", 1))
def m14(spark, sf_dir):
    """Segments of one hidden Markov model for each sample and contig."""
    return segmentation.state_segments(segmentation.segment_hmm(ad.sample_bins(spark, sf_dir)), "cn")


@query("m14_stepped_segments", sql(MARKOV.replace("sample_bins", "step_bins"), "step_bins").replace("WITH ", "WITH RECURSIVE ", 1))
def m14_steps(spark, sf_dir):
    """Segments of one hidden Markov model for each sample and contig, on counts with changes of state."""
    return segmentation.state_segments(segmentation.segment_hmm(ad.step_bins(spark, sf_dir)), "cn")


#: Joint emissions of three samples, over every choice of the samples that are in the state (bits of c), and best paths.
JOINT = """, pr AS (SELECT sample, chrom, greatest(1, median(cnt)) / 2 AS h, coalesce(var_samp(cnt), 0) AS v FROM step_bins GROUP BY 1, 2), cp AS (SELECT chrom, max(h) * 5 AS cap, count(*) AS samples FROM pr GROUP BY 1),
    kb AS (SELECT sample, chrom, start_pos, end_pos, h, v, round_even(least(cnt, cap), 0) AS k, samples, dense_rank() OVER (PARTITION BY chrom ORDER BY sample) - 1 AS place FROM step_bins JOIN pr USING (sample, chrom) JOIN cp USING (chrom)),
    mu AS (SELECT *, greatest(cn, 0.1) * h AS mu FROM kb, range(5) t(cn)), nr AS (SELECT *, pow(greatest(mu, 0.1), 2) / (greatest(v, 1.2 * mu) - mu) AS r FROM mu),
    lg AS (SELECT chrom, start_pos, end_pos, place, samples, list(greatest(ln(CAST(1e-300 AS DOUBLE)), -r * ln(1 + mu / r) + k * ln(mu / (mu + r)) + lgamma(r + k) - lgamma(k + 1) - lgamma(r)) ORDER BY cn) AS l FROM nr GROUP BY 1, 2, 3, 4, 5),
    ow AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS cn FROM lg), op AS (SELECT chrom, start_pos, end_pos, place, samples, cn, l[3] AS two, CASE WHEN cn < 2 THEN greatest(l[1], l[2]) WHEN cn > 2 THEN greatest(l[4], l[5]) ELSE l[3] END AS own FROM ow),
    ch AS (SELECT chrom, start_pos, end_pos, cn, c, sum(CASE WHEN (c >> place) & 1 = 1 THEN own ELSE two END) AS l FROM op, range(1, 8) b(c) GROUP BY 1, 2, 3, 4, 5, samples HAVING count(*) = samples),
    bs AS (SELECT chrom, start_pos, end_pos, cn, max(l) AS l FROM ch GROUP BY 1, 2, 3, 4), em AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start_pos) AS i, count(*) OVER (PARTITION BY chrom) AS n FROM (SELECT chrom, start_pos, end_pos, list(l ORDER BY cn) AS l FROM bs GROUP BY 1, 2, 3)),
    vt AS (SELECT chrom, i, n, list_transform(l, lambda x: x - ln(5)) AS best, CAST([] AS INT[]) AS back FROM em WHERE i = 1 AND n > 10
        UNION ALL SELECT chrom, i, n, list_transform([1, 2, 3, 4, 5], lambda j: list_max(ways[j]) + l[j]), list_transform([1, 2, 3, 4, 5], lambda j: list_position(ways[j], list_max(ways[j])))
        FROM (SELECT em.*, list_transform([1, 2, 3, 4, 5], lambda j: list_transform([1, 2, 3, 4, 5], lambda f: vt.best[f] + CASE WHEN f = j THEN ln(CAST(0.99 AS DOUBLE)) ELSE ln((1 - CAST(0.99 AS DOUBLE)) / 4) END)) AS ways
            FROM vt JOIN em ON vt.chrom = em.chrom AND em.i = vt.i + 1)),
    tb AS (SELECT chrom, i, list_position(best, list_max(best)) AS s FROM vt WHERE i = n UNION ALL SELECT vt.chrom, vt.i - 1, vt.back[tb.s] FROM tb JOIN vt ON vt.chrom = tb.chrom AND vt.i = tb.i WHERE vt.i > 1),
    st AS (SELECT em.chrom, em.start_pos, em.end_pos, em.i, CAST(coalesce(tb.s - 1, 2) AS BIGINT) AS state FROM em LEFT JOIN tb USING (chrom, i)),
    sh AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY chrom ORDER BY i) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS o FROM st), rn AS (SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY i) AS run FROM sh)
    SELECT chrom, state, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS bins FROM rn GROUP BY chrom, state, run"""


@query("m17_joint_hmm_segments", sql(JOINT, "step_bins").replace("WITH ", "WITH RECURSIVE ", 1))
def m17(spark, sf_dir):
    """Segments of one hidden Markov model for all samples of a contig."""
    return segmentation.state_segments(segmentation.segment_joint_hmm(ad.step_bins(spark, sf_dir)), "state", ("chrom",))


@query("a33_evenness", sql("""
    , n AS (SELECT *, (row_number() OVER (PARTITION BY sample, chrom ORDER BY start_pos) - 1) // 100 AS win FROM sample_bins),
    m AS (SELECT sample, chrom, win, avg(cnt) AS m FROM n GROUP BY 1, 2, 3), e AS (SELECT sample, chrom, win, sum(least(cnt, m)) / sum(m) AS e FROM n JOIN m USING (sample, chrom, win) GROUP BY 1, 2, 3)
    SELECT sample, round(100 * median(e), 6) AS evenness FROM e GROUP BY 1""", "sample_bins"))
def a33(spark, sf_dir):
    return segmentation.evenness(ad.sample_bins(spark, sf_dir), 100).select("sample", F.round("evenness", 6).alias("evenness"))


@query("a35_triplet_variability", sql("""
    , l0 AS (SELECT sample, chrom, row_number() OVER (PARTITION BY sample, chrom ORDER BY start_pos) - 1 AS i, cnt FROM sample_bins),
    l1 AS (SELECT sample, chrom, i // 3 AS i, median(cnt) AS cnt FROM l0 GROUP BY 1, 2, 3), l2 AS (SELECT sample, chrom, i // 3 AS i, median(cnt) AS cnt FROM l1 GROUP BY 1, 2, 3),
    a AS (SELECT 0 AS level, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)
    SELECT sample, level, round(mad(cnt) / median(cnt), 6) AS variability FROM a GROUP BY 1, 2""", "sample_bins"))
def a35(spark, sf_dir):
    """Median deviation over median at scales of 3^k bins."""
    out = segmentation.triplet_variability(ad.sample_bins(spark, sf_dir), levels=3, fewest=2)
    return out.select("sample", "level", F.round("variability", 6).alias("variability"))


#: Windows of half the bins for each percent of GC, what of each class lies in them, and the weighted lines.
LOESS = """, lg AS (SELECT gc, ln(cnt) AS y, row_number() OVER (ORDER BY gc) - 1 AS i FROM tiles WHERE cnt > 0), nn AS (SELECT count(*) AS n, CAST(ceil(0.5 * count(*)) AS BIGINT) AS k, median(y) AS mid FROM lg),
    cl AS (SELECT gc, count(*) AS n, avg(y) AS m, min(i) AS low, max(i) + 1 AS high FROM lg GROUP BY 1),
    ws AS (SELECT c.gc, min(a.i) AS first FROM cl c, nn JOIN lg a ON a.i <= nn.n - nn.k JOIN lg b ON b.i = a.i + nn.k - 1 JOIN lg d ON d.i = least(a.i + nn.k, nn.n - 1)
        WHERE a.i = nn.n - nn.k OR (b.gc >= c.gc AND d.gc + a.gc >= 2 * c.gc) GROUP BY 1),
    wi AS (SELECT ws.gc, first, k, mid, greatest(ws.gc - a.gc, b.gc - ws.gc) AS far FROM ws, nn JOIN lg a ON a.i = first JOIN lg b ON b.i = first + k - 1),
    wt AS (SELECT wi.gc, mid, cl.gc AS x, m AS y, (least(high, first + k) - greatest(low, first)) * pow(greatest(0, 1 - pow(abs(cl.gc - wi.gc) / CAST(far AS DOUBLE), 3)), 3) AS w FROM wi JOIN cl ON cl.low < first + k AND cl.high > first),
    me AS (SELECT gc, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM wt GROUP BY 1),
    ft AS (SELECT gc, any_value(mid) AS mid, any_value(my) + sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) * (gc - any_value(mx)) AS f FROM wt JOIN me USING (gc) GROUP BY 1)
    SELECT chrom, start_pos, gc, round(cnt * exp(mid - f), 6) AS cnt FROM tiles JOIN ft USING (gc)"""


@query("a16_gc_loess", sql(LOESS, "tiles"))
def a16(spark, sf_dir):
    """GC normalization by local regression over half of the bins."""
    out = models.normalize_gc_loess(ad.tiles(spark, sf_dir), span=0.5)
    return out.select("chrom", "start_pos", "gc", F.round("cnt", 6).alias("cnt"))


@query("a16_gc_loess_search")
def a16_search(spark, sf_dir):
    """GC normalization by local regression with the bandwidth that a search selects."""
    return models.normalize_gc_loess(ad.tiles(spark, sf_dir)).select("chrom", "start_pos", "gc", F.round("cnt", 6).alias("cnt"))


STATES = "states AS (SELECT cn, m AS mcc, CASE WHEN cn = 0 THEN 0.5 ELSE (cn - m) / cn END AS maf FROM (SELECT cn, unnest(range((cn + 1) // 2, cn + 1)) AS m FROM range(7) t(cn)))"
POINTS = ", pts AS (SELECT chrom, start_pos, cnt / 7 AS coverage, CASE WHEN q > 1 THEN q / 14 END AS maf, 1.0 AS weight FROM tiled)"


def points(spark, sf_dir):
    """Segments with coverage and minor allele share from the tiles."""
    return tiled(spark, sf_dir).select("chrom", "start_pos", (F.col("cnt") / 7).alias("coverage"), F.when(F.col("q") > 1, F.col("q") / 14).alias("maf"), F.lit(1.0).alias("weight"))


@query("j22_nearest_states", sql(TILED + POINTS + f""", {STATES},
    d AS (SELECT p.chrom, p.start_pos, s.cn, s.mcc, round(sqrt(pow((coverage - 100 * s.cn) / 200, 2) + CASE WHEN p.maf IS NULL THEN pow((coverage - 100 * s.cn) / 200, 2) ELSE pow(p.maf - CASE WHEN s.cn = 0 THEN 0 ELSE s.maf END, 2) END), 9) AS d FROM pts p, states s)
    SELECT chrom, start_pos, cn, mcc, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY d, cn, mcc) AS n FROM d) WHERE n = 1""", "tiles"))
def j22(spark, sf_dir):
    """The nearest copy-number state of each segment."""
    out = models.nearest_states(points(spark, sf_dir), models.state_table(spark), ["chrom", "start_pos"], 200.0)
    return out.select("chrom", "start_pos", "cn", "mcc", F.round("distance", 6).alias("distance"))


#: States of up to four copies in the grid's order, with the expected share of each in a candidate.
GRID_STATES = [(cn, m, (cn - m) / cn if cn else 0.5) for cn in range(5) for m in range((cn + 1) // 2, cn + 1)]
GRID_MIXED = "(purity * {0} + 2 * (1 - purity))"
GRID_DISTANCES = ", ".join(
    f"pow(({GRID_MIXED.format(cn)} / 2 * diploid - coverage) / diploid, 2) + CASE WHEN p.maf IS NULL THEN pow(({GRID_MIXED.format(cn)} / 2 * diploid - coverage) / diploid, 2)"
    f" ELSE pow((purity * {cn * maf} + (1 - purity)) / greatest({GRID_MIXED.format(cn)}, 1e-9) - p.maf, 2) END AS d{i}" for i, (cn, _, maf) in enumerate(GRID_STATES)
)
GRID_NEAREST = " ".join(f"WHEN d{i} <= d THEN {cn}" for i, (cn, _, _) in enumerate(GRID_STATES))


@query("m28_purity_grid", sql(TILED + POINTS + f""", cand AS (SELECT CAST(d AS DOUBLE) AS diploid, p / 100 AS purity FROM range(150, 251) a(d), range(30, 101) b(p)),
    ds AS (SELECT diploid, purity, weight, {GRID_DISTANCES} FROM pts p, cand), m AS (SELECT *, least({", ".join(f"d{i}" for i in range(len(GRID_STATES)))}) AS d FROM ds),
    f AS (SELECT diploid, purity, sum(sqrt(d) * weight) / sum(weight) AS deviation, sum(CASE {GRID_NEAREST} END * weight) / sum(weight) AS ploidy FROM m GROUP BY 1, 2)
    SELECT diploid, purity, round(deviation, 6) AS deviation, round(ploidy, 6) AS ploidy FROM f WHERE ploidy BETWEEN 1.5 AND 4.5 ORDER BY round(f.deviation, 9), purity DESC, diploid LIMIT 1""", "tiles"))
def m28(spark, sf_dir):
    """Purity and diploid coverage of least distance over a grid of steps of 1."""
    grid = models.purity_grid(spark, (150, 250), (30, 100))
    out = models.best_purity(points(spark, sf_dir), grid, models.state_table(spark, 4))
    return out.select("diploid", "purity", F.round("deviation", 6).alias("deviation"), F.round("ploidy", 6).alias("ploidy"))


#: Tiles in the plane of clustering: each state has a place of its own, with a scatter made of the tile's other values.
CLOUD = TILED + """, cloud AS (SELECT chrom, start_pos, 100.0 * cn + 24 * ((CAST(round(cnt * 10, 0) AS BIGINT) * 7 % 97) / 97.0 - 0.5) AS coverage,
    CASE WHEN q < 6 THEN CASE cn WHEN 0 THEN 0.46 WHEN 1 THEN 0.06 WHEN 2 THEN 0.42 ELSE 0.3 END + 0.06 * ((CAST(round(cnt * 10, 0) AS BIGINT) * 13 % 89) / 89.0 - 0.5) END AS maf, 1.0 + q AS weight FROM tiled)"""


def cloud(spark, sf_dir):
    tenths = F.round(F.col("cnt") * 10, 0).cast("long")
    place = F.when(F.col("cn") == 0, 0.46).when(F.col("cn") == 1, 0.06).when(F.col("cn") == 2, 0.42).otherwise(0.3)
    return tiled(spark, sf_dir).select(
        "chrom", "start_pos", (100.0 * F.col("cn") + 24 * ((tenths * 7 % 97) / 97.0 - 0.5)).alias("coverage"),
        F.when(F.col("q") < 6, place + 0.06 * ((tenths * 13 % 89) / 89.0 - 0.5)).alias("maf"), (1.0 + F.col("q")).alias("weight"),
    )


#: Distances of the cloud's segments to the states of each candidate, and what the deviation of a model is made of.
DEVIATIONS = CLOUD + f""", pts AS (SELECT chrom, start_pos, coverage, maf, weight, CAST(2 * round(coverage / 100) + CASE WHEN weight > 3 THEN 1 ELSE 0 END AS INT) AS cluster FROM cloud),
    cand AS (SELECT CAST(d AS DOUBLE) AS diploid, p / 100 AS purity FROM range(180, 221) a(d), range(70, 101) b(p)), av AS (SELECT sum(weight * coverage) / sum(weight) AS mean FROM pts),
    ds AS (SELECT diploid, purity, chrom, start_pos, coverage, maf, weight, cluster, mean, {GRID_DISTANCES} FROM pts p, cand, av),
    m AS (SELECT *, least({", ".join(f"d{i}" for i in range(len(GRID_STATES)))}) AS d, least({", ".join(f"CASE WHEN {GRID_MIXED.format(cn)} / 2 * diploid < 2 * mean THEN d{i} ELSE CAST('inf' AS DOUBLE) END" for i, (cn, _, _) in enumerate(GRID_STATES))}) AS e FROM ds),
    s AS (SELECT diploid, purity, coverage, maf, weight, cluster, d, e, CASE {" ".join(f"WHEN d{i} <= d THEN {i}" for i in range(len(GRID_STATES)))} END AS state,
        CASE {" ".join(f"WHEN d{i} <= e AND {GRID_MIXED.format(cn)} / 2 * diploid < 2 * mean THEN {mcc / cn if cn else 0.0}" for i, (cn, mcc, _) in enumerate(GRID_STATES))} END AS share FROM m),
    st AS (SELECT diploid, purity, state, sum(sqrt(d) * weight) AS d, sum(weight) AS w, sum(weight * coverage) / sum(weight) AS c, coalesce(sum(weight * maf) / sum(CASE WHEN maf IS NOT NULL THEN weight END), 0) AS f FROM s GROUP BY 1, 2, 3),
    sx AS (SELECT st.*, list_value({", ".join(str(cn) for cn, _, _ in GRID_STATES)})[state + 1] AS cn, list_value({", ".join(str(float(maf)) for _, _, maf in GRID_STATES)})[state + 1] AS maf FROM st),
    fi AS (SELECT diploid, purity, sum(d) / sum(w) AS precision, sum(cn * w) / sum(w) AS ploidy, sum(w * sqrt(pow(({GRID_MIXED.format('cn')} / 2 * diploid - c) / diploid, 2) + pow((purity * cn * maf + (1 - purity)) / greatest({GRID_MIXED.format('cn')}, 1e-9) - f, 2))) / sum(w) AS accuracy FROM sx GROUP BY 1, 2),
    cl AS (SELECT diploid, purity, cluster, count(*) AS n, median(e) AS med, avg(e) AS mean, list_filter(list_distinct(list(share)), lambda v: v > 0) AS v FROM s GROUP BY 1, 2, 3),
    ce AS (SELECT diploid, purity, CASE WHEN n > 2 THEN med ELSE 0 END AS med, CASE WHEN n > 2 THEN mean ELSE 0 END AS mean, CASE WHEN n > 2 THEN coalesce(list_sum(list_transform(v, lambda x: -x / n * ln(x / n))), 0) ELSE 0 END AS entropy FROM cl),
    al AS (SELECT diploid, purity, median(e) AS mid FROM s GROUP BY 1, 2), me AS (SELECT diploid, purity, median(entropy) AS mid_entropy, sum(mean) / count(*) AS cluster_deviation FROM ce GROUP BY 1, 2),
    ht AS (SELECT diploid, purity, count(*) FILTER (WHERE med > mid AND entropy > mid_entropy) AS heterogeneous FROM ce JOIN al USING (diploid, purity) JOIN me USING (diploid, purity) GROUP BY 1, 2),
    dv AS (SELECT fi.*, cluster_deviation, heterogeneous, CASE WHEN heterogeneous > 1 THEN (precision + accuracy + cluster_deviation) / 3 ELSE (precision + accuracy) / 2 END AS deviation FROM fi JOIN me USING (diploid, purity) JOIN ht USING (diploid, purity))"""


@query("m29_model_deviations", sql(DEVIATIONS + """ SELECT diploid, purity, round(ploidy, 6) AS ploidy, round(precision, 6) AS precision, round(accuracy, 6) AS accuracy, round(cluster_deviation, 6) AS cluster_deviation,
    heterogeneous, round(deviation, 6) AS deviation FROM dv""", "tiles"))
def m29(spark, sf_dir):
    """Precision, accuracy and cluster term of every model of a grid."""
    number = (2 * F.round(F.col("coverage") / 100) + F.when(F.col("weight") > 3, 1).otherwise(0)).cast("int")
    segments = cloud(spark, sf_dir).withColumn("cluster", number)
    out = models.model_deviations(segments, models.purity_grid(spark, (180, 220), (70, 100)), models.state_table(spark, 4), heterogeneous=1)
    return out.withColumns({c: F.round(c, 6) for c in ("ploidy", "precision", "accuracy", "cluster_deviation", "deviation")})


@query("m35_snv_purity", sql("""
    SELECT count(*) AS sites, CASE WHEN count(*) >= 100 THEN round(2 * median(alt_count / (ref_count + alt_count)), 6) END AS purity FROM sites
    WHERE ref_count + alt_count > 0 AND alt_count > 0 AND alt_count / (ref_count + alt_count) < 0.5""", "sites"))
def m35(spark, sf_dir):
    return callers.snv_purity(ad.sites(spark, sf_dir)).select("sites", F.round("purity", 6).alias("purity"))


def family_segments(spark, sf_dir):
    """Medians of three samples over shared segments."""
    segs = segmented(spark, sf_dir).select("chrom", "start_pos", "end_pos", "seg_idx")
    rows = ad.sample_bins(spark, sf_dir).join(segs, ["chrom", "start_pos", "end_pos"])
    return rows.groupBy("sample", "chrom", "seg_idx").agg(F.median("cnt").alias("median_cnt"))


#: Negative binomial likelihood of depth k in state cn, from a sample's mean and variance.
LIKELIHOOD = """, st AS (SELECT sample, avg(cnt) AS m, var_samp(cnt) AS v FROM sample_bins GROUP BY 1),
    mu AS (SELECT sample, m, v, CAST(cn AS INT) AS cn, greatest(cn, 0.1) * m / 2 AS mu FROM st, range(5) t(cn)),
    nb AS (SELECT *, CASE WHEN v > mu THEN greatest(mu * mu / greatest(v - mu, 1e-9), 2.0) ELSE 1e6 END AS r FROM mu)"""
NEGATIVE_BINOMIAL = "exp(lgamma({k} + r) - lgamma({k} + 1) - lgamma(r) + r * ln(r / (r + mu)) + {k} * ln(mu / (r + mu)))"


@query("p10_trio_calls", sql(SEGMENTED + LIKELIHOOD + f""", fs AS (SELECT sample, chrom, seg_idx, median(b.cnt) AS med FROM sample_bins b JOIN seg USING (chrom, start_pos, end_pos) GROUP BY 1, 2, 3),
    lk AS (SELECT f.sample, chrom, seg_idx, cn, {NEGATIVE_BINOMIAL.format(k="round_even(least(med, 3 * m), 0)")} AS p FROM fs f JOIN nb USING (sample)),
    tr AS (SELECT CAST(a AS INT) AS a, CAST(g AS INT) AS g, pow(greatest(a / 2, 0.1), g) / factorial(CAST(g AS INT)) AS w FROM range(5) x(a), range(5) y(g)),
    tn AS (SELECT a, g, w / sum(w) OVER (PARTITION BY a) AS t FROM tr),
    tt AS (SELECT x.a AS m, y.a AS f, x.g + y.g AS c, sum(x.t * y.t) AS t FROM tn x, tn y WHERE x.g + y.g <= 4 GROUP BY 1, 2, 3),
    j AS (SELECT chrom, seg_idx, tt.m, tt.f, tt.c, pm.p AS pm, pf.p AS pf, pc.p AS pc, pm.p * pf.p * pc.p * tt.t AS l FROM tt JOIN lk pm ON pm.sample = 's0' AND pm.cn = tt.m
        JOIN lk pf USING (chrom, seg_idx) JOIN lk pc USING (chrom, seg_idx) WHERE pf.sample = 's1' AND pf.cn = tt.f AND pc.sample = 's2' AND pc.cn = tt.c),
    z AS (SELECT *, row_number() OVER (PARTITION BY chrom, seg_idx ORDER BY l DESC, m, f, c) AS n, sum(l) OVER k AS total,
        sum(CASE WHEN c > 2 AND m <= 2 AND f <= 2 THEN l ELSE 0 END) OVER k AS g, sum(CASE WHEN c < 2 AND m >= 2 AND f >= 2 THEN l ELSE 0 END) OVER k AS s FROM j WINDOW k AS (PARTITION BY chrom, seg_idx)),
    y AS (SELECT *, CASE WHEN c > 2 AND m <= 2 AND f <= 2 THEN 1 - g / (total - s) WHEN c < 2 AND m >= 2 AND f >= 2 THEN 1 - s / (total - g) END AS new FROM z WHERE n = 1),
    w AS (SELECT sample, chrom, seg_idx, sum(p) AS whole FROM lk GROUP BY 1, 2, 3)
    SELECT chrom, seg_idx, m AS mother, f AS father, c AS child, round(least(100, -10 * log10(greatest(1 - pm / a.whole, 1e-10))), 3) AS q_mother, round(least(100, -10 * log10(greatest(1 - pf / b.whole, 1e-10))), 3) AS q_father,
        round(least(100, -10 * log10(greatest(1 - pc / d.whole, 1e-10))), 3) AS q_child, round(CASE WHEN new IS NOT NULL THEN least(100, 2 * least(60, -10 * log10(greatest(new, 1e-6)))) END, 3) AS dq
    FROM y JOIN w a USING (chrom, seg_idx) JOIN w b USING (chrom, seg_idx) JOIN w d USING (chrom, seg_idx) WHERE a.sample = 's0' AND b.sample = 's1' AND d.sample = 's2'""", "bins", "intervals", "sample_bins"))
def p10(spark, sf_dir):
    """Joint calls of a trio with qualities and de novo qualities."""
    bins = ad.sample_bins(spark, sf_dir)
    stats = bins.groupBy("sample").agg(F.avg("cnt").alias("m"), F.var_samp("cnt").alias("v")).collect()  # a row for each sample
    deepest = int(3 * max((r["m"] for r in stats), default=0)) + 2
    table = models.likelihood_table(spark, {r["sample"]: r["m"] for r in stats}, {r["sample"]: r["v"] for r in stats}, 4, deepest)
    depth = spark.createDataFrame([(r["sample"], r["m"]) for r in stats], "sample string, mean_depth double")
    likelihoods = callers.coverage_likelihoods(family_segments(spark, sf_dir), table, depth)
    out = callers.trio_calls(likelihoods, {"mother": "s0", "father": "s1", "child": "s2"}, ["chrom", "seg_idx"])
    return out.select("chrom", "seg_idx", "mother", "father", "child", *[F.round(c, 3).alias(c) for c in ("q_mother", "q_father", "q_child", "dq")])


@query("p17_major_count", sql(""", g AS (SELECT CAST(cn AS INT) AS cn, CAST(b AS INT) AS b, greatest(0.01, least(0.99, b / cn)) AS p FROM range(1, 5) x(cn), range(0, 3) y(b) WHERE b <= cn // 2),
    s AS (SELECT chrom, pos // 50000 AS seg, ref_count + alt_count AS n, alt_count AS k FROM sites WHERE ref_count + alt_count > 0),
    m AS (SELECT chrom, seg, cn, b, (exp(k * ln(p) + (n - k) * ln(1 - p)) + exp(k * ln(1 - p) + (n - k) * ln(p))) / 6 + (exp(k * ln(0.01) + (n - k) * ln(0.99)) + exp(k * ln(0.99) + (n - k) * ln(0.01))) / 3 AS x FROM s, g),
    l AS (SELECT chrom, seg, cn, b, avg(ln(greatest(x, 1e-300))) AS l, count(*) AS sites FROM m GROUP BY 1, 2, 3, 4),
    r AS (SELECT *, row_number() OVER k AS i, l - lead(l) OVER k AS gap FROM l WHERE cn = seg % 3 + 1 WINDOW k AS (PARTITION BY chrom, seg ORDER BY l DESC, b))
    SELECT chrom, seg, cn, cn - b AS mcc, round(least(60, coalesce(gap * sites * 10 / ln(10), 60)), 5) AS mcc_q FROM r WHERE i = 1""", "sites"))
def p17(spark, sf_dir):
    """Major chromosome counts of segments from their sites."""
    sites = ad.sites(spark, sf_dir).withColumn("seg", F.expr("pos div 50000"))
    likelihoods = callers.site_likelihoods(sites, ["chrom", "seg"])
    called = likelihoods.select("chrom", "seg").distinct().withColumn("cn", (F.col("seg") % 3 + 1).cast("int"))
    return callers.major_count(likelihoods, called, ["chrom", "seg"]).withColumn("mcc_q", F.round("mcc_q", 5))


@query("a38_normalization_factor", sql(TILED + """, w AS (SELECT chrom, cn * 1.0 / cnt AS f, 1.0 AS w, start_pos FROM tiled WHERE cn > 0),
    s AS (SELECT chrom, f, sum(w) OVER (PARTITION BY chrom ORDER BY f, start_pos ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY chrom) AS share FROM w)
    SELECT chrom, round(coalesce(max(f) FILTER (WHERE share <= 0.5), 0), 9) AS factor FROM s GROUP BY 1""", "tiles"))
def a38(spark, sf_dir):
    """Weighted median of copy number over median count."""
    from helixframe.functions import stats

    rows = tiled(spark, sf_dir).filter("cn > 0").select("chrom", "start_pos", (F.col("cn") / F.col("cnt")).alias("f"), F.lit(1.0).alias("w"))
    out = stats.weighted_quantile(rows, "f", "w", 0.5, ["chrom"], "start_pos", "factor")
    return out.select("chrom", F.round("factor", 9).alias("factor"))


@query("a23_plot_points", sql(TILED + """, w AS (SELECT chrom, CAST(start_pos // 10000 * 10000 AS BIGINT) AS win, cn, cnt, end_pos - start_pos AS len FROM tiled),
    c AS (SELECT chrom, win, arg_max(cn, b * 10 - cn) AS cn FROM (SELECT chrom, win, cn, sum(len) AS b FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT chrom, win, c.cn, count(*) AS bins, round(median(w.cnt), 6) AS median_hits, round(2 * median(w.cnt) / (SELECT median(cnt) FROM tiled), 6) AS normalized FROM w JOIN c USING (chrom, win) GROUP BY 1, 2, 3""", "tiles"))
def a23(spark, sf_dir):
    """Plot points in windows: dominant copy number, median and normalized counts."""
    rows = tiled(spark, sf_dir).withColumn("win", F.expr("(start_pos div 10000) * 10000"))
    top = rows.groupBy("chrom", "win", "cn").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("b"))
    top = top.groupBy("chrom", "win").agg((-F.max(F.struct("b", (-F.col("cn")).alias("c")))["c"]).alias("cn"))
    whole = rows.agg(F.median("cnt").alias("whole"))
    points_ = rows.groupBy("chrom", "win").agg(F.count(F.lit(1)).alias("bins"), F.median("cnt").alias("m"))
    joined = points_.join(top, ["chrom", "win"]).join(F.broadcast(whole))  # one row
    return joined.select("chrom", "win", "cn", "bins", F.round("m", 6).alias("median_hits"), F.round(2 * F.col("m") / F.col("whole"), 6).alias("normalized"))


@query("k11_bedgraph_rows", sql(TILED + " SELECT chrom, start_pos, end_pos, round(cnt, 2) AS value FROM tiled WHERE q >= 3 AND cn != 2", "tiles"))
def k11(spark, sf_dir):
    """Rows of the copy-number track, rounded away from zero."""
    return tiled(spark, sf_dir).filter("q >= 3 and cn != 2").select("chrom", "start_pos", "end_pos", F.round("cnt", 2).alias("value"))


def _windows(spark, sf_dir):
    """Medians of the points in windows, some hundreds for each contig."""
    rows = points(spark, sf_dir)
    return rows.groupBy("chrom", F.expr("(start_pos div 4000) * 4000").alias("start_pos")).agg(
        F.avg("coverage").alias("coverage"), F.avg("maf").alias("maf"), F.sum("weight").alias("weight")
    )


@query("m20_mixture_clusters")
def m20(spark, sf_dir):
    """Clusters of segments by a weighted Gaussian mixture."""
    return models.cluster_segments(cloud(spark, sf_dir), "mixture", scale=0.01)


def peaks(source: str, s: str = "") -> str:
    """Views of ``source`` (chrom, start_pos, x, y), their names ending in ``s``: distances of all pairs of a contig, densities, ranks, and the nearest denser point."""
    return f""", d{s} AS (SELECT a.chrom, a.start_pos AS a, b.start_pos AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM {source} a JOIN {source} b ON a.chrom = b.chrom AND a.start_pos != b.start_pos),
    o{s} AS (SELECT chrom, d, row_number() OVER (PARTITION BY chrom ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM d{s} WHERE a < b),
    dc{s} AS (SELECT chrom, greatest(d, 1e-12) AS dc FROM o{s} WHERE i = least(CAST(floor(n * 0.02) AS BIGINT), n - 1)),
    rho{s} AS (SELECT chrom, a, round(sum(exp(-(d / dc) * (d / dc))), 9) AS rho, max(d) AS far FROM d{s} JOIN dc{s} USING (chrom) GROUP BY 1, 2),
    k{s} AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY rho DESC, a) AS r FROM rho{s}),
    nd{s} AS (SELECT d.chrom, d.a, min(d.d) AS delta, arg_min(d.b, (d.d, kb.r)) AS parent FROM d{s} d JOIN k{s} ka ON d.chrom = ka.chrom AND d.a = ka.a JOIN k{s} kb ON d.chrom = kb.chrom AND d.b = kb.a WHERE kb.r < ka.r GROUP BY 1, 2),
    pk{s} AS (SELECT k.chrom, k.a, k.rho, k.r, coalesce(nd.delta, k.far) AS delta, nd.parent FROM k{s} k LEFT JOIN nd{s} nd USING (chrom, a))"""


PEAKS = CLOUD + ", p AS (SELECT chrom, start_pos, maf AS x, 0.01 * coverage AS y FROM cloud WHERE maf IS NOT NULL)" + peaks("p")


def labelled(cutoff: str, view: str = "pk", s: str = "") -> str:
    """Labels of the peaks farther than a cut-off, and of what leads to them."""
    return f""", ce{s} AS (SELECT chrom, a, row_number() OVER (PARTITION BY chrom ORDER BY r) - 1 AS cluster FROM {view} WHERE rho > 2 AND delta > {cutoff}),
    lb{s} AS (SELECT chrom, a, cluster FROM ce{s} UNION ALL SELECT v.chrom, v.a, lb{s}.cluster FROM lb{s} JOIN {view} v ON v.chrom = lb{s}.chrom AND v.parent = lb{s}.a WHERE NOT (v.rho > 2 AND v.delta > {cutoff}))"""


LABELS = " SELECT chrom, start_pos, CAST(coalesce(lb.cluster, -1) AS INT) AS cluster FROM cloud LEFT JOIN lb ON lb.chrom = cloud.chrom AND lb.a = cloud.start_pos".replace(" SELECT chrom", " SELECT cloud.chrom")


@query("m21_density_clusters", sql(PEAKS + labelled("0.05") + LABELS, "tiles").replace("WITH ", "WITH RECURSIVE ", 1))
def m21(spark, sf_dir):
    """Clusters of segments by density peaks."""
    return models.cluster_segments(cloud(spark, sf_dir), "density", scale=0.01, bandwidth=0.05)


@query("m22_mean_shift_clusters")
def m22(spark, sf_dir):
    """Clusters of segments by mean shift."""
    return models.cluster_segments(cloud(spark, sf_dir), "mean_shift", scale=0.01)


@query("m25_best_mixture")
def m25(spark, sf_dir):
    """Clusters of the mixture of greatest silhouette over four to seven clusters."""
    return models.cluster_segments(_windows(spark, sf_dir), "best_mixture", scale=0.01)


#: The cut-offs from above, the numbers of clusters they give, and each contig's cut-off.
SWEPT = PEAKS + """, cu AS (SELECT 19 - i AS place, 0.01 + i * (0.5 - 0.01) / 20 AS c FROM range(20) t(i)),
    nc AS (SELECT chrom, place, c, count(*) FILTER (WHERE rho > 2 AND delta > c) AS n FROM pk, cu GROUP BY 1, 2, 3),
    fr AS (SELECT chrom, n, count(*) AS times, min(place) AS place, max(c) AS c FROM nc GROUP BY 1, 2),
    md AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY place) AS nth, count(*) OVER (PARTITION BY chrom) AS modes FROM (SELECT *, max(times) OVER (PARTITION BY chrom) AS most FROM fr) WHERE times = most),
    ch AS (SELECT chrom, CASE WHEN any_value(modes) > 3 THEN 0.1 WHEN any_value(modes) > 1 AND max(n) FILTER (WHERE nth = 2) < 7 THEN max(c) FILTER (WHERE nth = 2) ELSE max(c) FILTER (WHERE nth = 1) END AS cut FROM md GROUP BY 1),
    pl AS (SELECT pk.*, cut FROM pk JOIN ch USING (chrom))"""


@query("m27_density_sweep", sql(SWEPT + labelled("cut", "pl") + LABELS, "tiles").replace("WITH ", "WITH RECURSIVE ", 1))
def m27(spark, sf_dir):
    """Clusters by density peaks at the cut-off that a sweep selects."""
    return models.cluster_segments(cloud(spark, sf_dir), "density_sweep", scale=0.01)


#: Clusters at a cut-off of 2, their spreads, and the wide ones' own peaks.
AGAIN = CLOUD + """, p AS (SELECT chrom, start_pos, maf AS x, 0.01 * CASE WHEN coverage > 250 THEN coverage + 200 ELSE coverage END AS y FROM cloud WHERE maf IS NOT NULL)""" + peaks("p") + labelled("2.0") + """,
    l1 AS (SELECT p.*, lb.cluster FROM p JOIN lb ON lb.chrom = p.chrom AND lb.a = p.start_pos), c1 AS (SELECT chrom, cluster, avg(x) AS mx, avg(y) AS my FROM l1 GROUP BY 1, 2),
    v1 AS (SELECT chrom, cluster, avg((x - mx) * (x - mx) + (y - my) * (y - my)) AS v, count(*) AS n FROM l1 JOIN c1 USING (chrom, cluster) GROUP BY 1, 2),
    w1 AS (SELECT chrom, cluster, sqrt(v) AS cut, last FROM (SELECT *, avg(v) OVER k AS mean, stddev_samp(v) OVER k AS sd, sum(n) OVER k AS total, count(*) OVER k AS clusters, max(cluster) OVER k AS last FROM v1 WINDOW k AS (PARTITION BY chrom))
        WHERE v >= mean AND sd > 0.015 AND n < 0.9 * total AND clusters < 4), p2 AS (SELECT l1.chrom, start_pos, x, y FROM l1 JOIN w1 USING (chrom, cluster))""" + peaks("p2", "2") + """,
    pl2 AS (SELECT pk2.*, cut FROM pk2 JOIN w1 USING (chrom))""" + labelled("cut", "pl2", "2")


# one cluster of a contig is wide, and after it is parted a contig has four, which ends the search
@query("m27_reclustered", sql(AGAIN + """ SELECT p.chrom, p.start_pos, CAST(CASE WHEN lb2.cluster > 0 THEN last + lb2.cluster ELSE coalesce(l1.cluster, -1) END AS INT) AS cluster
    FROM p LEFT JOIN l1 USING (chrom, start_pos) LEFT JOIN w1 ON w1.chrom = p.chrom AND w1.cluster = l1.cluster LEFT JOIN lb2 ON lb2.chrom = p.chrom AND lb2.a = p.start_pos""", "tiles").replace("WITH ", "WITH RECURSIVE ", 1))
def m27_again(spark, sf_dir):
    """A cluster of three states, too wide beside a narrow one, parted again."""
    rows = cloud(spark, sf_dir).withColumn("coverage", F.when(F.col("coverage") > 250, F.col("coverage") + 200).otherwise(F.col("coverage")))
    points_ = clusters.plane(rows, F.col("chrom"), F.col("start_pos"), F.col("maf"), 0.01 * F.col("coverage"))
    dense = clusters.density(points_)
    found = clusters.recluster(dense, written(clusters.peak_labels(dense, 2.0, F.lit(2.0)), "labels"))
    return found.select(F.col("grp").alias("chrom"), F.col("id").alias("start_pos"), "cluster")


@query("t05_neighbour_sums", sql(TILED + POINTS + """, w AS (SELECT chrom, start_pos // 4000 * 4000 AS start_pos, avg(coverage) AS coverage, avg(maf) AS maf FROM pts GROUP BY 1, 2),
    d AS (SELECT a.chrom, a.start_pos, sqrt(pow(a.coverage - b.coverage, 2) + pow(a.maf - b.maf, 2)) AS d FROM w a JOIN w b ON a.chrom = b.chrom AND a.start_pos != b.start_pos WHERE a.maf IS NOT NULL AND b.maf IS NOT NULL)
    SELECT chrom, start_pos, round(sum(d), 4) AS near FROM (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY d) AS n FROM d) WHERE n <= 10 GROUP BY 1, 2""", "tiles"))
def t05(spark, sf_dir):
    """Sums of the ten nearest distances."""
    return models.neighbour_sums(_windows(spark, sf_dir)).select("chrom", "start_pos", F.round("near", 4).alias("near"))


@query("m32_cluster_spread", sql(PEAKS + labelled("0.05") + """, me AS (SELECT c.chrom, lb.cluster, c.coverage, c.maf, c.weight FROM cloud c JOIN lb ON lb.chrom = c.chrom AND lb.a = c.start_pos),
    ct AS (SELECT chrom, cluster, avg(coverage) AS cx, avg(maf) AS cy, sum(weight) AS total FROM me GROUP BY 1, 2),
    dd AS (SELECT chrom, cluster, sqrt(pow(coverage - cx, 2) + pow(maf - cy, 2)) AS d, weight / total AS share FROM me JOIN ct USING (chrom, cluster))
    SELECT chrom, CAST(cluster AS INT) AS cluster, count(*) AS n, round(avg(d), 6) AS mean_distance, round(median(d), 6) AS median_distance, round(-sum(share * ln(share)), 6) AS entropy FROM dd GROUP BY 1, 2""", "tiles").replace("WITH ", "WITH RECURSIVE ", 1))
def m32(spark, sf_dir):
    """Distances and entropy of clusters."""
    rows = cloud(spark, sf_dir)
    out = models.cluster_spread(rows, models.cluster_segments(rows, "density", scale=0.01, bandwidth=0.05))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_distance", "median_distance", "entropy")})


@query("c06_likelihood_table", sql(LIKELIHOOD + f" SELECT sample, cn, CAST(k AS INT) AS depth, round({NEGATIVE_BINOMIAL.format(k='k')}, 7) AS p FROM nb, range(60) t(k)", "sample_bins"))
def c06(spark, sf_dir):
    """Negative binomial likelihoods by sample, copy number and depth."""
    stats_ = ad.sample_bins(spark, sf_dir).groupBy("sample").agg(F.avg("cnt").alias("m"), F.var_samp("cnt").alias("v")).collect()
    table = models.likelihood_table(spark, {r["sample"]: r["m"] for r in stats_}, {r["sample"]: r["v"] for r in stats_}, 4, 60)
    return table.select("sample", "cn", "depth", F.round("p", 7).alias("p"))
