"""Small cases of the operators, and properties against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import stats, vcf
from helixframe.operators import binning, callers, cleaning, evaluation, kmers, models, segmentation
from helixframe.operators import intervals as iv
from helixframe.operators import segments as sg

SPAN = "chrom string, start_pos long, end_pos long"


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def random_spans(seed, n=120):
    r = np.random.default_rng(seed)
    start = r.integers(0, 60_000, n)
    return [(f"chr{c}", int(s), int(s + k)) for c, s, k in zip(r.integers(1, 4, n), start, r.integers(0, 15_000, n), strict=True)]


def keys(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("bucket", [700, 10_000])
def test_overlap_join_equals_brute_force(spark, bucket):
    a, b = random_spans(1), random_spans(2)
    got = keys(iv.overlap_join(spans(spark, a), spans(spark, b), bucket=bucket))
    want = sorted(
        (x[0], x[1], x[2], y[1], y[2], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b
        if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])
    )
    assert got == want


def test_semi_and_anti_split_the_left_side(spark):
    a, b = random_spans(3), random_spans(4, 15)
    left, right = spans(spark, a), spans(spark, b)
    hit = [x for x in a if any(x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2]) for y in b)]
    assert keys(iv.overlap_semi(left, right)) == sorted(hit)
    assert keys(iv.overlap_anti(left, right)) == sorted(x for x in a if x not in hit)


def test_empty_tables(spark):
    none = spans(spark, [])
    some = spans(spark, random_spans(5, 5))
    assert iv.overlap_join(some, none).count() == 0
    assert iv.overlap_anti(some, none).count() == 5
    assert iv.merge_intervals(none).count() == 0
    assert iv.breakpoint_union(none).count() == 0
    assert cleaning.drop_outliers(some.withColumn("cnt", F.lit(1.0)).filter("false")).count() == 0


def test_sites_in_intervals(spark):
    sites = spark.createDataFrame([("c", 10), ("c", 20), ("c", 100), ("c", 50)], "chrom string, pos long")
    found = iv.points_in(sites, spans(spark, [("c", 1, 50), ("c", 51, 150)]))
    assert sorted((r.pos, r.start_pos_r) for r in found.collect()) == [(10, 1), (20, 1), (100, 51)]
    shifted = iv.points_in(sites, spans(spark, [("c", 49, 50)]), offset=1)
    assert [r.pos for r in shifted.collect()] == [50]


@pytest.mark.parametrize(
    "rows,want",
    [
        ([("c", 1, 10)], [("c", 1, 10, 1)]),
        ([("c", 1, 10), ("c", 1, 10)], [("c", 1, 10, 2)]),
        ([("c", 1, 10), ("c", 3, 6)], [("c", 1, 3, 1), ("c", 3, 6, 2), ("c", 6, 10, 1)]),
        ([("c", 1, 10), ("c", 5, 15)], [("c", 1, 5, 1), ("c", 5, 10, 2), ("c", 10, 15, 1)]),
        ([("c", 1, 10), ("c", 10, 15)], [("c", 1, 10, 1), ("c", 10, 15, 1)]),
        ([("c", 1, 5), ("d", 1, 5)], [("c", 1, 5, 1), ("d", 1, 5, 1)]),
    ],
)
def test_breakpoint_union(spark, rows, want):
    assert keys(iv.breakpoint_union(spans(spark, rows))) == want


def test_ploidy_pieces_keep_gaps_at_the_default(spark):
    left = spark.createDataFrame([(1, "x", 0, 30)], "id int, " + SPAN)
    values = spark.createDataFrame([("x", 5, 10, 1), ("x", 20, 40, 3)], SPAN + ", cn int")
    got = iv.value_pieces(left, values, "cn", ["id"]).select("start_pos", "end_pos", "cn")
    assert keys(got) == [(0, 5, 2), (5, 10, 1), (10, 20, 2), (20, 30, 3)]


def test_order_and_overlap_are_checked(spark):
    with pytest.raises(Exception, match="overlap"):
        iv.assert_disjoint(spans(spark, [("c", 0, 10), ("c", 5, 8)]), ["chrom"]).collect()
    bad = spark.createDataFrame([("c", 5, 8, 1), ("c", 0, 3, 2)], SPAN + ", line int")
    with pytest.raises(Exception, match="sorted"):
        iv.assert_ordered(bad, "line", ["chrom"]).collect()


def test_running_median_shrinks_at_the_ends(spark):
    rows = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate([2, 1, 3, 5, 4, 6, 7, 8])], "chrom string, i int, v double")
    out = stats.running_median(rows, "v", 1, ["chrom"], "i", "m").orderBy("i")
    assert [r.m for r in out.collect()] == [1.5, 2, 3, 4, 5, 6, 7, 7.5]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9])
def test_quartiles_by_hand(spark, n):
    rows = spark.createDataFrame([("g", float(i)) for i in range(1, n + 1)], "g string, v double")
    q = stats.quartiles(rows, "v", ["g"]).first()
    want = {1: (1, 1), 2: (1, 2), 3: (1.25, 2.75), 4: (1.5, 3.5), 5: (1.75, 4.25), 6: (2, 5), 7: (2.25, 5.75), 8: (2.5, 6.5), 9: (2.75, 7.25)}
    assert q.q2 == (n + 1) / 2
    assert (q.q1, q.q3) == pytest.approx(want[n])


def test_confidence_intervals(spark):
    bins = spark.createDataFrame([("c", 1, 10, 0), ("c", 10, 30, 1), ("c", 30, 40, 2)], SPAN + ", seg_idx long")
    got = sg.with_confidence(bins).orderBy("seg_idx").select("ci_pos_low", "ci_pos_high", "ci_end_low", "ci_end_high")
    assert [tuple(r) for r in got.collect()] == [(-5, 5, -5, 10), (-5, 10, -10, 5), (-10, 5, -5, 5)]


def test_merge_absorbs_short_segments(spark):
    rows = [("a", 0, 100_000, 2, 9.0), ("a", 100_000, 200_000, 3, 5.0), ("a", 200_000, 300_000, 2, 8.0), ("a", 300_000, 300_100, 3, 1.0), ("a", 300_100, 400_000, 2, 7.0)]
    rows += [("b", 0, 60_000, 2, 1.0), ("b", 80_000, 150_000, 2, 1.0), ("b", 170_000, 250_000, 2, 1.0)]
    rows += [("d", 0, 60_000, 2, 1.0), ("d", 60_000, 120_000, 2, 1.0), ("d", 120_000, 180_000, 2, 1.0)]
    out = sg.merge_calls(spark.createDataFrame(rows, SPAN + ", cn int, q double"))
    counts = {r.chrom: r["count"] for r in out.groupBy("chrom").count().collect()}
    assert counts == {"a": 3, "b": 3, "d": 1}


def test_size_tags():
    assert [sg.size_tag(n) for n in (10_000, 6_000_000, 500)] == ["L10kb", "L6Mb", "L500bp"]


def test_baf_table(spark):
    rows = [("A", "T", 0, 0), ("A", "T", 1, 3), ("T", "A", 1, 3), ("T", "G", 1, 3), ("G", "C", 1, 3), (".", "C", 1, 3)]
    df = spark.createDataFrame(rows, "ref string, alt string, r int, a int")
    got = [x[0] for x in df.select(binning.b_allele_frequency(F.col("ref"), F.col("alt"), F.col("r"), F.col("a"))).collect()]
    assert got == [None, 0.75, 0.25, 0.75, 0.75, None]


def test_pileup_walks_the_alignment(spark):
    reads = spark.createDataFrame(
        [(1, "c", 100, 60, [("S", 2), ("M", 3), ("I", 1), ("M", 2), ("D", 4), ("M", 5)]), (2, "c", 100, 60, [("M", 3), ("N", 2), ("M", 3)])],
        "read_id int, chrom string, pos long, mapq int, cigar array<struct<op:string,len:int>>",
    )
    sites = spark.createDataFrame([("c", p) for p in (100, 103, 105, 109)], "chrom string, pos long")
    got = sorted((r.pos, r.read_id, r.read_offset) for r in binning.pileup(reads, sites).collect())
    assert got == [(100, 1, 2), (103, 1, 6), (109, 1, 8)]


def test_fragments_need_both_mates(spark):
    rows = [(1, "c", 100, 10, False, 100), (1, "c", 120, 10, False, 100), (2, "c", 100, 10, False, 100), (2, "c", 100, 10, True, 100)]
    reads = spark.createDataFrame(rows, "read_id int, chrom string, pos long, mapq int, is_dup boolean, frag_len int")
    assert [(r.read_id, r.start_pos, r.end_pos) for r in binning.fragments(reads, ["read_id"]).collect()] == [(1, 100, 200)]


def test_wavelets_find_level_shifts():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(m, 4, n) for m, n in ((50, 50), (100, 40), (20, 60), (200, 30))])
    assert segmentation.haar_breakpoints(x, 4) == [50, 90, 150]
    assert segmentation.heal(x, [25, 50, 90, 150], 0.05) == [50, 90, 150]


def test_circular_segmentation_is_seeded_and_finds_an_arc():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, 60), r.normal(4, 1, 20), r.normal(0, 1, 60)])
    first = segmentation.cbs_breakpoints(x, 9, permutations=200)
    assert first == segmentation.cbs_breakpoints(x, 9, permutations=200)
    assert len(first) == 2 and abs(first[0] - 60) <= 2 and abs(first[1] - 80) <= 2
    assert segmentation.cbs_breakpoints(r.normal(0, 1, 150), 9, permutations=200) == []
    assert segmentation.prune(x, [30, 60, 80]) == [60, 80]
    assert segmentation.undo_by_deviation(x, [30, 60, 80]) == [60, 80]


def test_max_arc_equals_brute_force():
    x = np.random.default_rng(5).normal(0, 1, 25)
    c = x - x.mean()
    best = 0.0
    for i in range(25):
        for j in range(i + 2, 26):
            k = j - i
            if k <= 23:
                best = max(best, c[i:j].sum() ** 2 * 25 / (k * (25 - k)))
    total = (c * c).sum()
    assert segmentation.max_arc(x)[0] == pytest.approx(best / ((total - best) / 23))


def test_viterbi_equals_brute_force():
    import itertools

    r = np.random.default_rng(6)
    e = r.random((6, 3))
    move = np.full((3, 3), 0.05)
    np.fill_diagonal(move, 0.9)
    def score(path):
        s = np.log(e[0, path[0]] / 3)
        for t in range(1, 6):
            s += np.log(move[path[t - 1], path[t]]) + np.log(e[t, path[t]])
        return s
    best = max(itertools.product(range(3), repeat=6), key=score)
    assert tuple(segmentation.viterbi(e, 0.9)) == best


def test_negative_binomial_has_its_mode_at_the_mean_and_sums_to_one():
    p = segmentation.negative_binomial(30, 60, 400)
    assert abs(int(p.argmax()) - 29) <= 1 and p.sum() == pytest.approx(1, abs=1e-6)


def test_loess_follows_a_line_and_a_curve():
    x = np.linspace(0, 10, 60)
    assert models.loess(x, 2 * x + 1, x) == pytest.approx(2 * x + 1)
    assert np.abs(models.loess(x, np.sin(x), x, 0.3) - np.sin(x)).max() < 0.35


def test_golden_section():
    assert models.golden_section(lambda v: (v - 1.7) ** 2, 0, 5) == pytest.approx(1.7, abs=1e-4)


def test_clusterings_find_four_corners():
    r = np.random.default_rng(7)
    corners = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    points = np.concatenate([c + r.normal(0, 0.02, (12, 2)) for c in corners])
    truth = np.repeat(np.arange(4), 12)
    for labels in (models.mean_shift(points, 0.1)[1], models.density_peaks(points, 0.1, 1.0, 0.3)):
        assert len({(a, b) for a, b in zip(truth, labels, strict=True)}) == 4
    fit = models.gaussian_mixture(points, np.ones(48), corners + 0.05)
    assert np.abs(fit["mean"] - corners).max() < 0.05
    assert models.silhouette(points, truth) > 0.8
    assert set(models.density_peaks(points[[0, 12, 24]], density=2, distance=2)) == {-1}


def test_purity_grid_finds_the_mixture(spark):
    purity, diploid = 0.6, 100.0
    rows = []
    for cn, mcc, w in ((2, 1, 50.0), (3, 2, 20.0), (1, 1, 15.0), (4, 2, 8.0), (2, 2, 7.0)):
        copies = purity * cn + 2 * (1 - purity)
        rows.append((copies / 2 * diploid, (purity * (cn - mcc) + (1 - purity)) / copies, w))
    segs = spark.createDataFrame(rows, "coverage double, maf double, weight double")
    best = models.best_purity(segs, models.purity_grid(spark, (80, 120), (30, 100), 10), models.state_table(spark, 5)).first()
    assert (best.diploid, best.purity) == (100.0, 0.6)


def test_circular_segmentation_takes_10000_permutations(monkeypatch):
    import inspect

    from helixframe.plans import model_queries

    asked = inspect.signature(segmentation.segment_cbs)
    assert inspect.signature(segmentation.cbs_breakpoints).parameters["permutations"].default == 10_000
    monkeypatch.setattr(model_queries.ad, "sample_bins", lambda *_: None)
    monkeypatch.setattr(segmentation, "segment_cbs", lambda *a, **k: (got := asked.bind(*a, **k), got.apply_defaults())[0].arguments["permutations"])
    assert model_queries.QUERIES["m07_cbs_segments"](None, "") == 10_000


def test_purity_has_its_own_step_and_upper_bound(spark):
    grid = models.purity_grid(spark, (90, 1007), (30, 100), 5).toPandas()
    assert grid["diploid"].max() == 1007 and sorted(set(grid["purity"])) == [p / 100 for p in range(30, 101)]
    purity, diploid, rows = 0.63, 101.0, []
    for cn, mcc, w in ((2, 1, 50.0), (3, 2, 20.0), (1, 1, 15.0), (4, 2, 8.0), (2, 2, 7.0)):
        copies = purity * cn + 2 * (1 - purity)
        rows.append((copies / 2 * diploid, (purity * (cn - mcc) + (1 - purity)) / copies, w))
    segs = spark.createDataFrame([*rows, (None, 0.5, 1.0)], "coverage double, maf double, weight double").repartition(3)
    best = models.best_purity(segs, models.purity_grid(spark, (80, 120), (30, 100)), models.state_table(spark, 5)).collect()
    assert [(b.diploid, b.purity) for b in best] == [(101.0, 0.63)] and best[0].deviation < 1e-9


def test_trio_equals_brute_force(spark):
    p = {"m": [0.01, 0.1, 0.8, 0.05, 0.04], "f": [0.02, 0.08, 0.85, 0.03, 0.02], "c": [0.01, 0.04, 0.05, 0.8, 0.1]}
    rows = [(s, 1, cn, v) for s, vs in p.items() for cn, v in enumerate(vs)]
    got = callers.trio_calls(spark.createDataFrame(rows, "sample string, seg int, cn int, p double"), {"mother": "m", "father": "f", "child": "c"}, ["seg"]).first()
    t = {(a, b): v for a, b, v in callers.transmission(4)}
    joint = {}
    for m in range(5):
        for f in range(5):
            for g1 in range(5):
                for g2 in range(5 - g1):
                    k = (m, f, g1 + g2)
                    joint[k] = joint.get(k, 0) + p["m"][m] * p["f"][f] * t[m, g1] * t[f, g2] * p["c"][g1 + g2]
    assert (got.mother, got.father, got.child) == max(joint, key=joint.get)
    gain = sum(v for (m, f, c), v in joint.items() if c > 2 and m <= 2 and f <= 2)
    loss = sum(v for (m, f, c), v in joint.items() if c < 2 and m >= 2 and f >= 2)
    want = min(100, 2 * -10 * np.log10(1 - gain / (sum(joint.values()) - loss)))
    assert got.dq == pytest.approx(want)


def test_roles_need_a_full_trio():
    assert callers.roles_of({"a": "mother", "b": "father", "c": "proband"}) == {"mother": "a", "father": "b", "child": "c"}
    assert callers.roles_of({"a": "mother", "c": "proband"}) is None


def test_evaluation_of_perfect_calls(spark):
    truth = spark.createDataFrame([(i, "c", i * 1000, i * 1000 + 1000, cn) for i, cn in enumerate((2, 3, 1, 4, 2))], "iv_id int, " + SPAN + ", cn int")
    excluded = spans(spark, [("c", 4001, 5000)])
    cube = evaluation.confusion(truth, truth, excluded)
    out = evaluation.metrics(cube).first()
    assert out.recall == out.precision == out.accuracy == out.f1 == 100
    assert cube.filter("known_cn = 2").agg(F.sum("bases")).first()[0] == 1001


def test_vcf_columns(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "cn int")
    kinds = [r[0] for r in df.select(vcf.cnv_type(F.col("cn"), F.lit(None), F.lit(2))).collect()]
    assert kinds == ["loss", "loss", "reference", "gain"]
    assert df.filter("cn = 2").select(vcf.cnv_type(F.col("cn"), F.lit(2), F.lit(2))).first()[0] == "loh"
    head = vcf.header([("chr1", 100)], ["s"], {"q10": "low"})
    assert head[0] == "##fileformat=VCFv4.1" and head[-1].split("\t")[-1] == "s"


def test_kmers_of_odd_letters(spark):
    seqs = spark.createDataFrame([(1, "ACGTN\nACGT"), (2, "ac"), (3, ""), (4, None)], "seq_id int, seq string")
    got = {r.kmer: r.n for r in kmers.kmer_counts(seqs, 3).collect()}
    assert got == {"ACG": 4}
    cased = kmers.cased(spark.createDataFrame([(1, "aaac"), (2, ""), (3, "CCNacc")], "seq_id int, seq string"), 3)
    assert {r.seq_id: r.seq for r in cased.collect()} == {1: "AAac", 2: "", 3: "ccnAcc"}


#: Called segments, common variants, and the layouts wanted of them.
LAYOUTS = [
    ([(100000, 500002)], [(250000, 350001)], {("A", 100000, 500002), ("B", 100000, 250000), ("B", 250000, 350001), ("B", 350001, 500002)}),
    ([(100000, 500002)], [(200000, 250001), (400000, 450001)], {("A", 100000, 500002), ("B", 100000, 200000), ("B", 200000, 250001), ("B", 400000, 450001)}),
    ([(100000, 250001), (300000, 500001)], [(200000, 350001)],
     {("A", 100000, 250001), ("A", 300000, 350001), ("B", 100000, 200000), ("B", 200000, 350001), ("A", 350001, 500001)}),
    ([(100000, 500001)], [(300000, 500001)], {("A", 100000, 500001), ("B", 100000, 300000), ("B", 300000, 500001)}),
    ([(150000, 250001), (400000, 450001)], [(200000, 500001)], {("A", 150000, 250001), ("A", 400000, 450001), ("B", 150000, 200000), ("B", 200000, 500001)}),
    ([(300000, 450001)], [(200000, 350001)], {("A", 300000, 450001), ("B", 200000, 350001), ("B", 350001, 450001)}),
    ([(150000, 250001)], [(300000, 350001)], {("A", 150000, 250001), ("B", 300000, 350001)}),
    ([(150000, 250001)], [(150000, 250001)], {("B", 150000, 250001)}),
    ([(150000, 250001)], [(150400, 250401)], {("B", 150400, 250401)}),
    ([(150000, 250001)], [(249995, 260000)], {("A", 150000, 250001), ("B", 249995, 260000)}),
    ([(150000, 250001)], [(200000, 200999)], {("A", 150000, 250001)}),
    ([], [(200000, 300000)], {("B", 200000, 300000)}),
    ([(200000, 300000)], [], {("A", 200000, 300000)}),
]


def test_common_variants_give_layouts(spark):
    a = spans(spark, [(f"c{k}", *r) for k, (called, _, _) in enumerate(LAYOUTS) for r in called])
    b = spans(spark, [(f"c{k}", *r) for k, (_, common, _) in enumerate(LAYOUTS) for r in common])
    places = range(300000, 500001, 50000)
    marked = spans(spark, [(f"c{k}", p, p + 1) for k in range(len(LAYOUTS)) for p in places])
    got, held = sg.merge_common(a, b).collect(), sg.merge_common(a, b, marked).collect()
    for k, (_, common, want) in enumerate(LAYOUTS):
        own = [(r.alt, r.start_pos, r.end_pos) for r in got if r.chrom == f"c{k}"]
        assert set(own) == want and len(own) == len(want)
        parts = {(r.start_pos, r.end_pos) for r in held if r.chrom == f"c{k}" and r.alt == "B" and not r.is_common}
        whole = {(s, e) for alt, s, e in want if alt == "B" and (s, e) not in common}
        assert parts == {(s, e) for s, e in whole if any(s <= p < e for p in places)}


def test_neighbour_sums_do_not_depend_on_blocks(spark):
    r = np.random.default_rng(3)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(r.random((60, 2)).round(2))] + [("b", 7, 0.5, 0.5), ("c", 1, 0.1, 0.1), ("c", 2, 0.4, 0.5), ("c", 3, 0.4, None)]
    points = spark.createDataFrame(rows, "chrom string, start_pos long, coverage double, maf double")
    xy = np.array([v[2:] for v in rows[:60]])
    want = np.sort(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), axis=1)[:, 1:11].sum(axis=1)
    for block in (7, 1024):
        got = {(row.chrom, row.start_pos): row.near for row in models.neighbour_sums(points, block=block).collect()}
        assert len(got) == 63 and got["b", 7] == 0 and abs(got["c", 1] - 0.5) < 1e-12
        assert np.allclose([got["a", i] for i in range(60)], want)


def test_recall_against_the_reference_of_each_interval_and_in_regions(spark):
    shape = "iv_id long, chrom string, start_pos long, end_pos long, cn int, ref_ploidy int"
    truth = spark.createDataFrame([(1, "x", 0, 1000, 2, 1), (2, "x", 2000, 3000, 1, 2), (3, "x", 4000, 5000, 1, 1), (4, "x", 6000, 7000, 2, 2)], shape)
    calls = spark.createDataFrame([(1, "x", 0, 1000, 2, 0), (2, "x", 2000, 3000, 1, 0), (3, "x", 4000, 5000, 2, 0), (4, "x", 6000, 7000, 2, 0)], shape)
    none = truth.limit(0)
    cube = evaluation.confusion(truth, calls, none, by=["ref_ploidy"])
    row = evaluation.metrics(cube, F.col("ref_ploidy")).first()
    assert row.recall == 100 and row.accuracy == 75 and row.gain_recall == 100 and round(row.precision, 3) == 66.667
    regions = spans(spark, [("x", 500, 1200), ("x", 900, 1500), ("x", 4500, 4600)])
    inside = evaluation.in_regions(truth, regions)
    assert sorted((r.start_pos, r.end_pos) for r in inside.collect()) == [(500, 1000), (4500, 4600)]
    assert evaluation.metrics(evaluation.confusion(inside, calls, none)).first().accuracy == round(100 * 500 / 600, 6)


def test_sweeps_find_the_number_of_clusters():
    r = np.random.default_rng(11)
    centres = np.array([(0.1, 0.1), (0.1, 0.9), (0.9, 0.1), (0.9, 0.9), (0.5, 0.5)])
    xy = np.concatenate([c + 0.02 * r.standard_normal((30, 2)) for c in centres])
    true = np.repeat(np.arange(5), 30)
    for labels in (models.best_mixture(xy, np.ones(150)), models.density_sweep(xy)):
        assert len({(a, b) for a, b in zip(true, labels, strict=True)}) == 5 and len(set(labels)) == 5
    assert (models.best_mixture(xy, np.ones(150)) == models.best_mixture(xy, np.ones(150))).all()
    assert models.best_mixture(xy[:2], np.ones(2)).tolist() == [0, 0] and models.density_sweep(xy[:1]).tolist() == [-1]
    w = models.best_weighting(100 * xy[:, 1], xy[:, 0], np.ones(150), 0.001, 0.02)
    assert 0.001 <= w < 0.02
