"""Round trips of the text formats, and whole runs on simulated bins."""

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import vcf
from helixframe.plans import pipelines
from helixframe.sources import files

BINS = "chrom string, start_pos long, end_pos long, gc int, cnt double"


def put(path, lines):
    path.write_text("".join(line + "\n" for line in lines))
    return str(path)


def test_bins_and_segments_round_trip(spark, tmp_path):
    rows = [("chr1", 0, 10, 40, 1.5), ("chr1", 10, 25, 41, 2.25), ("chr2", 5, 9, 50, 3.0)]
    bins = spark.createDataFrame(rows, BINS)
    files.write_bins(bins, str(tmp_path / "bins"))
    back = files.read_bins(spark, str(tmp_path / "bins")).select("chrom", "start_pos", "end_pos", "gc", "cnt")
    assert sorted(map(tuple, back.collect())) == rows
    excluded = spark.createDataFrame([("chr1", 12, 13)], "chrom string, start_pos long, end_pos long")
    assert files.read_coverage(spark, str(tmp_path / "bins"), excluded).count() == 2
    files.write_partitioned(bins.withColumn("seg_idx", F.lit(4)), str(tmp_path / "seg"))
    segs = files.read_partitioned(spark, str(tmp_path / "seg")).orderBy("chrom").collect()
    assert [(s.chrom, s.start_pos, s.end_pos, s.bins) for s in segs] == [("chr1", 0, 25, 2), ("chr2", 5, 9, 1)]
    assert (segs[0].ci_pos_low, segs[0].ci_end_high) == (-5, 8)


def test_intervals_are_checked(spark, tmp_path):
    path = put(tmp_path / "a.bed", ["# comment", "c\t5\t9", "c\t1\t3"])
    assert files.read_bed(spark, path).count() == 2
    with pytest.raises(Exception, match="bad interval"):
        files.read_bed(spark, put(tmp_path / "b.bed", ["c\t5\t5"])).collect()
    regions = files.read_regions(spark, put(tmp_path / "r.tsv", ["t1\tc\t11\t20"]))
    assert tuple(regions.first()) == ("t1", "c", 10, 20)


def test_vcf_sources_and_sink(spark, tmp_path):
    lines = [
        "##fileformat=VCFv4.1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts",
        "c\t10\t.\tN\t<CN1>\t.\tPASS\tEND=20;CN=1.5\tGT:CN:DQ\t0/1:1:30", "c\t20\t.\tN\t<CN1>\t.\tq10\tEND=30\tCN\t1",
        "c\t40\t.\tN\t<DUP>\t.\tPASS\tEND=50;CN=3\tGT:CN\t.:.",
    ]
    path = put(tmp_path / "x.vcf", lines)
    assert sorted(map(tuple, files.read_ploidy(spark, path).collect())) == [("c", 10, 30, 1)]
    assert files.read_ploidy(spark, path, strict=False).count() == 3
    assert [r.cn for r in files.read_truth_vcf(spark, path).orderBy("start_pos").collect()] == [2, None, 3]
    calls = files.read_calls(spark, path).orderBy("start_pos").collect()
    assert [(c.start_pos, c.cn, c.ref_ploidy, c.is_pass) for c in calls] == [(10, 1, 2, True), (20, 1, None, False), (40, 3, None, True)]
    assert files.read_calls(spark, path, 20).count() == 1
    records = spark.createDataFrame([(2, "d", 5, "."), (1, "c", 9, "."), (1, "c", 3, ".")], "chrom_ord int, chrom string, pos long, id string")
    files.write_vcf(records, vcf.header([("c", 10)], ["s"], {}), str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert text[0] == "##fileformat=VCFv4.1" and text[-3:] == ["c\t3\t.", "c\t9\t.", "d\t5\t."]


def test_sites_truth_metrics_and_parameters(spark, tmp_path):
    sites = files.read_sites(spark, put(tmp_path / "s.tsv", ["#h", "c\t5\tA\tC\t4\t5", "c\t6\tA\tC\t5\t5"]))
    assert [r.pos for r in sites.collect()] == [6]
    files.write_sites(sites, str(tmp_path / "sites"))
    assert files.read_sites(spark, str(tmp_path / "sites")).count() == 1
    truth = files.read_truth_bed(spark, put(tmp_path / "t.bed", ["c\t0\t5\t1\t2\t0.4", "c\t5\t9\t1\t1"]), 0.5)
    assert [(r.start_pos, r.cn) for r in truth.collect()] == [(5, 2)]
    files.write_metrics({"m": 1.25}, spark, str(tmp_path / "m"))
    assert files.read_metric(spark, str(tmp_path / "m"), "m") == 1.25
    with pytest.raises(ValueError):
        files.read_metric(spark, str(tmp_path / "m"), "none")

    @dataclass
    class P:
        a: int = 1
        b: float = 2.0

    assert files.read_parameters(spark, put(tmp_path / "p.json", ['{"a": 5, "other": 1}']), P) == P(5, 2.0)
    model = files.read_pca_model(spark, put(tmp_path / "pca.tsv", ["c\t0\t1\t5.0\t3.0\t4.0", "c\t1\t2\t6.0\t4.0\t-3.0"]), 2).orderBy("start_pos").first()
    assert (model.axis_1, model.axis_2) == pytest.approx((0.6, 0.8))
    with pytest.raises(ValueError):
        files.read_pca_model(spark, put(tmp_path / "bad.tsv", ["c\t0\t1\t5.0\t3.0\t4.0", "c\t1\t2\t6.0\t4.0\t3.0"]), 2)


def simulated(spark, levels, seed=1, chrom="chr1"):
    r = np.random.default_rng(seed)
    means = np.concatenate([[m] * n for m, n in levels])
    gc = r.integers(38, 44, len(means))
    return [(chrom, 100_000 * i, 100_000 * (i + 1), int(g), float(c)) for i, (g, c) in enumerate(zip(gc, r.poisson(means), strict=True))]


def test_germline_run_finds_a_loss_and_a_gain(spark):
    bins = spark.createDataFrame(simulated(spark, [(100, 150), (50, 40), (100, 120), (150, 50), (100, 150)]), BINS)
    none = spark.createDataFrame([], "chrom string, start_pos long, end_pos long")
    options = pipelines.Options().override({"clean": {"drop_rare_gc": False}, "segment": {"method": "haar", "germline": False}})
    calls = pipelines.germline(bins, none, options=options).orderBy("start_pos").collect()
    assert [c.cn for c in calls] == [2, 1, 2, 3, 2]
    assert all(abs(c.start_pos - s) <= 300_000 for c, s in zip(calls[1:], (15_000_000, 19_000_000, 31_000_000, 36_000_000), strict=True))
    truth = spark.createDataFrame(
        [(1, "chr1", 0, 15_000_000, 2), (2, "chr1", 15_000_000, 19_000_000, 1), (3, "chr1", 19_000_000, 31_000_000, 2), (4, "chr1", 31_000_000, 36_000_000, 3)],
        "iv_id int, chrom string, start_pos long, end_pos long, cn int",
    )
    found = spark.createDataFrame([(c.chrom, c.start_pos, c.end_pos, c.cn) for c in calls], "chrom string, start_pos long, end_pos long, cn int")
    assert pipelines.evaluate(truth, found, none).first().recall > 95
    assert pipelines.evaluate(truth, found, none, by_size=True).count() == 1


def test_somatic_run_estimates_a_model(spark):
    levels = [(100, 200), (70, 60), (100, 100), (130, 60), (100, 100)]
    bins = spark.createDataFrame(simulated(spark, levels, 2), BINS)
    controls = spark.createDataFrame([("n1", *r) for r in simulated(spark, [(100, 520)], 3)] + [("n2", *r) for r in simulated(spark, [(150, 520)], 4)], "sample string, " + BINS)
    none = spark.createDataFrame([], "chrom string, start_pos long, end_pos long")
    options = pipelines.Options().override({"clean": {"gc": "none", "drop_rare_gc": False, "drop_outliers": False}, "segment": {"method": "haar", "germline": False}})
    calls = pipelines.somatic(bins, none, controls=controls, options=options)
    rows = calls.orderBy("start_pos").collect()
    assert rows and 0.2 <= rows[0].purity <= 1
    sides = [r.cn - 2 for r in rows if r.end_pos - r.start_pos > 1_000_000]
    assert min(sides) < 0 < max(sides)


def test_pedigree_run_sees_a_new_gain(spark):
    plain, gain = [(40, 300)], [(40, 120), (60, 60), (40, 120)]
    rows = [("m", *r) for r in simulated(spark, plain, 5)] + [("f", *r) for r in simulated(spark, plain, 6)] + [("c", *r) for r in simulated(spark, gain, 7)]
    bins = spark.createDataFrame(rows, "sample string, " + BINS)
    none = spark.createDataFrame([], "chrom string, start_pos long, end_pos long")
    options = pipelines.Options().override({"segment": {"method": "hmm"}})
    out = pipelines.pedigree(bins, none, {"m": "mother", "f": "father", "c": "proband"}, options).orderBy("start_pos").collect()
    new = [r for r in out if r.child == 3 and r.end_pos - r.start_pos > 3_000_000]
    assert new and all(r.mother == 2 and r.father == 2 and r.dq > 5 for r in new)
    with pytest.raises(ValueError):
        pipelines.pedigree(bins, none, {"m": "mother"})


def test_family_run_calls_two_children_by_haplotypes(spark):
    plain, gain = [(40, 300)], [(40, 120), (60, 60), (40, 120)]
    levels = {"m": plain, "f": plain, "c": gain, "d": plain}
    rows = [(who, *r) for i, (who, own) in enumerate(levels.items()) for r in simulated(spark, own, 15 + i)]
    r = np.random.default_rng(1)
    sites = []
    for who, own in levels.items():
        means = np.concatenate([[m] * n for m, n in own])
        for i in range(0, 300, 3):
            if 200 <= i < 210:
                continue  # a stretch without sites is judged by depth
            first, second = (2, 1) if means[i] > 50 else (1, 1)
            sites.append((who, "chr1", 100_000 * i + 50, int(r.poisson(15 * first)), int(r.poisson(15 * second))))
    none = spark.createDataFrame([], "chrom string, start_pos long, end_pos long")
    options = pipelines.Options().override({"segment": {"method": "joint_hmm"}})
    out = pipelines.family(
        spark.createDataFrame(rows, "sample string, " + BINS), spark.createDataFrame(sites, "sample string, chrom string, pos long, ref_count int, alt_count int"), none, "m", "f", ["c", "d"], options
    ).collect()
    large = [x for x in out if x.end_pos - x.start_pos > 3_000_000]
    new = [x for x in large if x.sample == "c" and x.cn == 3]
    assert new and all(x.dq is not None and x.dq > 10 and x.mcc == 2 and x.filters is not None for x in new)
    assert all(x.cn == 2 and x.dq is None for x in large if x.sample != "c")
    assert {x.sample for x in out} == set("mfcd") and all(0 <= x.q <= 60 for x in out)


def test_somatic_run_weighs_clusters_of_segments(spark):
    levels = [(100, 40), (70, 20), (100, 40), (130, 20)] * 4 + [(400, 30)]
    bins = spark.createDataFrame(simulated(spark, levels, 2), BINS)
    none = spark.createDataFrame([], "chrom string, start_pos long, end_pos long")
    means, r = np.concatenate([[m] * n for m, n in levels]), np.random.default_rng(4)
    minor = {100: 0.5, 70: 0.29, 130: 0.385, 400: 0.125}
    sites = spark.createDataFrame(
        [("chr1", 100_000 * i + 30 * k, int(n - b), int(b)) for i, m in enumerate(means) for k in range(2) for n in [30 + 4 * k] for b in [r.binomial(n, minor[m])]],
        "chrom string, pos long, ref_count int, alt_count int",
    )
    options = pipelines.Options().override({"clean": {"gc": "none", "drop_rare_gc": False, "drop_outliers": False, "drop_big": False}, "segment": {"method": "haar", "germline": False}})
    for given in (None, sites):
        rows = pipelines.somatic(bins, none, sites=given, options=options).collect()
        assert rows and rows[0].deviation is not None and 0.2 <= rows[0].purity <= 1
        assert max(r.cn for r in rows) > 6  # read off the depth beyond the greatest state
