"""Steps of the tumour model on cases worked out by hand."""

import math

from helixframe.operators import somatic

CALLS = "chrom string, start_pos long, end_pos long, cn int"


def test_distance_from_the_diploid_state(spark):
    plain = spark.createDataFrame([("a", 0, 100, 2), ("a", 100, 150, 3), ("a", 150, 200, 0)], CALLS)
    row = somatic.diploid_distance(plain, 1000.0).first()
    assert (row.baseline, row.events) == (2, 0.15) and math.isclose(row.distance, 1 / 0.15)
    high = spark.createDataFrame([("a", 0, 90, 4), ("a", 90, 100, 2)], CALLS)
    row = somatic.diploid_distance(high, 1000.0).first()
    assert (row.baseline, row.events) == (4, 1.02)
    most = spark.createDataFrame([("a", 0, 90, 10), ("a", 90, 100, 2)], CALLS)
    assert somatic.diploid_distance(most, 1000.0).first().baseline == 2
    row = somatic.diploid_distance(spark.createDataFrame([], CALLS), 1000.0).first()
    assert (row.baseline, row.events, row.distance) == (2, 0, 1000)


def test_distances_of_models(spark):
    rows = [(m, "a", 100 * k, 100 * k + 100, cn) for m, cns in ((0, (2, 3, 1)), (1, (2, 2, 4)), (2, (2, 3, 1))) for k, cn in enumerate(cns)]
    out = somatic.model_distances(spark.createDataFrame(rows, "model int, " + CALLS), 1000.0, ["chrom", "start_pos"])
    assert {(r.model, r.other): r.distance for r in out.collect()} == {(0, 1): 0.4, (0, 2): 0.0, (1, 2): 0.4}


def test_balanced_states_move_towards_their_segments(spark):
    points = spark.createDataFrame([(1, 1, 50.0, 0.0), (2, 1, 100.0, 0.5), (2, 2, 100.0, 0.0), (4, 2, 200.0, 0.5)], "cn int, mcc int, coverage double, maf double")
    segments = spark.createDataFrame(
        [(1, 100.0, 0.44, 10.0), (2, 101.0, 0.46, 10.0), (3, 100.0, 0.3, 1000.0), (4, 100.0, None, 1000.0), (5, 100.0, 0.05, 1000.0), (6, 51.0, 0.1, 5.0)],
        "id int, coverage double, maf double, weight double",
    )
    out = somatic.refine_even_maf(segments, points, ["id"], 0.01, prior=20.0)
    got = {(r.cn, r.mcc): r.maf for r in out.collect()}
    assert math.isclose(got.pop((2, 1)), (20 * 0.5 + 10 * 0.44 + 10 * 0.46) / 40) and got == {(1, 1): 0.0, (2, 2): 0.0, (4, 2): 0.5}


def test_samples_clearly_altered(spark):
    shape = "id int, start_pos long, end_pos long, coverage double, maf double, weight double, ref int"
    mb = 1_000_000
    flat = [(k, 0, 40 * mb, 100.0, 0.5, 40.0 * mb, 2) for k in range(4)]
    mixed = [(0.99, 0.98), (1.01, 1.02)]

    def judged(segments):
        pieces = [(k, 0, mb, c * x, f * y, 0.0, ref) for k, _, _, c, f, _, ref in segments for x, y in mixed]
        made = (spark.createDataFrame(x, shape) for x in (segments, pieces))
        return somatic.clearly_altered(*made, ["id"], 100.0, 0.5).first()

    row = judged(flat)
    assert not row.altered and math.isclose(row.coverage_scale, 0.01) and row.weight_off == 0
    assert judged([*flat[:2], *((k, 0, 40 * mb, 150.0, 0.5, 40.0 * mb, 2) for k in (2, 3))]).weight_off == 80 * mb
    assert judged([*flat[:2], *((k, 0, 40 * mb, 107.0, 0.4, 40.0 * mb, 2) for k in (2, 3))]).altered
    assert not judged([*flat[:2], *((k, 0, 40 * mb, 107.0, 0.5, 40.0 * mb, 2) for k in (2, 3))]).altered
    assert not judged([*flat[:2], *((k, 0, 40 * mb, 50.0, 0.5, 40.0 * mb, 1) for k in (2, 3))]).altered
    assert not judged([*flat[:2], *((k, 0, 40 * mb, 150.0, 0.5, 40.0 * mb, 0) for k in (2, 3))]).altered
    assert not judged([*flat[:2], *((k, 0, 300_000, 150.0, 0.5, 40.0 * mb, 2) for k in (2, 3))]).altered
    assert not judged([]).altered


def test_posterior_calls_fall_back_to_coverage(spark):
    parts = spark.createDataFrame(
        [(1, 1, 0.5, 0.0, 50.0, 1e-3, 0.0, 25.0), (2, 1, 0.5, 0.5, 100.0, 1e-3, 0.0, 25.0)],
        "cn int, mcc int, omega double, maf double, coverage double, v_maf double, v_both double, v_cov double",
    )
    rows = spark.createDataFrame([(1, 52.0, 0.02), (2, 99.0, 0.48), (3, 125.0, None), (4, 9000.0, 0.5)], "id int, coverage double, maf double")
    got = {r.id: (r.cn, r.mcc, r.posterior) for r in somatic.posterior_calls(rows, parts, ["id"], 100.0).collect()}
    assert got[1][:2] == (1, 1) and got[2][:2] == (2, 1) and got[1][2] > 0.999
    assert got[4] == (180, 90, 0.0)
