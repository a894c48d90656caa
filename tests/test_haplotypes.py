"""Phased genotypes: which are likelier for plain cases, and the trio's call against brute force."""

import itertools
import math
import random

from helixframe.operators import haplotypes

PAIRS = [(a, b) for a in range(5) for b in range(5 - a)]


def test_likelihoods_of_plain_cases(spark):
    cases = {
        "even": [(48, 1), (26, 23), (22, 28), (24, 26), (2, 49), (25, 24)], "lost": [(52, 1), (51, 0), (46, 2), (47, 1), (49, 2), (54, 0)],
        "single": [(30, 1), (38, 2), (32, 3), (1, 34), (35, 2), (28, 1)], "four": [(198, 1), (203, 2), (207, 3), (2, 197), (200, 1), (201, 2)],
        "none": [(0, 0), (1, 0), (0, 2)],
    }
    sites = spark.createDataFrame([(k, x, y) for k, v in cases.items() for x, y in v] + [("even", None, 3)], "k string, ref_count int, alt_count int")
    table = haplotypes.depth_table(spark, 25.0, 60.0, 4, 250)
    out = haplotypes.phased_likelihoods(sites, ["k"], table, deepest=250)
    log_l = {(r.k, r.a, r.b): r.log_l for r in out.collect()}
    assert log_l["even", 1, 1] > max(log_l["even", 0, 2], log_l["even", 2, 0])
    assert log_l["lost", 1, 1] < min(log_l["lost", 0, 2], log_l["lost", 2, 0])
    assert log_l["single", 1, 0] > log_l["single", 2, 0] and log_l["single", 1, 0] == log_l["single", 0, 1]
    assert log_l["four", 4, 0] > log_l["four", 3, 1] and log_l["four", 4, 0] == log_l["four", 0, 4]
    assert max(PAIRS, key=lambda g: log_l["none", *g]) == (0, 0)
    assert {r.sites for r in out.filter("k = 'even'").select("sites").collect()} == {6}


def test_lost_haplotypes_are_held_down(spark):
    rows = [("x", a, b, -10.0 - a - b, 2) for a, b in PAIRS] + [("y", a, b, -1.0 if {a, b} == {0, 2} else -10.0 - a - b, 2) for a, b in PAIRS]
    phased = spark.createDataFrame(rows, "k string, a int, b int, log_l double, sites long")
    coverage = spark.createDataFrame([(k, cn, 0.5) for k in "xy" for cn in range(5)], "k string, cn int, p double")
    got = {(r.k, r.a, r.b): r.log_l for r in haplotypes.with_coverage(phased, coverage, ["k"]).collect()}
    assert len(got) == 30 and math.isclose(got["x", 2, 0], -14 / 2 + math.log(0.5)) and math.isclose(got["x", 1, 1], -12 / 2 + math.log(0.5))
    assert math.isclose(got["y", 0, 2], -1 / 2 + math.log(0.5))


def test_trio_equals_brute_force(spark):
    r = random.Random(5)
    people = ("s0", "s1", "s2")
    l = {(k, s): {g: round(r.uniform(-9, 0), 3) for g in PAIRS} for k in range(12) for s in people}
    l[12, "s0"], l[12, "s1"] = ({g: 0.0 if g == (1, 1) else -30.0 for g in PAIRS} for _ in range(2))
    l[12, "s2"] = {g: 0.0 if g == (3, 1) else -30.0 for g in PAIRS}
    frame = spark.createDataFrame([(k, s, *g, v) for (k, s), d in l.items() for g, v in d.items()], "k int, sample string, a int, b int, log_l double")
    out = haplotypes.phased_trio(frame, dict(zip(("mother", "father", "child"), people, strict=True)), ["k"], best=4)
    got = {row.k: row for row in out.collect()}
    assert len(got) == 13 and got[12].child == 4 and got[12].child_mcc == 3 and got[12].dq == 60
    for k in range(13):
        best = [sorted(l[k, s], key=lambda g, d=l[k, s]: (-d[g], g))[:4] for s in people]

        def score(t, k=k):
            m, f, c = t
            shared = set(c) <= {*m, *f}
            return round(sum(l[k, s][g] for s, g in zip(people, t, strict=True)) + (1.0 if shared else 1e-5), 6)

        top = min(itertools.product(*best), key=lambda t: (-score(t), t))
        assert (got[k].mother, got[k].father, got[k].child) == tuple(map(sum, top))
        p = [math.exp(v) for v in l[k, "s2"].values()]
        want = min(60, -10 * math.log10(max(1e-6, 1 - math.exp(l[k, "s2"][top[2]]) / sum(p))))
        assert math.isclose(got[k].q_child, want, abs_tol=1e-6)
    gone = haplotypes.phased_trio(frame.filter("sample != 's1'"), dict(zip(("mother", "father", "child"), people, strict=True)), ["k"])
    assert gone.count() == 0
