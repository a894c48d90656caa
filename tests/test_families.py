"""The phased call of families against full enumeration."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import haplotypes

GENOTYPES = [(a, b) for a in range(4) for b in range(4 - a)]


def family(children, segments, seed):
    r = random.Random(seed)
    rows = {}
    for seg in range(segments):
        for who in ("m", "f", *children):
            # some likelihoods tie, some people are sure of themselves and others are not
            rows[seg, who] = {g: round(-r.choice([1, 8]) * r.randrange(9), 6) / 2 for g in GENOTYPES}
    return rows


def phred(p, cap=60.0):
    return min(cap, -10 * math.log10(max(p, 10 ** (-cap / 10)))) + 0.0


def enumerate_all(own, children, best, de_novo, logs, q_limit):
    """Every joint state of each person's best genotypes."""
    kept, new = (math.log(x) if logs else x for x in (1.0, de_novo))
    order = {who: sorted(own[who], key=lambda g: (-own[who][g], g))[:best] for who in own}
    states = {}
    for m, f, *rest in itertools.product(order["m"], order["f"], *[order[c] for c in children]):
        log_l = own["m"][m] + own["f"][f]
        for who, g in zip(children, rest, strict=True):
            log_l += own[who][g] + (kept if all(c in (*m, *f) for c in g) else new)
        states[m, f, *rest] = round(log_l, 6)
    top = max(states.values())
    chosen = min(s for s, v in states.items() if v == top)
    e = {s: math.exp(v - top) for s, v in states.items()}
    q = {}
    for who, g in zip(("m", "f", *children), chosen, strict=True):
        most = max(own[who].values())
        every = {x: math.exp(v - most) for x, v in own[who].items()}
        q[who] = phred(sum(v for x, v in every.items() if sum(x) != sum(g)) / sum(every.values()))
    out = {who: (*g, q[who], None) for who, g in zip(("m", "f", *children), chosen, strict=True)}
    m, f, *rest = chosen
    for i, (who, g) in enumerate(zip(children, rest, strict=True)):
        shared = any(g[0] in x and g[1] in y for x, y in ((m, f), (f, m)))
        if sum(g) == 2 or shared or any(sum(x) != 2 for k, x in enumerate(rest) if k != i) or min(q["m"], q["f"], q[who]) <= q_limit:
            continue
        up = sum(v for s, v in e.items() if sum(s[i + 2]) > 2 and sum(s[0]) <= 2 and sum(s[1]) <= 2)
        down = sum(v for s, v in e.items() if sum(s[i + 2]) < 2 and sum(s[0]) >= 2 and sum(s[1]) >= 2)
        total = sum(e.values())
        left = 1 - up / (total - down) if sum(g) > 2 else 1 - down / (total - up)
        out[who] = (*g, q[who], min(60.0, 2 * min(60.0, -10 * math.log10(max(left, 1e-6)))))
    return out


@pytest.mark.parametrize("children,best,logs", [(["c"], None, False), (["c", "d"], None, True), (["c", "d"], 5, False), (["c", "d", "e"], None, True)])
def test_family_equals_full_enumeration(spark, children, best, logs):
    rows = family(children, 60, 11)
    df = spark.createDataFrame([(seg, who, a, b, float(v)) for (seg, who), own in rows.items() for (a, b), v in own.items()], "seg int, sample string, a int, b int, log_l double")
    out = haplotypes.phased_family(df, "m", "f", children, ["seg"], best=best, logs=logs, q_limit=0.3).collect()
    assert len(out) == 60 * (2 + len(children))
    tried = best or (3 if len(children) > 1 else 5)
    fresh, visited = 0, []
    for seg in range(60):
        want = enumerate_all({who: own for (s, who), own in rows.items() if s == seg}, children, tried, 1e-5, logs, 0.3)
        for r in (r for r in out if r.seg == seg):
            a, b, q, dq = want[r.sample]
            assert (r.a, r.b, r.cn, r.mcc) == (a, b, a + b, max(a, b)), (seg, r.sample)
            assert r.q == pytest.approx(q, abs=1e-6)
            assert (r.dq is None) == (dq is None) and (dq is None or r.dq == pytest.approx(dq, abs=1e-5))
            fresh += dq is not None
            visited.append(r.visited)
    assert fresh and max(visited) <= tried**2 and min(visited) < tried**2


def test_a_missing_person_leaves_the_key_out(spark):
    df = spark.createDataFrame([(1, "m", 1, 1, 0.0), (1, "f", 1, 1, 0.0)], "seg int, sample string, a int, b int, log_l double")
    assert haplotypes.phased_family(df, "m", "f", ["c"], ["seg"]).count() == 0


def test_shared_haplotypes(spark):
    df = spark.createDataFrame([((1, 2), (1, 1), (2, 0)), ((2, 1), (1, 1), (2, 0)), ((1, 1), (1, 0), (2, 2)), ((0, 2), (0, 2), (0, 2))], "c struct<a: int, b: int>, m struct<a: int, b: int>, f struct<a: int, b: int>")
    assert [r.s for r in df.select(haplotypes.shared_phased(F.col("c"), F.col("m"), F.col("f")).alias("s")).collect()] == [True, True, False, True]
