"""Sweeps in two levels against plain loops, with stretches short enough to be crossed."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import intervals as iv

SCHEMA = "chrom string, start_pos long, end_pos long, v string"


def rows_of(seed, n=300):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), s, s + r.choice([0, 1, 7, 40, 900]), r.choice(["x", "y", None])) for s in (r.randrange(3000) for _ in range(n))]
    return [*rows, ("c", 5_000_000, 9_000_000, "x"), ("c", 1, 2, "x")]


@pytest.fixture(autouse=True)
def short(monkeypatch):
    for f in (iv.swept, iv.merge_intervals):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 37))


def merged(rows, gap):
    out = {}
    for c, s, e, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        own = out.setdefault(c, [])
        if own and s <= own[-1][1] + gap:
            own[-1] = (own[-1][0], max(own[-1][1], e), own[-1][2] + 1)
        else:
            own.append((s, e, 1))
    return sorted((c or "", *x) for c, own in out.items() for x in own)


@pytest.mark.parametrize("gap", [0, 25])
def test_merged_intervals(spark, gap):
    rows = rows_of(gap)
    got = iv.merge_intervals(spark.createDataFrame(rows, SCHEMA), gap).collect()
    assert sorted((r.chrom or "", r.start_pos, r.end_pos, r.pieces) for r in got) == merged(rows, gap)


def test_equal_neighbours(spark):
    rows = [(c, 10 * i, 10 * i + r.choice([10, 10, 10, 4]), r.choice(["x", "y", None])) for r in [random.Random(5)] for c in "ab" for i in range(200)]
    want, last = [], None
    for c, s, e, v in sorted(rows, key=lambda r: (r[0], r[1])):
        if last and last[0] == c and s <= last[2] and last[3] == v:
            last[2], last[4] = e, last[4] + 1
        else:
            last = [c, s, e, v, 1]
            want.append(last)
    got = iv.merge_equal(spark.createDataFrame(rows, SCHEMA), ["v"]).collect()
    assert sorted((r.chrom, r.start_pos, r.end_pos, r.v or "", r.pieces) for r in got) == sorted((c, s, e, v or "", n) for c, s, e, v, n in want)


def test_breakpoints_and_gaps(spark):
    rows = [(c or "n", s, e, v) for c, s, e, v in rows_of(3, 150) if c != "c"] + [("z", 40, 80, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c in {r[0] for r in rows}:
        own = [(s, e) for k, s, e, _ in rows if k == c and s < e]
        points = sorted({p for x in own for p in x})
        want += [(c, a, b, sum(s <= a and b <= e for s, e in own)) for a, b in zip(points, points[1:], strict=False) if any(s <= a and b <= e for s, e in own)]
    assert sorted(tuple(r) for r in iv.breakpoint_union(df).select("chrom", "start_pos", "end_pos", "depth").collect()) == sorted(want)
    genome = spark.createDataFrame([(c, 10_000) for c in "abnzq"], "chrom string, length long")
    free = iv.complement(df, genome).collect()
    spans = merged(rows, 0)
    for c in "abnzq":
        taken = [(s, e) for k, s, e, _ in spans if k == c] + [(10_000, 10_000)]
        gaps, at = [], 0
        for s, e in taken:
            if at < s:
                gaps.append((at, s))
            at = e
        assert sorted((r.start_pos, r.end_pos) for r in free if r.chrom == c) == gaps


def test_sweeps_of_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert iv.merge_intervals(none).count() == 0 and iv.merge_equal(none, ["v"]).count() == 0
    out = iv.swept(none, ["chrom"], ["start_pos"], sums={"n": F.lit(1)}, before=F.struct("v"), after=F.col("v"))
    assert out.columns == [*none.columns, "n", "__before", "__after"] and out.count() == 0
