"""Joint emissions of several samples against every choice of samples, and the joint path."""

import itertools
import math
import random
import statistics

import numpy as np
import pytest

from helixframe.operators import segmentation


def table(seed, bins=30):
    r = random.Random(seed)
    return {(s, i): float(max(0, r.gauss((2, 3, 1, 0, 4)[(i // 6 + j) % 5] * 20, 3))) for j, s in enumerate("abc") for i in range(bins)}


def nb(mean, variance, k):
    size = max(mean, 0.1) ** 2 / (max(variance, 1.2 * mean) - mean)
    log = -size * math.log(1 + mean / size) + k * math.log(mean / (mean + size)) + math.lgamma(size + k) - math.lgamma(k + 1) - math.lgamma(size)
    return max(log, math.log(1e-300))


def brute(counts, all_states):
    samples = sorted({s for s, _ in counts})
    haploid = {s: max(1, statistics.median(v for (t, _), v in counts.items() if t == s)) / 2 for s in samples}
    spread = {s: statistics.variance(v for (t, _), v in counts.items() if t == s) for s in samples}
    cap = 5 * max(haploid.values())
    out = {}
    for i in sorted({i for _, i in counts}):
        if any((s, i) not in counts for s in samples):
            continue
        logs = {s: [nb(max(cn, 0.1) * haploid[s], spread[s], round(min(counts[s, i], cap))) for cn in range(5)] for s in samples}
        own = lambda s, cn: max(logs[s][c] for c in ((cn,) if all_states or cn == 2 else (0, 1) if cn < 2 else (3, 4)))
        out[i] = [
            max(sum(own(s, cn) if taken else logs[s][2] for s, taken in zip(samples, choice, strict=True)) for choice in itertools.product([False, True], repeat=3) if any(choice))
            for cn in range(5)
        ]
    return out


@pytest.mark.parametrize("all_states", [False, True])
def test_joint_emissions_equal_every_choice(spark, all_states):
    counts = table(4)
    del counts["b", 7]  # a bin that one sample lacks is left out
    df = spark.createDataFrame([(s, "chr1", i * 10, i * 10 + 10, v) for (s, i), v in counts.items()], "sample string, chrom string, start_pos long, end_pos long, cnt double")
    got = {r.start_pos // 10: r.logs for r in segmentation.joint_emissions(df, all_states=all_states).collect()}
    want = brute(counts, all_states)
    assert set(got) == set(want) and 7 not in got
    for i, logs in want.items():
        assert got[i] == pytest.approx(logs, abs=1e-8)
    path = [r.state for r in segmentation.segment_joint_hmm(df, all_states=all_states).orderBy("start_pos").collect()]
    assert path == segmentation.viterbi_of_logs(np.array([want[i] for i in sorted(want)])).tolist() and len(set(path)) > 1


def test_short_contigs_are_diploid(spark):
    df = spark.createDataFrame([("a", "chr1", i, i + 1, 50.0) for i in range(10)], "sample string, chrom string, start_pos long, end_pos long, cnt double")
    assert {r.state for r in segmentation.segment_joint_hmm(df).collect()} == {2}
    assert segmentation.segment_joint_hmm(df.filter("false")).count() == 0
