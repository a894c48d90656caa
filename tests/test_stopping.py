"""The stopping boundary of permutation tests, and the exact choice of breakpoints."""

import itertools
import math

import numpy as np
import pytest

from helixframe.operators import segmentation as sg


@pytest.mark.parametrize("stops", [[3, 5, 8], [2, 2, 9], [10, 11, 12], [1, 4, 6]])
def test_crossing_probability_equals_every_order(stops):
    permutations, ones = 12, len(stops)
    met = 0
    for places in itertools.combinations(range(1, permutations + 1), ones):
        met += any(sum(p <= stop for p in places) <= k for k, stop in enumerate(stops))
    assert sg.crossing_probability(np.array(stops), permutations) == pytest.approx(met / math.comb(permutations, ones))


@pytest.mark.parametrize("permutations,ones", [(200, 3), (1000, 11), (10_000, 1), (10_000, 101)])
def test_the_boundary_spends_its_error(permutations, ones):
    stops = sg.stopping_boundary(permutations, ones)
    assert len(stops) == ones and (np.diff(stops) >= 0).all() and stops[-1] <= permutations
    met = sg.crossing_probability(stops, permutations)
    assert met <= 0.0501 and (ones == 1 or met > 0.03)
    assert stops[0] < permutations


def draws(rng, rate):
    return lambda: float(rng.random() < rate)


def test_tests_stop_early_with_the_same_answers():
    alike = early_draws = 0
    for seed in range(60):
        rate = [0.0, 0.001, 0.003, 0.03, 0.2][seed % 5]
        answers, used = [], []
        for early in (False, True):
            rng, count = np.random.default_rng(seed), [0]
            inner = draws(rng, rate)

            def draw(count=count, inner=inner):
                count[0] += 1
                return inner()

            answers.append(sg.exceeds(0.5, draw, 0.01, 2000, early))
            used.append(count[0])
        alike += answers[0] == answers[1]
        early_draws += used[1] < used[0]
        assert used[1] <= used[0]
    assert alike == 60 and early_draws >= 30


def test_segments_are_the_same_with_and_without_stopping():
    for seed in range(8):
        r = np.random.default_rng(seed)
        x = np.concatenate([r.normal(m, 1, n) for m, n in ((0, 40), (1.6, 25), (0, 50), (-1.2, 30))])
        assert sg.cbs_breakpoints(x, seed, permutations=1000) == sg.cbs_breakpoints(x, seed, permutations=1000, early=False), seed


def squared_error(x, points):
    bounds = [0, *points, len(x)]
    return sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in itertools.pairwise(bounds))


@pytest.mark.parametrize("seed", range(12))
def test_prune_finds_the_smallest_and_best_set(seed):
    r = np.random.default_rng(seed)
    x = r.normal(0, 1, 60) + np.repeat(r.integers(0, 4, 6), 10)
    points = sorted(r.choice(np.arange(1, 60), 7, replace=False).tolist())
    got, limit = sg.prune(x, points), 1.05 * squared_error(x, points)
    for size in range(len(points) + 1):
        fits = [(squared_error(x, c), c) for c in itertools.combinations(points, size) if squared_error(x, c) <= limit]
        if fits:
            assert tuple(got) == min(fits)[1]
            break


def test_prune_of_few_points():
    assert sg.prune(np.zeros(5), []) == []
    assert sg.prune(np.zeros(5), [2]) == []
    assert sg.prune(np.array([0.0, 0.0, 9.0, 9.0]), [2]) == [2]
