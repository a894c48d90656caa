"""Segmentation of bin counts: Haar wavelets, circular binary segmentation, and hidden Markov models.

Each method is a recurrence over the ordered bins of one sample's contig, so it runs as a grouped
function keyed by (sample, chrom); statistics that go over contigs are computed before by aggregates.
All take bins (sample, chrom, start_pos, end_pos, cnt) and return the bins that start a segment.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["sample", "chrom"]
STARTS = "sample string, chrom string, start_pos long"


def _starts(bins: DataFrame, find: Callable[[np.ndarray, str], list[int]]) -> DataFrame:
    """Apply a function from values to breakpoint numbers to each sample's contig."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start_pos")
        name = f"{rows['sample'].iloc[0]}/{rows['chrom'].iloc[0]}"
        values = rows["cnt"].to_numpy(float)
        finite = np.flatnonzero(np.isfinite(values))
        at = [0, *find(values[finite], name)] if len(finite) else [0]
        places = sorted({0} | {int(finite[k]) for k in at if k}) if len(finite) else [0]
        return rows.iloc[places][["sample", "chrom", "start_pos"]]

    return bins.select(*KEYS, "start_pos", "cnt").groupBy(*KEYS).applyInPandas(one, STARTS)


# ---------------------------------------------------------------- wavelets


def haar_split(prefix: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """Best place p in (a, b) and its coefficient of the unbalanced Haar vector on [a, b).

    The vector is positive on [a, p) and negative on [p, b), orthogonal to constants, of norm 1.
    """
    n = b - a
    p = np.arange(a + 1, b)
    left, right = p - a, b - p
    s1, s2 = prefix[p] - prefix[a], prefix[b] - prefix[p]
    inner = np.sqrt(right / (n * left)) * s1 - np.sqrt(left / (n * right)) * s2
    k = int(np.argmax(np.abs(inner)))
    return int(p[k]), float(inner[k])


def haar_breakpoints(x: np.ndarray, sigma: float, scale: float = 1.0) -> list[int]:
    """Places where the thresholded unbalanced Haar reconstruction changes.

    Top-down: every node takes its best split; coefficients within scale * sigma * sqrt(2 ln n) are
    set to zero, and what is left is summed up from the root.
    """
    n = len(x)
    if n < 2:
        return []
    prefix = np.concatenate([[0.0], np.cumsum(x)])
    limit = scale * sigma * math.sqrt(2 * math.log(n))
    level = np.full(n, prefix[-1] / n)
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, c = haar_split(prefix, a, b)
        if abs(c) > limit:
            left, right, size = p - a, b - p, b - a
            level[a:p] += c * math.sqrt(right / (size * left))
            level[p:b] -= c * math.sqrt(left / (size * right))
        stack += [(a, p), (p, b)]
    return (np.flatnonzero(np.abs(np.diff(level)) > 1e-9 * max(1.0, np.abs(x).max())) + 1).tolist()


def heal(x: np.ndarray, points: list[int], spread: float, floor: float = 50.0) -> list[int]:
    """Greedily, left to right, drop breakpoints whose sides' medians differ by no more than
    4 * spread * max(weighted median, floor)."""
    kept: list[int] = []
    ends = [*points[1:], len(x)]
    for k, p in enumerate(points):
        a = kept[-1] if kept else 0
        left, right = x[a:p], x[p : ends[k]]
        m1, m2 = float(np.median(left)), float(np.median(right))
        typical = (m1 * len(left) + m2 * len(right)) / (len(left) + len(right))
        if abs(m1 - m2) > 4 * spread * max(typical, floor):
            kept.append(p)
    return kept


def refine(x: np.ndarray, points: list[int], reach: int = 5) -> list[int]:
    """Move each breakpoint within ``reach`` bins to where the two sides' squared errors are least."""
    bounds = [0, *points, len(x)]
    out = []
    for k in range(1, len(bounds) - 1):
        a, b = (out[-1] if out else 0), bounds[k + 1]
        options = range(max(a + 1, bounds[k] - reach), min(b, bounds[k] + reach + 1))

        def error(p: int, a: int = a, b: int = b) -> float:
            return float(((x[a:p] - x[a:p].mean()) ** 2).sum() + ((x[p:b] - x[p:b].mean()) ** 2).sum())

        out.append(min(options, key=error) if len(options) else bounds[k])
    return out


def segment_haar(bins: DataFrame, factor: float = 1.0, lowest: float = 5.0, highest: float = 80.0, germline: bool = False, healing: float | None = None) -> DataFrame:
    """Wavelet segmentation; sigma is factor * 1.4826 * MAD of first differences / sqrt(2), clamped."""

    def find(x: np.ndarray, _: str) -> list[int]:
        if len(x) <= 10:
            return []
        d = np.diff(x)
        sigma = factor * 1.4826 * float(np.median(np.abs(d - np.median(d)))) / math.sqrt(2)
        sigma = min(highest, max(lowest, sigma)) if lowest is not None else sigma
        points = haar_breakpoints(x, sigma)
        if healing is not None:
            points = heal(x, points, healing)
        return refine(x, points) if germline else points

    return _starts(bins, find)


# ---------------------------------------------------------------- circular binary segmentation


#: Values up to which every arc is tried, blocks of sums at the end and at the start of the search, and pairs at a time.
ALL_ARCS, LEAF, FIRST, AT_ONCE = 1000, 32, 512, 1 << 15


def _arcs_by_length(s: np.ndarray, least: int) -> tuple[float, int, int]:
    """(statistic, i, j) of the arc of greatest statistic from running sums; of equal ones the shortest, then the first."""
    n = len(s) - 1
    best, where = 0.0, (0, n)
    for k in range(least, n - least + 1):
        d = s[k:] - s[: n - k + 1]
        b = d * d * n / (k * (n - k))
        at = int(np.argmax(b))
        if b[at] > best:
            best, where = float(b[at]), (at, at + k)
    return best, *where


def _arcs_by_blocks(s: np.ndarray, least: int) -> tuple[float, int, int]:
    """As :func:`_arcs_by_length`, by branch and bound over pairs of blocks of running sums.

    The greatest difference of two blocks' sums and the lengths of arcs between them bound the statistic. Pairs
    whose bound is under a statistic that has been met are left out, others are parted; pairs of the
    smallest blocks are tried in full. Nothing is left out that could be the answer.
    """
    n = len(s) - 1
    sizes = [LEAF]
    while n // sizes[-1] > FIRST:
        sizes.append(sizes[-1] * 4)
    met = 0.0

    def statistic(d: np.ndarray, k: np.ndarray) -> np.ndarray:
        return d * d * n / (k * (n - k))

    def ends(size: int):
        """Of each block the places of the least and the greatest sum."""
        count = -(-(n + 1) // size)
        padded = np.concatenate([s, np.full(count * size - n - 1, s[-1])]).reshape(count, size)
        starts = np.arange(count) * size
        return np.minimum(padded.argmin(axis=1) + starts, n), np.minimum(padded.argmax(axis=1) + starts, n)

    def bounded(p: np.ndarray, q: np.ndarray, size: int, low: np.ndarray, high: np.ndarray):
        """The pairs that may hold the answer, with their bounds."""
        nonlocal met
        shortest = np.maximum((q - p - 1) * size + 1, least)
        longest = np.minimum(np.minimum((q + 1) * size - 1, n) - p * size, n - least)
        can = shortest <= longest
        p, q, shortest, longest = p[can], q[can], shortest[can], longest[can]
        most = np.zeros(len(p))
        for i, j in ((low[p], high[q]), (high[p], low[q])):
            d, k = np.abs(s[j] - s[i]), j - i
            most = np.maximum(most, d)
            real = (k >= least) & (k <= n - least)
            if real.any():
                met = max(met, float(statistic(d[real], k[real]).max()))
        bound = most * most * n / np.minimum(shortest * (n - shortest), longest * (n - longest)) * (1 + 1e-9)
        return p, q, bound

    low, high = ends(sizes[-1])
    first = [bounded(np.full(len(low) - p, p), np.arange(p, len(low)), sizes[-1], low, high) for p in range(len(low))]
    p, q, bound = (np.concatenate([f[i] for f in first]) for i in range(3))
    for size in reversed(sizes[:-1]):
        low, high = ends(size)
        kept = bound >= met
        p, q, parts = p[kept], q[kept], []
        step = np.arange(4)
        for at in range(0, len(p), AT_ONCE // 16):
            a, b = p[at : at + AT_ONCE // 16, None, None], q[at : at + AT_ONCE // 16, None, None]
            a, b = (x.ravel() for x in np.broadcast_arrays(4 * a + step[:, None], 4 * b + step))
            fine = (a <= b) & (b < len(low))
            a, b, own = bounded(a[fine], b[fine], size, low, high)
            good = own >= met
            parts.append((a[good], b[good], own[good]))
        p, q, bound = (np.concatenate([x[i] for x in parts]) for i in range(3))
    best, length, where = 0.0, n, 0
    inner = np.arange(LEAF)
    order = np.argsort(-bound, kind="stable")
    for at in range(0, len(order), AT_ONCE // LEAF):
        pairs = order[at : at + AT_ONCE // LEAF]
        pairs = pairs[bound[pairs] >= max(met, best)]
        if not len(pairs):
            break
        i, j = (p[pairs, None] * LEAF + inner)[:, :, None], (q[pairs, None] * LEAF + inner)[:, None, :]
        k = j - i
        real = (k >= least) & (k <= n - least) & (j <= n)
        d = s[np.minimum(j, n)] - s[np.minimum(i, n)]
        b = np.where(real, statistic(d, np.where(real, k, 1)), -1.0)
        top = float(b.max())
        if top > 0 and top >= best:
            pair, row, column = np.nonzero(b == top)
            found = min(zip(k[pair, row, column].tolist(), i[pair, row, 0].tolist(), strict=True))
            if top > best or found < (length, where):
                best, (length, where) = top, found
    return best, where, where + length


def max_arc(x: np.ndarray, least: int = 2) -> tuple[float, int, int]:
    """(T squared, i, j) of the arc (i, j] whose mean differs most from the rest."""
    n = len(x)
    s = np.concatenate([[0.0], np.cumsum(x - x.mean())])
    best, *where = (_arcs_by_blocks if n > ALL_ARCS else _arcs_by_length)(s, least)
    total = float(((x - x.mean()) ** 2).sum())
    rest = total - best if total > best + 1e-4 else 1.0
    return best / (rest / (n - 2)), *where


def nu(x: float) -> float:
    """Siegmund's correction for the overshoot of a random walk."""
    if x <= 0.01:
        return math.exp(-0.583 * x)
    total, k = math.log(2) - 2 * math.log(x), 0
    while True:
        k += 1
        step = 2 * 0.5 * math.erfc(x * math.sqrt(k) / 2 / math.sqrt(2)) / k
        total -= step
        if step < 1e-10 or k > 5000:
            return math.exp(total)


def tail_probability(b: float, delta: float, m: int, steps: int = 100) -> float:
    """Approximate probability that the largest statistic over arcs longer than delta*m exceeds b."""
    grid = np.linspace(0.5, 1 - delta, steps + 1)
    def primitive(t: float) -> float:
        y = t - 0.5
        return 8 * y / (1 - 4 * y * y) + 2 * math.log((1 + 2 * y) / (1 - 2 * y))
    total = 0.0
    for t0, t1 in zip(grid[:-1], grid[1:], strict=True):
        t = (t0 + t1) / 2
        total += nu(b / math.sqrt(m * t * (1 - t))) ** 2 * (primitive(t1) - primitive(t0))
    density = math.exp(-b * b / 2) / math.sqrt(2 * math.pi)
    return min(1.0, b**3 * density * total / 2)  # the grid covers half of the range, by symmetry


#: Fixed values of the method: a statistic under which nothing is split, one over which a split needs no
#: test where both parts are of the given length, the length over which short arcs are permuted and long
#: ones bounded by their tail, and how long such arcs are.
NO_SPLIT, CLEAR_SPLIT, CLEAR_LENGTH, LONG, SHORT_ARC = 0.1, 7.0, 10, 200, 25
#: Fixed value: two sides of an edge whose means differ by so many standard errors need no test.
CLEAR_EDGE = 5.0
#: Fixed value: how often a permutation test may stop early against what all permutations would say.
EARLY_ERROR = 0.05


def _stops(eta: float, permutations: int, ones: int) -> np.ndarray:
    """When a test may stop with k exceedances, k under ``ones``: the first permutation at which so few have a chance of ``eta`` at most.

    With ``ones`` exceedances among all permutations in random order, those among the first i are hypergeometric.
    """
    at = np.full(ones, permutations, np.int64)
    lg = _log_factorials(permutations)
    for k in range(ones):
        low, high = (at[k - 1] if k else k), permutations
        while high - low > 1:  # the chance of at most k falls with i
            i = (low + high) // 2
            c = np.arange(max(0, ones - (permutations - i)), min(k, i, ones) + 1)
            p = np.exp(_log_choose(lg, ones, c) + _log_choose(lg, permutations - ones, i - c) - _log_choose(lg, permutations, i)).sum() if len(c) else 0.0
            low, high = (low, i) if p <= eta else (i, high)
        at[k] = high
    return at


@lru_cache(maxsize=4)
def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def _log_choose(lg: np.ndarray, n, k):
    n, k = np.broadcast_arrays(n, k)
    inside = (k >= 0) & (k <= n)
    k = np.where(inside, k, 0)
    return np.where(inside, lg[n] - lg[k] - lg[n - k], -np.inf)


def crossing_probability(stops: np.ndarray, permutations: int) -> float:
    """The chance that ``len(stops)`` exceedances in random order among the permutations meet a stop.

    Ways are followed from stop to stop: those with no more exceedances than the stop's number are taken
    out, the others go on by hypergeometric steps.
    """
    ones, lg = len(stops), _log_factorials(permutations)
    alive = np.zeros(ones + 1)  # by exceedances so far
    alive[0], before, crossed = 1.0, 0, 0.0
    counts = np.arange(ones + 1)
    for k, stop in enumerate(stops.tolist()):
        drawn, left = stop - before, permutations - before
        if drawn:
            rest = ones - counts  # exceedances still to come, by those so far
            more = counts[None, :] - counts[:, None]
            logs = _log_choose(lg, rest[:, None], more) + _log_choose(lg, left - rest[:, None], drawn - more) - lg[left] + lg[drawn] + lg[left - drawn]
            alive = alive @ np.exp(logs)
            before = stop
        crossed += alive[: k + 1].sum()
        alive[: k + 1] = 0.0
    return float(crossed)


@lru_cache(maxsize=512)
def stopping_boundary(permutations: int, ones: int, eta: float = EARLY_ERROR, tolerance: float = 0.01) -> np.ndarray:
    """Stops of a test that allows ``ones`` - 1 exceedances, so that ``ones`` of them would be overlooked with a chance of ``eta``.

    The level of the single stops is found by a secant search on the chance to cross any of them.
    """
    low, high = eta / (4 * ones), eta
    p_low, p_high = (crossing_probability(_stops(x, permutations, ones), permutations) for x in (low, high))
    while p_low > eta:
        low, p_low = low / 4, crossing_probability(_stops(low / 4, permutations, ones), permutations)
    for _ in range(60):
        if p_high <= eta or (high - low) / low <= tolerance:
            break
        guess = low + (high - low) * min(max((eta - p_low) / (p_high - p_low), 0.05), 0.95)
        p = crossing_probability(_stops(guess, permutations, ones), permutations)
        low, p_low, high, p_high = (low, p_low, guess, p) if p > eta else (guess, p, high, p_high)
    return _stops(high if p_high <= eta else low, permutations, ones)


def exceeds(observed: float, draw: Callable[[], float], level: float, permutations: int, early: bool = True) -> bool:
    """Whether more than ``level`` of the permutations reach ``observed``; with ``early`` it ends as soon as that is settled.

    A test that allows no further exceedance ends at once, and one whose exceedances are so few so
    late that the rest is unlikely to change the answer ends at its stopping boundary.
    """
    most = int(level * permutations)
    stops = stopping_boundary(permutations, most + 1) if early else None
    over = 0
    for k in range(1, permutations + 1):
        over += draw() >= observed
        if over > most:
            return True
        if stops is not None and k >= stops[over]:
            return False
    return False


def _largest_short_arc(y: np.ndarray) -> float:
    """T squared of the best arc of at most SHORT_ARC values."""
    n = len(y)
    s = np.concatenate([[0.0], np.cumsum(y - y.mean())])
    most, step = [0.0] * (SHORT_ARC + 1), 1 << 14
    for low in range(0, n + 1, step):  # stretches that stay in the processor's cache
        near = s[low : low + step + SHORT_ARC]
        for k in range(2, SHORT_ARC + 1):
            size = min(step, len(near) - k)
            if size > 0:
                d = near[k : k + size] - near[:size]
                most[k] = max(most[k], float(d.max()), -float(d.min()))
    value = max(most[k] * most[k] * n / (k * (n - k)) for k in range(2, SHORT_ARC + 1))
    total = float(((y - y.mean()) ** 2).sum())
    return value / ((total - value) / (n - 2)) if total > value + 1e-4 else value


def split_circular(x: np.ndarray, rng: np.random.Generator, alpha: float, permutations: int, early: bool = True) -> list[int]:
    """Significant change points inside ``x``: none, one or two.

    The arc that differs most from the rest is accepted when its statistic is clear, or when it beats
    the permutations at level ``alpha``. For long inputs the level is shared: long arcs take the tail
    probability of the limit process, short arcs the remainder by permutation. An accepted arc that
    lies inside gives two edges, each of which must hold against its own neighbours.
    """
    n = len(x)
    if n < 4 or np.ptp(x) == 0:
        return []
    squared, i, j = max_arc(x)
    statistic, inside = math.sqrt(squared), j - i
    if statistic <= NO_SPLIT:
        return []
    if statistic < CLEAR_SPLIT or min(inside, n - inside) < CLEAR_LENGTH:
        tail = tail_probability(statistic, (SHORT_ARC + 1) / n, n) if n > LONG else 0.0
        if tail > alpha:
            return []
        largest = _largest_short_arc if n > LONG else lambda y: max_arc(y)[0]
        if exceeds(squared, lambda: largest(rng.permutation(x)), alpha - tail, permutations, early):
            return []
    edges = [e for e in (i, j) if 0 < e < n]
    if len(edges) == 1:
        return edges
    bounds = [0, *edges, n]
    return [edge for before, edge, after in zip(bounds, edges, bounds[2:], strict=False) if _edge_holds(x[before:edge], x[edge:after], rng, alpha, permutations, early)]


def _edge_holds(left: np.ndarray, right: np.ndarray, rng: np.random.Generator, alpha: float, permutations: int, early: bool) -> bool:
    """Whether the means of an edge's two sides differ, by a permutation test unless it is clear."""
    shorter = min(len(left), len(right))
    if shorter == 1:
        return False
    both = np.concatenate([left, right])
    gap = abs(left.mean() - right.mean())
    error = math.sqrt(both.var() * (1 / len(left) + 1 / len(right)))
    if shorter >= CLEAR_LENGTH and error > 0 and gap > CLEAR_EDGE * error:
        return True

    def draw() -> float:
        y = rng.permutation(both)
        return abs(y[: len(left)].mean() - y[len(left) :].mean())

    return not exceeds(gap, draw, alpha, permutations, early)


def cbs_breakpoints(x: np.ndarray, seed: int, alpha: float = 0.01, permutations: int = 10_000, early: bool = True) -> list[int]:
    """Recursive circular binary segmentation; the rightmost open segment goes first."""
    rng = np.random.default_rng(seed)
    found: list[int] = []
    stack = [(0, len(x))]
    while stack:
        a, b = stack.pop()
        points = [a + p for p in split_circular(x[a:b], rng, alpha, permutations, early)]
        if points:
            found += points
            bounds = [a, *points, b]
            stack += list(zip(bounds[:-1], bounds[1:], strict=True))
    return sorted(found)


def undo_by_deviation(x: np.ndarray, points: list[int], deviations: float = 3.0) -> list[int]:
    """Drop, closest first, breakpoints whose sides' medians differ by less than so many deviations."""
    d = np.diff(x)
    sd = 1.4826 * float(np.median(np.abs(d - np.median(d)))) / math.sqrt(2) if len(d) else 0.0
    points = list(points)
    while points:
        bounds = [0, *points, len(x)]
        medians = [float(np.median(x[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        gaps = np.abs(np.diff(medians))
        k = int(np.argmin(gaps))
        if gaps[k] >= deviations * sd:
            break
        del points[k]
    return points


def prune(x: np.ndarray, points: list[int], share: float = 0.05) -> list[int]:
    """The smallest set of breakpoints whose squared error is within ``share`` of the full set's; of equal sizes the best one.

    The least error of every number of pieces comes from that of one piece fewer: the last piece is
    tried from each breakpoint, with errors from prefix sums. Time grows with the cube of the
    breakpoints, memory with their square.
    """
    bounds = np.array([0, *points, len(x)])
    pieces = len(bounds) - 1
    if pieces < 2:
        return list(points)
    centred = x - x.mean()
    s, q = (np.concatenate([[0.0], np.cumsum(v)])[bounds] for v in (centred, centred * centred))
    size = np.maximum(bounds[None, :] - bounds[:, None], 1)
    cost = np.where(np.triu(np.ones((pieces + 1, pieces + 1), bool), 1), (q[None, :] - q[:, None]) - (s[None, :] - s[:, None]) ** 2 / size, np.inf)
    limit = (1 + share) * float(np.maximum(np.diagonal(cost, 1), 0).sum()) + 1e-9 * float(q[-1])
    least, back = cost[0].copy(), []
    while least[pieces] > limit:
        ways = least[:, None] + cost
        back.append(ways.argmin(axis=0))
        least = ways.min(axis=0)
    kept, at = [], pieces
    for step in reversed(back):
        at = int(step[at])
        kept.append(int(bounds[at]))
    return sorted(kept)


def segment_cbs(bins: DataFrame, alpha: float = 0.01, permutations: int = 10_000, undo: str = "none", seed: int = 0) -> DataFrame:
    """Circular binary segmentation. A contig's seed comes from its name, so that results do not
    depend on partitions. ``undo`` is none, prune or sd. Permutation tests stop early at their boundary."""

    def find(x: np.ndarray, name: str) -> list[int]:
        points = cbs_breakpoints(x, zlib.crc32(name.encode()) ^ seed, alpha, permutations)
        return prune(x, points) if undo == "prune" else undo_by_deviation(x, points) if undo == "sd" else points

    return _starts(bins, find)


# ---------------------------------------------------------------- hidden Markov model


def negative_binomial(mean: float, variance: float, size: int, clumping: float = 2.0) -> np.ndarray:
    """Probabilities of 0..size-1 for a mean and variance; the clumping parameter is floored."""
    r = max(mean * mean / max(variance - mean, 1e-9), clumping) if variance > mean else 1e6
    p = r / (r + mean)
    k = np.arange(size)
    lg = np.array([math.lgamma(v + r) - math.lgamma(v + 1) for v in k]) - math.lgamma(r)
    out = np.exp(lg + r * math.log(p) + k * math.log1p(-p)) if mean > 0 else (k == 0).astype(float)
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def viterbi(emission: np.ndarray, stay: float = 0.99) -> np.ndarray:
    """Most probable states for emission probabilities (bins x states) with a uniform start."""
    return viterbi_of_logs(np.log(np.maximum(emission, 1e-300)), stay)


def viterbi_of_logs(logs: np.ndarray, stay: float = 0.99) -> np.ndarray:
    """Most probable states for log emissions; of equally good ways the one from the lowest state."""
    n, states = logs.shape
    move = np.full((states, states), math.log((1 - stay) / (states - 1)))
    np.fill_diagonal(move, math.log(stay))
    best, back = logs[0] - math.log(states), np.zeros((n, states), np.int64)
    for t in range(1, n):
        ways = best[:, None] + move
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + logs[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def emission_tables(haploid: float, variance: float, states: int = 5) -> np.ndarray:
    """Probability of each count up to five haploid means in every copy-number state."""
    size = max(2, int(round(5 * haploid)) + 1)
    return np.array([negative_binomial(max(cn, 0.1) * haploid, variance, size) for cn in range(states)])


def _profile(bins: DataFrame) -> DataFrame:
    """Haploid mean (half the median) and variance (squared interquartile range) of each sample."""
    stats = bins.groupBy("sample").agg(F.median("cnt").alias("m"), F.percentile("cnt", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return stats.select("sample", (F.col("m") / 2).alias("haploid"), F.pow(F.col("q")[1] - F.col("q")[0], 2).alias("variance"))


def segment_hmm(bins: DataFrame, stay: float = 0.99, states: int = 5, few: int = 10) -> DataFrame:
    """One hidden Markov model for each sample and contig: bins with their state ``cn``."""
    joined = bins.select(*KEYS, "start_pos", "end_pos", "cnt").join(F.broadcast(_profile(bins)), "sample")  # a row for each sample

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start_pos")
        if len(rows) <= few:
            rows["cn"] = 2
        else:
            tables = emission_tables(rows["haploid"].iloc[0], rows["variance"].iloc[0], states)
            at = np.clip(np.rint(rows["cnt"].to_numpy(float)), 0, tables.shape[1] - 1).astype(int)
            rows["cn"] = viterbi(tables[:, at].T, stay)
        return rows[["sample", "chrom", "start_pos", "end_pos", "cnt", "cn"]]

    return joined.groupBy(*KEYS).applyInPandas(one, "sample string, chrom string, start_pos long, end_pos long, cnt double, cn long")


def count_logs(mean: np.ndarray, variance: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Log negative binomial probabilities, the variance at least 1.2 times the mean, none under 1e-300."""
    gamma = np.frompyfunc(math.lgamma, 1, 1)
    r = np.maximum(mean, 0.1) ** 2 / (np.maximum(variance, 1.2 * mean) - mean)
    logs = -r * np.log1p(mean / r) + count * np.log(mean / (mean + r)) + (gamma(r + count) - gamma(count + 1) - gamma(r)).astype(float)
    return np.maximum(logs, math.log(1e-300))


def joint_emissions(bins: DataFrame, states: int = 5, all_states: bool = False) -> DataFrame:
    """(chrom, start_pos, end_pos, logs): a joint log emission of each state for bins that all samples of a contig have.

    In state k every sample is in k or diploid, at least one of them in k, whichever is likeliest.
    Samples choose apart, so the best choice is the sum of the greater of both, less the least loss of
    a sample that would rather be diploid where all would: a grouped sum and a grouped minimum, with
    no list of choices. Without ``all_states`` states 0 and 1 count as one, and so do 3 and 4: each
    takes the likelier. Means and variances are those of a sample on the contig; counts are capped at
    ``states`` times the greatest haploid mean and rounded half to even.
    """
    rows = bins.select("chrom", "sample", "start_pos", "end_pos", "cnt")
    profile = rows.groupBy("chrom", "sample").agg((F.greatest(F.lit(1.0), F.median("cnt")) / 2).alias("haploid"), F.coalesce(F.var_samp("cnt"), F.lit(0.0)).alias("variance"))
    caps = profile.groupBy("chrom").agg((F.max("haploid") * states).alias("cap"), F.count(F.lit(1)).alias("samples"))
    known = rows.join(profile.join(caps, "chrom"), ["chrom", "sample"])
    known = known.withColumn("k", F.bround(F.least("cnt", "cap"), 0).cast("long"))

    @F.pandas_udf("array<double>")
    def logs(haploid: pd.Series, variance: pd.Series, k: pd.Series) -> pd.Series:
        h, v, n = (x.to_numpy(float) for x in (haploid, variance, k))
        each = np.column_stack([count_logs(max(cn, 0.1) * h, v, n) for cn in range(states)])
        return pd.Series(list(each))

    # each count of a sample on a contig is valued once
    counts = known.select("chrom", "sample", "k", "haploid", "variance").distinct().select("chrom", "sample", "k", logs("haploid", "variance", "k").alias("l"))
    valued = known.select("chrom", "sample", "start_pos", "end_pos", "k", "samples").join(counts, ["chrom", "sample", "k"])

    def own(cn: int) -> Column:
        like = (0, 1) if cn in (0, 1) else (3, 4) if cn in (3, 4) else (cn,)
        return F.get("l", F.lit(cn)) if all_states or len(like) == 1 else F.greatest(*[F.get("l", F.lit(c)) for c in like if c < states])

    two = F.get("l", F.lit(2))
    sums = [F.sum(two if cn == 2 else F.greatest(own(cn), two)).alias(f"s{cn}") for cn in range(states)]
    losses = [F.min(F.greatest(two - own(cn), F.lit(0.0))).alias(f"d{cn}") for cn in range(states) if cn != 2]
    joint = valued.groupBy("chrom", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("n"), F.first("samples").alias("samples"), *sums, *losses)
    emissions = F.array(*[F.col(f"s{cn}") if cn == 2 else F.col(f"s{cn}") - F.col(f"d{cn}") for cn in range(states)])
    return joint.filter("n = samples").select("chrom", "start_pos", "end_pos", emissions.alias("logs"))


def segment_joint_hmm(bins: DataFrame, stay: float = 0.99, states: int = 5, few: int = 10, all_states: bool = False) -> DataFrame:
    """One model for all samples of a contig: bins (chrom, start_pos, end_pos, state).

    Emissions are those of :func:`joint_emissions`. As some sample is in the state itself, a step
    costs what leads from the state before to it, from the diploid state too. A task holds the
    emissions of one contig, whatever the number of samples. Contigs of up to ``few`` bins are diploid.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start_pos")
        rows["state"] = 2 if len(rows) <= few else viterbi_of_logs(np.stack(rows["logs"].to_numpy()), stay)
        return rows[["chrom", "start_pos", "end_pos", "state"]]

    return joint_emissions(bins, states, all_states).groupBy("chrom").applyInPandas(one, "chrom string, start_pos long, end_pos long, state long")


def state_segments(rows: DataFrame, state: str, by: tuple[str, ...] = ("sample", "chrom")) -> DataFrame:
    """Runs of neighbouring bins of one state as segments."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("start_pos")
    marked = rows.withColumn("__new", (~F.lag(state).over(w).eqNullSafe(F.col(state))).cast("int")).withColumn("__i", F.sum("__new").over(w))
    return marked.groupBy(*by, "__i", state).agg(
        F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count(F.lit(1)).alias("bins")
    ).drop("__i")


# ---------------------------------------------------------------- variability of coverage


def evenness(bins: DataFrame, width: int = 1000) -> DataFrame:
    """Per sample: median over windows of the area under min(cnt, mean) relative to the mean, in percent."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("start_pos")
    rows = bins.withColumn("win", F.floor((F.row_number().over(w) - 1) / width))
    means = rows.groupBy(*KEYS, "win").agg(F.avg("cnt").alias("m")).filter("m > 0")
    score = rows.join(means, [*KEYS, "win"]).groupBy(*KEYS, "win").agg((F.sum(F.least("cnt", "m")) / F.sum("m")).alias("e"))
    return score.groupBy("sample").agg((100 * F.median("e")).alias("evenness"))


def triplet_variability(bins: DataFrame, levels: int = 8, fewest: int = 50) -> DataFrame:
    """Per sample and level k: median absolute deviation over median after k rounds of triplet medians.

    Each round replaces three neighbouring bins by their median; below ``fewest`` values the level
    before is the last one.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("start_pos")
    now = bins.select(*KEYS, (F.row_number().over(w) - 1).alias("i"), "cnt")
    out = None
    for level in range(levels):
        mid = now.groupBy("sample").agg(F.median("cnt").alias("m"), F.count(F.lit(1)).alias("n"))
        dev = now.join(F.broadcast(mid), "sample").filter(F.col("n") >= fewest).groupBy("sample").agg(
            (F.median(F.abs(F.col("cnt") - F.col("m"))) / F.first("m")).alias("variability")
        ).withColumn("level", F.lit(level))
        out = dev if out is None else out.unionByName(dev)
        now = now.groupBy(*KEYS, F.floor(F.col("i") / 3).alias("i")).agg(F.median("cnt").alias("cnt"))
    return out
