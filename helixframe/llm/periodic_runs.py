"""Periodic runs of words: stretches that repeat one piece at least some number of times.

The words of many documents stand in one flat array, and an enhanced suffix array (order, inverse,
LCP) is built over it by prefix doubling. The branching-tandem test then goes through the LCP
intervals: each suffix i of an interval's children, the largest child left out, asks the inverse
array whether i + depth or i - depth lies in the interval too; if the words after the two halves
differ, a square ends there that cannot be rotated to the right. Squares are rotated to the left as
far as they go, which gives runs, and squares of one run are merged. There is no tree: intervals are
pairs of places, found from the nearest smaller LCP values.

A run of exponent e has e suffixes in its interval, so that groups of fewer suffixes are left
unsorted. Words that occur fewer times cost nothing beyond being counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_or_empty

#: Bytes of text whose words go into one suffix array; a longer text has one by itself.
PIECE = 1 << 21
#: Rounds of pointer jumping before the rest is searched by a table of minima, and words that every
#: square is first rotated by.
JUMPS, STEPS = 24, 8
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_array(words: np.ndarray, fewest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, inverse, lcp) of the suffixes whose first word occurs at least ``fewest`` times.

    Words are numbers from 0 on, alike only inside a document; each document has a -1 before and
    behind it. Intervals of at least ``fewest`` suffixes are exact; inside smaller ones the order
    is arbitrary and the lcp may be too small. The inverse is -1 for suffixes left out.
    """
    places = np.flatnonzero(words >= 0)
    often = np.bincount(words[places]) if len(places) else np.zeros(1, np.int64)
    places = places[often[words[places]] >= fewest]
    # a rank is the first slot of a suffix's group; suffixes out of play have ranks of their own
    rank = -2 - np.arange(len(words), dtype=np.int64)
    order = np.zeros(len(places), np.int64)
    slots, keys, levels, h = np.arange(len(places)), words[places].astype(np.int64), [], 1
    while len(slots):
        turn = np.argsort(keys, kind="stable")
        places, keys = places[turn], keys[turn]
        order[slots] = places
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        group = np.repeat(slots[first], sizes)
        large = np.repeat(sizes >= max(fewest, 2), sizes)
        rank = rank.copy()
        rank[places] = np.where(large, group, slots)
        levels.append(rank)
        slots, places, group = slots[large], places[large], group[large]
        keys = group * (2 * len(words) + 2) + rank[places + h] + len(words) + 2
        h *= 2
    inverse = np.full(len(words), -1, np.int64)
    inverse[order] = np.arange(len(order))
    lcp = np.zeros(len(order) + 1, np.int64)
    if len(order) > 1:
        a, b, length = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
        lcp[1:-1] = length
    return order, inverse, lcp


def _nearest(lcp: np.ndarray, at: np.ndarray, step: int, equal: bool) -> np.ndarray:
    """For each place in ``at`` the nearest in direction ``step`` whose lcp is less, or with ``equal`` not greater.

    The lcp is 0 at both ends and greater than 0 in ``at``.
    """
    beyond = (lambda p, v: lcp[p] > v) if equal else (lambda p, v: lcp[p] >= v)
    to = np.arange(len(lcp)) + step
    left = at
    for _ in range(JUMPS):  # what lies between a place and its pointer is never less
        left = left[beyond(to[left], lcp[left])]
        if not len(left):
            break
        to[left] = to[to[left]]
    left = left[beyond(to[left], lcp[left])] if len(left) else left
    if len(left):
        minima = [lcp]
        while 1 << len(minima) <= len(lcp):
            width = 1 << (len(minima) - 1)
            minima.append(np.minimum(minima[-1][:-width], minima[-1][width:]))
        far = to[left]
        for k in range(len(minima) - 1, -1, -1):  # minima[k][p] covers p to p + 2^k - 1
            low = far if step > 0 else far - (1 << k) + 1
            inside = (low >= 0) & (low < len(minima[k]))
            held = minima[k][np.where(inside, low, 0)]
            skip = inside & ((held > lcp[left]) if equal else (held >= lcp[left]))
            far = np.where(skip, far + step * (1 << k), far)
        to[left] = far
    return to[at]


def branching_squares(words: np.ndarray, fewest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of every square that cannot be rotated to the right, in intervals of ``fewest`` suffixes."""
    order, inverse, lcp = suffix_array(words, fewest)
    split = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(split):
        return none, none
    low, high = _nearest(lcp, split, -1, False), _nearest(lcp, split, 1, False)
    large = high - low >= fewest
    split, low, high = split[large], low[large], high[large]
    if not len(split):
        return none, none
    before, after = _nearest(lcp, split, -1, True), _nearest(lcp, split, 1, True)
    last = after == high
    # children of the intervals: what lies before each split, and what lies behind the last one
    child = np.concatenate([before, split[last]])
    size = np.concatenate([split, high[last]]) - child
    low, high = np.concatenate([low, low[last]]), np.concatenate([high, high[last]])
    depth = np.concatenate([lcp[split], lcp[split[last]]])
    turn = np.lexsort((size, high, low))
    low, high, depth, child, size = low[turn], high[turn], depth[turn], child[turn], size[turn]
    largest = np.r_[(low[1:] != low[:-1]) | (high[1:] != high[:-1]), True]
    low, high, depth, child, size = (x[~largest] for x in (low, high, depth, child, size))
    ends = np.cumsum(size)
    which = np.repeat(np.arange(len(size)), size)
    i = order[np.arange(len(which)) + (child - (ends - size))[which]]
    low, high, depth = low[which], high[which], depth[which]

    def squares(start: np.ndarray, partner: np.ndarray) -> np.ndarray:
        inside = (partner >= 0) & (partner < len(words))
        at = np.where(inside, inverse[np.where(inside, partner, 0)], -1)
        found = np.flatnonzero((at >= low) & (at < high))
        differ = words[start[found]] != words[start[found] + 2 * depth[found]]
        found = found[differ]
        return np.column_stack([start[found], depth[found]])

    both = np.concatenate([squares(i, i + depth), squares(i - depth, i - depth)])
    both = np.unique(both, axis=0)
    return both[:, 0], both[:, 1]


def _rotations(words: np.ndarray, start: int, half: int) -> int:
    """How far the square at ``start`` can be rotated to the left."""
    turns, width = 0, 64
    while True:
        low = max(start - turns - width, 0)
        a, b = words[low : start - turns], words[low + half : start - turns + half]
        unlike = np.flatnonzero(a != b)
        if len(unlike):  # always so at the -1 before the document
            return turns + len(a) - 1 - int(unlike[-1])
        turns, width = turns + len(a), 2 * width


def runs_of(words: np.ndarray, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``exponent`` periods and ``shortest`` words, in order.

    ``words`` is a flat array as in :func:`suffix_array`; starts are places in it.
    """
    start, half = branching_squares(words, exponent)
    need = np.maximum(shortest, exponent * half) - 2 * half
    for step in range(1, STEPS + 1):
        asked = need >= step
        stays = ~asked
        stays[asked] = words[start[asked] - step] == words[start[asked] - step + half[asked]]
        start, half, need = start[stays], half[stays], need[stays]
    end = start + 2 * half
    turn = np.lexsort((half, end))
    start, half, end = start[turn], half[turn], end[turn]
    bounds = np.flatnonzero(np.r_[True, end[1:] != end[:-1], True]) if len(end) else []
    found = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        starts, halves, stop = start[a:b], half[a:b], int(end[a])
        while len(halves):
            at, period = int(starts[0]), int(halves[0])
            at -= _rotations(words, at, period)
            if stop - at >= max(shortest, exponent * period):
                found.append((at, stop - at, period))
            other = (halves % period != 0) | (starts < at)  # the others are this run's with longer halves
            other[0] = False
            starts, halves = starts[other], halves[other]
    return sorted(found)


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, list[list[bytes]], np.ndarray]:
    """The flat array of the texts' words, the words themselves, and the place of each text's first."""
    lists = [text.split() for text in texts]
    starts = np.cumsum([1] + [len(x) + 1 for x in lists])
    flat = np.full(int(starts[-1]), -1, np.int64)
    used = 0
    for words, at in zip(lists, starts[:-1].tolist(), strict=True):
        numbers: dict[bytes, int] = {}
        for word in words:
            if word not in numbers:
                numbers[word] = used
                used += 1
        flat[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return flat, lists, starts[:-1]


def _search(texts: list[bytes], exponent: int, shortest: int) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, words that stay) of each text."""
    flat, lists, starts = _words_of(texts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = runs_of(flat, exponent, shortest)
    owners = np.searchsorted(starts, [at for at, _, _ in found], "right") - 1
    for owner, (at, length, period) in zip(owners.tolist(), found, strict=True):
        runs[owner].append((at - int(starts[owner]), length, period))
    for words, own in zip(lists, runs, strict=True):
        if own:
            change = np.zeros(len(words) + 1, np.int64)
            for at, length, period in own:
                change[at + period] += 1
                change[at + length] -= 1
            stays = np.cumsum(change[:-1]) == 0
            yield len(words), own, b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
        else:
            yield len(words), own, b" ".join(words)


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > PIECE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q and
    at least ``exponent`` q and ``shortest`` words that no neighbouring word extends; ``exponent`` is
    2 or more. In ``collapsed`` only the first q words of each run stay, and words are joined by one
    space. A null or empty text has no words, no runs and an empty ``collapsed``. Rows are judged
    apart, so repeated rows and ids give repeated results; an empty table gives an empty result.
    Other columns are not read. A text lies in one task, in memory of some hundred bytes a word.
    """
    if exponent < 2:
        raise ValueError("a run repeats at least twice")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            texts = [x.as_py() for x in batch.column("text").cast(pa.binary())]
            for portion in _portions(texts):
                rows = list(_search(portion, exponent, shortest))
                flat = [run for _, runs, _ in rows for run in runs]
                fields = [pa.array([run[k] for run in flat], pa.int64()) for k in range(3)]
                offsets = np.cumsum([0] + [len(runs) for _, runs, _ in rows])
                listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(done, len(rows)), pa.array([n for n, _, _ in rows], pa.int64()), listed,
                        pa.array([text for _, _, text in rows], pa.binary()).cast(pa.string()),
                    ],
                    [id_col, "n_words", "runs", "collapsed"],
                )
                done += len(rows)
        release_memory()

    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(search, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_words long, runs {RUNS}, collapsed string")
