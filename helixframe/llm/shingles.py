"""Sets of word shingles and their MinHash values, in numpy over many texts at once.

Words part at ASCII white space. A shingle is five words in a row; a text of one to four words has one
shingle, all its words; a text without words has none. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

WORDS = 5
#: Bytes of text hashed at a time, so far as whole texts allow.
CHUNK = 1 << 20
#: Bytes whose sums are made at a time.
STRETCH = 1 << 18

_SEEDS = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _SEEDS.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(factor: int) -> np.ndarray:
    """Powers of ``factor`` from 0 to 4095."""
    out = np.full(4096, np.uint64(factor))
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(factor: int, at: np.ndarray) -> np.ndarray:
    """Powers of ``factor`` at ascending places, by tables for every 12 bits."""
    out = _powers(factor)[at & 4095]
    shift = 12
    while len(at) and at[-1] >> shift:
        factor = pow(factor, 4096, 1 << 64)
        out *= _powers(factor)[at >> shift & 4095]
        shift += 12
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text), in order.

    A word's hash sums its bytes times powers of its places; the sums are made over a stretch at a
    time, so that besides the text itself only words take memory.
    """
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, np.uint8)
    blank = np.ones(len(raw) + 1, bool)
    np.take(_BLANK, raw, out=blank[1:])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    total = np.zeros(len(starts), np.uint64)
    for begin in range(0, len(raw), STRETCH):
        end = min(begin + STRETCH, len(raw))
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE[raw[begin:end]] * _power(_BASE, np.arange(begin, end)), out=sums[1:])
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, end)
        total[a:b] += sums[np.minimum(ends[a:b], end) - begin] - sums[np.maximum(starts[a:b], begin) - begin]
    limits = np.cumsum([len(t) + 1 for t in texts])
    return mix(total * _power(_INVERSE, starts)), np.searchsorted(limits, starts, side="right")


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text k has the sorted distinct hashes[bounds[k]:bounds[k+1]]."""
    words, owner = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    whole = np.flatnonzero(owner[: len(owner) - WORDS + 1] == owner[WORDS - 1 :]) if len(words) >= WORDS else np.zeros(0, np.int64)
    made = np.zeros(len(whole), np.uint64)
    for k in range(WORDS):
        made += words[whole + k] * _PLACE[k]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    few = np.zeros(len(short), np.uint64)
    for k in range(WORDS - 1):
        has = count[short] > k
        few[has] += words[first[short[has]] + k] * _PLACE[k]
    few += count[short].astype(np.uint64)
    hashes = mix(np.concatenate([made, few]))
    owner = np.concatenate([owner[whole], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, some texts in a row), about ``most`` bytes each."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield start, texts[start : k + 1]
            start, size = k + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def minhashes(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """``count`` MinHash values of 16 bits for each set; zeros for an empty set."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), count), np.uint16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    factors = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, (2, count), dtype=np.uint64)
    for k in range(count):
        values = hashes * (factors[0, k] << np.uint64(1) | np.uint64(1)) + factors[1, k]
        low = np.minimum.reduceat(values ^ (values >> np.uint64(32)), starts)
        out[full, k] = mix(low).astype(np.uint16)
    return out
