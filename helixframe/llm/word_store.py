"""Encodings of distinct white-space words, kept by a worker process between batches.

A byte-pair tokenizer that drops white space encodes a text as the encodings of its white-space
words, one after the other. So each distinct word is encoded once; a text then costs a dictionary
lookup for each word and one numpy gather. The store is emptied when it holds ``capacity`` words or
``most_bytes`` of them, which bounds its memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Bytes of text that are gathered at a time.
PIECE = 1 << 19
#: Words that are encoded at a time.
STEP = 8192
#: The bytes at which bytes.split() parts words.
BLANKS = b" \t\n\r\x0b\x0c"


class WordStore:
    def __init__(self, encode: Callable[[list[bytes]], list], dtype: type, capacity: int = 200_000, most_bytes: int = 1 << 25):
        self._encode, self._dtype, self._capacity, self._most_bytes = encode, dtype, capacity, most_bytes
        self._reset()

    def _reset(self) -> None:
        self._index: dict[bytes, int] = {}
        self._starts = np.zeros(1 << 12, np.int64)
        self._sizes = np.zeros(1 << 12, np.int64)
        self._flat = np.zeros(1 << 14, self._dtype)
        self._used = self._bytes = 0

    def _add(self, words: list[bytes]) -> None:
        rows = self._encode(words)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        first, last = len(self._index), len(self._index) + len(words)
        need = self._used + int(sizes.sum())
        if last > len(self._starts):
            for name in ("_starts", "_sizes"):
                grown = np.zeros(max(last, 2 * len(self._starts)), np.int64)
                grown[:first] = getattr(self, name)[:first]
                setattr(self, name, grown)
        if need > len(self._flat):
            grown = np.zeros(max(need, 2 * len(self._flat)), self._dtype)
            grown[: self._used] = self._flat[: self._used]
            self._flat = grown
        self._starts[first:last] = self._used + np.cumsum(sizes) - sizes
        self._sizes[first:last] = sizes
        if need > self._used:
            lists = isinstance(rows[0], list)
            new = np.fromiter(chain.from_iterable(rows), self._dtype, need - self._used) if lists else np.concatenate(rows)
            self._flat[self._used : need] = new
        self._used = need
        self._bytes += sum(map(len, words))
        self._index.update(zip(words, range(first, last), strict=True))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word; words not seen before are encoded."""
        found = list(map(self._index.get, words))
        if None in found:
            if len(self._index) > self._capacity or self._bytes > self._most_bytes:
                self._reset()
                found = [None]
            missing = list(dict.fromkeys(words)) if len(found) != len(words) else list(
                dict.fromkeys(w for w, at in zip(words, found, strict=True) if at is None)
            )
            for at in range(0, len(missing), STEP):
                self._add(missing[at : at + STEP])
            found = list(map(self._index.__getitem__, words))
        return np.array(found, np.int64)

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self._sizes[places]

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The encodings at these places, joined."""
        return gather(self._flat, self._starts[places], self._sizes[places])


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[start:start+size]`` for each pair, joined into one array."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(total)
    return flat[at]


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, bytes]]:
    """(number of the text, part of it) in order; parts of at most ``most`` bytes end at white space.

    A single word above that size is one part by itself. Every text gives at least one part.
    """
    for number, text in enumerate(texts):
        at = 0
        while len(text) - at > most:
            end = max(text.rfind(b, at, at + most) for b in (BLANKS[i : i + 1] for i in range(len(BLANKS))))
            if end <= at:
                later = [p for b in (BLANKS[i : i + 1] for i in range(len(BLANKS))) if (p := text.find(b, at + most)) >= 0]
                end = min(later, default=len(text))
            yield number, text[at:end]
            at = end
        yield number, text[at:]


def encoded_pieces(store: WordStore, texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, encodings of a part of it), in order, a few megabytes of text at a time."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        words = [w for _, ws in held for w in ws]
        places = store.places(words)
        flat = store.gather(places)
        ends = np.concatenate([[0], np.cumsum(store.sizes(places))])
        bounds = np.cumsum([0] + [len(ws) for _, ws in held])
        for (number, _), a, b in zip(held, ends[bounds[:-1]], ends[bounds[1:]], strict=True):
            yield number, flat[a:b]

    for number, part in pieces(texts, most):
        held.append((number, part.split()))
        size += len(part)
        if size >= most:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
