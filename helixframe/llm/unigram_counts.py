"""Token counts by dynamic programming shared over a trie of the pre-tokens.

A text's pre-tokens are its white-space words, each behind the word mark. The distinct new pre-tokens
of a batch form a trie, which is walked depth first: the best unigram score of a prefix and its number
of tokens are computed once for all pre-tokens that share it, and the number at the end of each
pre-token is stored. Documents then sum stored numbers.

The pieces are those of a vocabulary file; their probabilities are fitted to the corpus by
expectation-maximization over the grouped pre-tokens of all rows, and written out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, narrow_batches, text_or_empty
from .word_store import pieces

MARK = "▁"
#: Taken off the lowest piece score for a character that no piece covers.
UNKNOWN = 10.0
#: Bytes of pre-tokens that a worker remembers.
MOST_BYTES = 1 << 26


def unigram_scores(path: str) -> dict[str, float]:
    """Where the fit starts: log probabilities of the file's normal pieces by Zipf's law over their order."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1.0 / r for r in range(1, len(names) + 1)))
    return {name: -math.log(r) - total for r, name in enumerate(names, 1)}


#: Characters whose pieces are held at a time, and characters of pre-tokens that are gathered before they are worked on;
#: only a longer word takes more than one block.
BLOCK, GATHER = 1 << 17, 1 << 15
#: Expected occurrences are added up as whole numbers of units of 2^-40, kept in two halves of 20 bits, so that
#: a long holds the sum of 2^43 occurrences of a piece.
HALF = 20


class PieceSuffixes:
    """Finds all pieces in pre-tokens by walking back from every character, over arrays.

    ``levels[k]`` holds the last k + 1 characters of all pieces: sorted keys of the place that the last k
    have in the level before and of the character before them, and the number of the piece that this is, or -1.
    """

    def __init__(self, names: list[str]):
        number, place = {name: i for i, name in enumerate(names)}, {"": 0}
        self.names, self.levels = names, []
        for size in range(1, max(map(len, names), default=0) + 1):
            keys = {ending: place[ending[1:]] << 21 | ord(ending[0]) for ending in {n[-size:] for n in names if len(n) >= size}}
            endings = sorted(keys, key=keys.__getitem__)
            place = {ending: i for i, ending in enumerate(endings)}
            self.levels.append((np.array([keys[e] for e in endings], np.int64), np.array([number.get(e, -1) for e in endings], np.int64)))

    def find(self, codes: np.ndarray, first: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place before it, place of its last character, number) of all pieces that end on the layers low to
        high - 1, by their end. A character that is no piece is one of number ``len(names)``."""
        end = np.arange(first[low], first[high])
        layer = np.repeat(np.arange(low, high), np.diff(first[low : high + 1]))
        word, state = end - first[layer], np.zeros(len(end), np.int64)
        single = np.full(len(end), len(self.names))
        found = []
        for size, (keys, pieces) in enumerate(self.levels, 1):
            key = state << 21 | codes[first[layer - size + 1] + word]
            state = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            known = keys[state] == key
            end, layer, word, state = end[known], layer[known], word[known], state[known]
            piece = pieces[state]
            if size == 1:
                single[end[piece >= 0] - first[low]] = piece[piece >= 0]
            else:
                whole = piece >= 0
                found.append((first[layer[whole] - size] + word[whole], end[whole], piece[whole]))
            more = layer > size
            end, layer, word, state = end[more], layer[more], word[more], state[more]
        end = np.arange(first[low], first[high])
        layer = np.repeat(np.arange(low, high), np.diff(first[low : high + 1]))
        found.insert(0, (first[layer - 1] + end - first[layer], end, single))
        start, end, piece = map(np.concatenate, zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]


def add_expected(words: list[str], times: np.ndarray, suffixes: PieceSuffixes, logs: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` how often each piece is expected in these words, over all their segmentations.

    Forward and backward run over all words at once: layer e holds the place behind the e-th character of
    each word that has one, longest words first. Scores are logarithms, so that none vanishes in a long word.
    The pieces of :data:`BLOCK` places are held at a time, so a word may be of any length. ``logs`` has the
    unknown character last; ``total`` has a row for each half of the units.
    """
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order], np.int64)
    wide = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="right")  # words of at least e characters
    first = np.concatenate([[0], np.cumsum(wide)])
    flat = np.frombuffer("".join(words[i] for i in order).encode("utf-32-le", "replace"), np.uint32)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = np.zeros(first[-1], np.int64)
    codes[first[at + 1] + np.repeat(np.arange(len(sizes)), sizes)] = flat
    blocks, low = [], 1
    while low <= sizes[0]:
        high = max(int(np.searchsorted(first, first[low] + BLOCK, side="right")) - 1, low + 1)
        blocks.append((low, min(high, int(sizes[0]) + 1)))
        low = blocks[-1][1]
    forward, backward = np.zeros(first[-1]), np.full(first[-1], -np.inf)
    for low, high in blocks:
        held = start, end, piece = suffixes.find(codes, first, low, high)
        score = logs[piece]
        heads = np.append(np.flatnonzero(np.diff(end, prepend=-1)), len(end))  # every place has a piece that ends there
        for a, b in zip((first[low:high] - first[low]).tolist(), (first[low + 1 : high + 1] - first[low]).tolist(), strict=True):
            m, n = heads[a], heads[b]
            forward[first[low] + a : first[low] + b] = np.logaddexp.reduceat(forward[start[m:n]] + score[m:n], heads[a:b] - m)
    last = first[sizes] + np.arange(len(sizes))
    backward[last] = -forward[last]
    weights = times[order]
    for low, high in reversed(blocks):
        start, end, piece = held if high > sizes[0] else suffixes.find(codes, first, low, high)
        score = logs[piece]
        bounds = np.searchsorted(end, first[low : high + 1]).tolist()
        for m, n in zip(reversed(bounds[:-1]), reversed(bounds[1:]), strict=True):
            to = start[m:n]  # no place twice: pieces of one word with one end
            backward[to] = np.logaddexp(backward[to], backward[end[m:n]] + score[m:n])
        units = np.rint(np.exp(forward[start] + score + backward[end]) * (1 << 2 * HALF)).astype(np.int64)
        layer = np.searchsorted(first, end, side="right") - 1
        n = weights[end - first[layer]]
        np.add.at(total[0], piece, n * (units >> HALF))
        np.add.at(total[1], piece, n * (units & (1 << HALF) - 1))


def in_occurrences(high: int, low: int) -> float:
    return ((int(high) << HALF) + int(low)) / (1 << 2 * HALF)


def expected_pieces(word: str, probs: dict[str, float], longest: int, unknown: float) -> dict[str, float]:
    """How often each piece is expected in a word, over all its segmentations; other characters count as pieces."""
    known = {c: unknown for c in word} | {p: v for p, v in probs.items() if len(p) <= longest}
    suffixes, total = PieceSuffixes(list(known)), np.zeros((2, len(known) + 1), np.int64)
    add_expected([word], np.array([1]), suffixes, np.log([*known.values(), unknown]), total)
    return {p: in_occurrences(*total[:, i]) for i, p in enumerate(known) if total[:, i].any()}


def _expect(batches: Iterator[pa.RecordBatch], suffixes: PieceSuffixes, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(logs)), np.int64)
    words, times, size = [], [], 0
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            words.append(MARK + word.decode("utf-8", "replace"))
            times.append(n)
            size += len(words[-1])
            if size >= GATHER:
                add_expected(words, np.array(times), suffixes, logs, total)
                words, times, size = [], [], 0
    if words:
        add_expected(words, np.array(times), suffixes, logs, total)
    seen = np.flatnonzero(total[:, :-1].any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["piece", "high", "low"])


def fit_unigram(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """A written table (piece, score): log probabilities of the file's pieces, fitted to the texts.

    The fit starts at :func:`unigram_scores` and takes ``rounds`` steps of expectation-maximization
    over the distinct pre-tokens, of any length, of all rows. Expected occurrences are summed exactly, so
    that scores do not depend on how the rows are dealt. A piece that is not expected keeps a hundredth
    of an occurrence. Without any word the scores stay as they began.
    """
    spark = df.sparkSession
    words = df.select(F.explode(F.split(text_or_empty(text_col), r"[ \t\n\x0b\f\r]+")).alias("word")).filter(F.col("word") != "")
    words = words.groupBy(F.col("word").cast("binary").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words, "distinct-words")
    scores = unigram_scores(path)
    suffixes = spark.sparkContext.broadcast(PieceSuffixes(list(scores)))
    for _ in range(rounds):
        logs = spark.sparkContext.broadcast(np.array([*scores.values(), min(scores.values(), default=0.0) - UNKNOWN]))
        with narrow_batches(spark):
            found = words.mapInArrow(lambda it, logs=logs: _expect(it, suffixes.value, logs.value), "piece long, high long, low long")
            rows = found.groupBy("piece").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # at most a row for each piece
        expected = {r["piece"]: in_occurrences(r["high"], r["low"]) for r in rows}
        if not expected:
            break
        counts = {p: max(expected.get(i, 0.0), 0.01) for i, p in enumerate(scores)}
        total = math.log(sum(counts.values()))
        scores = {p: math.log(n) - total for p, n in counts.items()}
    discard(words)
    return materialize(spark.createDataFrame(list(scores.items()), "piece string, score double").coalesce(1), "unigram")


class TrieCounter:
    def __init__(self, scores: dict[str, float], capacity: int = 1_000_000):
        self._scores = scores
        self._longest = max(map(len, scores), default=1)
        self._unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.counts: dict[bytes, int] = {}
        self._capacity = capacity
        self._bytes = 0

    def _visit(self, word: str, depth: int, best: list[float], count: list[int]) -> None:
        """Fill the path of ``word`` below ``depth``; ties go to the longest last piece."""
        score_of, longest = self._scores.get, self._longest
        del best[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                piece = score_of(word[start:end])
                if piece is not None and best[start] + piece > top:
                    top, n = best[start] + piece, count[start] + 1
            one = word[end - 1]
            if one not in self._scores and best[end - 1] + self._unknown > top:
                top, n = best[end - 1] + self._unknown, count[end - 1] + len(one.encode("utf-8", "replace"))
            best.append(top)
            count.append(n)

    def learn(self, words: set[bytes]) -> None:
        """Store the counts of new words; in sorted order neighbours share their prefix's path."""
        new = {w for w in words if w not in self.counts}
        self._bytes += sum(map(len, new))
        if len(self.counts) + len(new) > self._capacity or self._bytes > MOST_BYTES:
            self.counts.clear()
            new = words
            self._bytes = sum(map(len, new))
        best, count, last = [0.0], [0], ""
        for text, word in sorted((MARK + w.decode("utf-8", "replace"), w) for w in new):
            depth, most = 0, min(len(text), len(last))
            while depth < most and text[depth] == last[depth]:
                depth += 1
            self._visit(text, depth, best, count)
            self.counts[word] = count[len(text)]
            last = text


_COUNTER: list[tuple[int, TrieCounter]] = []


def _counts(batches: Iterator[pa.RecordBatch], scores: dict[str, float], name: int) -> Iterator[pa.RecordBatch]:
    if not _COUNTER or _COUNTER[0][0] != name:  # a worker keeps the counts of the model it used last
        _COUNTER[:] = [(name, TrieCounter(scores))]
    counter = _COUNTER[0][1]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, size = [], 0
        for number, part in pieces(texts):
            held.append((number, part.split()))
            size += len(part)
            if size >= 1 << 21:
                _sum(counter, held, words, tokens)
                held, size = [], 0
        _sum(counter, held, words, tokens)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(tokens)], ["id", "n_pretokens", "n_tokens"])


def _sum(counter: TrieCounter, held: list[tuple[int, list[bytes]]], words: np.ndarray, tokens: np.ndarray) -> None:
    """Add up a few megabytes of text; new words of all of them go into one trie."""
    counter.learn({w for _, ws in held for w in ws})
    for number, ws in held:
        words[number] += len(ws)
        tokens[number] += sum(map(counter.counts.__getitem__, ws))


def count_tokens(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", scores: dict[str, float] | None = None
) -> DataFrame:
    """Per row: id, n_pretokens, n_tokens of the best unigram segmentation.

    The pieces are the file's; their ``scores`` are fitted by :func:`fit_unigram` where not given.
    Pre-tokens part at ASCII white space. A character that no piece covers counts as its UTF-8
    bytes. A null or empty text counts 0. Repeated rows give repeated results, an empty table none;
    other columns are not read.
    """
    if scores is None:
        fitted = fit_unigram(df, path, id_col, text_col)
        scores = {r["piece"]: r["score"] for r in fitted.collect()}  # a row for each piece
        discard(fitted)
    name = zlib.crc32(repr(sorted(scores.items())).encode())
    shared = df.sparkSession.sparkContext.broadcast(scores)
    kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    out = slim.mapInArrow(
        lambda it: _counts(it, shared.value, name), f"id {kind}, n_pretokens long, n_tokens long"
    ).withColumnRenamed("id", id_col)
    with narrow_batches(df.sparkSession):
        return materialize(out, "token-counts")
