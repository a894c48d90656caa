"""Canonical k-mers and their uniqueness over all sequences.

Letters are packed to two bits in numpy; a word of k letters is a pair of longs (hi, lo) with the last
31 letters in lo. The codes keep the order of the letters, so the lesser of a word and its reverse
complement is that of the numbers. Rows are summed inside a batch before Spark groups them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters that are packed at a time, and letters of the low word.
STRETCH, LOW = 1 << 20, 31
_CODES = np.full(256, 4, np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODES[list(_letters.encode())] = _code


def _packed(codes: np.ndarray, width: int) -> np.ndarray:
    """The number of each window of ``width`` letters, by doubling."""
    n = len(codes) - width + 1
    power, size, at, out = codes.astype(np.uint64), 1, 0, np.zeros(n, np.uint64)
    while size <= width:
        if width & size:
            out = (out << np.uint64(2 * size)) | power[at : at + n]
            at += size
        if 2 * size <= width:
            power = (power[:-size] << np.uint64(2 * size)) | power[size:]
        size *= 2
    return out


def _both(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, high = len(codes) - k + 1, max(k - LOW, 0)
    hi = _packed(codes[: len(codes) - k + high], high) if high else np.zeros(n, np.uint64)
    return hi, _packed(codes[high:], min(k, LOW))


def canonical_codes(letters: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hi, lo) of the windows of letters ACGT, of either case."""
    if len(letters) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    codes = _CODES[np.frombuffer(letters, np.uint8)]
    odd = np.concatenate([[0], np.cumsum(codes == 4)])
    at = np.flatnonzero(odd[k:] == odd[:-k])
    hi, lo = (x[at] for x in _both(codes, k))
    other_hi, other_lo = (x[::-1][at] for x in _both(3 - codes[::-1], k))
    swap = (other_hi < hi) | ((other_hi == hi) & (other_lo < lo))
    return at, np.where(swap, other_hi, hi), np.where(swap, other_lo, lo)


def _stretches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list, np.ndarray, bytes]]:
    """(sequence ids, where each begins, letters): short sequences together, long ones in overlapping parts."""
    ids, begins, held, size = [], [], [], 0
    for batch in batches:
        for name, seq in zip(batch.column("seq_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
            raw = (seq or "").encode("ascii", "replace")  # one byte for each letter
            for at in range(0, max(len(raw) - k + 1, 0), STRETCH):
                ids.append((name, at))
                begins.append(size)
                held += [raw[at : at + STRETCH + k - 1], b"\n"]
                size += len(held[-2]) + 1
                if size >= STRETCH:
                    yield ids, np.array(begins), b"".join(held)
                    ids, begins, held, size = [], [], [], 0
    if held:
        yield ids, np.array(begins), b"".join(held)


def _grouped(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place in the order, count) of each distinct word."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def _words(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (hi, lo, n, seq_id, pos): the words of a stretch, their numbers and one place of each."""
    for ids, begins, letters in _stretches(batches, k):
        at, hi, lo = canonical_codes(letters, k)
        order, first, n = _grouped(hi, lo)
        chosen = order[first]
        owner = np.searchsorted(begins, at[chosen], side="right") - 1
        pos = at[chosen] - begins[owner] + np.array([a for _, a in ids], np.int64)[owner]
        names = pa.array([name for name, _ in ids], kind).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hi[chosen].view(np.int64)), pa.array(lo[chosen].view(np.int64)), pa.array(n), names, pa.array(pos)],
            ["hi", "lo", "n", "seq_id", "pos"],
        )


def _numbers(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for ids, begins, letters in _stretches(batches, k):
        at = canonical_codes(letters, k)[0]
        n = np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in ids], kind), pa.array(n)], ["seq_id", "n"])


def _letters(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hi, lo = (batch.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        table = np.empty((batch.num_rows, k), np.uint8)
        for j in range(k):
            word, place = (lo, k - 1 - j) if k - 1 - j < LOW else (hi, k - 1 - j - LOW)
            table[:, j] = np.frombuffer(b"ACGT", np.uint8)[(word >> np.uint64(2 * place) & np.uint64(3)).astype(np.int64)]
        offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * k
        names = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(table)])
        yield pa.RecordBatch.from_arrays([names, batch.column("n")], ["kmer", "n"])


def _arrow_kind(sequences: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(sequences.dtypes)["seq_id"]
    return kind, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def _rows(sequences: DataFrame, k: int) -> DataFrame:
    kind, arrow = _arrow_kind(sequences)
    return sequences.select("seq_id", "seq").mapInArrow(lambda it: _words(it, k, arrow), f"hi long, lo long, n long, seq_id {kind}, pos long")


def kmer_counts(sequences: DataFrame, k: int) -> DataFrame:
    """Occurrences of each canonical k-mer of letters ACGT, k at most 62: one shuffle of numbers."""
    counts = _rows(sequences, k).groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(lambda it: _letters(it, k), "kmer string, n long")


def kmers_of(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, n): how many k-mers of letters ACGT each sequence has, of those that have any."""
    kind, arrow = _arrow_kind(sequences)
    rows = sequences.select("seq_id", "seq").mapInArrow(lambda it: _numbers(it, k, arrow), f"seq_id {kind}, n long")
    return rows.groupBy("seq_id").agg(F.sum("n").alias("n")).filter("n > 0")


def unique_places(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos) of the k-mers that occur once over all sequences. Words are grouped with their
    number and one place, so that frequent ones meet in sums and nothing is joined."""
    once = _rows(sequences, k).groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.min(F.struct("seq_id", "pos")).alias("at"))
    return once.filter("n = 1").select("at.seq_id", "at.pos")


def _case(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for seq, places in zip(batch.column("seq").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if seq:
                low = seq.lower() if seq.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in seq)
                letters = list(low)
                for p in places or ():
                    letters[p] = letters[p].upper()
                seq = "".join(letters)
            out.append(seq)
        yield pa.RecordBatch.from_arrays([batch.column("seq_id"), pa.array(out, pa.string())], ["seq_id", "seq"])


def cased(sequences: DataFrame, k: int) -> DataFrame:
    """Sequences with upper case where a unique k-mer starts and lower case elsewhere.

    A sequence fits a row, and so do the places of its unique k-mers.
    """
    places = unique_places(sequences, k).groupBy("seq_id").agg(F.collect_list("pos").alias("places"))
    joined = sequences.select("seq_id", "seq").join(places, "seq_id", "left")
    return joined.mapInArrow(_case, f"seq_id {_arrow_kind(sequences)[0]}, seq string")
