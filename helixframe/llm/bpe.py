"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. In every round all neighbouring pairs are looked
up by binary search over the sorted pair keys, each word's lowest-ranked pair is merged wherever it
stands in the word, and words without a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow_batches, text_or_empty
from .word_store import WordStore, encoded_pieces, gather

#: Unicode white space.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizers file of the kind: lower case, white space dropped, word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern.replace(r"\s", WHITE))
        self._white = regex.compile(f"[{WHITE}]+")
        suffix = spec["model"]["end_of_word_suffix"]
        marks = byte_symbols()
        self._inner = np.array([vocab[m] for m in marks], np.int64)
        self._final = np.array([vocab[m + suffix] for m in marks], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks, self._made = keys[order], order.astype(np.int64), made
        names = {i: t for t, i in {**vocab, **self.special}.items()}
        rows = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self._name_sizes = np.array([len(r) for r in rows], np.int64)
        self._name_starts = np.cumsum(self._name_sizes) - self._name_sizes
        self._names = np.frombuffer(b"".join(rows), np.uint8)

    def pre_tokens(self, word: bytes) -> list[bytes | int]:
        """Pre-tokens of a white-space word in UTF-8; the ids of special tokens stand as they are."""
        out: list[bytes | int] = []
        text = word.decode("utf-8", "replace")
        for part in self._special.split(text) if "<|" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = self._white.sub(" ", unicodedata.normalize("NFC", part))
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            out += [t.encode() for t in self._words.findall(part)]
        return out

    def merge(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token (none empty), all in one flat array."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self._inner[flat]
        symbols[ends - 1] = self._final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        done: list[np.ndarray | None] = [None] * len(tokens)
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            key = symbols[pair] << 32 | symbols[pair + 1]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[at] == key
            rank[pair[hit]] = self._ranks[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(rank, first)
            ended = lowest == NO_RANK
            for a, n, word in zip(first[ended], count[ended], owner[first[ended]], strict=True):
                done[word] = symbols[a : a + n]
            lowest = np.repeat(lowest, count)
            take = np.flatnonzero((rank == lowest) & (lowest != NO_RANK))
            if len(take):  # of overlapping places (a pair of equal symbols) every second one merges
                run = np.concatenate([[True], np.diff(take) > 1])
                begin = take[np.maximum.accumulate(np.where(run, np.arange(len(take)), 0))]
                take = take[(take - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[take] = self._made[rank[take]]
            keep = lowest != NO_RANK
            keep[take + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each white-space word."""
        parts = [self.pre_tokens(w) for w in words]
        distinct = list(dict.fromkeys(t for p in parts for t in p if isinstance(t, bytes)))
        known = dict(zip(distinct, self.merge(distinct), strict=True)) if distinct else {}
        one = {i: np.array([i], np.int64) for i in self.special.values()}
        none = np.zeros(0, np.int64)
        rows = [[known[t] if isinstance(t, bytes) else one[t] for t in p] for p in parts]
        return [r[0] if len(r) == 1 else np.concatenate(r) if r else none for r in rows]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings with a space between neighbours, in UTF-8."""
        return gather(self._names, self._name_starts[ids], self._name_sizes[ids]).tobytes()[:-1]


_STORES: dict[str, tuple[WordBpe, WordStore]] = {}


def _codec(path: str) -> tuple[WordBpe, WordStore]:
    """The worker process's codec for a file, made once."""
    if path not in _STORES:
        bpe = WordBpe(path)
        _STORES[path] = (bpe, WordStore(bpe.encode_words, np.uint32))
    return _STORES[path]


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, store = _codec(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        count = np.zeros(len(texts), np.int64)
        of_ids = [hashlib.sha256() for _ in texts]
        of_text = [hashlib.sha256() for _ in texts]
        for number, ids in encoded_pieces(store, texts):
            if len(ids):
                of_ids[number].update(ids.astype("<u4").tobytes())
                of_text[number].update((b" " if count[number] else b"") + bpe.decode(ids))
                count[number] += len(ids)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(count), pa.array([h.hexdigest() for h in of_ids]), pa.array([h.hexdigest() for h in of_text])],
            ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids (little-endian unsigned 32 bits) and of the decoded text.

    ``path`` must be readable on the workers. A null or empty text has no tokens; both digests are
    then those of no bytes. Texts of any length are encoded in parts that end at white space.
    Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    out = slim.mapInArrow(
        lambda it: _digests(it, path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    with narrow_batches(df.sparkSession):
        return materialize(out.withColumnRenamed("id", id_col), "bpe")


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    _, store = _codec(path)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        for number, ids in encoded_pieces(store, texts):
            rows[number].append(ids.astype(np.int32))
        values = [np.concatenate(r) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "ids"]
        )


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and its token ids as an array; nulls and empty texts give an empty array."""
    kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    out = slim.mapInArrow(lambda it: _tokens(it, path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
    with narrow_batches(df.sparkSession):
        return materialize(out, "bpe")


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, _ = _codec(path)
    for batch in batches:
        rows = batch.column("ids").to_pylist()
        texts = [bpe.decode(np.array(r, np.int64)).decode("utf-8", "replace") if r else "" for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text, the tokens' strings joined by spaces; a null or empty array gives ''."""
    kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(lambda it: _texts(it, path), f"id {kind}, text string").withColumnRenamed("id", id_col)
