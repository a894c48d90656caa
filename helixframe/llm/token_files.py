"""Binary token files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank of frequency over all documents, so that common ids are small. A rank
takes one to four bytes, little-endian, without leading zero bytes; the lengths stand apart, two bits
an id, four ids to a control byte. A block of the format holds, in order, all little-endian:

    magic 4 bytes, n_docs u32, n_ids u32, n_data u32, document lengths n_docs x u32,
    control bytes ceil(n_ids / 4), data bytes n_data

A block closes after the document that fills it. Blocks are rows of a Parquet table (shard, block,
place of its first id in the shard, number of ids, document ids, payload), which Spark's committer
writes safely wherever the shared folder is; shards are ranges of ascending document ids. Beside the
table of blocks stands the table of ranks (rank, token), without which blocks cannot be decoded.
Decoding reads four ids at a time with a table of the 256 control bytes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import discard, materialize, narrow_batches, release_memory, shared_dir, shuffle_width, text_or_empty
from .word_store import WordStore, gather, pieces

MAGIC = b"HXT1"
#: The tables in a folder of token files.
BLOCKS, RANKS = "blocks", "ranks"
#: A block closes once it holds so many ids.
BLOCK = 1 << 20

# for each control byte: the four lengths, and where each id's bytes start among the group's
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
_STARTS = np.cumsum(_LENGTHS, axis=1) - _LENGTHS
_TOTALS = _LENGTHS.sum(axis=1)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    sizes = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    wide = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of :func:`pack`, by table lookup on the control bytes."""
    codes = np.frombuffer(control, np.uint8)
    totals = _TOTALS[codes]
    base = np.cumsum(totals) - totals
    at = (base[:, None] + _STARTS[codes]).ravel()[:n]
    sizes = _LENGTHS[codes].ravel()[:n]
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    value = padded[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        if len(more):
            value[more] |= padded[at[more] + k] << np.uint32(8 * k)
    return value


def write_block(lengths: list[int], values: np.ndarray) -> bytes:
    control, data = pack(values)
    head = np.array([len(lengths), len(values), len(data)], "<u4").tobytes()
    return MAGIC + head + np.array(lengths, "<u4").tobytes() + control + data


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Document lengths and values of one block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n_ids, n_data = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
    lengths = np.frombuffer(payload, "<u4", n_docs, 16).astype(np.int64)
    at = 16 + 4 * n_docs
    middle = at + -(-n_ids // 4)
    if len(payload) != middle + n_data or lengths.sum() != n_ids:
        raise ValueError("broken block")
    return lengths, unpack(payload[at:middle], payload[middle:], n_ids)


#: Bytes of text that are encoded together, the longest part of a text, and pieces that a worker holds.
CHUNK, PART, HELD = 16 << 20, 4 << 20, 500_000
#: Fixed values of a tokenizers file. With these normalizers and this pattern a word of letters up to
#: U+00FF, digits and signs is put in lower case and cut by the patterns below.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = "^[!-;=-~À-ÖØ-öø-ÿ]+$"
_STEM_AND_SIGNS = "^(?P<stem>[a-zß-öø-ÿ]*)(?P<signs>[^a-z0-9'ß-öø-ÿ]*)$"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Encoder:
    """The tokenizers library over Arrow arrays of texts.

    A tokenizer that drops white space encodes a text as its white-space words, one after the other.
    Arrow finds the distinct words of some megabytes of text, and cuts the plain ones into letters
    and signs. The library's model encodes each distinct piece once, and a worker remembers them.
    Words with other characters, or with the sign that special tokens begin with, go through the
    whole library, and so do all words of a tokenizer of another kind.
    """

    def __init__(self, path: str, end_id: int):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        spec = json.loads(self._tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self._known_kind = (
            steps == _NORMALIZERS and first.get("pattern", {}).get("Regex") == _PATTERN
            and all(t["content"].startswith("<") for t in spec["added_tokens"])
        )
        self.kind = id_kind(self._tokenizer, end_id)
        self._end = end_id
        self._store = WordStore(self._encode_pieces, np.dtype(self.kind), HELD)
        self._symbols = {b: c for b, c in enumerate(byte_symbols()) if chr(b) != c}

    def _encode_pieces(self, found: list[bytes]) -> list[list[int]]:
        tokenize = self._tokenizer.model.tokenize
        texts = (p.decode() if p.isascii() else p.decode("latin-1").translate(self._symbols) for p in found)
        return [[t.id for t in tokenize(p)] if p else [] for p in texts]

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each) by the whole library."""
        rows = []
        for at in range(0, len(words), 1024):  # the library's results take many times the ids' memory
            texts = [w.decode("utf-8", "replace") for w in words[at : at + 1024]]
            rows += [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), self.kind, int(sizes.sum())), sizes

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each word's first id, number of its ids)."""
        starts, sizes = np.zeros((2, len(words)), np.int64)
        if self._known_kind:
            plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        else:
            plain = np.zeros(len(words), bool)
        others = np.flatnonzero(~plain)
        other_ids, sizes[others] = self._whole(words.take(pa.array(others)).cast(pa.binary()).to_pylist())
        lower = pc.utf8_lower(words.filter(pa.array(plain)))
        cut = pc.extract_regex(lower, _STEM_AND_SIGNS)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        place = np.flatnonzero(plain)
        found: list[bytes] = []
        owners, numbers = [], []
        for k in (0, 1):
            coded = cut.field(k).filter(pa.array(simple)).dictionary_encode()
            owners.append(place[simple])
            numbers.append(coded.indices.to_numpy() + len(found))
            found += coded.dictionary.cast(pa.binary()).to_pylist()
        rows = [_PIECES.findall(w) for w in lower.filter(pa.array(~simple)).to_pylist()]
        owners.append(np.repeat(place[~simple], [len(r) for r in rows]).astype(np.int64))
        numbers.append(np.arange(len(owners[-1])) + len(found))
        found += [p.encode() for r in rows for p in r]
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        piece = self._store.places(found)[np.concatenate(numbers)[order]] if found else np.zeros(0, np.int64)
        own = np.bincount(owner[order], self._store.sizes(piece), len(words)).astype(np.int64)
        sizes[plain] = own[plain]
        starts[place] = np.cumsum(own[place]) - own[place]
        ids = self._store.gather(piece)
        starts[others] = len(ids) + np.cumsum(sizes[others]) - sizes[others]
        return np.concatenate([ids, other_ids]), starts, sizes

    def _parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bare = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset)
        split = pc.ascii_split_whitespace(bare)
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        ids, starts, sizes = self.words(coded.dictionary)
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds - bounds[0]]
        return gather(ids, starts[at], sizes[at]), np.diff(ends)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); long texts go in parts that end at white space."""
        if not len(texts) or pc.max(pc.binary_length(texts)).as_py() <= PART:
            return self._parts(texts)
        rows, counts = [], np.zeros(len(texts), np.int64)
        for number, part in pieces(texts.to_pylist(), PART):
            ids, _ = self._parts(pa.array([part], pa.binary()))
            rows.append(ids)
            counts[number] += len(ids)
        return np.concatenate(rows), counts

    def rows(self, texts: pa.Array) -> pa.Array:
        """The ids of each text and the end id, as bytes."""
        ids, counts = self.texts(texts)
        ends = np.cumsum(counts + 1)
        out = np.full(ends[-1] if len(ends) else 0, self._end, self.kind)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = ids
        offsets = np.concatenate([[0], ends * out.itemsize]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def id_kind(tokenizer: Tokenizer, end_id: int) -> str:
    """Two bytes an id where all ids fit, else four."""
    return "<u2" if max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4"


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    encoder = _ENCODERS[path, end_id]
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([both.column("id"), encoder.rows(both.column("text"))], ["id", "ids"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= CHUNK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()
    release_memory()


def _count(batches: Iterator[pa.RecordBatch], size: int, kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for row in batch.column("ids"):
            total += np.bincount(np.frombuffer(row.as_buffer(), kind), minlength=size)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])


def _pack(batches: Iterator[pa.RecordBatch], rank: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of one shard; the rows come in the order of the file."""
    shard = TaskContext.get().partitionId()
    number, start, docs, parts, held = 0, 0, [], [], 0
    id_type = None

    def block() -> pa.RecordBatch:
        payload = write_block([len(p) for p in parts], np.concatenate(parts))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start]),
             pa.array([held]), pa.array([docs], pa.list_(id_type)), pa.array([payload], pa.binary())],
            ["shard", "block", "start", "n_ids", "docs", "payload"],
        )

    for batch in batches:
        id_type = batch.column("id").type
        for doc, row in zip(batch.column("id").to_pylist(), batch.column("ids"), strict=True):
            values = rank[np.frombuffer(row.as_buffer(), kind)]
            docs.append(doc)
            parts.append(values)
            held += len(values)
            if held >= BLOCK:
                yield block()
                number, start, docs, parts, held = number + 1, start + held, [], [], 0
    if parts:
        yield block()


def _unpack(batches: Iterator[pa.RecordBatch], token: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            lengths, values = read_block(batch.column("payload")[k].as_buffer().to_pybytes())
            ids = token[values].astype("<u4")
            begin = np.cumsum(lengths) - lengths
            rows = [ids[a : a + n].tobytes() for a, n in zip(begin, lengths, strict=True)]
            first, shard = batch.column("start")[k].as_py(), batch.column("shard")[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(rows), pa.int32()), batch.column("docs")[k].values,
                 pa.array(begin + first), pa.array(lengths), pa.array(rows, pa.binary())],
                ["shard", "id", "start", "n", "ids"],
            )


def write_token_files(
    df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> tuple[str, list[int]]:
    """Encode every text with the tokenizers file at ``path`` and write the ranks and the blocks.

    Returns the folder and the tokens by rank, at most one entry for each id of the vocabulary. Documents stand in ascending id order, null ids first; rows that repeat an id stand
    in the order of a hash of their ids. A null or empty text holds only ``end_id``. An empty table
    writes no block.
    """
    spark = df.sparkSession
    tokenizer = Tokenizer.from_file(path)
    size = max(tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = id_kind(tokenizer, end_id)
    doc_kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    encoded = slim.mapInArrow(lambda it: _encode(it, path, end_id), f"id {doc_kind}, ids binary")
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    try:
        with narrow_batches(spark):
            encoded = materialize(encoded.withColumn("h", F.xxhash64("ids")), "ids")
            counted = encoded.select("ids").mapInArrow(lambda it: _count(it, size, kind), "token long, n long")
            counts = counted.groupBy("token").agg(F.sum("n").alias("n")).collect()  # at most one row for each id
            order = [r["token"] for r in sorted(counts, key=lambda r: (-r["n"], r["token"]))]
            rank = np.zeros(size, np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            shared = spark.sparkContext.broadcast(rank)
            ordered = encoded.repartitionByRange(shuffle_width(spark), "id", "h").sortWithinPartitions("id", "h")
            blocks = ordered.select("id", "ids").mapInArrow(
                lambda it: _pack(it, shared.value, kind),
                f"shard int, block int, start long, n_ids long, docs array<{doc_kind}>, payload binary",
            )
            folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
            ranks = spark.createDataFrame(list(enumerate(order)), "rank int, token long").coalesce(1)
            ranks.write.mode("error").parquet(f"{folder}/{RANKS}")
            blocks.write.mode("error").parquet(f"{folder}/{BLOCKS}")
            discard(encoded)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
    return folder, order


def read_token_files(spark: SparkSession, folder: str, order: list[int] | None = None) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n, ids (little-endian unsigned 32 bits).

    The folder is all that is needed; ``order``, the tokens by rank, spares reading its ranks.
    """
    blocks = spark.read.parquet(f"{folder}/{BLOCKS}")
    if order is None:
        order = [r["token"] for r in spark.read.parquet(f"{folder}/{RANKS}").orderBy("rank").collect()]  # at most one row for each id
    token = spark.sparkContext.broadcast(np.array(order, np.uint32))
    id_kind = blocks.schema["docs"].dataType.elementType.simpleString()
    docs = blocks.select("shard", "start", "docs", "payload").mapInArrow(
        lambda it: _unpack(it, token.value), f"shard int, id {id_kind}, start long, n long, ids binary"
    )
    # one row for each shard, of which there are no more than shuffle partitions
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(shards), "shard").select(
        "id", (F.col("base") + F.col("start")).alias("start"), "n", "ids"
    )
