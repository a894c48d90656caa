"""Similarity join on word shingles with Bayesian pruning of candidate pairs.

Candidates come from an exact filter: two sets of Jaccard similarity t or more share an element among
the first |x| - ceil(t |x|) + 1 elements of either, in any one order of all elements. The order puts
shingles that many documents share last, so that common passages yield no candidates. The sets that
share one shingle there form a list. Each set of a list is paired with the list's least set, which
gives at most one pair for each posting. Pairs are compared 16 MinHash values at a time and go once
the posterior probability of reaching t, under a uniform prior, falls below ``tolerance``; those left
connect sets into groups. Where a list reaches over several groups, its sets of different groups are
compared in the same way, so that groups hold every likely pair. Inside the final groups all pairs are
pruned by the posterior, and the rest verified on the whole sets.

Documents of one shingle set are copies and take part once. Long lists and large groups are compared
block against block, each pair of blocks in a task of its own, which returns edges of a spanning
forest and counts of links, never the pairs. The number of links of every document can only be had by
comparing the pairs of its group, so that compute (not rows or shuffling beyond a copy of a set for
each block) grows with the square of a group of near copies.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, key_filter, materialize, narrow_batches, release_memory, shuffle_width, text_or_empty
from .components import connected_components
from .shingles import chunks, minhashes, mix, shingle_sets

#: MinHash values of 16 bits for each set, and how many are compared at a time.
HASHES, STEP = 64, 16
#: Shingles that a summary of a stretch of shingles may name as common, and the order's length.
SUMMARY, COMMON = 16384, 65536
#: A shingle of over 1/HOT of the documents is hot: its list, which one task had to read, is not shuffled.
HOT = 500
#: Equal lists of sets are taken once among so many that a task has seen last.
SEEN = 100_000
#: Sets, and shingles, of a block of a list or group that is compared block against block.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000
#: Pairs that are compared at a time.
PAIRS = 1 << 18


def least_matches(k: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``k`` equal MinHash values at which a pair stays.

    With a uniform prior the posterior of the similarity after m matches is Beta(m+1, k-m+1); its
    mass above the threshold is the probability of at most m successes in k+1 trials.
    """
    mass = 0.0
    for m in range(k + 1):
        mass += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        if mass >= tolerance:
            return m
    return k


@cache
def _limits(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    return [(k, least_matches(k, threshold, tolerance)) for k in range(STEP, HASHES + 1, STEP)]


def bayes_keep(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which pairs (left[a], right[b]) stay; every step looks only at the pairs still there."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int16)
    for k, least in _limits(threshold, tolerance):
        span = slice(k - STEP, k)
        matches[alive] += (left[a[alive], span] == right[b[alive], span]).sum(axis=1, dtype=np.int16)
        alive = alive[matches[alive] >= least]
    return alive


def prefix_length(n: int | np.ndarray, threshold: float):
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").to_pylist()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every stretch of two million shingles, those that occur most, with their counts."""
    held, size = [], 0

    def summary() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = np.flatnonzero(counts >= 2)
        if len(often) > SUMMARY:
            often = often[np.argpartition(counts[often], -SUMMARY)[-SUMMARY:]]
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["sh", "n"])

    for batch in batches:
        for _, texts in chunks(_texts(batch)):
            held.append(shingle_sets(texts)[0])
            size += len(held[-1])
            if size >= 1 << 21:
                yield summary()
                held, size = [], 0
    if held:
        yield summary()
    release_memory()


def _prepare(
    batches: Iterator[pa.RecordBatch], common: np.ndarray, rank: np.ndarray, hot: np.ndarray, threshold: float
) -> Iterator[pa.RecordBatch]:
    """Per document: id, text key, set hash, set size, other and hot shingles of its prefix, MinHashes.

    ``common`` are shingles in ascending order, with their ranks in the order and whether they are hot.
    """
    for batch in batches:
        texts = _texts(batch)
        for first, part in chunks(texts):
            hashes, bounds = shingle_sets(part)
            sizes = np.diff(bounds)
            owner = np.repeat(np.arange(len(part)), sizes)
            at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
            known = common[at] == hashes if len(common) else np.zeros(len(hashes), bool)
            place = hashes >> np.uint64(1)
            if known.any():
                place[known] = (np.uint64(1) << np.uint64(63)) + rank[at[known]]
            order = np.lexsort((place, owner))
            within = np.arange(len(hashes)) - np.repeat(bounds[:-1], sizes)
            order = order[within < np.repeat(prefix_length(sizes, threshold), sizes)]
            heavy = known[order] & hot[at[order]] if len(common) else known[order]
            rare, often = order[~heavy], order[heavy]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
            names = mix(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64)).view(np.int64)
            marks = minhashes(hashes, bounds, HASHES)
            cut = batch.slice(first, len(part))

            def lists(chosen: np.ndarray) -> pa.Array:
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner[chosen], minlength=len(part)))])
                return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(hashes[chosen].view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [cut.column("id"), cut.column("key"), pa.array(names), pa.array(sizes), lists(rare), lists(often),
                 pa.array([m.tobytes() for m in marks], pa.binary())],
                ["id", "key", "set", "n", "rare", "often", "marks"],
            )
    release_memory()


class _Lists:
    """Sorted postings to lists of sets: a pair for a list of two, rows (sh, a, b) for a longer one.

    a is the list's least set, b each other. Lists that hold just the same sets say nothing new.
    """

    def __init__(self):
        self._seen: set[bytes] = set()
        self._shingle: int | None = None
        self._parts: list[np.ndarray] = []
        self._out: list[tuple[int | None, np.ndarray]] = []

    def _new(self, sets: np.ndarray) -> bool:
        name = hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
        if name in self._seen:
            return False
        if len(self._seen) >= SEEN:
            self._seen.clear()
        self._seen.add(name)
        return True

    def close(self) -> None:
        if sum(map(len, self._parts)) > 1:
            sets = np.concatenate(self._parts)
            if self._new(sets):
                self._out.append((None if len(sets) == 2 else self._shingle, sets))
        self._parts = []

    def add(self, shingles: np.ndarray, sets: np.ndarray) -> None:
        """Rows in the order of (sh, set); a list may go on in the next call."""
        begins = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
        ends = np.append(begins[1:], len(shingles))
        # lists of one set inside the rows yield nothing, and most are such
        for k in np.unique(np.concatenate([np.flatnonzero(ends - begins > 1), [0, len(begins) - 1]])):
            shingle = int(shingles[begins[k]])
            if shingle != self._shingle:
                self.close()
                self._shingle = shingle
            self._parts.append(sets[begins[k] : ends[k]])

    def batch(self) -> pa.RecordBatch:
        out, self._out = self._out, []
        sizes = [len(s) - 1 for _, s in out]
        first = np.repeat([s[0] for _, s in out], sizes).astype(np.int64) if out else np.zeros(0, np.int64)
        rest = np.concatenate([s[1:] for _, s in out]) if out else np.zeros(0, np.int64)
        names = [n for (n, _), k in zip(out, sizes, strict=True) for _ in range(k)]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first), pa.array(rest)], ["sh", "a", "b"])


def _list_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sh, a, b) of the lists among postings (sh, set) in the order of both."""
    lists = _Lists()
    for batch in batches:
        if batch.num_rows:
            lists.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("sh", "set")))
            yield lists.batch()
    lists.close()
    yield lists.batch()
    release_memory()


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _prune(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = _marks(batch.column("left")), _marks(batch.column("right"))
        every = np.arange(batch.num_rows)
        kept = pa.array(bayes_keep(left, right, every, every, threshold, tolerance))
        yield batch.select(["a", "b"]).take(kept)


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each task in turn, from rows in the order of ``task``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column("task").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist()
        for begin, end in zip(begins, [*begins[1:], len(task)], strict=True):
            if held and task[begin] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = task[begin]
    if held:
        yield pa.Table.from_batches(held)


def _row_pairs(sizes: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], apart: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that fit, about PAIRS at a time.

    All i > j of one side, or, with the first ``apart`` places on one side, all across both.
    """
    n = len(sizes)
    if apart:
        step = max(1, PAIRS // max(1, n - apart))
        for at in range(0, apart, step):
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + step, apart)), np.arange(apart, n), indexing="ij"))
            ok = fits(i, j)
            yield i[ok], j[ok]
        return
    at = 1
    while at < n:
        end = min(n, max(at + 1, int(math.sqrt(at * at + 2 * PAIRS))))
        i = np.repeat(np.arange(at, end), np.arange(at, end))
        j = np.arange(len(i)) - np.repeat(np.cumsum(np.arange(at, end)) - np.arange(at, end), np.arange(at, end))
        ok = fits(i, j)
        yield i[ok], j[ok]
        at = end


def _close_sizes(sizes: np.ndarray, threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda i, j: np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9


class _Forest:
    """A spanning forest over named items, grown by links; a tree's root has its least name."""

    def __init__(self, names: np.ndarray):
        self.names = names.tolist()
        self.root = list(range(len(names)))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.edges.append((self.names[x], self.names[y]))
                low, high = (p, q) if self.names[p] < self.names[q] else (q, p)
                self.root[high] = low

    def roots(self) -> np.ndarray:
        return np.array([self.find(k) for k in range(len(self.names))], np.int64)


def _bridges(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    """Edges between groups: likely pairs among the sets of a list, or of two blocks of one."""
    for rows in _tasks(batches):
        names, first = np.unique(rows.column("set").to_numpy(), return_index=True)
        rows = rows.take(pa.array(first))
        places = rows.column("place").to_numpy()
        order = np.argsort(places, kind="stable")
        apart = int((places == places.min()).sum()) if rows.column("first")[0] != rows.column("second")[0] else 0
        if apart == len(names):  # the other block has no rows
            continue
        names, sizes = names[order], rows.column("n").to_numpy()[order]
        marks = _marks(rows.column("marks").combine_chunks())[order]
        groups, group = np.unique(rows.column("group").to_numpy()[order], return_inverse=True)
        forest = _Forest(groups)
        close = _close_sizes(sizes, threshold)
        root = np.arange(len(groups))
        for i, j in _row_pairs(sizes, lambda i, j: (group[i] != group[j]) & close(i, j), apart):
            new = root[group[i]] != root[group[j]]
            i, j = i[new], j[new]
            kept = bayes_keep(marks, marks, i, j, threshold, tolerance)
            if len(kept):
                pairs = np.unique(group[i[kept]] * len(groups) + group[j[kept]])
                forest.link(pairs // len(groups), pairs % len(groups))
                root = forest.roots()
        if forest.edges:
            a, b = zip(*forest.edges, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    release_memory()


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for _, part in chunks(_texts(batch)):
            hashes, bounds = shingle_sets(part)
            rows += [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "shingles", pa.array(rows, pa.binary()))
    release_memory()


def shared_counts(sides: list[tuple[np.ndarray, np.ndarray, int]], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of two sides' sets, by matrix products over stretches of shingles.

    A side is (shingles, number of the set of each, number of sets).
    """
    (left, _, n), (right, _, m) = sides
    both = np.intersect1d(left, right)
    out = np.zeros((n, m), np.float32)
    held = []
    for hashes, owner, size in sides:
        at = np.minimum(np.searchsorted(both, hashes), max(len(both) - 1, 0))
        hit = both[at] == hashes if len(both) else np.zeros(len(at), bool)
        column, row = at[hit], owner[hit]
        order = np.argsort(column, kind="stable")
        held.append((column[order], row[order], size))
    for start in range(0, len(both), width):
        dense = []
        for column, row, size in held:
            a, b = np.searchsorted(column, [start, start + width])
            block = np.zeros((size, min(width, len(both) - start)), np.float32)
            block[row[a:b], column[a:b] - start] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def _links(rows: pa.Table, threshold: float, tolerance: float) -> pa.RecordBatch:
    """Compare the sets of a group, or of two blocks of one.

    Returns (set, class, links) where a group is whole, (set, null, links) for parts of one, and
    (a, b) for the edges of such a part's spanning forest.
    """
    names, first = np.unique(rows.column("set").to_numpy(), return_index=True)
    rows = rows.take(pa.array(first))
    places = rows.column("place").to_numpy()
    order = np.argsort(places, kind="stable")
    two = rows.column("first")[0] != rows.column("second")[0]
    apart = int((places == places.min()).sum()) if two else 0
    names, copies = names[order], rows.column("copies").to_numpy()[order]
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").take(pa.array(order)).to_pylist()]
    marks = _marks(rows.column("marks").combine_chunks())[order]
    sizes = np.array([len(x) for x in sets], np.int64)
    links = np.zeros(len(names), np.int64)
    forest = _Forest(names)
    if len(names) > 1 and apart < len(names):
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        cut = int(sizes[:apart].sum())
        one = (hashes, owner, len(sets))
        sides = [(hashes[:cut], owner[:cut], apart), (hashes[cut:], owner[cut:] - apart, len(sets) - apart)] if apart else [one, one]
        shared = None
        for i, j in _row_pairs(sizes, _close_sizes(sizes, threshold), apart):
            kept = bayes_keep(marks, marks, i, j, threshold, tolerance)
            i, j = i[kept], j[kept]
            if not len(i):
                continue
            shared = shared_counts(sides) if shared is None else shared
            common = shared[i, j - apart]
            true = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-6
            i, j = i[true], j[true]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            forest.link(i, j)
    whole = bool(rows.column("whole")[0].as_py())
    classes = names[forest.roots()]
    a, b = zip(*forest.edges, strict=True) if forest.edges and not whole else ((), ())
    n, m = len(names), len(a)
    columns = [
        pa.array([*names.tolist(), *[None] * m], pa.int64()), pa.array([*(classes.tolist() if whole else [None] * n), *[None] * m], pa.int64()),
        pa.array([*links.tolist(), *[None] * m], pa.int64()), pa.array([*[None] * n, *a], pa.int64()), pa.array([*[None] * n, *b], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["set", "class", "links", "a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, tolerance: float) -> Iterator[pa.RecordBatch]:
    for rows in _tasks(batches):
        yield _links(rows, threshold, tolerance)
    release_memory()


def _in_tasks(rows: DataFrame, key: str) -> DataFrame:
    """Deal rows (key, set, blocks) to tasks, a task's rows one after the other.

    A list or group of n blocks has a task for each pair of blocks; a set goes to the n pairs that
    its own block is in. One block is one task.
    """
    place = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("place", place).withColumn("other", other).withColumns(
        {"first": F.least("place", "other"), "second": F.greatest("place", "other"), "whole": F.col("blocks") == 1}
    )
    dealt = dealt.withColumn("task", F.xxhash64(key, "first", "second")).drop("other", "blocks")
    return dealt.repartition(shuffle_width(rows.sparkSession), "task").sortWithinPartitions("task")


def _groups(sets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(set, component) of the sets that a chain of likely pairs connects with others."""
    spark = sets.sparkSession
    worded = sets.filter("n > 0")
    postings = worded.select(F.explode("rare").alias("sh"), "set").repartition(shuffle_width(spark), "sh").sortWithinPartitions("sh", "set")
    found = materialize(postings.mapInArrow(_list_rows, "sh long, a long, b long"), "found")
    # at most COMMON shingles are hot, so their lists' least sets and sizes may be broadcast
    often = worded.select(F.explode("often").alias("sh"), "set")
    heads = often.groupBy("sh").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("listed")).filter("listed > 1")
    heads = materialize(heads, "heads")
    common = often.join(F.broadcast(heads), "sh").filter("set != a").select("sh", "a", F.col("set").alias("b"), "listed")
    pairs = found.select("a", "b").union(common.select("a", "b")).distinct()
    marks = worded.select("set", "marks")
    pairs = pairs.join(marks.withColumnsRenamed({"set": "b", "marks": "right"}), "b")
    pairs = pairs.join(marks.withColumnsRenamed({"set": "a", "marks": "left"}), "a")
    likely = pairs.mapInArrow(lambda it: _prune(it, threshold, tolerance), "a long, b long")
    linked = connected_components(likely)
    # lists of three and more that reach over several groups; a set without links is its own group
    of_b = linked.select(F.col("node").alias("b"), F.col("component").alias("group_b"))
    of_a = linked.select(F.col("node").alias("a"), F.col("component").alias("group_a"))
    long = found.filter(F.col("sh").isNotNull()).select("sh", "a", "b", F.lit(0).cast("long").alias("listed"))
    long = long.unionByName(common.filter("listed > 2")).join(of_b, "b", "left").join(of_a, "a", "left")
    long = long.withColumns({"group_a": F.coalesce("group_a", "a"), "group_b": F.coalesce("group_b", "b")})
    long = materialize(long, "long")
    apart = F.max(F.when(F.col("group_a") != F.col("group_b"), True).otherwise(False))
    mixed = long.groupBy("sh").agg(apart.alias("apart"), (F.count(F.lit(1)) + 1).alias("size"), F.min("a").alias("head"), F.min("group_a").alias("head_group"), F.max("listed").alias("listed"))
    mixed = materialize(mixed.filter("apart").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "mixed")
    of_common = F.broadcast(mixed.filter("listed > 0").select("sh", "blocks"))  # at most COMMON rows
    of_rare = mixed.filter("listed = 0").select("sh", "blocks")
    rows = long.filter("listed > 0").join(of_common, "sh").unionByName(long.filter("listed = 0").join(of_rare, "sh"))
    rows = rows.select("sh", F.col("b").alias("set"), F.col("group_b").alias("group"), "blocks")
    rows = rows.unionByName(mixed.select("sh", F.col("head").alias("set"), F.col("head_group").alias("group"), "blocks"))
    rows = rows.join(worded.select("set", "n", "marks"), "set")
    bridges = _in_tasks(rows, "sh").mapInArrow(lambda it: _bridges(it, threshold, tolerance), "a long, b long")
    bridges = materialize(bridges, "bridges")
    if bridges.isEmpty():
        discard(found, heads, long, mixed, bridges)
        return linked
    groups = connected_components(bridges.union(linked.select("node", "component")))
    discard(found, heads, long, mixed, bridges, linked)
    return groups


def similar_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
    tolerance: float = 1e-6, block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, text key, class, links, copies and the class's winner.

    key is a 64-bit hash of the text, class an arbitrary number, links the number of other rows
    whose shingle set has the similarity or more (copies included), copies the rows of the same set.
    The winner of a class is its least (id, key), null ids last: win_id and win_key. A text without
    words has no links and is a class of its own text. Classes are the connected components of the
    links. An empty table gives an empty result; only the two named columns are read.
    """
    spark = df.sparkSession
    with narrow_batches(spark):
        docs, sets, verified = _verified(df, id_col, text_col, threshold, tolerance, block)
    results = verified.filter(F.col("set").isNotNull()).groupBy("set").agg(
        F.max("class").alias("whole_class"), F.sum("links").alias("links")
    )
    edges = verified.filter(F.col("a").isNotNull()).select("a", "b")
    parts = connected_components(edges).withColumnsRenamed({"node": "set", "component": "part_class"})
    classes = (
        sets.select("set", "top", "copies", "n").join(results, "set", "left").join(parts, "set", "left")
        .withColumn("class", F.coalesce("part_class", "whole_class", "set"))
    )
    classes = materialize(classes, "classes")
    discard(sets, verified, parts)
    tops = classes.groupBy("class").agg(F.min("top").alias("win"))
    named = classes.join(tops, "class").select(
        "set", "class", "copies", "n", F.coalesce("links", F.lit(0)).alias("others"), "win"
    )
    joined = docs.select("id", "key", "set").join(named, "set")
    worded = F.col("n") > 0
    return joined.select(
        "id", "key", F.when(worded, F.col("class")).otherwise(F.col("key")).alias("class"),
        F.when(worded, F.col("others") + F.col("copies") - 1).otherwise(0).alias("links"),
        F.when(worded, F.col("copies")).otherwise(1).alias("copies"),
        F.when(worded, F.col("win.id")).otherwise(F.col("id")).alias("win_id"),
        F.when(worded, F.col("win.key")).otherwise(F.col("key")).alias("win_key"),
    )


def _verified(
    df: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float, block: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (id, key, set) of the documents, the distinct sets, and the rows of :func:`_links`."""
    spark = df.sparkSession
    id_kind = dict(df.dtypes)[id_col]
    slim = df.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).cast("binary").alias("text"))
    counted = slim.select("text").mapInArrow(_frequent, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))
    top = counted.filter("n >= 24").orderBy(F.desc("n"), "sh").limit(COMMON).collect()  # at most COMMON rows
    values = np.array([r["sh"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    # the most frequent shingle has the highest rank, the end of the order
    hot = np.array([r["n"] for r in top], np.int64) > slim.count() / HOT
    shared = spark.sparkContext.broadcast((values[order], (len(top) - 1 - order).astype(np.uint64), hot[order]))
    wide = materialize(
        slim.mapInArrow(
            lambda it: _prepare(it, *shared.value, threshold),
            f"id {id_kind}, key long, set long, n long, rare array<long>, often array<long>, marks binary",
        ),
        "shingled",
    )
    docs = materialize(wide.select("id", "key", "set"), "docs")
    winner = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    sets = wide.groupBy("set").agg(
        F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("often").alias("often"),
        F.first("marks").alias("marks"), F.min(winner).alias("top"), F.count(F.lit(1)).alias("copies"),
    )
    sets = materialize(sets, "sets")
    discard(wide)
    groups = _groups(sets, threshold, tolerance)
    members = sets.select("set", "top", "copies", "n", "marks").join(groups.withColumnRenamed("node", "set"), "set")
    verified = materialize(_verify(df, members, id_col, text_col, threshold, tolerance, block), "verified")
    discard(groups)
    return docs, sets, verified


def _verify(
    df: DataFrame, members: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float, block: int
) -> DataFrame:
    """Compare all sets of each group; see :func:`_links` for the rows."""
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held")).filter("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    wanted = members.join(sized, "component").select(
        F.col("component").alias("group"), "set", "copies", "marks", blocks.alias("blocks"), F.col("top.id").alias("want_id"), F.col("top.key").alias("want_key")
    )
    wanted = materialize(wanted, "wanted")
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("text"))
    texts = texts.filter(key_filter(wanted, "want_key")(F.col("key")))
    texts = texts.join(wanted, F.col("key").eqNullSafe(F.col("want_key")) & F.col("id").eqNullSafe(F.col("want_id")))
    texts = texts.select("group", "set", "copies", "marks", "blocks", F.col("text").cast("binary").alias("text"))
    sets = texts.mapInArrow(_shingle_rows, "group long, set long, copies long, marks binary, blocks int, shingles binary")
    return _in_tasks(sets, "group").mapInArrow(
        lambda it: _compare(it, threshold, tolerance), "set long, class long, links long, a long, b long"
    )


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay: of each class the winner, once."""
    decided = similar_documents(df, id_col, text_col, **options)
    wins = F.col("id").eqNullSafe(F.col("win_id")) & (F.col("key") == F.col("win_key"))
    decided = materialize(decided.select("id", "key", wins.alias("wins")), "decided")
    lost = decided.filter("not wins").select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct()
    lost = materialize(lost, "lost")
    out = [F.col(f"`{c}`") for c in df.columns]
    full = df.withColumn("__text_key", F.xxhash64(text_or_empty(text_col)))
    may_lose = key_filter(lost, "__key")
    full = full.withColumn("__may", may_lose("__text_key"))
    lost_here = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    kept = full.filter("not __may").unionByName(full.filter("__may").join(lost, lost_here, "left_anti"))
    twice = decided.filter("wins").groupBy("id", "key").count().filter("count > 1")
    twice = materialize(twice.select(F.col("id").alias("__id"), F.col("key").alias("__key")), "twice")
    if twice.isEmpty():
        return kept.select(out)
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    worded = F.length(F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", "")) > 0
    once = kept.join(twice, same & worded, "left_anti").select(out)
    again = kept.join(twice, same & worded, "left_semi").dropDuplicates([id_col, "__text_key"]).select(out)
    return once.unionByName(again)
