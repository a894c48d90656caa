"""Exact deduplication that splits off heavy hitters.

Every text is reduced to its SHA-256. Misra-Gries summaries of the partitions, merged by a grouped
sum, name the digests that may be frequent; their true counts and winners are then computed exactly.
At most ``capacity`` winners exist, so they are broadcast and settle the frequent groups on the map
side. All other digests have at most 2/capacity of the rows and go through ordinary grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_filter, materialize, text_or_empty

CAPACITY = 1024


def misra_gries(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """One summary of at most ``capacity`` counters for a partition; counts are lower bounds."""
    counters: dict[bytes, int] = {}
    for batch in batches:
        for digest, n in batch["digest"].map(bytes).value_counts(sort=False).items():
            counters[digest] = counters.get(digest, 0) + int(n)
        if len(counters) > capacity:
            # the (capacity+1)-th largest count goes off every counter, as in the mergeable form
            cut = int(np.partition(np.fromiter(counters.values(), np.int64), -capacity - 1)[-capacity - 1])
            counters = {d: n - cut for d, n in counters.items() if n > cut}
    if counters:
        yield pd.DataFrame({"digest": list(counters), "n": list(counters.values())})


def frequent_digests(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """At most ``capacity`` rows (digest): every digest with over 2/capacity of the N rows is in it.

    A summary's counts are lower bounds, too low by N/capacity at most over all partitions. So such a
    digest has a sum above N/capacity, which fewer than ``capacity`` digests can have, as all sums
    together are N at most. Others may be in it; their counts are exact wherever they are used.
    """
    parts = digests.select("digest").mapInPandas(lambda it: misra_gries(it, capacity), "digest binary, n long")
    merged = parts.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    return merged.orderBy(F.desc("n"), "digest").limit(capacity).select("digest")


def _by_row(digests: DataFrame) -> DataFrame:
    """Per digest: the group's size, the id that stays and the row that stays among ties."""
    top = digests.groupBy("digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("top")
    )
    return top.select("digest", "group_size", F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"))


def _by_id(digests: DataFrame) -> DataFrame:
    """Per digest: the group's size, the id that stays and how many rows carry that id."""
    top = (
        digests.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest")
        .agg(F.sum("n").alias("group_size"), F.max(F.struct("id", "n")).alias("top"))
    )
    return top.select("digest", "group_size", F.col("top.id").alias("keep_id"), F.col("top.n").alias("ties"))


def _split(
    digests: DataFrame, capacity: int, winners: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Exact winners of the frequent digests (at most ``capacity`` rows) and of all others."""
    frequent = materialize(frequent_digests(digests, capacity), "frequent")
    heavy = winners(digests.join(F.broadcast(frequent), "digest", "left_semi"))
    light = winners(digests.join(F.broadcast(frequent), "digest", "left_anti"))
    return materialize(heavy, "heavy"), light


def assign_exact(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty, so nulls and empty texts form one
    group. The largest id of a group stays (a null id is smaller than any other); of rows that
    repeat both id and text exactly one is kept. An empty table gives an empty result. Other
    columns of the input are not read.
    """
    digests = materialize(
        df.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    heavy, light = _split(digests, capacity, _by_row)
    at_map = digests.join(F.broadcast(heavy), "digest", "left")
    done = at_map.filter(F.col("group_size").isNotNull())
    rest = at_map.filter(F.col("group_size").isNull()).select("digest", "id", "row").join(light, "digest")
    return done.unionByName(rest).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_exact(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rules as in :func:`assign_exact`.

    Only rows that pass a filter of the digests of groups of two and more go through a join, and
    only where one id repeats inside a text are rows compared further.
    """
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    digests = materialize(df.select(F.col(id_col).alias("id"), digest.alias("digest")), "digests")
    heavy, light = _split(digests, capacity, _by_id)
    light = materialize(light.filter("group_size > 1").withColumn("short", F.xxhash64("digest")), "light")
    may_repeat = key_filter(light, "short")
    full = df.withColumn("__digest", digest)
    out = [F.col(f"`{c}`") for c in df.columns]

    def named(winners: DataFrame) -> DataFrame:
        return winners.select([F.col(c).alias(f"__{c}") for c in ("digest", "keep_id", "ties")])

    wins = F.col("__ties").isNull() | F.col(id_col).eqNullSafe(F.col("__keep_id"))
    at_map = full.join(F.broadcast(named(heavy)), "__digest", "left").filter(wins)
    at_map = at_map.withColumn("__n", F.coalesce(F.col("__ties"), F.lit(1))).drop("__keep_id", "__ties")
    at_map = at_map.withColumn("__may", may_repeat(F.xxhash64("__digest")))
    alone = at_map.filter("not __may")
    grouped = at_map.filter("__may").join(named(light), "__digest", "left").filter(wins)
    grouped = grouped.withColumn("__n", F.greatest("__n", F.coalesce(F.col("__ties"), F.lit(1))))
    if heavy.filter("ties > 1").isEmpty() and light.filter("ties > 1").isEmpty():
        return alone.select(out).unionByName(grouped.select(out))
    both = alone.select(*out, "__n", "__digest").unionByName(grouped.select(*out, "__n", "__digest"))
    tied = both.filter("__n > 1").dropDuplicates([id_col, "__digest"])
    return both.filter("__n <= 1").select(out).unionByName(tied.select(out))
