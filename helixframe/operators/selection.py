"""Exact medians of very many lists of numbers that are made row by row, without holding a list."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places that a range is counted in at a time; a range that holds no more rows than ``FEW`` is listed.
PLACES, FEW = 256, 256
#: Numbers that a task works on at a time.
CHUNK = 1 << 19


def chunks(batches: Iterator[pd.DataFrame], lists: int) -> Iterator[pd.DataFrame]:
    """Parts of the batches of which ``lists`` numbers a row are about ``CHUNK``."""
    step = max(1, CHUNK // max(lists, 1))
    for batch in batches:
        for at in range(0, len(batch), step):
            yield batch.iloc[at : at + step]


def medians(rows: DataFrame, values: Callable[[pd.DataFrame, np.ndarray], np.ndarray], group: str, sizes: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The medians of list k over the rows of each group and, in the last column, over all rows.

    ``values`` gives for some rows and list numbers an array (lists x rows) of numbers of 0 or more;
    ``rows`` have ``times``, by which they count, and their ``group`` from 0. ``sizes`` are the counts of the groups and
    of all; ``least`` and ``most`` (lists x groups and all) hold each list's numbers. Lists and groups are few: their
    bounds stay in the driver, and a task holds ``PLACES`` counts for each.

    Numbers order as their bits do. The range of bits in which a middle number lies is counted in
    ``PLACES`` places and shrinks to one of them, until it holds few rows, which are then listed.
    """
    spark = rows.sparkSession
    groups = len(sizes)
    n = np.broadcast_to(sizes, least.shape)
    # a list of even length has two middle numbers, each with its own range, and rank in it
    low, high = (np.ascontiguousarray(np.broadcast_to(np.maximum(x, 0.0).view(np.int64), (2, *least.shape))).copy() for x in (np.ascontiguousarray(least), np.ascontiguousarray(most)))
    rank = np.stack([(n - 1) // 2, n // 2]).astype(np.int64)
    held = np.where(n > 0, np.iinfo(np.int64).max, 0) * np.ones((2, 1, 1), np.int64)  # rows in a range, at most
    low[:, n == 0] = high[:, n == 0] = 0

    def inside(batches, shared):
        """Chunks with the numbers' bits of the lists that are still open, and each row's groups."""
        low, high, todo = shared
        lists = np.flatnonzero(todo.any(axis=(0, 2)))
        for chunk in chunks(batches, len(lists)):
            bits = np.ascontiguousarray(values(chunk, lists), float).view(np.int64)
            times, own = chunk["times"].to_numpy(), chunk[group].to_numpy()
            for which in (own, np.full(len(own), groups - 1)):
                for t in np.flatnonzero(todo.any(axis=(1, 2))).tolist():
                    a, b, open_ = (x[t][np.ix_(lists, which)] for x in (low, high, todo))
                    i, j = np.nonzero(open_ & (bits >= a) & (bits <= b))
                    yield t, lists[i], which[j], bits[i, j], a[i, j], b[i, j], times[j]

    while (todo := (low < high) & (held > FEW)).any():
        same = (low[0] == low[1]) & (high[0] == high[1])
        todo[1] &= ~same  # where both ranges are one it is counted once
        shared = spark.sparkContext.broadcast((low, high, todo))

        def count(batches):
            found = {}
            for t, k, g, bits, a, b, times in inside(batches, shared.value):
                place = (bits - a) // ((b - a) // PLACES + 1)
                total = found.setdefault(t, np.zeros((2, *shared.value[0].shape[1:], PLACES), np.int64))
                np.add.at(total[0], (k, g, place), times)
                np.add.at(total[1], (k, g, place), 1)
            for t, total in found.items():
                k, g, place = np.nonzero(total[1])
                yield pd.DataFrame({"t": t, "k": k, "g": g, "place": place, "n": total[0][k, g, place], "held": total[1][k, g, place]})

        counted = rows.mapInPandas(count, "t int, k int, g int, place int, n long, held long").groupBy("t", "k", "g", "place").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
        before = F.sum("n").over(Window.partitionBy("t", "k", "g").orderBy("place")) - F.col("n")
        ends = spark.createDataFrame(pd.DataFrame([
            (t, u, k, g, rank[u, k, g]) for t, k, g in np.argwhere(todo).tolist() for u in ((0, 1) if same[k, g] else (t,))
        ], columns=["t", "u", "k", "g", "rank"]), "t int, u int, k int, g int, rank long")
        hit = counted.withColumn("before", before).join(F.broadcast(ends), ["t", "k", "g"]).filter("rank >= before and rank < before + n")  # one row for each range
        for r in hit.select("u", "k", "g", "place", "before", "held").collect():  # bounded by lists and groups
            at = r["u"], r["k"], r["g"]
            step = (high[at] - low[at]) // PLACES + 1
            low[at] += r["place"] * step
            high[at] = min(high[at], low[at] + step - 1)
            rank[at] -= r["before"]
            held[at] = r["held"]

    todo = low < high
    if todo.any():
        shared = spark.sparkContext.broadcast((low, high, todo))

        def listed(batches):
            for t, k, g, bits, _, _, times in inside(batches, shared.value):
                yield pd.DataFrame({"t": t, "k": k, "g": g, "bits": bits, "n": times})

        ends = spark.createDataFrame(pd.DataFrame([(t, k, g, rank[t, k, g]) for t, k, g in np.argwhere(todo).tolist()], columns=["t", "k", "g", "rank"]), "t int, k int, g int, rank long")
        each = rows.mapInPandas(listed, "t int, k int, g int, bits long, n long").groupBy("t", "k", "g", "bits").agg(F.sum("n").alias("n"))
        through = F.sum("n").over(Window.partitionBy("t", "k", "g").orderBy("bits"))
        hit = each.withColumn("through", through).join(F.broadcast(ends), ["t", "k", "g"]).filter("rank < through").groupBy("t", "k", "g").agg(F.min("bits").alias("bits"))
        for r in hit.collect():  # bounded by lists and groups
            low[r["t"], r["k"], r["g"]] = r["bits"]
    middle = low.view(np.float64)
    return (middle[0] + middle[1]) / 2
