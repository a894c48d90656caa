"""Connected components by alternating stars, each round a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with over 1/HUBS of all edge ends is a hub; there are at most HUBS of them.
HUBS = 1000


def _relink(sides: DataFrame, ends: int) -> DataFrame:
    """Each (u, v) to (u, v, m), m the least of u and u's neighbours in ``sides`` of ``ends`` rows.

    Hubs, at most HUBS rows, are broadcast, so that no task gets all the edges of one.
    """
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = least.filter(F.col("n") > ends / HUBS).select("u", F.col("m").alias("hub_m"))
    marked = sides.join(F.broadcast(hubs), "u", "left")
    done = marked.filter(F.col("hub_m").isNotNull()).select("u", "v", F.col("hub_m").alias("m"))
    rest = marked.filter(F.col("hub_m").isNull()).select("u", "v")
    return done.unionByName(rest.join(least.select("u", "m"), "u"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), both long; the component is its least node.

    Every round writes its edges to the shared folder and deletes those of the round before. A
    large-star step links larger neighbours to the least neighbour, a small-star step the smaller
    ones; in the end each node has one edge, to its component. Repeated edges and loops do no harm;
    nulls are left out. The result is written, so it may be read often.
    """
    valid = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = materialize(valid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = edges.filter("a != b")
    written, mark = edges, None
    size = F.count(F.lit(1))
    check = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = tuple(now.agg(size, check).first())
    while seen[0] and seen != mark:
        mark = seen
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _relink(both, 2 * seen[0]).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "edges")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _relink(down, large.count()).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).filter("a != b").distinct()
        now = materialize(small, "edges")
        seen = tuple(now.agg(size, check).first())
        discard(large)
        if written is not edges:
            discard(written)
        written = now
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = linked.union(roots).union(loops).groupBy("node").agg(F.min("component").alias("component"))
    found = materialize(found, "components")
    discard(edges, written)
    return found
