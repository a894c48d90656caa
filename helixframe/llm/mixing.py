"""Mixing of sources to target weights by Poisson replication.

A source of weight w gets the mean repetition rate r = total * w / (sum of weights * its size). Each
document's uniform number is a hash of seed, id and text; inverting the Poisson distribution of mean r at
that number gives its count of copies, so the draw needs no state, and a lost task draws the same
counts again. Documents are exploded by their counts and dealt out by a hash of seed, id,
text and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, text_or_empty

#: A mean above this is drawn as a sum of independent parts, as exp(-mean) must not vanish.
PART_MEAN = 256.0


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(uniform: Column, mean: Column) -> Column:
    """The smallest k whose cumulative Poisson probability exceeds ``uniform``."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(
        F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c")
    )

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(
            F.when(acc["c"] <= uniform, i).otherwise(acc["k"]).alias("k"), p.alias("p"), (acc["c"] + p).alias("c")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def poisson_count(seed: int, key: Column, mean: Column) -> Column:
    """A Poisson count of any mean, drawn from the hash of ``seed`` and ``key``."""
    parts = F.greatest(F.lit(1), F.ceil(mean / PART_MEAN)).cast("int")
    # each number is made once, not in every step of the inversion
    uniforms = F.transform(F.sequence(F.lit(1), parts), lambda i: hash_uniform(F.lit(seed), key, i))
    draws = F.transform(uniforms, lambda u: poisson_inverse(u, mean / parts))
    return F.when(mean > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(0)


def source_rates(
    df: DataFrame, targets: DataFrame | None = None, total: float | None = None,
    source_col: str = "source", text_col: str = "text", temperature: float = 0.5,
) -> DataFrame:
    """Per source: size (characters) and mean repetition rate.

    ``targets`` (source, weight) states the wanted shares; a source that it leaves out gets weight 0.
    Without it a source's weight is its size to the power ``temperature``. ``total`` is the wanted
    size of the mixture; the input's size where it is not given.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(
        F.sum(F.length(text_or_empty(text_col))).cast("double").alias("size")
    )
    sizes = materialize(sizes, "sizes")
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        wanted = targets.groupBy(F.col("source").alias("t")).agg(F.sum("weight").cast("double").alias("weight"))
        weighted = sizes.join(wanted, F.col("source").eqNullSafe(F.col("t")), "left").drop("t").fillna(0.0, ["weight"])
    weighted = weighted.withColumn("weight", F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0))
    sums = weighted.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    if not sums["w"]:
        return weighted.select("source", "size", F.lit(0.0).alias("rate"))
    factor = (sums["s"] if total is None else float(total)) / sums["w"]
    rate = F.when(F.col("size") > 0, F.col("weight") * F.lit(factor) / F.col("size")).otherwise(0.0)
    return weighted.select("source", "size", rate.alias("rate"))


def mix_sources(
    df: DataFrame, targets: DataFrame | None = None, total: float | None = None, seed: int = 17,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temperature: float = 0.5,
    bookkeeping: bool = False,
) -> DataFrame:
    """Every document as often as its Poisson count says, in a global random order.

    Returns the columns of ``df``; with ``bookkeeping`` also mix_rate, mix_copies (the document's
    count) and mix_copy (1..mix_copies). Rows that repeat both id and text get the same count each. A
    null source is a source of its own, a null id hashes as a fixed word, a null or empty text has size
    0; sources without any text get no copies. An empty table gives an empty table.
    """
    rates = materialize(
        source_rates(df, targets, total, source_col, text_col, temperature).filter("rate > 0"), "rates"
    ).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text_or_empty(text_col)))
    counted = df.join(rates, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__key", key)
    counted = counted.withColumn("__copies", poisson_count(seed, F.col("__key"), F.col("__rate")))
    copies = counted.filter("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    order = F.xxhash64(F.lit(seed), F.col("__key"), F.col("__copy"))
    dealt = copies.withColumn("__order", order).repartition(shuffle_width(df.sparkSession), "__order")
    out = [F.col(f"`{c}`") for c in df.columns]
    if bookkeeping:
        out += [F.col("__rate").alias("mix_rate"), F.col("__copies").alias("mix_copies"), F.col("__copy").alias("mix_copy")]
    return dealt.sortWithinPartitions("__order").select(out)
