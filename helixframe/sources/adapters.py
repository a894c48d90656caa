"""Genome-coordinate views over the given tables.

Coordinates are half-open and 0-based: chrom, start_pos, end_pos. Each view has a Spark form and the
same definition as a DuckDB common table expression, by which results are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chrom_of(number: Column) -> Column:
    """One of five contigs."""
    return F.concat(F.lit("chr"), (F.lit(1) + number % 5).cast("string"))


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint bins with gaps: GC percent and a count of hits."""
    hits = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("hits"))
    part = read(spark, sf_dir, "part")
    joined = part.join(hits, part.p_partkey == hits.l_partkey, "left")
    return joined.select(
        chrom_of(F.col("p_partkey")).alias("chrom"),
        (F.col("p_partkey") * 1000).cast("long").alias("start_pos"),
        (F.col("p_partkey") * 1000 + 500 + F.col("p_size") * 10).cast("long").alias("end_pos"),
        (F.lit(40) + F.col("p_size") % 11).cast("int").alias("gc"),
        F.coalesce("hits", F.lit(0)).cast("double").alias("cnt"),
    )


def sample_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of three samples; a sample lacks the bins in which it has no hits."""
    line = read(spark, sf_dir, "lineitem")
    hits = line.groupBy("l_partkey", F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sample")).agg(
        F.count(F.lit(1)).alias("hits")
    )
    part = read(spark, sf_dir, "part")
    return part.join(hits, part.p_partkey == hits.l_partkey).select(
        "sample", chrom_of(F.col("p_partkey")).alias("chrom"),
        (F.col("p_partkey") * 1000).cast("long").alias("start_pos"),
        (F.col("p_partkey") * 1000 + 500 + F.col("p_size") * 10).cast("long").alias("end_pos"),
        (F.lit(40) + F.col("p_size") % 11).cast("int").alias("gc"), F.col("hits").cast("double").alias("cnt"),
    )


def step_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that three samples share; each has stretches of ten bins with fewer or more copies, some of them common."""
    part = read(spark, sf_dir, "part").withColumns({"s": F.explode(F.sequence(F.lit(0), F.lit(2))), "block": F.expr("p_partkey div 50")})
    even, third = F.col("block") % 4, F.col("block") % 6
    cn = F.when((F.col("s") == 0) & (even == 1), 3).when((F.col("s") == 1) & (even == 2), 1).when((F.col("s") == 2) & (third == 3), 4).when(third == 5, 0).otherwise(2)
    noise = (F.col("p_size") * 7 + F.col("s") * 13 + F.col("p_partkey") * 3) % 11 - 5
    return part.select(
        F.concat(F.lit("s"), F.col("s").cast("string")).alias("sample"), chrom_of(F.col("p_partkey")).alias("chrom"),
        (F.col("p_partkey") * 1000).cast("long").alias("start_pos"), (F.col("p_partkey") * 1000 + 900).cast("long").alias("end_pos"),
        F.greatest(F.lit(0), 30 * cn + noise).cast("double").alias("cnt"),
    )


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous bins with a copy number and a score, and sparse GC classes."""
    return read(spark, sf_dir, "part").select(
        chrom_of(F.col("p_partkey")).alias("chrom"),
        F.expr("(p_partkey div 5) * 1000").cast("long").alias("start_pos"),
        F.expr("(p_partkey div 5) * 1000 + 1000").cast("long").alias("end_pos"),
        (F.lit(30) + F.col("p_size") % 50).cast("int").alias("gc"), F.col("p_retailprice").alias("cnt"),
        (F.col("p_size") % 4).cast("int").alias("cn"), (F.col("p_size") % 7).cast("double").alias("q"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant sites with reference and alternate read counts."""
    return read(spark, sf_dir, "events").filter("value is not null").select(
        chrom_of(F.col("user_id")).alias("chrom"), (F.col("event_id") * 200).cast("long").alias("pos"),
        F.floor("value").cast("int").alias("ref_count"), (F.col("event_id") % 37).cast("int").alias("alt_count"),
        F.col("event_type").alias("filt"),
    )


def intervals(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """Intervals with a copy number; status O stands for truth, F for calls, P for exclusions."""
    orders = read(spark, sf_dir, "orders")
    if status:
        orders = orders.filter(F.col("o_orderstatus") == status)
    return orders.select(
        F.col("o_orderkey").alias("iv_id"), chrom_of(F.col("o_custkey")).alias("chrom"),
        (F.col("o_orderkey") * 130).cast("long").alias("start_pos"),
        (F.col("o_orderkey") * 130 + 100 + F.col("o_custkey") % 900).cast("long").alias("end_pos"),
        (F.col("o_orderkey") % 6).cast("int").alias("cn"), F.col("o_orderstatus").alias("st"),
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned reads: sample, contig, 0-based position, mapping quality, flags, fragment length."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("sample"),
        chrom_of(F.col("l_suppkey")).alias("chrom"),
        (F.col("l_partkey") * 1000 + (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 900).cast("long").alias("pos"),
        F.col("l_quantity").cast("int").alias("mapq"), (F.col("l_returnflag") == "R").alias("is_dup"),
        (F.col("l_linestatus") == "O").alias("is_forward"),
        (F.lit(100) + F.col("l_orderkey") % 300).cast("int").alias("frag_len"), F.col("l_orderkey").alias("read_id"),
        F.col("l_linenumber").alias("mate"),
    )


#: Letters of a sequence made from text: fixed values of the adapter.
BASES = ("ETAOINetaoin", "ACGTACacgtac")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nucleotide sequence for every document, other letters stay as they are."""
    text = F.translate("text", *BASES)
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), text.alias("seq"))


#: Every letter and the blank of a text as a base, so that long words of bases occur.
_LATIN = "abcdefghijklmnopqrstuvwxyz"
LETTERS = (_LATIN + _LATIN.upper() + " ", "".join("acgt"[k % 4] for k in range(26)) + "".join("ACGT"[k % 4] for k in range(26)) + "a")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nucleotide sequence for every document, broken by signs and digits only."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.translate("text", *LETTERS).alias("seq"))


_CHROM = "concat('chr', CAST(1 + {} % 5 AS VARCHAR))"
CTES = {
    "bins": f"""bins AS (SELECT {_CHROM.format('p.p_partkey')} AS chrom, CAST(p.p_partkey * 1000 AS BIGINT) AS start_pos,
        CAST(p.p_partkey * 1000 + 500 + p.p_size * 10 AS BIGINT) AS end_pos, CAST(40 + p.p_size % 11 AS INT) AS gc,
        CAST(coalesce(l.hits, 0) AS DOUBLE) AS cnt
        FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS hits FROM lineitem GROUP BY l_partkey) l
        ON p.p_partkey = l.l_partkey)""",
    "sample_bins": f"""sample_bins AS (SELECT l.sample, {_CHROM.format('p.p_partkey')} AS chrom,
        CAST(p.p_partkey * 1000 AS BIGINT) AS start_pos, CAST(p.p_partkey * 1000 + 500 + p.p_size * 10 AS BIGINT) AS end_pos,
        CAST(40 + p.p_size % 11 AS INT) AS gc, CAST(l.hits AS DOUBLE) AS cnt
        FROM part p JOIN (SELECT l_partkey, concat('s', CAST(l_suppkey % 3 AS VARCHAR)) AS sample, count(*) AS hits
                          FROM lineitem GROUP BY 1, 2) l ON p.p_partkey = l.l_partkey)""",
    "step_bins": f"""step_bins AS (SELECT 's' || CAST(s AS VARCHAR) AS sample, {_CHROM.format('p_partkey')} AS chrom, CAST(p_partkey * 1000 AS BIGINT) AS start_pos, CAST(p_partkey * 1000 + 900 AS BIGINT) AS end_pos,
        CAST(greatest(0, 30 * CASE WHEN s = 0 AND (p_partkey // 50) % 4 = 1 THEN 3 WHEN s = 1 AND (p_partkey // 50) % 4 = 2 THEN 1 WHEN s = 2 AND (p_partkey // 50) % 6 = 3 THEN 4 WHEN (p_partkey // 50) % 6 = 5 THEN 0 ELSE 2 END
            + (p_size * 7 + s * 13 + p_partkey * 3) % 11 - 5) AS DOUBLE) AS cnt FROM part, range(3) r(s))""",
    "tiles": f"""tiles AS (SELECT {_CHROM.format('p_partkey')} AS chrom, CAST((p_partkey // 5) * 1000 AS BIGINT) AS start_pos,
        CAST((p_partkey // 5) * 1000 + 1000 AS BIGINT) AS end_pos, CAST(30 + p_size % 50 AS INT) AS gc,
        p_retailprice AS cnt, CAST(p_size % 4 AS INT) AS cn, CAST(p_size % 7 AS DOUBLE) AS q FROM part)""",
    "sites": f"""sites AS (SELECT {_CHROM.format('user_id')} AS chrom, CAST(event_id * 200 AS BIGINT) AS pos,
        CAST(floor(value) AS INT) AS ref_count, CAST(event_id % 37 AS INT) AS alt_count, event_type AS filt
        FROM events WHERE value IS NOT NULL)""",
    "intervals": f"""intervals AS (SELECT o_orderkey AS iv_id, {_CHROM.format('o_custkey')} AS chrom,
        CAST(o_orderkey * 130 AS BIGINT) AS start_pos, CAST(o_orderkey * 130 + 100 + o_custkey % 900 AS BIGINT) AS end_pos,
        CAST(o_orderkey % 6 AS INT) AS cn, o_orderstatus AS st FROM orders),
        truth AS (SELECT * FROM intervals WHERE st = 'O'), calls AS (SELECT * FROM intervals WHERE st = 'F'),
        excl AS (SELECT * FROM intervals WHERE st = 'P')""",
    "alignments": f"""alignments AS (SELECT concat('s', CAST(l_suppkey % 3 AS VARCHAR)) AS sample,
        {_CHROM.format('l_suppkey')} AS chrom,
        CAST(l_partkey * 1000 + (l_orderkey * 37 + l_linenumber * 11) % 900 AS BIGINT) AS pos,
        CAST(l_quantity AS INT) AS mapq, l_returnflag = 'R' AS is_dup, l_linestatus = 'O' AS is_forward,
        CAST(100 + l_orderkey % 300 AS INT) AS frag_len, l_orderkey AS read_id, l_linenumber AS mate FROM lineitem)""",
    "sequences": """sequences AS (SELECT doc_id AS seq_id, translate(text, 'ETAOINetaoin', 'ACGTACacgtac') AS seq FROM documents)""",
    "contigs": f"""contigs AS (SELECT doc_id AS seq_id, translate(text, '{LETTERS[0]}', '{LETTERS[1]}') AS seq FROM documents)""",
}


def sql(body: str, *views: str) -> str:
    """A DuckDB query with the named views before it; ``body`` may begin with further ones."""
    return "WITH " + ",\n".join(CTES[v] for v in views) + ("\n" if not body.lstrip().startswith(",") else "") + body
