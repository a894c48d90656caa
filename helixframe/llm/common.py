"""Shared helpers of the text operators: where intermediate tables go, and how tables are read."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session gets a folder of its own; a cluster session is refused,
    as a local folder of one machine is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-helix-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Cuts the lineage in a way that survives the loss of executors, and gives the optimizer the
    table's real size, by which it decides whether a side may be broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helix-{tag}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key filter has so many bits for each key, within these limits (the upper one is 16 MB of bits).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


def key_filter(keys: DataFrame, column: str):
    """A test, for Columns of longs, that is true for every value of ``column`` and few others.

    One bit of an array is set for each key; the array grows with the number of keys up to
    MOST_BITS. Rows that fail the test need not go through a join with the keys, so the test saves
    shuffling and never decides. Above some 10^8 keys most rows pass, and the join then shuffles
    about the whole table, once; results stay the same.
    """
    spark = keys.sparkSession
    bits = LEAST_BITS
    wanted = keys.count() * BITS_A_KEY
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col(column), F.lit(bits))
    words = (
        keys.filter(F.col(column).isNotNull()).select(F.floor(place / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )  # at most MOST_BITS / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_have(values: pd.Series) -> pd.Series:
        at = values.to_numpy(np.int64) & (bits - 1)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    return may_have


def heavy_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: float, most: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``key`` and, in ``count``, how many of
    the ``total`` rows bear it. Keys of over 1/most of the rows, ``most`` at most, are broadcast."""
    heavy = table.filter(F.col(count) > total / most)
    light = table.filter(F.col(count) <= total / most)
    named = heavy.select(F.col(key).alias("__key"))
    others = rows.join(F.broadcast(named), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(others.join(light, key))


#: Settings of the batches that go to Python workers, and the most rows and bytes of one.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


@contextmanager
def narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs inside, as texts are long and a worker holds a batch several
    times over. Lower settings stay as they are, and all are put back at the end."""
    before = {name: spark.conf.get(name, None) for name in _BATCH}
    for name, most in _BATCH.items():
        now = int(re.sub(r"\D+$", "", before[name] or "") or 0)
        if now <= 0 or now > most:
            spark.conf.set(name, most)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("helix-"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_memory() -> None:
    """Hand a Python worker's freed memory back to the system between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
