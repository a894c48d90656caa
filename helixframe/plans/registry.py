"""The registered queries over the given tables, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    count_queries, haplotype_queries, interval_queries, model_queries, more_queries, quality_queries, segment_queries,
    somatic_queries, stat_queries,
)

_MODULES = (
    interval_queries, stat_queries, count_queries, segment_queries, model_queries, more_queries, quality_queries, haplotype_queries,
    somatic_queries,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["j02_excluded_bins"](spark, sf_dir)
