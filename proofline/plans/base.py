"""Registered queries: an operator over columns derived from the test tables, and SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derivation that Spark and the oracle's engine both read: {name} stands for the table of that name."""
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def spread(d: DataFrame) -> DataFrame:
    """Rows of a table that has fewer splits than there are cores, dealt to all of them: for rules that take long a row.

    What a large table has in splits is more than that; it stays as it is, without a shuffle.
    """
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def query(inputs: str, oracle: str | None = None):
    """Registers a function from the derived rows; `oracle` reads them as `given`."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(derived(spark, sf_dir, inputs))
        if oracle:
            ORACLES[f.__name__] = f"WITH RECURSIVE given AS ({re.sub(r'\{(\w+)\}', r'\1', inputs)}){oracle if oracle.startswith(',') else ' ' + oracle}"
        return f

    return register
