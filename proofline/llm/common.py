"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words as every contract of this subpackage defines them: runs without ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver imported it from."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local one is set only where that is unset and the master is local."""
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if (now := sc._jsc.sc().getCheckpointDir()).isDefined():
        return now.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(where := tempfile.mkdtemp(prefix="proofline-"))
    return where


def written(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/proofline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of earlier steps: it does so once the driver has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unsigned_crc(text: Column) -> Column:
    return F.crc32(text.cast("string").cast("binary"))


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; what Arrow and the C library keep for reuse is given back at the end of the task."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release(collect: bool = False) -> None:
    """Give memory that is free back to the system: processes live on, and executors and the driver have little room."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows whose text `keep` accepts, with all columns as they are: no shuffle, whatever ids are null or repeated."""
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_())).rename_columns(names)

    return docs.mapInArrow(run, schema)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of equal names, null to null; the keys of `left` stay."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"__right_{k}" for k in keys])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, to: str, least_rows: int = 1_000, rows: int | None = None) -> DataFrame:
    """Adds `to`: the sum of `value` over the earlier rows of the group.

    Earlier is by a hash of the order columns, then by them. A group is cut into chunks of about the square root of
    all rows, `least_rows` at least, so that a hot group is summed by many tasks; then only chunk totals meet, about
    as many. At 10^10 rows either is 10^5.
    """
    many = df.count() if rows is None else rows
    n = max(1, many // max(least_rows, math.isqrt(many)))
    df = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(n)))
    keys = [*group, "__chunk"]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = null_safe_join(df, totals, keys, "left").withColumn(to, (F.col("__inside") + F.col("__base")).cast("long"))
    return out.drop("__chunk", "__inside", "__base")
