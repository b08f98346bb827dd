"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
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


def write_shared(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/proofline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def evenly(rows: DataFrame) -> DataFrame:
    """Rows dealt out in turn, so that rules that take long a row are the work of all cores, however few or unequal the parts that hold them."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
