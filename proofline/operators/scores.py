"""Comparing results with what was expected, and readers with one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse_whitespace, normalized


def upper_median(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, median): the value at index floor(n / 2) in rising order, not a mean of two; nulls come first.

    Equal values are counted before anything is moved, so that a group is as many rows as it has values.
    """
    w = Window.partitionBy(*key)
    counts = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_half": F.floor(F.sum("_c").over(w) / 2)})
    return counts.where((F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_c") <= F.col("_half"))).select(*key, F.col(value).alias("median"))


def same_reading(a: Column, b: Column) -> Column:
    """Equality in compatibility form, whatever the case, spaces and apostrophes."""
    fold = lambda c: F.lower(collapse_whitespace(F.translate(normalized(c, "NFKC"), "‘’", "''")))
    return F.coalesce(fold(a) == fold(b), a.isNull() & b.isNull())


def scorecard(readings: DataFrame, truth: DataFrame, fields: list[str], model: str = "model", sample: str = "sample_id", elapsed: str = "elapsed_ms") -> DataFrame:
    """(model, correct, total, accuracy, median_ms, worst_ms) of readers on samples whose text is known."""
    joined = readings.join(truth.select(sample, *[F.col(f).alias(f"_t_{f}") for f in fields]), sample)
    right = sum((same_reading(F.col(f), F.col(f"_t_{f}")).cast("int") for f in fields), F.lit(0))
    scored = joined.withColumn("_right", right)
    sums = scored.groupBy(model).agg(F.sum("_right").alias("correct"), (F.count(F.lit(1)) * len(fields)).alias("total"), F.max(elapsed).alias("worst_ms"))
    return sums.join(upper_median(scored, [model], elapsed).withColumnRenamed("median", "median_ms"), model).select(model, "correct", "total", (F.col("correct") / F.col("total")).alias("accuracy"), "median_ms", "worst_ms")


def against_expected(reports: DataFrame, expected: DataFrame, on: str = "sample_id") -> DataFrame:
    """(on, recommendation, expected, matched) of each expected sample; one without report does not match."""
    want = expected.select(on, F.col("recommendation").alias("expected"))
    return want.join(reports.select(on, "recommendation"), on, "left").withColumn("matched", F.coalesce(F.col("recommendation") == F.col("expected"), F.lit(False)))


def totals(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count_if("matched").alias("passed"), F.count_if(~F.col("matched")).alias("failed"))


def unknown_ids(expected: DataFrame, checks: DataFrame, id_col: str = "id") -> DataFrame:
    """Check ids that are expected but never given."""
    return expected.select(id_col).distinct().join(checks.select(id_col).distinct(), id_col, "left_anti")
