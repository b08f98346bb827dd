"""From checks to recommendations, from reports to batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_IMAGE_SCORE, VERDICT_RANK
from ..functions.scalars import csv_cell, lookup

EXPORT_HEADER = ("File", "Application ID", "Brand name", "Recommendation", "Summary", "Failed checks", "Checks needing review", "Seconds")


def reviewable(quality: Column) -> Column:
    return F.coalesce(~quality["too_poor_to_review"] & (quality["score"] >= MIN_IMAGE_SCORE), F.lit(False))


def verdict_count(checks: Column, verdict: str) -> Column:
    return F.size(F.filter(checks, lambda c: c["verdict"] == verdict))


def recommend(fails: Column, unreadables: Column, reviews: Column) -> Column:
    return F.when(fails > 0, "reject").when((unreadables > 0) | (reviews > 0), "needs_review").otherwise("approve")


def summarise(checks: Column) -> Column:
    """struct<recommendation, headline>: problems reject, then what is unreadable, then what needs a look."""
    fails, blind, looks = (verdict_count(checks, v) for v in ("fail", "unreadable", "review"))
    many = lambda n, one, more: F.format_string(f"%d %s", n, F.when(n == 1, one).otherwise(more))
    headline = (
        F.when(fails > 0, many(fails, "problem stands against approval", "problems stand against approval"))
        .when(blind > 0, many(blind, "item is unreadable", "items are unreadable"))
        .when(looks > 0, many(looks, "item needs a look", "items need a look"))
        .otherwise("No problem found")
    )
    return F.struct(recommend(fails, blind, looks).alias("recommendation"), headline.alias("headline"))


def override_unreviewable(quality: Column, checks: Column, summary: Column) -> dict[str, Column]:
    """Columns checks, recommendation, headline: a poor picture voids every conclusion but that a check does not apply."""
    def void(c: Column) -> Column:
        blank = c.withField("verdict", F.lit("unreadable")).withField("rule", F.lit("image-not-reviewable")).withField("explanation", F.lit("The picture is too poor for any conclusion."))
        return F.when(c["verdict"] == "not_applicable", c).otherwise(blank)

    ok = reviewable(quality)
    return {
        "checks": F.when(ok, checks).otherwise(F.transform(checks, void)),
        "recommendation": F.when(ok, summary["recommendation"]).otherwise("needs_review"),
        "headline": F.when(ok, summary["headline"]).otherwise("The picture is too poor for a review"),
    }


def explode_checks(reports: DataFrame, on: str = "filename_key") -> DataFrame:
    """One row a check: (on, check_seq, the check's fields), check_seq keeping the order."""
    numbered = F.transform("checks", lambda c, k: F.struct(k.alias("check_seq"), c.alias("check")))  # exploded as they are, they would be made again for each field
    return reports.select(on, F.explode(numbered).alias("_c")).select(on, "_c.check_seq", "_c.check.*")


def verdict_rank(verdict: Column) -> Column:
    return lookup({k: str(v) for k, v in VERDICT_RANK.items()}, verdict).cast("int")


def by_severity(checks: Column) -> Column:
    """Checks with the gravest verdict first, in order otherwise."""
    keyed = F.transform(checks, lambda c, k: F.struct(verdict_rank(c["verdict"]).alias("rank"), k.alias("seq"), c.alias("check")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.coalesce(F.nullif(x["rank"] - y["rank"], F.lit(0)), x["seq"] - y["seq"])), lambda s: s["check"])


def of_category(checks: Column, category: str) -> Column:
    return F.filter(checks, lambda c: c["category"] == category)


def has_rule(checks: Column, id: str, verdict: str, rule: str) -> Column:
    return F.exists(checks, lambda c: (c["id"] == id) & (c["verdict"] == verdict) & (c["rule"] == rule))


def item_status(items: DataFrame) -> DataFrame:
    """Adds status: failed if there is an error, done if a recommendation, queued otherwise."""
    return items.withColumn("status", F.when(F.col("error").isNotNull(), "failed").when(F.col("recommendation").isNotNull(), "done").otherwise("queued"))


def batch_summary(items: DataFrame) -> DataFrame:
    """One row of counts: approve, needs_review, reject, failed, pending."""
    done = F.col("status") == "done"
    kinds = [F.count_if(done & (F.col("recommendation") == r)).alias(r) for r in ("approve", "needs_review", "reject")]
    return items.agg(*kinds, F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "queued").alias("pending"))


def needs_attention(items: DataFrame) -> DataFrame:
    return items.where((F.col("status") == "failed") | ((F.col("status") == "done") & (F.col("recommendation") != "approve")))


def ready_counts(items: DataFrame, application: str = "application_id") -> DataFrame:
    there = F.col(application).isNotNull()
    return items.agg(F.count_if(there & (F.col("status") == "queued")).alias("ready"), F.count_if(~there).alias("unmatched"))


def export_rows(items: DataFrame) -> DataFrame:
    """The eight columns of a batch's export, one row an item that failed or has a report, as strings."""
    listed = lambda *verdicts: F.array_join(F.transform(F.filter("checks", lambda c: c["verdict"].isin(*verdicts)), lambda c: F.concat_ws(": ", c["name"], c["explanation"])), " | ")
    failed = F.col("status") == "failed"
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cols = [
        text("filename"), text("application_id"), text("brand_name"), F.when(failed, "ERROR").otherwise(F.col("recommendation")), F.when(failed, text("error")).otherwise(F.col("headline")),
        F.when(failed, "").otherwise(listed("fail")), F.when(failed, "").otherwise(listed("review", "unreadable")), F.format_string("%.1f", F.coalesce(F.col("elapsed_ms"), F.lit(0)) / 1000.0),
    ]
    return items.where(F.col("status") != "queued").select(*[c.alias(n) for c, n in zip(cols, EXPORT_HEADER, strict=True)])


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): each row's cells, guarded and quoted, with commas between."""
    return rows.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`").cast("string")) for c in rows.columns]).alias("line"))
