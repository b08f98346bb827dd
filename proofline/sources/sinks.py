"""Writing: CSV lines, text reports, archives, responses."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import lookup
from ..functions.text import slug, wrap
from ..operators.rollup import csv_lines, of_category

#: How verdicts and recommendations read in a printed record, and on a screen.
VERDICT_WORDS = {"pass": "MATCHES", "review": "CHECK BY EYE", "fail": "PROBLEM", "unreadable": "COULD NOT READ", "not_applicable": "NOT REQUIRED"}
SCREEN_WORDS = {"pass": "Matches", "review": "Check by eye", "fail": "Problem", "unreadable": "Could not read", "not_applicable": "Not required"}
RECOMMENDATION_WORDS = {"approve": "NO PROBLEMS FOUND", "needs_review": "NEEDS REVIEW BY AN AGENT", "reject": "PROBLEMS FOUND"}
RECOMMENDATION_VERDICT = {"approve": "pass", "reject": "fail", "needs_review": "review"}
LINE = 78


def write_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """Cells as csv_lines() guards them, CR LF between lines; a file for each partition with rows, each with the header."""
    lines = csv_lines(rows)
    if header:
        names = csv_lines(rows.sparkSession.range(1).select(*[F.lit(c).alias(c) for c in rows.columns])).first()[0]

        def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = True
            for b in batches:
                if first and b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([names], b.column(0).type)], schema=b.schema)
                    first = False
                yield b

        lines = lines.mapInArrow(headed, "line string")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def filed_fields(a: Column) -> Column:
    """array<struct<label, value>> of what was filed, blanks left out."""
    pairs = [
        ("Application reference", a["application_id"]), ("TTB ID", a["ttb_id"]), ("Beverage type", F.replace(a["beverage_type"], F.lit("_"), F.lit(" "))), ("Brand name", a["brand_name"]), ("Class / type", a["class_type"]),
        ("Alcohol content", a["alcohol_content"]), ("Net contents", a["net_contents"]), ("Bottler / producer", a["bottler_name"]), ("Trade name on label", a["label_company_name"]), ("Country of origin", a["country_of_origin"]),
        ("Imported", F.when(a["is_import"], "yes").otherwise("no")),
    ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in pairs]), lambda p: F.coalesce(p["value"] != "", F.lit(False)))


def padded(c: Column, width: int) -> Column:
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def utc(at: Column | str, pattern: str) -> Column:
    """A time as UTC has it, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), pattern)


def provenance(check: Column) -> Column:
    """The regulation, rule and confidence of a check in one line."""
    sure = F.concat(F.lit("Reading confidence: "), F.floor(check["confidence"] * 100 + 0.5).cast("string"), F.lit("%"))
    return F.concat_ws("   ", F.concat(F.lit("Regulation: "), check["citation"]), F.concat(F.lit("Rule: "), check["rule"]), sure)


def report_text(application: Column, report: Column, filename: Column, at: Column) -> Column:
    """The printed record of one label: result, what was filed, the checks in two groups, the picture, notes."""
    rule, thick = F.lit("-" * LINE), F.lit("=" * LINE)
    line = lambda label, value: F.concat(F.lit(f"{label + ':':<19}"), value)
    join = lambda *parts: F.concat_ws("\n", *parts)

    def one(c: Column) -> Column:
        return join(
            F.concat(F.lit("  ["), lookup(VERDICT_WORDS, c["verdict"]), F.lit("]  "), c["name"]),
            F.concat(F.lit("      Application says: "), c["expected"]),
            F.concat(F.lit("      Label shows:      "), c["found"]),
            wrap(c["explanation"], 70, "      "),
            F.concat(F.lit("      "), provenance(c), F.lit("\n")),
        )

    def group(title: str, category: str) -> Column:
        checks = of_category(report["checks"], category)
        return F.when(F.size(checks) > 0, join(rule, F.lit(title), rule, F.lit(""), F.array_join(F.transform(checks, one), "\n")))

    quality, notes = report["image_quality"], report["notes"]
    bullet = lambda items: F.array_join(F.transform(items, lambda x: wrap(F.concat(F.lit("- "), x), 74, "  ")), "\n")
    poor = F.when(shows_quality(quality), join(rule, F.lit("PHOTOGRAPH QUALITY"), rule, F.concat(F.lit("  Score: "), F.format_string("%.2f", quality["score"])), F.nullif(bullet(quality["issues"]), F.lit("")), F.lit("")))
    return F.concat(
        join(
            thick, F.lit("VERIFICATION RECORD"), thick, F.lit(""), line("Result", lookup(RECOMMENDATION_WORDS, report["recommendation"])), wrap(report["headline"], 60, " " * 19), F.lit(""),
            line("Generated", utc(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), line("Label artwork", filename), line("Reader", report["reader"]), line("Time taken", F.format_string("%.1fs", report["extraction_ms"] / 1000.0)), F.lit(""),
            rule, F.lit("APPLICATION AS FILED"), rule, F.array_join(F.transform(filed_fields(application), lambda p: F.concat(F.lit("  "), padded(p["label"], 22), F.lit(" "), p["value"])), "\n"), F.lit(""),
            group("COMPARED WITH THE APPLICATION", "match"), group("REQUIRED BY REGULATION", "compliance"), poor,
            F.when(F.size(notes) > 0, join(rule, F.lit("OTHER OBSERVATIONS"), rule, bullet(notes), F.lit(""))),
            thick, F.lit("Advisory only: a compliance agent decides every application."), thick,
        ),
        F.lit("\n"),
    )


def archive(names: list[str], contents: list[bytes], at: pd.Timestamp) -> bytes:
    """A store-only archive that is the same for the same input."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in zip(names, contents, strict=True):
            info = zipfile.ZipInfo(name, (max(1980, at.year), at.month, at.day, at.hour, at.minute, at.second // 2 * 2))
            info.flag_bits |= 0x800
            z.writestr(info, data)
    return out.getvalue()


@F.pandas_udf(T.BinaryType())
def zip_entries(names: pd.Series, contents: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([archive(list(n), [bytes(x) for x in c], t) for n, c, t in zip(names, contents, at, strict=True)])


def case_files(rows: DataFrame, application: str = "application", report: str = "report", image: str = "content", filename: str = "filename", at: str = "at", keep: Sequence[str] = ()) -> DataFrame:
    """(keep, name, bytes): an archive for each row of record, its data and the picture, named by reference and day."""
    a, r = F.col(application), F.col(report)
    data = F.to_json(F.struct(utc(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"), a.alias("application"), r.alias("report")), {"pretty": "true"})
    name = F.concat(F.lit("label-check-"), slug(F.coalesce(a["application_id"], a["brand_name"])), F.lit("-"), utc(at, "yyyy-MM-dd"), F.lit(".zip"))
    contents = F.array(F.encode(report_text(a, r, F.col(filename), F.col(at)), "UTF-8"), F.encode(data, "UTF-8"), F.col(image))
    return rows.select(*keep, name.alias("name"), zip_entries(F.array(F.lit("report.txt"), F.lit("report.json"), F.col(filename)), contents, F.to_utc_timestamp(at, F.current_timezone())).alias("bytes"))


def responses(rows: DataFrame, report: str = "report", error: str = "error", reader: str = "reader", usage: str | None = None, failure: str | None = None, retry_after: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, status int, body string, retry_after long) of each request: refused and failed rows stay rows.

    429 where `retry_after` (seconds) is not null, 400 where `error` is not; `failure`, a struct (kind, message,
    retryable), gives 503 or 500 as a reader's failure may be retried or not, and 500 for any other kind. Else 200
    with the report, its reader, and what it used.
    """
    json = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    name, wrong = F.col(reader), F.col(error)
    wait = F.col(retry_after).cast("long") if retry_after else F.lit(None).cast("long")
    shown = {"report": F.col(report), "readerId": name, "isDemoReader": name == "mock"} | ({"usage": F.col(usage)} if usage else {})
    status = F.when(wait.isNotNull(), 429).when(wrong.isNotNull(), 400)
    body = F.when(wait.isNotNull(), json(error=F.lit("rate_limited"), message=F.format_string("Too many labels at once. Try again in %d seconds.", wait))).when(wrong.isNotNull(), json(error=F.lit("bad_request"), message=wrong))
    if failure:
        f = F.col(failure)
        by_reader, again = f["kind"] == "reader", F.coalesce(f["retryable"], F.lit(False))
        status = status.when(f.isNotNull() & by_reader, F.when(again, 503).otherwise(500)).when(f.isNotNull(), 500)
        body = body.when(f.isNotNull() & by_reader, json(error=F.lit("reader_failed"), message=f["message"], retryable=again))
        body = body.when(f.isNotNull(), json(error=F.lit("internal_error"), message=F.lit("The check failed. Try again."), retryable=F.lit(True)))
    return rows.select(*keep, status.otherwise(200).alias("status"), body.otherwise(json(**shown)).alias("body"), wait.alias("retry_after"))


def shows_quality(quality: Column) -> Column:
    """Whether a report has a part on the picture: if something was noted, or it is too poor."""
    return (F.size(quality["issues"]) > 0) | quality["too_poor_to_review"]
