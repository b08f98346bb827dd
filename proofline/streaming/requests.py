"""Requests as a stream: limited, gated, parsed, verified and answered, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import RATE_LIMIT, RATE_WINDOW_MS
from ..operators.rules import verify_pairs
from ..schemas import APPLICATION
from ..sources.readers import parse_applications, parse_extractions, request_error
from ..sources.shared import evenly
from ..sources.sinks import responses
from .limits import rate_limit, rate_limit_stream

REQUEST = "request_id long, key string, at_ms long, content binary, mime string, application string, reading string, reader string, elapsed_ms long"
CARRIED = ("refused", "application", "reading", "reader", "elapsed_ms")
REPORT = ("recommendation", "headline", "checks", "image_quality", "notes", "warning_diff", "extraction_ms", "reader")


def gated(requests: DataFrame) -> DataFrame:
    """Requests with why they are refused before anything is parsed, without their pictures, which go no further."""
    refused = request_error(F.col("content"), F.col("mime"), F.col("application"))
    return requests.select("request_id", "key", "at_ms", refused.alias("refused"), *CARRIED[1:])


def answered(limited: DataFrame) -> DataFrame:
    """(request_id, status, body, retry_after) of gated requests that a limiter has looked at.

    `reading` is what the reader returned, as JSON; a reading that is missing or not valid is the reader's failure.
    Rows are dealt out evenly, whichever clients they are of; those that are refused or failed are not verified.
    """
    limited = evenly(limited)
    step = limited.withColumns({"a": parse_applications(F.col("application")), "e": parse_extractions(F.coalesce("reading", F.lit("")))})
    fields = [c.split()[0] for c in APPLICATION.split(", ")]
    read = [f for f in step.schema["e"].dataType["value"].dataType.names if f not in ("extraction_ms", "reader")]
    step = step.select(
        "request_id", "allowed", "retry_after_seconds", F.coalesce("refused", F.col("a.error")).alias("error"), F.col("e.error").alias("unread"),
        F.col("a.value").alias("a"), F.col("e.value").alias("e"), F.col("elapsed_ms").alias("extraction_ms"), "reader",
    )
    judged = F.coalesce(F.col("allowed") & F.col("error").isNull() & F.col("unread").isNull(), F.lit(False))
    step = step.withColumns({c: F.when(judged, F.col(c)) for c in ("a", "e")})
    step = step.select("*", *[F.col(f"a.{c}").alias(f"a_{c}") for c in fields], *[F.col(f"e.{f}").alias(f) for f in read]).drop("a", "e")
    reports = verify_pairs(step, "request_id", keep=["allowed", "retry_after_seconds", "error", "unread"])
    rows = reports.withColumns({
        "report": F.struct(*REPORT),
        "retry_after": F.when(~F.col("allowed"), F.col("retry_after_seconds")),
        "failure": F.when(F.col("unread").isNotNull(), F.struct(F.lit("reader").alias("kind"), F.col("unread").alias("message"), F.lit(True).alias("retryable"))),
    })
    return responses(rows, failure="failure", retry_after="retry_after", keep=["request_id"])


def answer_table(requests: DataFrame, limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS) -> DataFrame:
    """The answers to a table of requests (REQUEST), in order of their time."""
    given = gated(requests)
    limited = rate_limit(given, limit, window_ms).select("request_id", "allowed", "retry_after_seconds")
    return answered(given.join(limited, "request_id"))


def answer_stream(requests: DataFrame, path: str, checkpoint: str, limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS, shards: int = 64) -> StreamingQuery:
    """Start a stream of requests (REQUEST) whose answers land in Parquet under `path`, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each request has one answer. The limiter's
    state is the stream's; the rest of a batch is what answered() does. Needs the RocksDB state store.
    """
    limited = rate_limit_stream(gated(requests), limit, window_ms, carry=CARRIED, shards=shards)

    def land(batch: DataFrame, number: int) -> None:
        answered(batch).write.mode("overwrite").parquet(f"{path}/batch={number:010d}")

    return limited.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
