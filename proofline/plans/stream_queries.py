"""Whole paths: applications and readings from tables of their own, and requests as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..schemas import APPLICATION, EXTRACTION
from ..sources.shared import shared_folder
from ..streaming.requests import answer_stream
from .base import query
from .label_queries import PAIRS, readings, two

FILED = [f"a_{c.split()[0]}" for c in APPLICATION.split(", ") if c != "ttb_id string"]
#: Some readings have no application and some applications no reading; the application of part 1 has readings for a third of all parts.
ONE_PAIR = f"SELECT p_partkey AS filename_key, {', '.join(FILED)} FROM ({PAIRS}) AS p WHERE p_partkey % 10 <> 9 UNION ALL SELECT -p_partkey, {', '.join(FILED)} FROM ({PAIRS}) AS p WHERE p_partkey % 10 = 3"
READ = "v, a_class_type, a_is_import, brand, alcohol, volume, bottler, warning, picture, sure"
READINGS = f"SELECT p_partkey AS filename_key, {READ} FROM ({PAIRS}) AS p WHERE p_partkey % 10 <> 8 UNION ALL SELECT h.filename_key, {', '.join(f'h.{c}' for c in READ.split(', '))} FROM (SELECT p_partkey AS filename_key, {READ} FROM ({PAIRS}) AS p WHERE p_partkey = 1) AS h, {{part}} AS t WHERE t.p_partkey % 3 = 0"


@two(
    "verify_filed", ONE_PAIR, READINGS,
    """SELECT a.filename_key, a.a_application_id AS application_id, CASE WHEN v IN (2, 5) THEN 'reject' WHEN v IN (4, 6, 7) THEN 'needs_review' ELSE 'approve' END AS recommendation,
        CAST(CASE a_beverage_type WHEN 'malt_beverage' THEN 10 ELSE 11 END AS INT) AS checks, count(*) AS n FROM a JOIN b USING (filename_key) GROUP BY ALL""",
)
def _filed(a: DataFrame, b: DataFrame) -> DataFrame:
    applications = a.withColumnsRenamed({c: c.removeprefix("a_") for c in FILED})
    columns = ["filename_key", *[c.split(" ", 1)[0] for c in EXTRACTION.split(", ")]]
    reports = rules.verify_labels(applications, readings(b).select(*columns))
    return reports.groupBy("filename_key", "application_id", "recommendation", F.size("checks").alias("checks")).agg(F.count(F.lit(1)).alias("n"))


#: Seven clients, a request each 70 ms; of a window of 600 ms the limiter admits five, so four of nine are refused.
REQUESTS = """SELECT k AS request_id, concat('c', CAST(k % 7 AS STRING)) AS key, CAST(k * 10 AS BIGINT) AS at_ms, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'plain text data' ELSE 'GIF89a......' END AS content, 'text/plain' AS mime,
        CASE k % 6 WHEN 1 THEN '{oops' ELSE concat('{"beverageType":"wine","brandName":"', c_name, '","classType":"Red"}') END AS application, CASE k % 11 WHEN 3 THEN NULL ELSE '{"brand_name":{"text":"Quite Other","confidence":0.9}}' END AS reading
    FROM (SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS k, c_name FROM {customer}) AS c"""


@query(
    REQUESTS,
    """, placed AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY at_ms) - 1) % 9 AS place FROM given),
    told AS (SELECT *, CASE WHEN place >= 5 THEN 429 WHEN request_id % 5 < 2 OR request_id % 6 = 1 THEN 400 WHEN reading IS NULL THEN 503 ELSE 200 END AS status FROM placed)
    SELECT request_id, CAST(status AS INT) AS status, CAST(CASE WHEN status = 429 THEN 1 END AS BIGINT) AS retry_after, CASE WHEN status = 200 THEN 'reject' END AS recommendation,
        CASE status WHEN 429 THEN 'rate_limited' WHEN 400 THEN 'bad_request' WHEN 503 THEN 'reader_failed' END AS error FROM told""",
)
def request_stream(d: DataFrame) -> DataFrame:
    spark, folder = d.sparkSession, f"{shared_folder(d.sparkSession)}/proofline-{uuid.uuid4().hex}"
    rows = d.withColumns({"content": F.encode("content", "UTF-8"), "reader": F.lit("table"), "elapsed_ms": F.lit(900).cast("long")})
    rows.write.parquet(f"{folder}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        answer_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/state", 5, 600, shards=4).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    told = spark.read.parquet(f"{folder}/out")
    said = lambda path: F.get_json_object("body", path)
    return told.select("request_id", "status", "retry_after", said("$.report.recommendation").alias("recommendation"), said("$.error").alias("error"))
