"""Requests from files through the stream, against the table's answers."""

import json

import pytest
from proofline.constants import STATUTORY_WARNING
from proofline.streaming import limits, requests
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20


def reading(brand, sure=0.9):
    said = lambda t: {"text": t, "confidence": sure}
    warning = said(STATUTORY_WARNING) | {"header_is_all_caps": True, "header_is_bold": True, "legible_size": True}
    picture = {"score": 0.9, "issues": [], "too_poor_to_review": False}
    return json.dumps({"brand_name": said(brand), "class_type": said("Gin"), "alcohol_content": said("45%"), "net_contents": said("750 mL"), "bottler_name": said("Ash Distillery"), "government_warning": warning, "image_quality": picture, "label_legibility": {"score": 0.9, "below_ordinary_eyesight": False, "issues": []}, "notes": []})


def rows():
    out = []
    for k in range(60):
        filed = json.dumps({"beverageType": "distilled_spirits", "brandName": f"Ash {k}", "classType": "Gin", "alcoholContent": "45%", "netContents": "750 mL", "bottlerName": "Ash Distillery"})
        content = b"" if k % 7 == 1 else b"text" * 9 if k % 7 == 2 else PNG
        application = None if k % 11 == 3 else "{oops" if k % 11 == 4 else filed
        read = None if k % 13 == 5 else reading(f"Ash {k}" if k % 5 else "Quite Other")
        out.append((k, "busy" if k % 2 else f"c{k % 6}", 100 * k, bytearray(content), "image/tiff", application, read, "table", 900))
    return out


def seen(df):
    return sorted((r.request_id, r.status, r.body, r.retry_after) for r in df.select("request_id", "status", "body", "retry_after").collect())


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_restarted_stream_answers_each_request_once(spark, tmp_path, rocks, monkeypatch):
    df = spark.createDataFrame(rows(), requests.REQUEST)
    want = seen(requests.answer_table(df, 5, 1500))
    assert {s for _, s, _, _ in want} == {200, 400, 429, 503}
    assert {json.loads(b)["report"]["recommendation"] for _, s, b, _ in want if s == 200} == {"approve", "reject"}
    given = tmp_path / "in"
    for lo in range(0, 60, 20):  # files in order of time
        df.where(F.col("request_id").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(str(given))
    stream = lambda: spark.readStream.schema(requests.REQUEST).option("maxFilesPerTrigger", 1).parquet(str(given))
    start = lambda: requests.answer_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), 5, 1500, shards=2)
    real, fails = requests.answered, [2]

    def answered(batch):
        fails[0] -= 1
        if fails[0] == 0:
            real(batch).limit(3).write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0000000001"))
            raise RuntimeError("lost in the middle of a batch")
        return real(batch)

    monkeypatch.setattr(requests, "answered", answered)
    query = start()
    with pytest.raises(Exception, match="lost in the middle"):
        query.awaitTermination(120)
    assert start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert seen(got) == want and got.select("batch").distinct().count() == 3


def plain(rows, limit, window, most):
    """One map in order of insertion; an entry that is set again keeps its place."""
    held, out = {}, []
    for key, at, rid in rows:
        if len(held) >= most:
            held = {k: v for k, v in held.items() if v[1] > at}
            for k in list(held)[: max(0, len(held) - most)]:
                del held[k]
        count, reset = held.get(key, (0, 0))
        if not count or reset <= at:
            count, reset = 0, at + window
        held[key] = (count + 1, reset)
        out.append((rid, count + 1 <= limit))
    return out, len(held)


def test_a_flood_of_keys_does_not_grow_the_state(spark, tmp_path, rocks):
    flood = [(f"flood-{k % 150}" if k % 3 else f"old-{k % 9}", 7 * k, k) for k in range(900)]
    for lo in range(0, 900, 300):
        spark.createDataFrame(flood[lo : lo + 300], "key string, at_ms long, request_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at_ms long, request_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = limits.rate_limit_stream(stream, 4, 2000, most_keys=20, shards=1)
    q = out.writeStream.format("memory").queryName("flooded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want, held = plain(flood, 4, 2000, 20)
    assert sorted(map(tuple, spark.sql("select request_id, allowed from flooded").collect())) == want
    assert held <= 21 and [p.stateOperators[0].numRowsTotal for p in q.recentProgress][-1] <= 2 * 21 + 2


def test_answers_of_one_task_are_the_work_of_many(spark):
    """What one shard of the limiter hands on is verified by many tasks, about as many rows each (by that one task before)."""
    from proofline.streaming.requests import answered
    from pyspark.sql import functions as F

    given = spark.range(400, numPartitions=1).select(
        F.col("id").alias("request_id"), F.lit(None).cast("string").alias("refused"), F.lit('{"beverageType":"wine","brandName":"B","classType":"Red"}').alias("application"),
        F.lit('{"brand_name":{"text":"Quite Other","confidence":0.9}}').alias("reading"), F.lit("table").alias("reader"), F.lit(900).cast("long").alias("elapsed_ms"), (F.col("id") % 4 > 0).alias("allowed"), F.lit(1).cast("long").alias("retry_after_seconds"),
    )
    got = answered(given)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 3 * 400 / len(sizes)
    told = got.select("request_id", "status", F.get_json_object("body", "$.report.recommendation").alias("said")).collect()
    assert all((r.status, r.said) == ((200, "reject") if r.request_id % 4 else (429, None)) for r in told)
