import json
import os
import random

import pytest
from proofline.streaming import limits
from proofline.streaming.limits import admit, rate_limit, rate_limit_stream, refused_share


def plain(rows, limit, window):
    state, out = {}, []
    for key, at, rid in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        count, reset = state.get(key, (0, 0))
        if not count or reset <= at:
            count, reset = 0, at + window
        count += 1
        state[key] = (count, reset)
        out.append((key, rid, at, count <= limit, max(0, limit - count), 0 if count == 1 else -(-(reset - at) // 1000)))
    return sorted(out)


ROWS = [(f"k{i % 3}", i * 137 % 5000, i) for i in range(200)] + [("one", 0, 1000), ("one", 60_000, 1001), ("one", 60_001, 1002)]


def test_table(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "key string, at_ms long, request_id long, other string")
    out = rate_limit(df, 3, 1000)
    assert sorted(map(tuple, out.collect())) == plain(ROWS, 3, 1000)
    assert rate_limit(df.limit(0)).count() == 0
    shares = {r.key: (r.requests, r.refused) for r in refused_share(out).collect()}
    assert shares["one"] == (3, 0)


@pytest.mark.parametrize("folded", [4_096, 5])
def test_one_hot_key(spark, monkeypatch, folded):
    """Windows that follow one another without a pause for long, in one key, with equal times and a null key."""
    monkeypatch.setattr(limits, "FOLDED", folded)  # the second way doubles pointers
    rng = random.Random(9)
    rows = [("hot", t, i) for i, t in enumerate(sorted(rng.choices(range(40_000), k=900)))] + [("hot", 50_000 + 999 * k, 2000 + k) for k in range(20)] + [("hot", -1500, 5000), ("hot", -10, 5001)]
    rows += [(None, 7, 6000), (None, 8, 6001), ("cold", 5, 7000), ("cold", 1004, 7001), ("cold", 1005, 7002)]
    df = spark.createDataFrame(rows, "key string, at_ms long, request_id long")
    got = rate_limit(df, 12, 1000)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(k or None, *r) for k, *r in plain([(k or "", *r) for k, *r in rows], 12, 1000)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_admit():
    assert admit(0, 0, 5, 2, 1000) == (1, 1005, (True, 1, 0))
    assert admit(2, 1005, 6, 2, 1000) == (3, 1005, (False, 0, 1)) and admit(3, 1005, 1005, 2, 1000)[2] == (True, 1, 0)


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    rows = [(f"k{i % 3}", i * 10, i) for i in range(60)]
    for b in range(3):
        path = src / f"{b}.json"
        path.write_text("\n".join(json.dumps(dict(zip(("key", "at_ms", "request_id"), r, strict=True))) for r in rows[b * 20 : b * 20 + 20]))
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))  # the source takes files by age
    stream = spark.readStream.schema("key string, at_ms long, request_id long").option("maxFilesPerTrigger", 1).json(str(src))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = rate_limit_stream(stream, 4, 600_000).writeStream.format("memory").queryName("limited").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    got = sorted(map(tuple, spark.sql("select key, request_id, at_ms, allowed, remaining, retry_after_seconds from limited").collect()))
    assert got == plain(rows, 4, 600_000)
