"""Importance resampling of documents towards a target's distribution of words, with exact ranks of those drawn."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .byte_words import table, words_of
from .common import load, release, ship, small, written
from .tournament import merge

#: Features are counted by this many hashes: bounds what is gathered on the driver and sent to the tasks (16 bytes each).
BUCKETS = 10_000
#: Rows of a block of a sorted run, and of the result at a time.
BLOCK, OUT = 256, 8_192
#: Rows of a range that one task merges, at least; else SPREAD times the root of the rows. A range has some SAMPLED rows looked at.
LEAST_RANGE, SPREAD, SAMPLED = 4_096, 16, 20
WORD = table(digits=True)
#: Order of the draw; the last two and `row`, a hash of the row's place, only deal equal ids out.
KEY = ["score", "id", "n_features", "weight", "row"]


def features(text: bytes, longest_run: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashes of features) by slice: runs of 1 to `longest_run` words, joined by a space; runs go on across slices."""
    tail: list[bytes] = []
    for words in words_of(text, WORD):
        hashes = list(map(zlib.crc32, words))
        line = tail + words
        for n in range(2, longest_run + 1):
            first = max(0, len(tail) - n + 1)
            hashes += [zlib.crc32(b" ".join(line[k : k + n])) for k in range(first, len(line) - n + 1)]
        tail = line[len(line) - longest_run + 1 :] if longest_run > 1 else []
        yield len(words), np.array(hashes, np.uint32)


def texts_of(df: DataFrame, text_col: str):
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest_run: int) -> np.ndarray:
    """Features of all texts by bucket; each task adds up an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in small(batches):
            for body in b.column(0):
                for _, hashes in features(body.as_py(), longest_run):
                    total += np.bincount(hashes % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = df.select(texts_of(df, text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(int)] = found["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier a bucket is in the target, smoothed by one a bucket, rounded down."""
    of_all, of_target = float(source.sum() + source.size), float(target.sum() + target.size)
    return np.array([math.floor(1000 * math.log((float(t + 1) * of_all) / (float(s + 1) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: object) -> int:
    """A thousand times a Gumbel variable that hangs on the id alone, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int, longest_run: int, least_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_features, weight, score, eligible, row) of each row, from an array of gains in every task."""
    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for b in small(batches):
            rows = []
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n = words = total = 0
                for many, hashes in features(body.as_py(), longest_run):
                    words += many
                    n += hashes.size
                    total += int(gain[hashes % gain.size].sum())
                weight = total // n if n else 0
                rows.append((n, weight, weight + noise(seed, doc_id), words >= least_words))
            n, weight, score, eligible = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (n, weight, score)], pa.array(eligible, pa.bool_())], ["id", "n_features", "weight", "score", "eligible"])

    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score")], T.StructField("eligible", T.BooleanType())])
    out = docs.select(F.col(id_col).alias("id"), texts_of(docs, text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumn("row", F.xxhash64(F.monotonically_increasing_id()))


def in_order(columns: list[list]) -> list[tuple]:
    """Rows as tuples that sort as the draw goes: score falling, id rising with nulls first, then what deals out equal ids."""
    return [(-s, d is not None, d, *rest) for s, d, *rest in zip(*columns, strict=True)]


def cut_points(rows: DataFrame, many: int) -> list[tuple]:
    """Borders of ranges of about equal size, from a sample that grows with the root of the rows; they decide who works on a row, not its rank."""
    n = -(-many // max(LEAST_RANGE, SPREAD * math.isqrt(many)))
    if n < 2:
        return []
    some = rows.select(*KEY).sample(False, min(1.0, SAMPLED * n / many), 11).collect()
    keys = sorted(in_order(list(zip(*some, strict=True)))) if some else []
    return [keys[k * len(keys) // n] for k in range(1, n)] if len(keys) >= n else keys


def runs(rows: DataFrame, borders: list[tuple]) -> DataFrame:
    """Each partition's sorted run in blocks: (range, head_*: the first row, a list of each column of KEY)."""
    kinds = {f.name: f.dataType for f in rows.select(*KEY).schema}
    sent = rows.sparkSession.sparkContext.broadcast(borders)  # grows with the root of the rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = in_order([c.to_pylist() for c in b.columns])
            ends = [bisect.bisect_left(keys, x) for x in sent.value]
            for part, (start, end) in enumerate(itertools.pairwise([0, *ends, len(keys)])):
                for at in range(start, end, BLOCK):
                    block = b.slice(at, min(BLOCK, end - at))
                    whole = pa.array([0, block.num_rows], pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[c.slice(0, 1) for c in block.columns], *[pa.ListArray.from_arrays(whole, c) for c in block.columns]], names)

    fields = [T.StructField("range", T.IntegerType()), *[T.StructField(f"head_{c}", k) for c, k in kinds.items()], *[T.StructField(c, T.ArrayType(k)) for c, k in kinds.items()]]
    names = [f.name for f in fields]
    order = [F.desc("score"), *[F.asc_nulls_first(c) for c in KEY[1:]]]
    return rows.select(*KEY).sortWithinPartitions(*order).mapInArrow(run, T.StructType(fields))


def merged(blocks: DataFrame, draw: int, n_ranges: int) -> DataFrame:
    """(id, n_features, weight, score, rank) of all rows in blocks; ranks end with the draw.

    A range's first rank is what the blocks of ranges before it hold. Its task merges its runs as they come from
    the shuffle, sorted by first row: at any time it holds a block a run.
    """
    kind = blocks.schema["head_id"].dataType
    held = blocks.groupBy("range").agg(F.sum(F.size("score")).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = blocks.join(held.select("range", before.alias("base")), "range")
    heads = [F.desc("head_score"), *[F.asc_nulls_first(f"head_{c}") for c in KEY[1:]]]
    dealt = based.repartition(n_ranges, "range").sortWithinPartitions("range", *heads).select("range", "base", *KEY)

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                rows = in_order([c[k].as_py() for c in b.columns[2:]])
                yield b.column(0)[k].as_py(), b.column(1)[k].as_py(), rows

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in itertools.groupby(blocks_of(batches), key=lambda x: x[0]):
            _, base, rows = next(own)
            given = itertools.chain([(rows[0], rows)], ((r[0], r) for _, _, r in own))
            for rank, (score, _, doc_id, n, weight, _) in enumerate(merge(given), base + 1):
                yield doc_id, n, weight, -score, rank if rank <= draw else None

    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, T.LongType()) for c in ("n_features", "weight", "score", "rank")]])
    types = to_arrow_schema(schema).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ranked(batches)
        while some := list(itertools.islice(rows, OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], schema.names)
        release()

    return dealt.mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, buckets: int = BUCKETS, longest_run: int = 1, least_words: int = 20,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row: rank 1, 2, 3, ... of those drawn, null of the others.

    Of the rows with `least_words` words, the floor of `percent` hundredths with the highest scores are drawn. weight is
    the mean gain() of a text's features, score adds noise() of the id, so the draw is without replacement and with
    chances in proportion to exp(weight / 1000). All texts are read twice, by tasks that hold an array a bucket.
    Scores are whole numbers within 200,000 values (a gain is a log of counts), so their histogram is gathered to
    find the last score drawn; only rows from there on are sorted, in their partitions, and merged range by range.

    A null text has no features, weight 0 and is not drawn. A very long one is read whole, in slices. Equal scores go by
    id, null ids first; equal ids by n_features, then weight; rows equal in all that are interchangeable, and ranges
    may end between them. An empty table gives no rows, an empty target gains by the smoothing alone. Further columns
    are not read.
    """
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs, text_col, buckets, longest_run), bucket_counts(target, target_text_col, buckets, longest_run))
    rows = written(scored(docs, gain, seed, longest_run, least_words, id_col, text_col))
    bars = sorted(((r["score"], r["count"]) for r in rows.where("eligible").groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in bars) // 100
    out = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not draw:
        return rows.select(*out, none)
    sums = list(itertools.accumulate(n for _, n in bars))
    last = bisect.bisect_left(sums, draw)
    due = F.col("eligible") & (F.col("score") >= bars[last][0])
    borders = cut_points(rows.where(due), sums[last])
    blocks = written(runs(rows.where(due), borders))
    return merged(blocks, draw, len(borders) + 1).unionByName(rows.where(~due).select(*out, none))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
    WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
        said AS (SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
            UNION ALL SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
        flat AS (SELECT side, doc_id, unnest(words) AS word FROM said),
        hexed AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM flat),
        hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
                lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17)::BIGINT)),
                lambda c, b: xor(crc[xor(c, b) % 256 + 1]::BIGINT, c >> 8))) % 10000 AS bucket FROM hexed, steps),
        counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM flat JOIN hashed USING (word) GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS total_s, coalesce(sum(t), 0) AS total_t FROM counted),
        gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (total_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (total_t + 10000)::DOUBLE)))::BIGINT AS gain FROM counted, totals),
        weighed AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM flat JOIN hashed USING (word) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY doc_id),
        noised AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN weighed USING (doc_id)),
        placed AS (SELECT *, n_features >= 20 AS eligible, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM noised)
    SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 10 * (SELECT count(*) FROM placed WHERE eligible) // 100 THEN place END AS rank FROM placed"""
