"""Document fingerprints: the improbable byte windows of a text in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, ship, written
from .letters import MULT, mixed

#: Bytes of a window, and starts to either side among which a chosen window must be the rarest. Under WINDOW, so texts laid end to end do not touch.
WINDOW, REACH = 32, 24
#: A window's collision count: pairs of equal bytes in it, so its order-2 entropy.
LEVELS = WINDOW * (WINDOW - 1) // 2 + 1
#: A Bloom filter: its bits, the features that fill it, bits set by a feature.
BITS, FEATURES, HASHES = 2048, 128, 4
#: Bytes worked on at a time.
SLICE = 1 << 17
#: Rows between bounds of document ids, at least: one row is sent twice for each bound.
BUCKET_ROWS = 2000


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * SLICE + 4 * WINDOW
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.cumprod(np.full(n - 1, MULT))]), np.concatenate([one, np.cumprod(np.full(n - 1, inverse))])


def collisions(data: np.ndarray) -> np.ndarray:
    """Collision count of the window from each place on, each from the one before by the byte that leaves and the one that comes."""
    n = data.size - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int32)
    ahead, behind = np.zeros(data.size, np.uint8), np.zeros(data.size, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        ahead[:-d] += same
        behind[d:] += same
    c = np.bincount(data[:WINDOW])
    out = np.empty(n, np.int32)
    out[0] = int((c * (c - 1)).sum()) // 2
    np.cumsum(behind[WINDOW:].astype(np.int32) - ahead[: n - 1], out=out[1:])
    out[1:] += out[0]
    return out


def window_hashes(data: np.ndarray) -> np.ndarray:
    up, down = _powers()
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.size], out=sums[1:])
    return mixed((sums[WINDOW:] - sums[:-WINDOW]) * down[: data.size - WINDOW + 1])


def chosen(data: np.ndarray, valid: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of valid windows that are the rarest within reach; equal ones stand by their hash."""
    if data.size < WINDOW:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    hashes = window_hashes(data)
    key = (ranks[collisions(data)].astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    key[~valid] = np.uint64(2**64 - 1)
    least = np.full(key.size + 2 * REACH, np.uint64(2**64 - 1))
    least[REACH : REACH + key.size] = key
    width, want = 1, 2 * REACH + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: key.size], least[want - width : want - width + key.size])
    at = np.flatnonzero((key == least) & valid)
    return at, hashes[at]


def text_features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Features of each text in order, each once; a text shorter than a window is one feature."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    some: list[int] = []

    def close() -> None:
        if not some:
            return
        data = np.frombuffer(b"".join([texts[k] for k in some]), np.uint8)
        ends = np.cumsum([len(texts[k]) for k in some])
        starts = np.arange(max(0, data.size - WINDOW + 1))
        own = np.searchsorted(ends, starts, "right")
        at, hashes = chosen(data, starts + WINDOW <= ends[own], ranks)
        for k, h in zip(some, np.split(hashes, np.searchsorted(at, ends[:-1])), strict=True):
            out[k] = _first(h)
        some.clear()

    size = 0
    for k, t in enumerate(texts):
        if len(t) < WINDOW:
            out[k] = np.array([xxhash.xxh64_intdigest(t)] if t else [], np.uint64)
        elif len(t) > SLICE:
            data, found = np.frombuffer(t, np.uint8), []
            for s in range(0, data.size - WINDOW + 1, SLICE):
                lo, hi = max(0, s - REACH), min(data.size, s + SLICE + REACH + WINDOW - 1)
                part = data[lo:hi]
                at, hashes = chosen(part, np.ones(part.size - WINDOW + 1, bool), ranks)
                found.append(hashes[(at + lo >= s) & (at + lo < s + SLICE)])
            out[k] = _first(np.concatenate(found))
        else:
            if size + len(t) > SLICE:
                close()
                size = 0
            some.append(k)
            size += len(t)
    close()
    return out


def _first(x: np.ndarray) -> np.ndarray:
    return x[np.sort(np.unique(x, return_index=True)[1])]


def filters(features: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters of a text's features, FEATURES to each: (filters, BITS / 64) words."""
    n = -(-features.size // FEATURES)
    bits = np.zeros((n, BITS), np.uint8)
    which = np.arange(features.size) // FEATURES
    for k in range(HASHES):
        bits[which, ((features >> np.uint64(16 * k)) % np.uint64(BITS)).astype(int)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: each filter's share of bits found in its best match in the other chain beyond chance, weighed by its bits, both ways."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    na, nb = np.bitwise_count(a).sum(1).astype(float), np.bitwise_count(b).sum(1).astype(float)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    step = max(1, (1 << 16) // len(b))
    for lo in range(0, len(a), step):
        both = np.bitwise_count(a[lo : lo + step, None] & b[None]).sum(2, dtype=np.int64)
        chance = na[lo : lo + step, None] * nb[None] / BITS
        best_a[lo : lo + step] = ((both - chance) / (na[lo : lo + step, None] - chance)).max(1)
        best_b = np.maximum(best_b, ((both - chance) / (nb[None] - chance)).max(0))
    total = (na * np.maximum(0, best_a)).sum() + (nb * np.maximum(0, best_b)).sum()
    return min(1.0, float(total / (na.sum() + nb.sum())))


def to_string(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint64).reshape(-1, BITS // 64)


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each collision count, the rarest over all windows of all texts first, ties to the lower count."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for b in batches:
            some: list[bytes] = []

            def close(some: list[bytes]) -> None:
                data = np.frombuffer(b"".join(some), np.uint8)
                starts, ends = np.arange(max(0, data.size - WINDOW + 1)), np.cumsum([len(x) for x in some])
                if starts.size:
                    total[:] += np.bincount(collisions(data)[starts + WINDOW <= ends[np.searchsorted(ends, starts, "right")]], minlength=LEVELS)
                some.clear()

            size = 0
            for t in b.column(0).cast(pa.binary()):
                t = t.as_py() or b""
                for lo in range(0, max(1, len(t) - WINDOW + 1), SLICE):
                    some.append(t[lo : lo + SLICE + WINDOW - 1])
                    size += len(some[-1])
                    if size > SLICE:
                        close(some)
                        size = 0
            close(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(total)], ["level", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    n = np.zeros(LEVELS, np.int64)
    for r in counts.collect():  # one row a level
        n[r["level"]] = r["n"]
    ranks = np.empty(LEVELS, np.uint16)
    ranks[np.lexsort((np.arange(LEVELS), n))] = np.arange(LEVELS)
    return ranks


def _bucket(bounds: list, c: Column, kind: str) -> Column:
    """How many of the rising bounds are not above c; -1 for null. Two levels of lists, each a literal to Spark."""
    if not bounds:
        return F.when(c.isNull(), -1).otherwise(0)
    fine = math.isqrt(len(bounds) - 1) + 1
    given = lambda x, t: F.from_json(F.lit(json.dumps(x, default=str)), t)
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= c))
    at = count(given(bounds[::fine], f"array<{kind}>"))
    parts = given([bounds[k : k + fine] for k in range(0, len(bounds), fine)], f"array<array<{kind}>>")
    return F.when(c.isNull(), -1).when(at == 0, 0).otherwise((at - 1) * fine + count(F.get(parts, at - 1)))


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_rows: int) -> DataFrame:
    """(bucket, tail, id, text) dealt by bucket and sorted: each bucket's rows by falling id, then one that has tail 1, the row that follows.

    Buckets are ranges of ids, so that the texts are moved once and only the first row of each twice. A bucket has
    about the square root of all rows, `bucket_rows` at least: at 10^10 rows there are 10^5 buckets of as many.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, kind = rows.count(), docs.schema[id_col].dataType.simpleString()
    many = max(1, n // max(bucket_rows, math.isqrt(n)))
    cut = rows.agg(F.percentile_approx("id", [k / many for k in range(1, many)], max(20_000, 10 * many))).first()[0] if many > 1 else []
    bucket = _bucket(sorted(set(cut or [])), F.col("id"), kind)
    heads = rows.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("id").alias("head"))
    # A bucket's following row is the head of the bucket below, or of the highest. A row a bucket: all fit in a task.
    every = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = written(heads.withColumn("to", F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.first("bucket").over(every))))
    first = rows.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head")))  # the square root of all rows at most
    first = first.groupBy("to").agg(F.max("id").alias("id"), F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    both = rows.select(bucket.alias("bucket"), F.lit(0).alias("tail"), "id", "text").union(first.select("to", F.lit(1), "id", "text"))
    return both.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("id"), F.xxhash64("text"), "text")


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The next row is that of the next lower id (null last, equal ids by hash of the text), after the last the first.
    A null text is empty; an empty one has the empty fingerprint, which is like itself only. A very long text has as
    many filters as its features fill. Equal rows each get a row, in any order. The only row of a table follows
    itself, an empty table gives no rows; further columns, whatever their names, go.
    """
    ship(docs.sparkSession)
    ranks = rarity(docs, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (bucket, tail, id, text)
        size = 0
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if held and held[-1][1]:
                    if row[0] == held[-1][0]:
                        continue
                    yield finish(held)
                    held, size = [], 0
                row = (*row[:3], row[3].as_py())
                held.append(row)
                size += len(row[3])
                if size > 2 * SLICE and len(held) > 1:
                    yield finish(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield finish(held)

    def finish(held: list[tuple]) -> pa.RecordBatch:
        texts, edited = [r[3] for r in held], []
        for a, b in zip(texts, texts[1:], strict=False):
            k = len(a) // 2
            edited.append((a[: len(a) - k] + b[:k]).encode())
        chains = [filters(x) for x in text_features([t.encode() for t in texts] + edited, ranks)]
        own, changed = chains[: len(texts)], chains[len(texts) :]
        columns = [
            pa.array([r[2] for r in held[:-1]], id_type), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([to_string(x) for x in own[:-1]], pa.string()), pa.array([to_string(x) for x in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, bucket_rows).mapInArrow(run, schema)


def op5_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(load(spark, sf_dir, "documents"))
