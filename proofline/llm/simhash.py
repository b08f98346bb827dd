"""SimHash near-duplicates by an inverted index over positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, ship, written
from .components import connected_components
from .shingles import shingle_components

#: Differing bits at which two fingerprints still link. They touch 3 of 8 bytes at most: 5 are shared.
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Byte positions of the postings: each three positions lie together in exactly one of these fours
#: (the affine planes of the cube), and the other four positions are again one of them. So whichever
#: three bytes differ, some posting consists of shared bytes only.
BLOCKS = [x for x in combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0]
#: A posting with more fingerprints is split by one further shared byte; bounds what a task holds.
SPLIT_ROWS = 1 << 17
#: Shingles hashed at a time, whatever the length of the text.
SLICE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    digest, join, counts = xxhash.xxh64_intdigest, b" ".join, np.zeros(64, np.int64)
    n = max(1, len(words) - width + 1)
    for at in range(0, n, SLICE):
        part = words[at : min(at + SLICE, n) + width - 1]
        grams = map(join, zip(*(part[k:] for k in range(width)), strict=False)) if len(words) >= width else [join(words)]
        hashes = np.array([digest(g, 42) for g in grams], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of shingles that are hashed already; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, SLICE):
        counts += np.unpackbits(hashes[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long) of every row; a null or empty text has fingerprint 0. Any other column is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def links(fps: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(a, b): links that join the distinct fingerprints `fp` wherever chains of up to 3 differing bits join them.

    Postings hold fingerprints by four positional bytes; large ones are split by a fifth. Within a posting the
    shared positional bytes of a pair are tallied, pairs with fewer than five are dropped, the rest verified.
    A posting gives the links of a spanning forest, never all its pairs.
    """
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, block in enumerate(BLOCKS):
        key = F.lit(k).cast("long")
        for p in block:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    index = fps.select(F.posexplode(F.array(*keys)).alias("block", "key"), "fp")
    hot = index.groupBy("key").count().where(F.col("count") > split_rows).select("key", F.lit(True).alias("hot"))
    index = index.join(hot, "key", "left")
    spare = F.array(*[F.array(*[F.struct(F.lit(p + 1).alias("p"), byte(p).alias("v")) for p in range(8) if p not in b]) for b in BLOCKS])
    whole = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("v")))
    index = index.withColumn("part", F.explode(F.when(F.col("hot"), F.element_at(spare, F.col("block") + 1)).otherwise(whole)))
    index = index.select("key", F.col("part.p").cast("long") * 256 + F.col("part.v"), "fp").toDF("key", "part", "fp")
    return index.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_link_runs, "a long, b long")


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((3, 0), np.int64)
    for b in batches:
        held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        if not held.shape[1]:
            continue
        whole = np.flatnonzero((held[:2] != held[:2, -1:]).any(0))
        cut = whole[-1] + 1 if len(whole) else 0
        if cut:
            yield from _links_of(held[:, :cut])
            held = held[:, cut:].copy()
    yield from _links_of(held)


def _links_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    fps = rows[2].view(np.uint64)
    new = np.ones(fps.size, bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(0)
    run = np.cumsum(new) - 1
    sizes = np.bincount(run) if fps.size else np.zeros(0, int)
    label, dense = np.arange(fps.size), sizes > SPLIT_ROWS // 4
    alive = np.flatnonzero((sizes[run] > 1) & ~dense[run]) if fps.size else np.zeros(0, int)
    d = 1
    while alive.size:
        alive = alive[alive + d < fps.size]
        alive = alive[run[alive] == run[alive + d]]
        if alive.size:
            near = alive[_linked(fps[alive], fps[alive + d])]
            label = _joined(label, near, near + d)
        d += 1
    for r in np.flatnonzero(dense):
        label = _by_masks(fps, label, np.searchsorted(run, r), np.searchsorted(run, r, "right"))
    a = np.flatnonzero(label != np.arange(fps.size))
    if a.size:
        yield pa.RecordBatch.from_arrays([pa.array(rows[2][a]), pa.array(rows[2][label[a]])], ["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes and then differ in few enough bits."""
    differ = x ^ y
    out = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= MIN_SHARED
    out[out] = np.bitwise_count(differ[out]) <= MAX_BITS
    return out


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining x with y: each part's smallest index, by hooking and pointer jumping."""
    while x.size:
        a, b = label[x], label[y]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def _by_masks(fps: np.ndarray, label: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Links within a large posting: flips every one, two and three of the bits in which it varies."""
    order = np.argsort(fps[lo:hi], kind="stable")
    part = fps[lo:hi][order]
    bits = [np.uint64(1 << k) for k in range(64) if (int(np.bitwise_or.reduce(part ^ part[0])) >> k) & 1]
    for n in range(1, MAX_BITS + 1):
        for flip in combinations(bits, n):
            other = part ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
            at = np.minimum(np.searchsorted(part, other), part.size - 1)
            hit = np.flatnonzero(part[at] == other)
            label = _joined(label, lo + order[hit], lo + order[at[hit]])
    return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id its chain of links reaches.

    A null or empty text has fingerprint 0 and is linked like any other. A very long text is hashed whole, SLICE
    shingles at a time; a bit that is set in exactly half of the hashes is 0. Equal ids and repeated rows keep their
    rows; a null id is smaller than none. An empty table gives no rows; further columns, whatever their names, do not
    matter.
    """
    fps = written(fingerprints(docs, id_col, text_col))
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), split_rows))
    known = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(load(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts whose five-word shingles have a similarity of 0.8 or more.

    Fingerprints of five-word shingles, linked by the positional index, give the first pairs; those they miss come from
    the shingles, which verify all. The row kept is that of smallest id, null last, then of smallest hash; of rows
    equal in all columns, any one. Null and wordless texts are one group. A text counts whole, whatever its length.
    An empty table stays empty; columns other than doc_id and text may have any name but __key and __again.
    """
    ship(spark)
    key = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])  # a hash passes over nulls
    given = docs.select(F.col("doc_id").alias("id"), key.alias("key"), F.xxhash64("text").alias("hash"), "text")
    first = shingle_components(given, fold, links).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
    rows = docs.withColumn("__key", key).join(first.select(F.col("first.key").alias("__key")), "__key", "left_semi")
    again = F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))
    return rows.withColumn("__again", again).where("__again = 1").select(*docs.columns)
