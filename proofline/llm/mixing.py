"""Mixing sources to target weights in fixed-length blocks of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORDS, load, null_safe_join, release, running_sum, ship, small, written

#: Words a block has (the last of a source may have fewer).
BLOCK = 64
#: Blocks an output shard has.
SHARD = 1 << 14
WEIGHTS = (3, 1, 2)
#: Sources that may be mixed: what each task of the draw is sent; more are an error. Tasks of the draw at most.
MOST_SOURCES, MOST_TASKS = 1 << 16, 20_000
#: Slots up to which the exact draw is used.
MOST_EXACT = 10**9
#: Rounds of the pseudorandom index permutation.
ROUNDS = 4


def permuted(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at the given slots: a Feistel network, walked until it falls below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, x = np.uint64((1 << half) - 1), slots.astype(np.uint64)
    out, left = np.empty(x.size, np.uint64), np.arange(x.size)
    while left.size:
        a, b = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            h = (b + np.uint64((key * 2654435761 + r * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((h ^ (h >> np.uint64(32))) & mask)
        x = (a << np.uint64(half)) | b
        done = x < n
        out[left[done]] = x[done]
        left, x = left[~done], x[~done]
    return out.astype(np.int64)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size long, target double): what each source should give, in words.

    Sources by code point, null last, weigh `weights` in turn and share `percent` % of all words; no target
    exceeds `most` times its source's size, the excess being shared by weight again until none does. With
    sources by most * size / weight, those capped come first; the share per weight of the others then is what
    is left by the weight left, in whole numbers until the last division. One row a source meets in one task.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    all_rows = Window.partitionBy()
    upto = Window.orderBy(F.expr("source_size / weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source", "source_size", "weight",
        (F.lit(percent) * F.sum("source_size").over(all_rows) - 100 * most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))).alias("left100"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("weights_left"),
        F.row_number().over(Window.orderBy(F.expr("source_size / weight"), F.col("source").asc_nulls_last())).alias("k"),
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    fits = wide("left100") * F.col("weight").cast("decimal(6,0)") <= wide("source_size") * (100 * most * F.col("weights_left")).cast("decimal(12,0)")
    first = rows.withColumn("open_k", F.min(F.when(fits, F.col("k"))).over(all_rows))
    share = F.max(F.when(F.col("k") == F.col("open_k"), F.struct("left100", "weights_left"))).over(all_rows)
    open_ = first.withColumn("share", share)
    target = F.when(F.col("k") < F.coalesce("open_k", F.lit(1 << 62)), F.col("source_size").cast("double") * most)
    target = target.otherwise((F.col("weight") * F.col("share.left100")).cast("double") / (100 * F.col("share.weights_left")).cast("double"))
    return open_.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def split_draw(rng: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` slots, drawn without order from `left` slots by source, are each source's.

    That is a multinomial draw given the numbers left, source after source. Beyond what the generator takes a
    rounded normal stands for the hypergeometric, of the same mean and variance, within what is possible.
    """
    out, total = np.zeros(left.size, np.int64), int(left.sum())
    for k in np.flatnonzero(left).tolist():
        own, rest = int(left[k]), total - int(left[k])
        if not rest or not take:
            n = take
        elif total < MOST_EXACT:
            n = int(rng.hypergeometric(own, rest, take))
        else:
            p = own / total
            n = round(rng.normal(take * p, (take * p * (1 - p) * (total - take) / (total - 1)) ** 0.5))
        out[k] = min(max(n, take - rest, 0), own, take)
        take, total = take - int(out[k]), rest
    return out


def shard_draw(slots: np.ndarray, number: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, number of slots) of each source in output shard `number` of `shard` slots.

    The shards are halved again and again, the halves' counts drawn from a seed of their own: any shard finds its
    own by itself, in as many draws as halvings, and all of them together use each source's slots once.
    """
    total = int(slots.sum())
    lo, hi, first, own = 0, -(-total // shard), np.zeros(slots.size, np.int64), slots.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        here = split_draw(np.random.default_rng([seed, lo, hi]), own, (mid - lo) * shard)
        if number < mid:
            hi, own = mid, here
        else:
            lo, first, own = mid, first + here, own - here
    return first, own


def draws(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """(source_id, block, shard, epoch, most): the blocks that each output shard takes of each source, and how many of their words.

    A source's target in whole words is full epochs of all its blocks, then blocks until it is reached, of the last
    one only what is wanting: its words are off by less than one. Each shard's counts by source are multinomial, given
    that all shards together use each source's slots. Slot s is block permutation(s mod blocks) in epoch s div blocks,
    a short block at the source's end last; so none comes up more often than another by more than one. A task draws
    its own shards; the sources, MOST_SOURCES at most, are sent to all.
    """
    need = sources.where("source_size > 0").select("source_id", "source_size", F.least(F.round("target").cast("long"), 2 * F.col("source_size")))
    rows = sorted(tuple(r) for r in need.limit(MOST_SOURCES + 1).collect())
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    ids, sizes, words = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    many, wanting = -(-sizes // block), words % np.maximum(1, sizes)
    slots = words // np.maximum(1, sizes) * many + -(-wanting // block)
    last = np.where(wanting > 0, (wanting - 1) % block + 1, block)  # words of the last slot
    shards = -(-int(slots.sum()) // shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0).to_pylist():
                first, count = shard_draw(slots, h, shard, seed)
                for k in np.flatnonzero(count).tolist():
                    for lo in range(int(first[k]), int(first[k] + count[k]), 1 << 18):
                        s, n = np.arange(lo, min(lo + (1 << 18), int(first[k] + count[k]))), int(many[k])
                        at = s % n
                        blocks = np.where(at < n - 1, permuted(np.minimum(at, max(0, n - 2)), max(1, n - 1), int(ids[k]) + (seed << 32)), n - 1)
                        cols = [np.full(s.size, ids[k]), blocks, np.full(s.size, h), s // n, np.where(s == slots[k] - 1, last[k], block)]
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["source_id", "block", "shard", "epoch", "most"])
        release()

    numbers = sources.sparkSession.range(0, shards, 1, max(1, min(shards, MOST_TASKS))).withColumnRenamed("id", "number")
    return numbers.mapInArrow(run, "source_id long, block long, shard long, epoch long, most long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): (row, doc_id, size, source_size, target) of each row, and (row, first, n_words, epoch, shard) of the words the mix takes.

    Documents of a source stand in a row in order of a hash of id and text; a block is `block` words of that row.
    Words are [^\\x20\\x09-\\x0D]+; a null text has none. Reruns take the same words. Repeated rows are rows like
    any other, told apart by `copy`; a null source is a source of its own, a null id an id. A very long text fills
    many blocks. A mix takes no word of an empty table. Columns other than the three go, whatever their names.
    """
    ship(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("hash"))
    rows = written(rows)
    sources = written(source_targets(rows, weights).withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")))
    own = null_safe_join(rows, sources, ["source"]).select("doc_id", "size", "hash", "source_id", "source_size", "target")
    again = Window.partitionBy("doc_id", "hash", "source_id", "size").orderBy("doc_id")
    own = own.withColumn("copy", F.row_number().over(again))
    placed = written(running_sum(own, ["source_id"], ["doc_id", "hash", "copy"], "size", "at"))
    there = placed.where("size > 0")
    cut = there.select("*", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    lo, hi = F.greatest("at", F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    cut = cut.select("doc_id", "hash", "source_id", "copy", "block", (lo - F.col("at")).alias("first"), (hi - lo).alias("n_words"), (lo - F.col("block") * block).alias("inside"))
    drawn = draws(sources, block, shard, seed).hint("merge")  # its size is not seen in what it is made from
    taken = cut.join(drawn, ["source_id", "block"]).withColumn("n_words", F.least("n_words", F.col("most") - F.col("inside"))).where("n_words > 0")
    return placed, taken.drop("block", "inside", "most")


KEYS = ["doc_id", "hash", "source_id", "copy"]


def taken_words(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sums = spans.groupBy(*KEYS).agg(F.sum("n_words").alias("taken"))
    return null_safe_join(placed, sums, KEYS, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(*mix(load(spark, sf_dir, "documents")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: each document's text becomes its taken spans, one a line, epoch by epoch.

    Documents of which nothing is taken go, so null and empty texts. n_chars, where there is one, becomes that of
    the new text. Repeated rows each have their own words; null ids and sources are kept apart like others. An empty
    table stays empty. Other columns stay, whatever their names but for __hash, __source_id, __copy and __spans.
    """
    ship(spark)
    _, spans = mix(docs)
    spans = spans.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("epoch", "first", "n_words"))).alias("__spans"))
    spans = spans.withColumnsRenamed({k: f"__{k}" for k in KEYS[1:]})
    # Numbers of sources and of rows of equal id, text and source as mix() gives them; which of such rows has which number does not matter.
    ids = docs.select("source").distinct().withColumn("__source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    rows = null_safe_join(docs.withColumn("__hash", F.xxhash64("text")), written(ids), ["source"])
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "__hash", "__source_id").orderBy("doc_id")))
    out = null_safe_join(rows, spans, ["doc_id", *(f"__{k}" for k in KEYS[1:])])
    at, names = docs.columns.index("text"), docs.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = []
            for text, cuts in zip(b.column(at).cast(pa.binary()), b.column(len(names)), strict=True):
                words = text.as_py().split()
                texts.append(b"\n".join(b" ".join(words[c["first"] : c["first"] + c["n_words"]]) for c in cuts.as_py()).decode())
            columns = b.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return out.select(*names, "__spans").mapInArrow(run, docs.schema)
