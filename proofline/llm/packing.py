"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, running_sum, ship, small, written
from .tokens import KNOWN, encoder

CAPACITY = 2048
END_ID = 1
#: Pieces of text a worker remembers as the pipeline's last stage, in executors that have done the others.
REMEMBERED_LAST = 200_000


def sizes(capacity: int) -> np.ndarray:
    """The lengths pieces may have, falling: the capacity's whole parts by 1, 2, 3 and so on."""
    return np.unique(capacity // np.arange(1, capacity + 1))[::-1]


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths into which n ids are cut: whole sequences first, then ever the largest size that fits."""
    out, own = [capacity] * (n // capacity), sizes(capacity)
    n %= capacity
    while n:
        out.append(int(own[np.searchsorted(-own, -n)]))
        n -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, remembered: int = KNOWN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids, cut to class sizes. Written to the shared folder."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer, remembered), np.array([end_id], "<u4").tobytes()
        tails = {n: cuts(n, capacity) for n in range(capacity)}
        for b in small(batches, 4096):
            rows: list[list] = [[], [], [], [], []]
            for k, ids in enumerate(own.encode_column(b.column(1))):
                ids += end
                n, at = len(ids) // 4, 0
                for length in [capacity] * (n // capacity) + tails[n % capacity]:
                    for col, x in zip(rows, (k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n), strict=True):
                        col.append(x)
                    at += length
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(x, pa.int64()) for x in rows[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(given.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"))


def harmonic_pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces whose `length` is one of sizes(capacity).

    The class of length capacity // i fills sequences of i pieces each; which piece goes where follows from its
    rank in the class, so each is placed by whatever task has it. What is left of each class is under i pieces,
    in all a number that the capacity alone bounds (about 11,000 at 2048); these go first-fit, longest first.
    """
    order = [c for c in rows.columns if c != "length"]
    ranked = running_sum(rows.withColumn("__one", F.lit(1)), ["length"], order, "__one", "rank").drop("__one")
    ranked = written(ranked)
    fit = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    classes = ranked.groupBy("length").count().withColumn("full", F.floor(F.col("count") / fit).cast("long"))
    classes = classes.select("length", "full", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base"))
    placed = ranked.join(F.broadcast(classes), "length").withColumn("fit", fit)  # under 100 rows: one a size
    whole = F.col("rank") < F.col("full") * F.col("fit")
    even = placed.where(whole).withColumn("sequence_id", (F.col("base") + F.floor(F.col("rank") / F.col("fit"))).cast("long")).withColumn("offset", F.col("rank") % F.col("fit") * F.col("length"))
    cols = [*rows.columns, "sequence_id", "offset"]

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "rank"], ascending=[False, True], ignore_index=True)
        used: list[int] = []
        bins, offsets = [], []
        for n in part["length"].tolist():
            k = next((k for k, u in enumerate(used) if u + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            bins.append(k)
            offsets.append(used[k])
            used[k] += n
        part["sequence_id"], part["offset"] = first + np.array(bins, np.int64), np.array(offsets, np.int64)
        return part[cols]

    first = classes.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    rest = placed.where(~whole).select(*rows.columns, "rank", F.lit(0).alias("__all"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["sequence_id long", "offset long"])
    return even.select(*cols).unionByName(rest.groupBy("__all").applyInPandas(fill, schema))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY, remembered: int = KNOWN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    A null or empty text is the end id alone; a very long one is cut into whole sequences first. Repeated rows are
    packed as often as they stand, and pieces that are equal in everything stand in any order; a null id stays null.
    An empty table gives no rows; further columns, whatever their names, do not matter.
    """
    return harmonic_pack(pieces(docs, tokenizer, id_col, text_col, end_id, capacity, remembered), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left: the pieces, with their sequences and places in them.

    Null and empty texts, repeated rows, null ids and empty tables are as pack_documents() says; columns other than
    doc_id and text go, whatever their names.
    """
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED_LAST)
