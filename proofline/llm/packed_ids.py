"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents. All numbers are little-endian:

    "PFR1", then unsigned 32-bit: documents, blocks; unsigned 64-bit: ids
    per document: its id (signed 64-bit), 1 if that is null (8-bit), its number of ids (unsigned 64-bit)
    per block: where it starts after this index (unsigned 64-bit)
    per block: its minimum (unsigned 32-bit), width w and number of exceptions (unsigned 16-bit each),
        256 w-bit remainders (id less minimum, low bits; the last block is filled up with its minimum),
        then of each exception its place (8-bit) and what its remainder has beyond w bits (unsigned 32-bit)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from .common import load, ship, written
from .tokens import encoder

MAGIC, BLOCK, HEAD = b"PFR1", 256, struct.Struct("<4sIIQ")
#: The share of a block's remainders that its width must hold.
PERCENTILE = 90
#: A file is closed with the document that brings it to so many ids.
FILE_IDS = 1 << 18
END_ID = 2


def pack(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file of documents, each given as little-endian unsigned 32-bit ids."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    n = -(-flat.size // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: flat.size] = flat
    if n:
        full[flat.size :] = flat[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    least = full.min(1) if n else np.zeros(0, np.uint32)
    rest = full - least[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.frexp(np.partition(rest, at, 1)[:, at].astype(np.float64))[1].astype(np.int64) if n else np.zeros(0, np.int64)
    over = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(over)
    many = np.bincount(row, minlength=n)
    sizes = 8 + BLOCK // 8 * width + 5 * many
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(n, np.dtype([("least", "<u4"), ("width", "<u2"), ("many", "<u2")]))
    head["least"], head["width"], head["many"] = least, width, many
    body[starts[:, None] + np.arange(8)] = head.view(np.uint8).reshape(n, 8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = (rest[rows] & np.uint32((1 << w) - 1)).reshape(-1, 8).astype(np.uint64)
        part = np.zeros((low.shape[0], w), np.uint8)  # eight remainders are w bytes
        for j in range(8):
            at, shift = divmod(j * w, 8)
            x = low[:, j] << np.uint64(shift)
            for k in range(-(-(shift + w) // 8)):
                part[:, at + k] |= (x >> np.uint64(8 * k)).astype(np.uint8)
        body[(starts[rows] + 8)[:, None] + np.arange(BLOCK // 8 * w)] = part.reshape(rows.size, -1)
    own, at_place, at_value = _exceptions(starts, width, many)
    body[at_place] = place
    body[at_value[:, None] + np.arange(4)] = over[row, place].astype("<u4")[:, None].view(np.uint8)
    docs = np.zeros(len(ids), np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]))
    docs["id"] = [0 if x is None else x for x in doc_ids]
    docs["null"] = [x is None for x in doc_ids]
    docs["n"] = [len(x) // 4 for x in ids]
    return b"".join([HEAD.pack(MAGIC, len(ids), n, flat.size), docs.tobytes(), starts.astype("<u8").tobytes(), body.tobytes()])


def _exceptions(starts: np.ndarray, width: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, byte of the place, byte of the value) of every exception, blocks in order."""
    own = np.repeat(np.arange(many.size), many)
    k = np.arange(own.size) - np.repeat(np.cumsum(many) - many, many)
    at = (starts + 8 + BLOCK // 8 * width)[own]
    return own, at + k, at + many[own] + 4 * k


def unpack_block(data: bytes, at: int) -> np.ndarray:
    """The 256 ids of the block that starts at byte `at` of a file."""
    least, w, n = struct.unpack_from("<IHH", data, at)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, 32 * w, at + 8), bitorder="little").reshape(BLOCK, w)
    rest = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64)) if w else np.zeros(BLOCK, np.uint64)
    place = np.frombuffer(data, np.uint8, n, at + 8 + 32 * w)
    rest[place] |= np.frombuffer(data, "<u4", n, at + 8 + 32 * w + n).astype(np.uint64) << np.uint64(w)
    return (rest + np.uint64(least)).astype("<u4")


def layout(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, byte at which each block starts, ids) of a file."""
    magic, n_docs, n_blocks, n_ids = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a file of packed ids")
    docs = np.frombuffer(data, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<u8")]), n_docs, HEAD.size)
    at = HEAD.size + docs.nbytes
    return docs, np.frombuffer(data, "<u8", n_blocks, at) + np.uint64(at + 8 * n_blocks), n_ids


def unpack(data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each document of a file, in order."""
    docs, starts, n_ids = layout(data)
    ids = _unpack_all(data, starts)[:n_ids].tobytes()
    at = 0
    for doc_id, null, n in docs.tolist():
        yield (None if null else doc_id), ids[4 * at : 4 * (at + n)]
        at += n


def part_of(data: bytes, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi-1 of a file: the block index says which blocks have them, no other is read."""
    _, starts, n = layout(data)
    lo, hi = min(max(lo, 0), n), min(hi, n)
    first, last = lo // BLOCK, -(-hi // BLOCK)
    return _unpack_all(data, starts[first:last])[lo - first * BLOCK : max(lo, hi) - first * BLOCK]


def _unpack_all(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All blocks, those of one width at a time."""
    raw, s = np.frombuffer(data, np.uint8), starts.astype(np.int64)
    take = lambda at, n: raw[at[:, None] + np.arange(n)]
    head = take(s, 8) if s.size else np.zeros((0, 8), np.uint8)
    least, width, n = head[:, :4].copy().view("<u4")[:, 0], head[:, 4:6].copy().view("<u2")[:, 0].astype(int), head[:, 6:8].copy().view("<u2")[:, 0].astype(int)
    out = np.zeros((s.size, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        part = take(s[rows] + 8, 32 * w).reshape(-1, w)  # eight remainders are w bytes
        low = np.empty((part.shape[0], 8), np.uint32)
        for j in range(8):
            at, shift = divmod(j * w, 8)
            many = -(-(shift + w) // 8)
            wide = np.uint32 if many <= 4 else np.uint64
            x = part[:, at].astype(wide)
            for k in range(1, many):
                x |= part[:, at + k].astype(wide) << wide(8 * k)
            low[:, j] = (x >> wide(shift)) & wide((1 << w) - 1)
        out[rows] = low.reshape(rows.size, BLOCK)
    own, at_place, at_value = _exceptions(s, width, n)
    out[own, raw[at_place]] |= raw[at_value[:, None] + np.arange(4)].view("<u4")[:, 0] << width[own].astype(np.uint32)
    return (out + least[:, None]).ravel().astype("<u4")


def write_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, seq int, n_ids long, file binary): files in ascending order of document by (part, seq), written to the shared folder.

    Null ids come first, equal ids in order of text, repeated rows one after another; a null text is empty, so that
    only end_id is written. A very long text is one document of one file. An empty table gives no file; further
    columns, whatever their names, do not matter. Ids must be whole numbers, as the format has them.
    """
    ship(docs.sparkSession)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number: files hold 64-bit ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, names, ids, n, seq = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal names, ids, n, seq
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n // 4], pa.int64()), pa.array([pack(names, ids)], pa.binary())], ["part", "seq", "n_ids", "file"])
            names, ids, n, seq = [], [], 0, seq + 1
            return out

        part = 0
        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for doc_id, found in zip(b.column(1).to_pylist(), own.encode_column(b.column(2)), strict=True):
                names.append(doc_id)
                ids.append(found + end)
                n += len(ids[-1])
                if n >= 4 * file_ids:
                    yield close()
        if names:
            yield close()

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dealt = given.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return written(dealt.select(F.spark_partition_id().alias("part"), "id", "text").mapInArrow(run, "part int, seq int, n_ids long, file binary"))


def read_files(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 long) of every document in the files; start counts the ids of all documents before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [(i, len(x) // 4, zlib.crc32(x)) for i, x in unpack(file)]
                n = np.array([x[1] for x in rows], np.int64)
                cols = [pa.array([part] * len(rows), pa.int32()), pa.array([seq] * len(rows), pa.int32()), pa.array([x[0] for x in rows], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([x[2] for x in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "id", "inside", "n_tokens", "ids_crc32"])

    sizes = files.select("part", "seq", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("inner")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    rows = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "seq"]).select("id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op8_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(files).withColumnRenamed("id", "doc_id")
