"""Near-duplicates by exact Jaccard similarity of word shingles: fingerprints first, then a set join by prefix, length and position filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_shuffles, ship, small, written
from .components import connected_components

#: Words of a shingle, and the similarity at which two texts are near-duplicates, as a fraction.
WIDTH = 5
SIMILAR, OF = 4, 5
#: One text in so many tells which shingles are common; those seen so often there, this many at most, come last
#: in the order of prefixes. Any order gives the same pairs, this one gives few candidates.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 1 << 15
#: Places apart up to which the sets of a posting meet in each round; the last round has no bound. Links of a round
#: spare the next ones all pairs within what they join.
ROUNDS = (1, 12, None)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The XXH64 (seed 42) of each of a UTF-8 text's shingles; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    if len(words) < width:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def sketch(shingles: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of shingles is b modulo the number of bits, a power of two that is 2 n at least.

    Two sketches, the longer folded to the length of the other, differ in no more bits than their sets in shingles.
    """
    bits = 1 << max(6, int(2 * shingles.size - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ: the least number of shingles that only one of the two sets has."""
    a, b = (np.frombuffer(t, np.uint64) for t in (x, y))
    if a.size < b.size:
        a, b = b, a
    while a.size > b.size:
        a = a[: a.size // 2] ^ a[a.size // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest shingles, of which two sets that are similar enough share one: all but ceil(0.8 n) - 1 of them."""
    n = shingles.size
    key = np.zeros(n, np.int64)
    if common.size:
        at = np.minimum(np.searchsorted(common, shingles), common.size - 1)
        key = np.where(common[at] == shingles, rank[at], 0)
    return shingles[np.lexsort((shingles, key))][: n - -(-SIMILAR * n // OF) + 1]


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles that a sample of the texts has often, sorted; their ranks, the commonest highest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], ["token"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    often = some.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON)
    got = often.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()
    tokens = np.array([r["token"] for r in got], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(got) - np.arange(len(got)))[order]


def shingled(docs: DataFrame, fold: Callable[[np.ndarray], int]) -> DataFrame:
    """(id, key, hash, node, n, tokens, sketch, fp) of each row of (id, key, hash, text).

    Its set's number, size, prefix and sketch, and the fingerprint that `fold` makes of all its shingles' hashes,
    repeats included. A task gives the last three once for a set, so that copies do not meet there.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))  # MOST_COMMON entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small(batches):
            nodes, sizes, tokens, sketches, fps = [], [], [], [], []
            for t in b.column(3).cast(pa.binary()):
                hashes = shingle_hashes(t.as_py() or b"")
                s = np.unique(hashes)
                nodes.append(node_of(s))
                sizes.append(s.size)
                new = s.size > 0 and nodes[-1] not in seen
                tokens.append(prefix(s, *sent.value).view(np.int64) if new else None)
                sketches.append(sketch(s) if new else None)
                fps.append(fold(hashes) if new else None)
                seen.add(nodes[-1])
            cols = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(fps, pa.uint64()).view(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], ["id", "key", "hash", "node", "n", "tokens", "sketch", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, key long, hash long, node long, n long, tokens array<long>, sketch binary, fp long")


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of texts, each set once a task."""
    seen: set[int] = set()
    for b in small(batches):
        nodes, out = [], []
        for t in b.column(0).cast(pa.binary()):
            s = shingle_set(t.as_py())
            if (x := node_of(s)) not in seen:
                seen.add(x)
                nodes.append(x)
                out.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(out, pa.binary())], ["node", "shingles"])


def _sketches_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y, n, m): the pairs (a, b) whose sketches x and y and sizes n and m leave it open that they are similar enough."""
    for b in batches:
        total = b.column(4).to_numpy() + b.column(5).to_numpy()
        least = np.array([sketches_differ(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)], np.int64)
        yield b.select(["a", "b"]).filter(pa.array((SIMILAR + OF) * least <= (OF - SIMILAR) * total))


def _sets_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, x, y): the pairs (a, b) whose sets x and y are similar enough."""
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.intersect1d(x, y, assume_unique=True).size
            keep.append(OF * both >= SIMILAR * (x.size + y.size - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard similarity of SIMILAR / OF or more.

    Sketches, a twentieth of a set or less, rule out nearly all others; sets are made and sent for what is left.
    """
    pairs = written(pairs)
    small = sets.where("sketch is not null").join(_ends(pairs), "node", "left_semi").groupBy("node").agg(F.min("sketch").alias("x"), F.min("n").alias("n"), F.min("hash").alias("hash"))
    small = written(small)
    both = pairs.join(small.select(F.col("node").alias("a"), "x", "n"), "a").join(small.select(F.col("node").alias("b"), F.col("x").alias("y"), F.col("n").alias("m")), "b")
    near = written(both.select("a", "b", "x", "y", "n", "m").mapInArrow(_sketches_near, "a long, b long"))
    where = written(small.join(_ends(near), "node", "left_semi").select("hash").distinct())  # its size is known then
    known = written(docs.join(where, "hash", "left_semi").select("text").mapInArrow(_sets_of, "node long, shingles binary").dropDuplicates(["node"]))
    both = near.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_sets_similar, "a long, b long")


def open_pairs(placed: DataFrame, lo: int, hi: int | None) -> DataFrame:
    """(a, b): pairs of a posting that stand `lo` places apart or more, under `hi`, that no links join yet and that can be similar enough.

    `placed` has (token, n, node, pos, part), part being what links have joined so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((5, 0), np.int64)
        for b in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
            whole = np.flatnonzero(held[0] != held[0, -1]) if held.shape[1] else []
            cut = whole[-1] + 1 if len(whole) else 0
            if cut:
                yield from _open_pairs_of(held[:, :cut], lo, hi)
                held = held[:, cut:].copy()
        yield from _open_pairs_of(held, lo, hi)

    rows = placed.select("token", "n", "node", "pos", "part").repartition("token").sortWithinPartitions("token", "n", "node")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _open_pairs_of(rows: np.ndarray, lo: int, hi: int | None) -> Iterator[pa.RecordBatch]:
    if not rows.shape[1]:
        return
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    sizes = np.diff(np.append(first, rows.shape[1]))
    mixed = np.minimum.reduceat(rows[4], first) != np.maximum.reduceat(rows[4], first)
    token, n, node, pos, part = rows[:, np.repeat(mixed, sizes)]
    alive, d = np.arange(n.size), lo
    while alive.size and (hi is None or d < hi):
        alive = alive[alive + d < n.size]
        alive = alive[(token[alive] == token[alive + d]) & (OF * n[alive] >= SIMILAR * n[alive + d])]
        a, b = alive, alive + d
        rest = np.minimum(n[a] - pos[a], n[b] - pos[b])
        a = a[(part[a] != part[b]) & ((SIMILAR + OF) * rest >= SIMILAR * (n[a] + n[b]))]
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[a + d])), pa.array(np.maximum(node[a], node[a + d]))], ["a", "b"])
        d += 1


def _fingerprint_pairs(sets: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): nodes of one fingerprint with its smallest node, and the smallest nodes of fingerprints that `near` links."""
    known = sets.where("fp is not null").select("fp", "node").distinct()
    least = written(known.groupBy("fp").agg(F.min("node").alias("first")))
    same = known.join(least, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = written(near(least.select("fp"))).toDF("x", "y")
    linked = linked.join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(linked).distinct()


def _merged(parts: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) of the links behind `parts` and further ones."""
    if parts is None:
        return written(connected_components(links))
    a, b = parts.toDF("a", "root_a"), parts.toDF("b", "root_b")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    more = written(connected_components(ends)).toDF("root", "now")
    moved = parts.join(more, "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    new = more.toDF("node", "root").join(parts, "node", "left_anti")
    return written(moved.union(new))


def shingle_components(docs: DataFrame, fold: Callable[[np.ndarray], int], near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, key, root) for each row of (id, key, hash, text): rows have one root if a chain of pairs that are similar enough joins them.

    The pairs of fingerprints (`fold`) that `near` links are verified first. The others come from prefixes: sets that
    are similar enough share a shingle of these, so every pair meets in some posting. A set first meets the next in
    its postings, then those further off, as ROUNDS says; only those meet that no links join yet, so that a large
    group of near copies does not give all its pairs. Every link is verified by the sets of both. `hash` tells texts
    apart. Null and wordless texts are one group; copies count once, whatever their number.
    """
    ship(docs.sparkSession)
    sets = written(shingled(docs, fold))
    parts = _merged(None, written(similar_pairs(_fingerprint_pairs(sets, near), sets, docs)))
    entries = sets.where("tokens is not null").select("n", "node", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.select("token", "n", "node", F.col("pos").cast("long").alias("pos"))
    w = Window.partitionBy("token")
    entries = entries.withColumn("met", F.min("node").over(w) != F.max("node").over(w)).where("met").drop("met")
    entries, lo = written(entries.distinct()), 1
    for most in ROUNDS:
        placed = entries.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node"))
        hi = None if most is None else most + 1
        parts = _merged(parts, written(similar_pairs(open_pairs(placed, lo, hi), sets, docs)))
        lo = hi
        drop_shuffles(docs.sparkSession)
    return sets.select("id", "key", "node").join(parts, "node", "left").select("id", "key", F.coalesce("root", "node").alias("root"))
