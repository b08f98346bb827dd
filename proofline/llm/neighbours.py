"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, frexp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, ship, written

#: Projected dimensions (even, for the chi-square distribution's closed form).
DIMENSIONS = 8
#: Chance, at least, with which a neighbour nearer than the k-th found would have come up before the search stops.
CERTAINTY = 0.95
#: Vectors of a shard, about; projected vectors from which the shards' borders are made, and of these at least so many a shard.
SHARD_ROWS, SAMPLE_ROWS, SAMPLED = 16_384, 50_000, 16
#: Vectors that the shards nearest to a query have at least, which it searches first.
FIRST_ROWS = 1_000
LEAF, STEP = 64, 512
#: Leaves that a query searches before any other, and leaves verified together.
FIRST_LEAVES, GROUP = 4, 16


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable of m (even) degrees of freedom stays below with chance p."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        below = 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree that halves the widest side."""
    open_, out = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if rows.size <= leaf:
            out.append(rows)
            continue
        part = points[rows]
        side = np.argmax(part.max(0) - part.min(0))
        order = np.argpartition(part[:, side], rows.size // 2)
        open_ += [rows[order[: rows.size // 2]], rows[order[rows.size // 2 :]]]
    return out


def stable(d: int, m: int = DIMENSIONS) -> np.ndarray:
    """The projection of vectors of d components and one further."""
    return np.random.default_rng(7).standard_normal((d + 1, m))


def projected(vectors: np.ndarray, top: float, m: int = DIMENSIONS) -> np.ndarray:
    """Projections of vectors made longer by the root of top - |x|^2, which turns the largest product into the smallest distance."""
    s = stable(vectors.shape[1], m)
    return vectors @ s[:-1] + np.sqrt(np.maximum(0, top - (vectors * vectors).sum(1)))[:, None] * s[-1]


def box_bounds(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.empty((len(at), len(low)))
    for lo in range(0, len(at), 64):
        q = at[lo : lo + 64, None]
        gap = np.maximum(0, np.maximum(low[None] - q, q - high[None]))
        out[lo : lo + 64] = (gap * gap).sum(2)
    return out


class Borders:
    """A kd-tree of borders: the shard of a projected vector is the leaf it falls into. Made from a sample, for any vector."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.side, self.value, self.child, self.leaf = [], [], [], []
        self.leaves = 0
        self._grow(points, leaves)
        self.side, self.value, self.child, self.leaf = (np.array(x) for x in (self.side, self.value, self.child, self.leaf))

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        k = len(self.side)
        for x, y in ((self.side, 0), (self.value, 0.0), (self.child, (k, k)), (self.leaf, -1)):
            x.append(y)
        if leaves > 1 and len(points) >= 2 * SAMPLED:
            side = int(np.argmax(points.max(0) - points.min(0)))
            value = float(np.quantile(points[:, side], leaves // 2 / leaves))
            left = points[:, side] < value
            if left.any() and not left.all():
                self.side[k], self.value[k] = side, value
                self.child[k] = (self._grow(points[left], leaves // 2), self._grow(points[~left], leaves - leaves // 2))
                return k
        self.leaf[k] = self.leaves
        self.leaves += 1
        return k

    def find(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), int)
        while (inner := np.flatnonzero(self.leaf[at] < 0)).size:
            own = at[inner]
            at[inner] = self.child[own, (points[inner, self.side[own]] >= self.value[own]).astype(int)]
        return self.leaf[at]


class Tree:
    """Searches vectors by largest inner product. `top` bounds all squared lengths, also in other trees."""

    def __init__(self, vectors: np.ndarray, top: float, certainty: float = CERTAINTY, m: int = DIMENSIONS) -> None:
        self.vectors, self.top, self.quantile = vectors, top, chi_square_quantile(certainty, m)
        self.stable = stable(vectors.shape[1], m)
        points = projected(vectors, top, m)
        leaves = kd_leaves(points)
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])
        self.rows = np.full((len(leaves), LEAF), -1)
        for k, x in enumerate(leaves):
            self.rows[k, : x.size] = x
        self.verified = 0

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, inner products) of about the k best of each query, unordered; -1 where there are fewer.

        `floor` has products that k others are known to reach: what cannot come up to them is not looked for.
        """
        n, width = len(queries), min(k, len(self.vectors))
        best, score = np.full((n, width), -1), np.full((n, width), -np.inf)
        floor = np.full(n, -np.inf) if floor is None else floor
        for lo in range(0, n, STEP):
            at = slice(lo, lo + STEP)
            best[at], score[at] = self._search(queries[at], floor[at], width)
        return best, score

    def _search(self, q: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest leaves first, then the others, a group at a time, for the queries whose test leaves them open."""
        best, score = np.full((len(q), width), -1), np.full((len(q), width), -np.inf)
        bound, own = box_bounds(q @ self.stable[:-1], self.low, self.high), (q * q).sum(1) + self.top

        def open_(leaves: np.ndarray | slice) -> np.ndarray:
            near = own - 2 * np.maximum(score.min(1), least)
            return bound[:, leaves] < self.quantile * near[:, None]

        def verify(leaves: np.ndarray, wanted: np.ndarray) -> None:
            some = np.flatnonzero(wanted.any(1))
            if not some.size:
                return
            rows = self.rows[leaves].ravel()
            use = np.repeat(wanted[some], LEAF, axis=1) & (rows >= 0)
            got = np.where(use, q[some] @ self.vectors[rows].T, -np.inf)
            self.verified += int(use.sum())
            rows, got = np.hstack([best[some], np.where(use, rows, -1)]), np.hstack([score[some], got])
            keep = np.argpartition(-got, width - 1, axis=1)[:, :width]
            floor = np.take_along_axis(got, keep, 1).min(1) - 1e-13 * own[some]
            for k in np.flatnonzero((got >= floor[:, None]).sum(1) > width):  # ties, or as good as: by the exact product, then by row
                if np.isfinite(floor[k]):
                    near = np.flatnonzero(got[k] >= floor[k])
                    exact = (self.vectors[rows[k, near]] * q[some[k]]).sum(1)
                    keep[k] = near[np.lexsort((rows[k, near], -exact))[:width]]
            best[some], score[some] = np.take_along_axis(rows, keep, 1), np.take_along_axis(got, keep, 1)

        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(bound, min(FIRST_LEAVES, bound.shape[1]) - 1, axis=1)[:, :FIRST_LEAVES], True, 1)
        first &= open_(slice(None))
        order = np.argsort(bound.min(0), kind="stable")
        groups = [order[k : k + GROUP] for k in range(0, order.size, GROUP)]
        for leaves in groups:
            verify(leaves, first[:, leaves])
        for leaves in groups:
            verify(leaves, ~first[:, leaves] & open_(leaves))
        return best, score


def usable(v: Column) -> Column:
    """Whether a vector takes part: it is not null, all components are finite numbers, not all of them zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length in a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[starts[rows][:, None] + np.arange(d)]


def _search_shards(batches: Iterator[pa.RecordBatch], k: int, top: float, certainty: float) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, score) of rows (d, cell, salt, kind, id, v, least): of each shard its vectors, then queries, which need not fit in memory."""
    key, ids, parts, found = None, [], [], None

    def build() -> tuple:
        names = pa.chunked_array(ids).combine_chunks()
        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
        names, vectors = names.to_numpy(zero_copy_only=False)[order], np.concatenate(parts)[order]
        _, first, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        alike = [np.unique(names[x])[: k + 1] for x in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])]
        by_id = np.argsort(first, kind="stable")  # so that of equal products the lower row has the smaller id
        return Tree(vectors[first[by_id]], top, certainty), [alike[x] for x in by_id]

    for b in batches:
        marks = np.stack([b.column(c).to_numpy() for c in range(4)])
        cuts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [b.num_rows]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if lo == hi:
                continue
            if (now := tuple(marks[:3, lo].tolist())) != key:
                key, ids, parts, found = now, [], [], None
            part = b.slice(lo, hi - lo)
            matrix = next(_by_length(part.column(5)))[1]
            if not marks[3, lo]:
                ids.append(part.column(4))
                parts.append(matrix)
                continue
            if not ids:
                continue
            tree, alike = found = found or build()
            least = part.column(6).to_numpy()
            hits, _ = tree.search(matrix, k + 8, least)
            out: list[list] = [[], [], []]
            for a, x, row, floor in zip(part.column(4).to_numpy(zero_copy_only=False), matrix, hits, least, strict=True):
                row = row[row >= 0]
                if not row.size:
                    continue
                some = [alike[h] for h in row.tolist()]
                names, scores = np.concatenate(some), np.repeat((tree.vectors[row] * x).sum(1), [len(s) for s in some])
                use = (names != a) & (scores >= floor)
                names, scores = names[use], scores[use]
                use = np.lexsort((names, -scores))[:k]
                for col, y in zip(out, (np.full(use.size, a, names.dtype), names[use], scores[use]), strict=True):
                    col.append(y)
            if out[0]:
                kind = part.column(4).type
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]), kind), pa.array(np.concatenate(out[1]), kind), pa.array(np.concatenate(out[2]))], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", certainty: float = CERTAINTY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank int, vec_id, score): for each query the k of `vectors` with the largest inner product found.

    Borders in the projected space, from a sample of SAMPLE_ROWS, deal all vectors to shards; shards of too many are
    split by hash. A query first goes to the nearest shards, then, with the k-th product found, to those that the
    stopping test leaves open: a nearer neighbour there would show within the quantile of the k-th distance. So a
    vector is moved once a round, and a query only to where it may find something. A shard has one kd-tree and reads
    its queries in batches. Equal vectors of a shard are searched once; ties go to the smaller id. Rows with a query's
    id are its own and never among its neighbours; rows of equal id and vector count once; of several vectors of one query id the
    least is asked. Unusable vectors (null,
    zero, null or non-finite components) and null ids take no part, nor do vectors of another length than the
    query's. Empty tables give no rows; further columns, whatever their names, do not matter.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[id_col].dataType.simpleString()
    take = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    index, asked = take(vectors), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    n, biggest = index.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    power = frexp(biggest)[1] - 1
    power = power if abs(power) > 400 else 0  # squares would overflow or vanish; scaling by a power of two rounds nothing
    scaled = lambda df: df.withColumn("v", F.transform("v", lambda x: x * 2.0**-power)) if power else df
    index, asked = scaled(index), scaled(asked)
    top = index.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    top, axes = float(top) * (1 + 1e-12), [f"p{i}" for i in range(DIMENSIONS)]

    def project(batches: Iterator[pa.RecordBatch], borders: Borders | None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, matrix in _by_length(b.column(1)):
                points, some = projected(matrix, top), b.take(pa.array(rows))
                cells = np.zeros(len(points), int) if borders is None else borders.find(points)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(rows.size, matrix.shape[1])), pa.array(cells), *(pa.array(points[:, i].copy()) for i in range(DIMENSIONS))], ["id", "v", "d", "cell", *axes])

    schema = f"id {kind}, v array<double>, d long, cell long, {', '.join(f'{p} double' for p in axes)}"
    sample = index.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).mapInArrow(lambda x: project(x, None), schema).select(*axes).limit(2 * SAMPLE_ROWS).toPandas().to_numpy()
    borders = spark.sparkContext.broadcast(Borders(sample.reshape(-1, DIMENSIONS), -(-n // shard_rows)))  # SAMPLE_ROWS / SAMPLED leaves at most
    placed = written(index.mapInArrow(lambda x: project(x, borders.value), schema))
    found = placed.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(p) for p in axes], *[F.max(p) for p in axes]).collect()  # a row a shard and length
    boxes = {}
    for d in {r["d"] for r in found}:
        own = sorted(tuple(r)[1:] for r in found if r["d"] == d)
        boxes[d] = (np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2 : 2 + DIMENSIONS] for r in own]), np.array([r[2 + DIMENSIONS :] for r in own]))
    sent = spark.sparkContext.broadcast(boxes)
    salts = spark.createDataFrame([(r["d"], r["cell"], -(-r["n"] // shard_rows)) for r in found], "d long, cell long, salts long")
    quantile = chi_square_quantile(certainty, DIMENSIONS)

    def route(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, matrix in _by_length(b.column(1)):
                if (d := matrix.shape[1]) not in sent.value:
                    continue
                cells, many, low, high = sent.value[d]
                for lo in range(0, rows.size, STEP):
                    q, some = matrix[lo : lo + STEP], rows[lo : lo + STEP]
                    bound = box_bounds(q @ stable(d)[:-1], low, high)
                    order = np.argsort(bound, axis=1, kind="stable")
                    before = np.cumsum(many[order], axis=1) - many[order]
                    go = np.zeros(bound.shape, bool)
                    np.put_along_axis(go, order, before < FIRST_ROWS, 1)
                    if not first:
                        near = (q * q).sum(1) + top - 2 * b.column(2).to_numpy()[some]
                        go = ~go & (bound < quantile * near[:, None])
                    a, c = np.nonzero(go)
                    out = b.take(pa.array(some[a]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(a.size, d)), pa.array(cells[c]), *out.columns], ["d", "cell", "id", "v", "least"])

    def search(asked: DataFrame, first: bool) -> DataFrame:
        sides = "d long, cell long, id {0}, v array<double>, least double".format(kind)
        right = asked.select("id", "v", "least").mapInArrow(lambda x: route(x, first), sides).join(salts, ["d", "cell"])
        right = right.select("d", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(1).cast("long").alias("kind"), "id", "v", "least")
        left = placed.join(salts, ["d", "cell"]).select("d", "cell", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.lit(0).cast("long").alias("kind"), "id", "v", F.lit(0.0).alias("least"))
        dealt = left.union(right).repartition("d", "cell", "salt").sortWithinPartitions("d", "cell", "salt", "kind")
        return dealt.mapInArrow(lambda x: _search_shards(x, k, top, certainty), f"query_id {kind}, vec_id {kind}, score double")

    asked = written(asked)
    near = written(search(asked.withColumn("least", F.lit(float("-inf"))), True))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(w))
    least = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    more = search(asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), False)
    best = near.union(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", (F.col("score") * 2.0**power * 2.0**power if power else F.col("score")).alias("score"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
