"""Request limits: windows that open with a key's first request, on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..constants import MOST_CLIENTS, RATE_LIMIT, RATE_WINDOW_MS
from ..sources.shared import write_shared

#: Different times of a busy spell that are gone through in order as one array; longer spells are worked on by many tasks.
FOLDED = 4_096
#: Answered requests that a stream's task hands on at once.
SENT = 10_000
STATE = T.StructType([T.StructField("count", T.LongType()), T.StructField("reset_at", T.LongType())])


def admit(count: int, reset_at: int, now: int, limit: int, window_ms: int) -> tuple[int, int, tuple]:
    """(count, reset_at, (allowed, remaining, retry_after_seconds)) after a request at `now`.

    A window opens with the first request after the last one ended; refused requests count, too.
    """
    if count == 0 or reset_at <= now:
        return 1, now + window_ms, (True, limit - 1, 0)
    count += 1
    wait = -(-(reset_at - now) // 1000)
    return count, reset_at, (count <= limit, max(0, limit - count), wait)


OUTPUT = ["allowed", "remaining", "retry_after_seconds"]


def _successors(times: DataFrame, window_ms: int) -> DataFrame:
    """Adds what a time of a key needs to know of others: `first` whether a window must open there, `next` where the one after opens.

    times: (key, at, n) of different times. A chunk is a window long, so what a window ends in is the next chunk or, if
    nothing there is late enough, the start of the first later one with requests. Tasks see a chunk or two; of a key's
    chunks only their ends meet.
    """
    times = times.withColumn("chunk", F.call_function("div", F.col("at") - F.pmod("at", F.lit(window_ms)), F.lit(window_ms)))
    of_key, inside = Window.partitionBy("key").orderBy("chunk"), Window.partitionBy("key", "chunk").orderBy("at")
    ends = times.groupBy("key", "chunk").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum("n").alias("n"))
    ends = ends.select(
        "key", "chunk", F.lag("high").over(of_key).alias("before"), F.lead("chunk").over(of_key).alias("chunk_1"), F.lead("low").over(of_key).alias("low_1"), F.lead("low", 2).over(of_key).alias("low_2"),
        F.coalesce(F.sum("n").over(of_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    role = lambda meets, place, point: F.struct(meets.alias("meets"), place.alias("place"), F.lit(point).alias("point"))
    roles = F.array(role(F.col("chunk"), F.col("at"), True), role(F.col("chunk") + 1, F.col("at") + window_ms, False))
    ahead = Window.partitionBy("key", "meets").orderBy(F.desc("place"))  # up to the current place, rows of equal place included
    met = times.select("*", F.explode(roles).alias("role")).select("key", "at", "chunk", "n", "role.*")
    met = met.withColumn("late", F.min(F.when(F.col("point"), F.col("at"))).over(ahead)).where(~F.col("point"))
    out = met.join(ends, ["key", "chunk"])
    previous = F.coalesce(F.lag("at").over(inside), F.col("before"))
    adjacent = F.when(F.col("chunk_1") == F.col("chunk") + 1, F.coalesce(F.col("late"), F.col("low_2"))).otherwise(F.col("low_1"))
    return out.select(
        "key", "at", "chunk", "n", F.coalesce(F.col("at") - previous >= window_ms, F.lit(True)).alias("first"), adjacent.alias("next"),
        (F.col("base") + F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("earlier"),
    )


def _covered(nodes: DataFrame, marked: DataFrame, to: str) -> DataFrame:
    """Adds `to`: (at, earlier) of the last marked time up to each, where marked times of a key are a window apart, so that a chunk has one at most."""
    known = nodes.join(marked.select("key", "at", F.lit(True).alias("marked")), ["key", "at"], "left")
    chunks = known.groupBy("key", "chunk").agg(F.min(F.when(F.col("marked"), F.struct("at", "earlier"))).alias("own"))
    chunks = chunks.withColumn("before", F.last("own", ignorenulls=True).over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.when(F.col("own.at") <= F.col("at"), F.col("own")).otherwise(F.col("before"))
    return nodes.join(chunks, ["key", "chunk"]).select(*[nodes[c] for c in nodes.columns], own.alias(to))


def _folded(nodes: DataFrame, window_ms: int) -> DataFrame:
    """(key, at) of all times at which a window opens in busy spells of up to FOLDED times, each gone through in order."""
    opens = F.aggregate(
        F.array_sort(F.collect_list("at")), F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("all")),
        lambda so_far, t: F.when(t < so_far["last"] + window_ms, so_far).otherwise(F.struct(t.alias("last"), F.concat(so_far["all"], F.array(t)).alias("all"))),
    )
    return nodes.groupBy("key", "spell").agg(opens["all"].alias("opens")).select("key", F.explode("opens").alias("at"))


def _doubled(nodes: DataFrame) -> DataFrame:
    """The same of spells of any length: what is reached from their first times, by pointers that double in length.

    A round joins each time with where it points; no task follows a chain. There are as many rounds as the logarithm
    of a spell's windows.
    """
    points = nodes.select("key", "at", F.col("next").alias("to"))
    marked = write_shared(nodes.where("first").select("key", "at"))
    while True:
        reached = marked.join(points, ["key", "at"]).where("to is not null").select("key", F.col("to").alias("at"))
        new = write_shared(reached.join(marked, ["key", "at"], "left_anti").distinct())
        if new.isEmpty():
            return marked
        marked = marked.union(new)
        further = points.select("key", F.col("at").alias("to"), F.col("to").alias("beyond"))
        points = write_shared(points.where("to is not null").join(further, ["key", "to"]).select("key", "at", F.col("beyond").alias("to")))


def rate_limit(requests: DataFrame, limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS, key: str = "key", at: str = "at_ms", order: str = "request_id") -> DataFrame:
    """(key, order, at, allowed, remaining, retry_after_seconds) of each request of a table, by time, then `order`.

    A window opens with a key's first request after the last one ended; refused requests count, too. A pause of a
    window's length ends any, so spells between pauses are worked on apart, long ones by many tasks. Only requests of
    one key at the same millisecond are numbered by one task. Null keys are a key, requests without time are left out.
    """
    given = requests.select(F.struct(F.col(key).alias("k")).alias("key"), F.col(at).cast("long").alias("at"), F.col(order).alias("id"), F.col(at).alias("given")).where("at is not null")
    nodes = write_shared(_successors(given.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n")), window_ms))
    nodes = write_shared(_covered(nodes, nodes.where("first"), "spell").withColumn("spell", F.col("spell.at")))
    sizes = nodes.groupBy("key", "spell").agg(F.count(F.lit(1)).alias("times"))
    long = sizes.where(F.col("times") > FOLDED)
    short = nodes.join(sizes.where(F.col("times") <= FOLDED), ["key", "spell"], "left_semi")
    opened = _folded(short, window_ms)
    if not long.isEmpty():
        opened = opened.union(_doubled(nodes.join(long, ["key", "spell"], "left_semi")))
    spans = _covered(nodes, opened, "opening").select("key", "at", "earlier", "opening")
    same = F.row_number().over(Window.partitionBy("key", "at").orderBy("id"))
    count = F.col("earlier") + F.col("same") - F.col("opening.earlier")
    wait = F.ceil((F.col("opening.at") + window_ms - F.col("at")) / 1000)
    out = given.withColumn("same", same).join(spans, ["key", "at"])
    return out.select(
        F.col("key.k").alias(key), F.col("id").alias(order), F.col("given").alias(at), (count <= limit).alias("allowed"),
        F.greatest(F.lit(0), limit - count).cast("long").alias("remaining"), F.when(count == 1, 0).otherwise(wait).cast("long").alias("retry_after_seconds"),
    )


class Limiter(StatefulProcessor):
    """Windows of the keys of one shard, `most_keys` and one at most, however many keys come.

    A map from a key to its window and its place in the order of first requests. When it is full, windows that are
    over go before a request is looked at, and if that is not enough, the keys that came first. A shard's map is read
    once a batch, its changes are written at the end.
    """

    def __init__(self, limit: int, window_ms: int, most_keys: int, columns: list[str], at: str, order: str) -> None:
        self.limit, self.window_ms, self.most_keys, self.columns, self.at, self.order = limit, window_ms, most_keys, columns, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", T.StructType([T.StructField("key", T.StringType())]), T.StructType([*STATE.fields, T.StructField("place", T.LongType())]))

    def sweep(self, held: dict[str, list[int]], now: int) -> None:
        for key in [k for k, (_, reset_at, _) in held.items() if reset_at <= now]:
            del held[key]
        for key in list(islice(held, max(0, len(held) - self.most_keys))):
            del held[key]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stored = {k[0]: [int(x) for x in v] for k, v in self.windows.iterator()}
        held = dict(sorted(((k, list(v)) for k, v in stored.items()), key=lambda x: x[1][2]))  # in order of first requests
        place = max((v[2] for v in held.values()), default=-1) + 1
        batch = pd.concat(list(rows)).sort_values([self.at, self.order], ignore_index=True)
        out = []
        for k, t in zip(batch["limiter_client"], batch[self.at], strict=True):
            if len(held) >= self.most_keys:
                self.sweep(held, int(t))
            if k not in held:
                held[k] = [0, 0, place]
                place += 1
            count, reset_at, said = admit(*held[k][:2], int(t), self.limit, self.window_ms)
            held[k][:2] = [count, reset_at]
            out.append(said)
        for k in stored.keys() - held.keys():
            self.windows.removeKey((k,))
        for k, v in held.items():
            if stored.get(k) != v:
                self.windows.updateValue((k,), tuple(v))
        for k in range(0, len(batch), SENT):
            yield pd.concat([batch[self.columns].iloc[k : k + SENT].reset_index(drop=True), pd.DataFrame(out[k : k + SENT], columns=OUTPUT)], axis=1)

    def close(self) -> None:
        pass


def rate_limit_stream(
    requests: DataFrame, limit: int = RATE_LIMIT, window_ms: int = RATE_WINDOW_MS, key: str = "key", at: str = "at_ms", order: str = "request_id",
    carry: Sequence[str] = (), most_keys: int = MOST_CLIENTS, shards: int = 64,
) -> DataFrame:
    """rate_limit() of a stream, with the columns of `carry`; needs the RocksDB state store.

    Keys are dealt to a fixed number of shards by hash; each keeps `most_keys` windows, so a flood of keys lets old
    ones be forgotten, but state does not grow. Null keys are one key.
    """
    given = requests.select(key, order, at, *carry)
    schema = T.StructType([*given.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType()), T.StructField("retry_after_seconds", T.LongType())])
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("limiter_client")
    dealt = given.select("*", name).withColumn("limiter_shard", F.pmod(F.xxhash64("limiter_client"), F.lit(shards)))
    return dealt.groupBy("limiter_shard").transformWithStateInPandas(Limiter(limit, window_ms, most_keys, given.columns, at, order), schema, "Update", "None")


def refused_share(limited: DataFrame) -> DataFrame:
    return limited.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("refused"))
