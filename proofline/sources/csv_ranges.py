"""CSV read by byte ranges: one quoted file, of whatever size, is tokenized by many tasks.

Lines come from Spark's text source, which cuts files into ranges. Whether a range begins inside quotes hangs on all
before it, but only by the parity of the quotes: a doubled quote in a quoted cell turns the state twice. So each range
is summed up for both cases, the cases are chosen by a running sum over ranges, and then each range is read on its own.
Records that run over the end of a range come in parts, which are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import write_shared

#: White space that does not make a cell filled, as the engine's text functions have it.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Ranges whose states are sent to every task, some 200 bytes each; of more, lines are joined with them by a shuffle.
MOST_SENT = 50_000
PIECES = "file string, block long, line long, head boolean, cells array<string>, part string"


def cells_of(record: str) -> list[str]:
    """The cells of a record: quotes keep commas and line ends, a doubled quote in them is one; they may stand anywhere in a cell."""
    if '"' not in record:
        return record.split(",")
    cells: list[list[str]] = [[]]
    runs = record.split('"')
    for k, run in enumerate(runs):
        if k % 2:  # inside quotes
            cells[-1].append(run)
        elif not run and 0 < k < len(runs) - 1:  # closed and opened at once
            cells[-1].append('"')
        else:
            first, *more = run.split(",")
            cells[-1].append(first)
            cells += [[c] for c in more]
    return ["".join(c) for c in cells]


def filled(cells: list[str]) -> bool:
    return any(c.strip(BLANKS) for c in cells)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, pos): lines ended by LF, CR or both, in order within a range."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Parts of batches by range, in order."""

    def parts() -> Iterator[pa.RecordBatch]:
        for b in batches:
            file, block = b.column("file"), b.column("block").to_numpy()
            new = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
            for a, z in pairwise([0, *(np.flatnonzero(new) + 1), b.num_rows]):
                if a < z:
                    yield b.slice(a, z - a)

    yield from groupby(parts(), key=lambda b: (b.column("file")[0].as_py(), b.column("block")[0].as_py()))


def _quotes_before(values: pa.Array, before: int) -> tuple[np.ndarray, int]:
    """Quotes ahead of each line and of what follows."""
    sums = before + np.concatenate([[0], np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))])
    return sums[:-1], int(sums[-1])


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, turns, rows_out, rows_in, filled_out, filled_in) of each range: for a start outside and inside quotes, records that begin, and whether any cell is filled."""
    for (file, block), parts in _ranges(batches):
        quotes, rows, seen = 0, [0, 0], [False, False]
        for b in parts:
            before, quotes = _quotes_before(b.column("value"), quotes)
            for case in (0, 1):
                inside = (before + case) % 2
                rows[case] += int((inside == 0).sum())
                if not seen[case]:
                    seen[case] = any(filled(cells_of('"' * int(i) + v)) for v, i in zip((x.as_py() for x in b.column("value")), inside, strict=True))
        yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "turns": quotes % 2 == 1, "rows_out": rows[0], "rows_in": rows[1], "filled_out": seen[0], "filled_in": seen[1]}])


def states(found: DataFrame) -> DataFrame:
    """(file, block, inside, ends_inside, base, filled_before): how each range begins, by running sums over a row a range.

    base counts the records of all ranges before, files in the order of their paths.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = earlier(Window.partitionBy("file").orderBy("block"))
    out = found.withColumn("inside", F.coalesce(F.sum(F.col("turns").cast("int")).over(own), F.lit(0)) % 2 == 1)
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))
    out = out.withColumns({"base": F.coalesce(F.sum(pick("rows")).over(earlier(Window.orderBy("file", "block"))), F.lit(0)), "filled_before": F.coalesce(F.max(pick("filled")).over(own), F.lit(False))})
    return out.select("file", "block", "inside", (F.col("inside") != F.col("turns")).alias("ends_inside"), "base", "filled_before")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES: records of a range with their number and cells, or a part of one that goes over its start or end; the record with a file's first filled cell is its head."""

    for (file, block), parts in _ranges(batches):
        quotes = number = None
        held: list[str] = []
        seen = False

        def piece(whole: bool) -> dict:
            nonlocal seen
            text = "\n".join(held)
            cells = cells_of(text if starts_out else '"' + text)  # of a part: enough to see whether it is filled
            head = not seen and filled(cells)
            seen = seen or head
            return {"file": file, "block": block, "line": number, "head": head, "cells": cells if whole else None, "part": None if whole else text}  # noqa: B023

        for b in parts:
            if quotes is None:
                inside, base, seen = (b.column(c)[0].as_py() for c in ("inside", "base", "filled_before"))
                quotes, number, starts_out = int(inside), base - 1, not inside
            before, quotes = _quotes_before(b.column("value"), quotes)
            out = []
            for value, inner in zip(b.column("value").to_pylist(), (before % 2).tolist(), strict=True):
                if not inner:
                    if held:
                        out.append(piece(starts_out))
                    held, starts_out = [], True
                    number += 1
                held.append(value)
            yield _batch(out)
        yield _batch([piece(starts_out and quotes % 2 == 0)])


SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("head", pa.bool_()), ("cells", pa.list_(pa.string())), ("part", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, SCHEMA)


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("line"), pa.array(map(cells_of, b.column("text").to_pylist()), pa.list_(pa.string()))], ["line", "cells"])


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(line, cells) of all records but each file's first with a filled cell, and (file, line, cells) of these firsts.

    line numbers all records, files in the order of their paths. Texts are read by two passes and a third that
    tokenizes only the ranges that hold a first record or end inside quotes.
    """
    text = lines(spark, path)
    found = text.mapInArrow(summaries, "file string, block long, turns boolean, rows_out long, rows_in long, filled_out boolean, filled_in boolean")
    known = write_shared(states(found))
    few = known.count() <= MOST_SENT

    def of(ranges: DataFrame) -> DataFrame:
        if few:  # joined where they are, in order
            return text.join(F.broadcast(ranges), ["file", "block"]).mapInArrow(pieces, PIECES)
        return text.join(ranges, ["file", "block"]).sortWithinPartitions("file", "block", "pos").mapInArrow(pieces, PIECES)

    border = write_shared(of(known.where("inside or ends_inside or not filled_before")).where("head or part is not null"))
    parts = border.where("part is not null").groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"]), "\n").alias("text"), F.min("file").alias("file"), F.max("head").alias("head"))
    joined = parts.select("line", "text").mapInArrow(stitched, "line long, cells array<string>")
    firsts = border.where("head").groupBy("file").agg(F.min("line").alias("line"))
    whole = border.where("head and part is null").select("line", "cells").union(joined)
    heads = write_shared(firsts.join(whole, "line").select("file", "line", "cells"))  # its size tells how it is joined
    rows = of(known).where("part is null").select("line", "cells").union(joined)
    return rows.join(heads.select("line"), "line", "left_anti"), heads
