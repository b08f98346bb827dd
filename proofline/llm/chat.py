"""Chat formatting with a grammar that is read back until it gives the source again."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

OPEN, CLOSE = "### ", "\n</turn>\n"
#: Control strings with the backslashes before them. With none, the string is control; else text.
MARK = re.compile(r"(\\*)(###|</turn>)")
ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}
ROLE_IN = re.compile(r"\\(.)")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted text; start and end bound the escaped text.

    Raises ValueError for a text that the grammar does not give.
    """
    turns, at = [], 0
    while at < len(text):
        start = text.find("\n", at) + 1
        if not text.startswith(OPEN, at) or not start:
            raise ValueError("a turn must open with its role")
        role = ROLE_IN.sub(lambda m: "\n" if m[1] == "n" else m[1], text[at + len(OPEN) : start - 1])
        end = next((m.start() - 1 for m in MARK.finditer(text, start) if not m[1]), -1)
        if end < start or not text.startswith(CLOSE, end):
            raise ValueError("a turn must end with its closing line")
        turns.append((role, MARK.sub(lambda m: m[0][1:], text[start:end]), start, end))
        at = end + len(CLOSE)
    return turns


def _render(role: str, text: str, escape_text: bool, escape_role: bool) -> str:
    if escape_role:
        role = "".join(ROLE_OUT.get(c, c) for c in role)
    if escape_text:
        text = MARK.sub(r"\\\g<0>", text)
    return f"{OPEN}{role}\n{text}{CLOSE}"


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start, end of its text): escapes only if the plain form is not read back as it was."""
    for how in ((False, False), (True, False), (False, True), (True, True)):
        out = _render(role, text, *how)
        try:
            turns = parse(out)
        except ValueError:
            continue
        if [x[:2] for x in turns] == [(role, text)]:
            return out, turns[0][2], turns[0][3]
    raise AssertionError("escaping everything is always read back")


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """One row a turn: (conv, turn, formatted string, loss_start, loss_end int), loss bounds in code points of formatted.

    A conversation is its turns' formatted texts joined in order of (turn, formatted), null turns first; it stays
    in rows, so that none has to fit in memory. Null role or text counts as empty; loss bounds are null for roles
    other than `learn_from`. Repeated rows stay repeated. An empty table gives no rows; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r or "", *format_turn(r or "", t or "")) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            bounds = [pa.array([x[k] if x[0] == learn_from else None for x in out], pa.int32()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[1] for x in out], pa.string()), *bounds], ["conv", "turn", "formatted", "loss_start", "loss_end"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    given = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, formatted string, loss_start int, loss_end int")


def read_chat(formatted: DataFrame) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of format_chat's rows, read back from them.

    A task reads each conversation in order, a batch of turns at a time, and keeps only two running digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, state, now = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None, object()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names)
            done.clear()
            return batch

        def close() -> None:
            if state:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for conv, text, lo, hi in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, start, end in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    if (start, end) == (lo, hi):
                        state[2] += len(said)
                        state[3].update(said.encode())
                state[4] += len(text)
            yield out()
        close()
        if done:
            yield out()

    kind = formatted.schema["conv"].dataType.simpleString()
    dealt = formatted.repartition("conv").sortWithinPartitions("conv", "turn", "formatted")
    return dealt.select("conv", "formatted", "loss_start", "loss_end").mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return read_chat(format_chat(given.unionByName(more))).withColumnRenamed("conv", "conv_id")
