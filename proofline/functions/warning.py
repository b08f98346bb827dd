"""The mandatory warning, word by word against the statute."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import STATUTORY_WARNING, WARNING_HEADER
from .text import WS, collapse_whitespace, normalized

DIFF_TYPE = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))


def words(c: Column) -> Column:
    """Lower-cased words, punctuation kept, of a text in compatibility form."""
    plain = F.translate(c, "‘’“”", "''\"\"")
    return F.filter(F.split(F.lower(collapse_whitespace(plain)), " "), lambda w: w != "")


def _common_tails(a: list[str], b: list[str]) -> Callable[[int, int], int]:
    """The length of the longest common subsequence of a[i:] and b[j:], by i and j.

    For each tail of b one whole number: its lowest k bits have as many zeros as that tail and the last k words of a
    have words in common. A word of b makes the next number in a few operations, whatever the length of a.
    """
    places: dict[str, int] = {}
    for k, x in enumerate(reversed(a)):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    tails = [every]
    for x in reversed(b):
        bits, hits = tails[-1], places.get(x, 0)
        tails.append((bits + (bits & hits) | bits & ~hits) & every)
    tails.reverse()
    return lambda i, j: len(a) - i - (tails[j] & (1 << len(a) - i) - 1).bit_count()


def diff_lists(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, text) runs that turn a into b along a longest common subsequence; of equally good ways a word is deleted first."""
    common = _common_tails(a, b)

    def steps() -> Iterator[tuple[str, str]]:
        i = j = 0
        while (i, j) != (len(a), len(b)):
            if a[i : i + 1] == b[j : j + 1]:
                yield "equal", a[i]
                i, j = i + 1, j + 1
            elif j == len(b) or i < len(a) and common(i + 1, j) >= common(i, j + 1):
                yield "delete", a[i]
                i += 1
            else:
                yield "insert", b[j]
                j += 1

    return [(op, " ".join(word for _, word in run)) for op, run in groupby(steps(), key=itemgetter(0))]


STATUTE_WORDS = unicodedata.normalize("NFKC", STATUTORY_WARNING).lower().split()


@F.pandas_udf(DIFF_TYPE)
def _diff(found: pd.Series) -> pd.Series:
    return found.map(lambda b: None if b is None else [{"op": op, "text": text} for op, text in diff_lists(STATUTE_WORDS, list(b))])


def warning_diff(found_words: Column) -> Column:
    """Runs of equal, deleted and inserted words; verbatim texts do not leave the JVM."""
    verbatim = found_words == F.array(*map(F.lit, STATUTE_WORDS))
    same = F.array(F.struct(F.lit("equal").alias("op"), F.lit(" ".join(STATUTE_WORDS)).alias("text")))
    return F.when(verbatim, same).otherwise(_diff(F.when(~verbatim, found_words)))


def words_in(diff: Column, op: str) -> Column:
    return F.aggregate(F.filter(diff, lambda s: s["op"] == op), F.lit(0), lambda n, s: n + F.size(F.split(s["text"], " ")))


def compatible(c: Column) -> Column:
    return normalized(c, "NFKC")


def assess(reading: Column, text: Column, diff: Column) -> Column:
    """struct<wording_exact, insertions, deletions, header_caps, header_bold, legible_size, problems>.

    `text` is the reading's text in compatibility form, `diff` its warning_diff(). The heading counts as
    capitals only if the reader says so and the text has it.
    """
    insertions, deletions = words_in(diff, "insert"), words_in(diff, "delete")
    exact = (insertions == 0) & (deletions == 0)
    caps = reading["header_is_all_caps"] & F.contains(F.regexp_replace(text, f"{WS}+", " "), F.lit(WARNING_HEADER))
    bold, size = reading["header_is_bold"], reading["legible_size"]
    count = lambda n, what: F.when(n > 0, F.format_string(f"%d {what}", n))
    problems = F.array_compact(
        F.array(
            F.when(~exact, F.concat(F.lit("wording differs: "), F.concat_ws(", ", count(deletions, "missing"), count(insertions, "added or altered")))),
            F.when(~caps, F.lit("heading not in capitals")),
            F.when(~bold, F.lit("heading not bold")),
            F.when(~size, F.lit("not readily legible")),
        )
    )
    return F.struct(exact.alias("wording_exact"), insertions.alias("insertions"), deletions.alias("deletions"), caps.alias("header_caps"), bold.alias("header_bold"), size.alias("legible_size"), problems.alias("problems"))
