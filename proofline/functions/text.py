"""Folding, tokens, the normalisation ladder and similarity of short texts, as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import APOSTROPHES, DASHES, NOISE_TOKENS, QUOTES, TOKEN_SYNONYMS

#: White space as ECMAScript has it; Java's \s lacks most of it. The class costs most characters one look-up and one comparison: Java tries the parts of a class in turn.
WS = "[\\t\\n\\x0B\\f\\r \\u00A0[\\u1680-\\uFEFF&&[\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]]]"
BLANKS = "\t\n\v\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
FOLD_FROM = APOSTROPHES + DASHES + QUOTES
FOLD_TO = "'" * len(APOSTROPHES) + "-" * len(DASHES) + '"' * len(QUOTES)
RUNGS = ("exact", "whitespace", "typography", "case", "accents", "punctuation", "synonyms")


def _normaliser(form: str):
    @F.pandas_udf(T.StringType())
    def normalise(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return normalise


_NORMALISERS = {form: _normaliser(form) for form in ("NFKC", "NFD", "NFKD")}


def normalized(c: Column, form: str) -> Column:
    """Unicode normal form. ASCII texts, which all forms leave alone, do not leave the JVM: the UDF gets null for them."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, c).otherwise(_NORMALISERS[form](F.when(~ascii_only, c)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def collapse_whitespace(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"{WS}+", " "))


def fold_typography(c: Column) -> Column:
    """Compatibility form, then one apostrophe, one hyphen, one quotation mark."""
    return F.translate(normalized(c, "NFKC"), FOLD_FROM, FOLD_TO)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(normalized(c, "NFD"), "[\\u0300-\\u036F]", "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, "[^\\p{L}\\p{N}\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]", " ")


def _tokens_of_folded(c: Column) -> Column:
    words = F.split(F.lower(strip_punctuation(F.regexp_replace(c, "[&+]", " and "))), f"{WS}+")
    return F.filter(words, lambda t: t != "")


def tokenize(c: Column) -> Column:
    return _tokens_of_folded(fold_typography(c))


def _canonical(tokens: Column) -> Column:
    same = F.create_map(*[F.lit(x) for pair in TOKEN_SYNONYMS.items() for x in pair])
    return F.filter(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(same, t), t)), lambda t: ~t.isin(*NOISE_TOKENS))


def canonical_tokens(c: Column) -> Column:
    """Tokens with abbreviations written out and noise words left out."""
    return _canonical(tokenize(c))


def forms(c: Column) -> Column:
    """The text at each rung of the ladder, and its canonical tokens: all that comparing it needs."""
    folded = fold_typography(c)
    typography = collapse_whitespace(folded)
    case = F.lower(typography)
    tokens = _canonical(_tokens_of_folded(folded))
    return F.struct(
        c.alias("exact"),
        collapse_whitespace(c).alias("whitespace"),
        typography.alias("typography"),
        case.alias("case"),
        strip_diacritics(case).alias("accents"),
        collapse_whitespace(strip_punctuation(F.lower(strip_diacritics(folded)))).alias("punctuation"),
        F.array_join(tokens, " ").alias("synonyms"),
        tokens.alias("tokens"),
    )


def ladder_level(left: Column, right: Column) -> Column:
    """The first rung at which two forms() agree on something other than blanks; null if none."""
    out = F
    for rung in RUNGS:
        a, b = left[rung], right[rung]
        out = out.when((a == b) & (trimmed(a) != ""), F.lit(rung))
    return out


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of distinct tokens; two empty lists are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def combined_similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column) -> Column:
    return F.greatest(edit_similarity(a, b), token_similarity(a_tokens, b_tokens))


def contains_all(haystack: Column, needle: Column) -> Column:
    return (F.size(needle) > 0) & (F.size(F.array_except(needle, haystack)) == 0)


def extra_tokens(found: Column, expected: Column) -> Column:
    """Found tokens that were not expected, in order, repeats kept."""
    return F.filter(found, lambda t: ~F.array_contains(expected, t))


def slug(c: Column) -> Column:
    """File-name form: word characters and hyphens, 40 at most, `label` if nothing is left."""
    plain = F.regexp_replace(normalized(c, "NFKD"), f"(?!{WS})[^A-Za-z0-9_-]", "")
    short = F.substring(F.lower(F.regexp_replace(trimmed(plain), f"{WS}+", "-")), 1, 40)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("label"))


def wrap(c: Column, width: int, indent: str = "") -> Column:
    """Greedy line breaks at white space; a line has more than `width` characters only if one word has."""
    words = F.split(c, f"{WS}+")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(state: Column, word: Column) -> Column:
        full = (F.length(state["line"]) + F.length(word) + 1 > width) & (F.length(state["line"]) > 0)
        longer = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        return F.struct(F.when(full, F.array_append(state["lines"], F.concat(F.lit(indent), state["line"]))).otherwise(state["lines"]).alias("lines"), F.when(full, word).otherwise(longer).alias("line"))

    def finish(state: Column) -> Column:
        return F.array_join(F.when(state["line"] == "", state["lines"]).otherwise(F.array_append(state["lines"], F.concat(F.lit(indent), state["line"]))), "\n")

    return F.aggregate(words, start, step, finish)


def plain_number(c: Column) -> Column:
    """A double without a needless decimal part: 45, 12.5."""
    return F.regexp_replace(c.cast("string"), "\\.0$", "")
