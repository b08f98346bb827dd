"""Audit of how sources of a language differ in their words, by inclusion-exclusion over the terms that each has."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_words import table, words_of
from .common import load, release, ship, small, written

#: A term is kept if so many documents of its language have it.
LEAST_DOCUMENTS = 10
#: Shares are whole numbers of this.
UNIT = 1_000_000_000
#: Ranks given of the part `term`.
TOP_TERMS = 10
#: Sources of a language that meet in one task at a time: longer postings are joined block by block.
BLOCK = 256
#: Rows of a histogram that are priced together.
PRICED = 4_096
#: Different terms that a task holds before it passes its counts on.
HELD = 200_000
TERMS = table(digits=False)


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): each group's terms with occurrences and documents; a row of null term for each group.

    Tasks count in memory and pass on what they have whenever it is HELD terms, so that one row a term and task is shuffled.
    """
    text = lambda c, kind: F.coalesce(F.col(c).cast("string"), F.lit("")).cast(kind)
    given = docs.select(text(lang_col, "string").alias("lang"), text(source_col, "string").alias("source"), text(text_col, "binary").alias("text"))
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, holders) in seen.items():
                terms = [None, *times]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *times.values()], pa.int64()), pa.array([0, *map(holders.__getitem__, times)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)
            seen.clear()

        for b in small(batches):
            for lang, source, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                times, holders = seen.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in words_of(body.as_py(), TERMS):
                    times.update(terms)
                    own.update(terms)
                holders.update(own)
            if sum(len(times) for times, _ in seen.values()) > HELD:
                yield from passed_on()
        yield from passed_on()
        release()

    ship(docs.sparkSession)
    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in whole units, exact whatever the counts; null where no term is kept."""
    upper = (count + 2).cast("decimal(19,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", upper, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counted: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The counts of kept terms with `lang_n`, the language's, and `first`, true in one row a language and term; groups' own rows stay."""
    w = Window.partitionBy("lang", "term")
    known = F.col("term").isNotNull()
    out = counted.withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": known & (F.min("source").over(w) == F.col("source"))})
    return out.where(~known | (F.col("lang_docs") >= least)).select("lang", "source", "term", "n", "lang_n", "first")


def group_sizes(kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, zero, n_blocks, block) of each group: sums of counts, terms kept, the share of a term it lacks."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("v"))
    lang = own.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("v").alias("v"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    out = own.drop("v").join(lang, "lang")
    return out.withColumns({"zero": share(F.lit(0), F.col("total"), F.col("v")), "block": F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int")})


def meeting(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Each two different sources of equal keys once: (keys, a, b, a_* and b_* of the values), a before b within a block.

    Rows of a source go to all pairs of blocks that its own is in, so a task has two blocks at most, however many
    sources a key has. A language's n_blocks is the same in all its rows.
    """
    side = lambda s, other: rows.select(*keys, F.col("source").alias(s), *[F.col(v).alias(f"{s}_{v}") for v in values], F.col("block").alias(f"{s}_block"), F.explode(other).alias("other"))
    left = side("a", F.sequence("block", F.col("n_blocks") - 1)).withColumnsRenamed({"a_block": "i", "other": "j"})
    right = side("b", F.sequence(F.lit(0), F.col("block"))).withColumnsRenamed({"b_block": "j", "other": "i"})
    return left.join(right, [*keys, "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))).drop("i", "j")


def one_sided(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value): what the terms of a come to if b had none of them, for each two sources of a language.

    Prices depend on a count alone, so a group's terms are a histogram of counts, and on the other side by its `zero`
    alone. A language's histograms are cut into chunks that each meet all its different zeros.
    """
    bars = terms.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("many"), F.first("p").alias("p"))
    chunks = F.ceil(F.count(F.lit(1)) / PRICED).cast("int")
    langs = bars.groupBy("lang").agg(chunks.alias("chunks"))
    bars = bars.join(langs, "lang").withColumn("chunk", F.pmod(F.xxhash64("source", "n"), F.col("chunks")).cast("int")).drop("chunks")
    zeros = sizes.select("lang", "zero").distinct().join(langs, "lang").select("lang", "zero", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    priced = bars.join(zeros, ["lang", "chunk"]).groupBy("lang", F.col("source").alias("a"), "zero").agg(F.sum(F.col("many") * gap(F.col("p"), F.col("zero"))).alias("value"))
    return priced.join(sizes.select("lang", "zero", F.col("source").alias("b")), ["lang", "zero"]).where("a <> b").select("lang", "a", "b", "value")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other, and its own terms.

    Terms are runs of letters and characters outside ASCII, A-Z lower-cased; a language keeps those that `least` of its
    documents have. Each group gives a kept term the share of share(). Part `pair` has the sum of gap() over all kept
    terms, part `term` the `top` terms that the source has more of than its language.

    No pair of sources visits all terms. With A and B the terms that each has, of V kept:
    sum = one_sided(A, B) + one_sided(B, A) + (V - |A| - |B| + |A and B|) gap(zero, zero)
    + over A and B: gap(p, q) - gap(p, zero) - gap(zero, q), from the join of postings, which hold a term's sources only.

    Nulls in the three columns are ''. Empty texts are documents without terms; very long ones are read whole, in
    slices. Repeated rows count as often as they are there. Ties of value go by the item's bytes. A language without
    kept terms has pairs of value 0; an empty table gives no rows. Further columns, whatever their names, are not read.
    """
    kept = written(kept_terms(count_terms(docs, text_col, lang_col, source_col), least))
    sizes = written(group_sizes(kept))
    placed = kept.where("term is not null").join(sizes, ["lang", "source"])
    terms = placed.withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    held = terms.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("own"))
    frame = sizes.join(held, ["lang", "source"], "left").fillna(0, ["own"])
    constants = meeting(frame, ["lang", "v"], ["zero", "own"])
    none = F.coalesce(gap(F.col("a_zero"), F.col("b_zero")), F.lit(0))
    constants = constants.select("lang", "a", "b", ((F.col("v") - F.col("a_own") - F.col("b_own")) * none).alias("value"))

    shared = meeting(terms, ["lang", "term"], ["p", "zero"])
    p, q, zp, zq = (F.col(c) for c in ("a_p", "b_p", "a_zero", "b_zero"))
    overlaps = shared.select("lang", "a", "b", (gap(p, q) - gap(p, zq) - gap(zp, q) + gap(zp, zq)).alias("value"))
    overlaps = overlaps.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    # Both orders of a pair, so that each block's order of a and b is of no account.
    both = lambda d: d.unionByName(d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    parts = both(constants).unionByName(both(overlaps)).unionByName(both(one_sided(terms, sizes)))
    pairs = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")

    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    more = terms.where(F.col("n") > 0).withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    named = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(ranked(pairs), "pair").unionByName(named(ranked(more).where(F.col("rank") <= top), "term"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(load(spark, sf_dir, "documents"))


ORACLE = r"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        said AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
        kept AS (SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p
            FROM totals JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN counts USING (lang, source, term)),
        whole AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 2)::HUGEINT // ((SELECT sum(total) FROM totals AS t WHERE t.lang = s.lang) + 2 * any_value(v))::HUGEINT AS q
            FROM shares AS s JOIN v USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source),
        pair_values AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN pair_values USING (lang, source, item)
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 10"""
