import random
import re
from collections import Counter, defaultdict

from proofline.llm import divergence as D
from proofline.llm.byte_words import table, words_of


def plain(rows, least, top):
    """All shares of all kept terms, one by one."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = Counter(t for *_, words in own for t in set(words))
        kept = sorted(t for t, n in holders.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if holders[w] >= least)
            counts[None].update(w for w in words if holders[w] >= least)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for source in {s for _, s, _ in own}:
            pairs = [(sum(gap(p[source][t], p[other][t]) for t in kept), other) for other in {s for _, s, _ in own} - {source}]
            terms = [(gap(p[source][t], p[None][t]), t) for t in kept if counts[source][t] and p[source][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, source, part, item, value, k + 1))
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")


def test_divergence(spark, monkeypatch):
    rng = random.Random(2)
    words = [*[f"w{c}" for c in "abcdefghijklmnop"], "Été", "ÉTÉ", "naïve", "日本", "İ"]
    rows = [(" ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(25))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s2", "s3", "S1", "é", None, ""])) for _ in range(400)]
    rows += [(None, "en", "s9"), ("", "fr", "only"), ("12 !!", "fr", "other"), ("wa " * 9, "it", "lone"), ("wa-wb_wc\x00wa " * 50_000, "de", "s1"), rows[0], rows[0]]
    df = table_of(spark, rows)
    want = plain(rows, 10, 10)
    got = D.source_divergence(df)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    monkeypatch.setattr(D, "BLOCK", 2)  # postings in several blocks, histograms in several chunks, counts passed on early
    monkeypatch.setattr(D, "PRICED", 3)
    monkeypatch.setattr(D, "HELD", 5)
    assert set(map(tuple, D.source_divergence(df).collect())) == want
    assert set(map(tuple, D.source_divergence(df, least=1, top=2).collect())) == plain(rows, 1, 2)
    assert D.source_divergence(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    n, total, v = 4 * 10**12, 9 * 10**13, 10**7
    got = spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def test_slices_end_between_words(monkeypatch):
    from proofline.llm import byte_words

    text = ("Ab1 " * 50 + "x" * 300 + ",,é" + "  ").encode()
    whole = text.translate(table(True)).split()
    for size in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(byte_words, "SLICE", size)
        assert [w for s in words_of(text, table(True)) for w in s] == whole
    assert whole[0] == b"ab1" and b"ab1".translate(table(False)).split() == [b"ab"]
