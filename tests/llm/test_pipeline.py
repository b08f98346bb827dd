import re

import pytest
from pyspark.sql import functions as F
from test_shingles import first_of_each_group

SF = "/root/testdata/sf0.001"


def with_odd_rows(docs):
    """The given documents, repeated rows, null and empty values, copies, and columns whose names the stages use inside."""
    spark = docs.sparkSession
    more = [(10_000, "12 34", "en", "src1", 5), (10_001, None, None, None, None), (10_002, "", "en", "src1", 0), (None, "Ein Text ohne Nummer, der bleibt.", None, None, 3), (None, "Ein Text ohne Nummer, der bleibt.", None, None, 3)]
    docs = docs.union(spark.createDataFrame(more, docs.schema)).union(docs.where("doc_id = 3").withColumn("doc_id", F.lit(20_000).cast("long"))).union(docs.where("doc_id in (5, 6)"))
    return docs.withColumns({"hash": F.lit(1), "node": F.lit("n"), "score": F.lit(0.0), "id": F.lit(7), "block": F.lit(2), "length": F.lit(3)})


def run_stages(spark, docs, where):
    import corpus_pipeline

    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        done.write.parquet(path := str(where / name))
        done = spark.read.parquet(path)
        out.append((docs, done))
        docs = done
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    from proofline.llm.common import load
    from proofline.llm.languages import MIN_SHARE, learn
    from proofline.llm.mixing import mix, taken_words
    from proofline.llm.toxicity import learn as learn_toxic

    docs = with_odd_rows(load(spark, SF, "documents"))
    kept = run_stages(spark, docs, tmp_path)
    for a, b in kept[:4]:
        assert a.columns == b.columns
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=str)

    a, b = kept[0]
    model = learn(a)
    want = []
    for r in a.collect():
        lang, share, _ = model.predict([r.text])[0]
        if lang != "und" and share >= MIN_SHARE:
            want.append(tuple((r.asDict() | {"lang": r.lang or lang}).values()))
    assert as_rows(b) == sorted(want, key=str) and not {10_000, 10_001, 10_002} & {r.doc_id for r in b.collect()}

    a, b = kept[1]
    model = learn_toxic(a, load(spark, SF, "labels"))
    assert as_rows(b) == sorted((tuple(r) for r in a.collect() if model.score_text(r.text or "") < 0.5), key=str)

    a, b = kept[2]
    rows = sorted(((r.doc_id, r.text) for r in a.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted((r.doc_id for r in b.collect()), key=str) == sorted(first_of_each_group(rows), key=str)
    assert {5, 6} <= {r.doc_id for r in a.collect()} and len(rows) - b.count() >= 4

    a, b = kept[3]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted(((r.doc_id, r.taken) for r in taken_words(*mix(a)).collect() if r.taken), key=str)
    assert sorted(((r.doc_id, count(r.text)) for r in b.collect()), key=str) == want
    source = {r.doc_id: (r.text or "").encode().split() for r in a.collect()}
    assert all(set(r.text.encode().split()) <= set(source[r.doc_id]) and r.n_chars == len(r.text) for r in b.collect())

    a, b = kept[4]
    got = b.toPandas()
    texts = [r.doc_id for r in a.collect()]
    assert sorted(map(str, texts)) == sorted(str(None if x != x else int(x)) for x in got[got.start == 0].doc_id)
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    ends = got.sort_values(["sequence_id", "offset"])
    assert ((ends.offset + ends.length).groupby(ends.sequence_id).shift(1, fill_value=0) == ends.offset).all() and (ends.offset + ends.length).max() <= 2048


@pytest.mark.parametrize("odd", [False, True])
def test_empty_table(spark, odd):
    import corpus_pipeline
    from proofline.llm.common import load

    docs = load(spark, SF, "documents")
    docs = (with_odd_rows(docs) if odd else docs).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
