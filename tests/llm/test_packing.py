import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from proofline.llm.packing import cuts, pack_documents, sizes
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_cuts():
    own = set(sizes(2048).tolist())
    assert len(own) < 100
    for n in range(1, 5000):
        got = cuts(n, 2048)
        assert sum(got) == n and set(got) <= own
    assert cuts(2048, 2048) == [2048] and cuts(600, 2048) == [512, 85, 3]


def test_each_id_lies_in_one_piece(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "Brewery", "of", "12", "café"]) for _ in range(rng.randrange(700))) for _ in range(300)] + [None, "", "same", "same", "x y " * 9000]
    df = spark.createDataFrame([(k, t, "a", 0) for k, t in enumerate(texts)], "doc_id long, text string, length string, rank int")
    got = pack_documents(df, PATH).toPandas()
    tok = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        mine = got[got.doc_id == k].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum()[:-1]] and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    ends = defaultdict(int)
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert set(ends) == set(range(len(ends))) and max(ends.values()) <= 2048
    padding = sum(2048 - v for v in ends.values() if v & (v - 1))
    assert padding < 0.02 * sum(ends.values()) + 2048
    assert pack_documents(df.limit(0), PATH).count() == 0
    twice = pack_documents(df.limit(3).union(df.limit(3)), PATH).toPandas()
    assert twice.length.sum() == 2 * got[got.doc_id < 3].length.sum()
    assert not twice.duplicated(["sequence_id", "offset"]).any()
