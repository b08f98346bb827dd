import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from proofline.llm.packed_ids import BLOCK, layout, pack, part_of, read_files, unpack, unpack_block, write_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=400)), max_size=5))
def test_file_round_trip(docs):
    ids = [np.array(x, "<u4").tobytes() for _, x in docs]
    data = pack([i for i, _ in docs], ids)
    assert list(unpack(data)) == [(i, x) for (i, _), x in zip(docs, ids, strict=True)]
    _, starts, n = layout(data)
    flat = b"".join(unpack_block(data, int(s)).tobytes() for s in starts)
    assert flat[: 4 * n] == b"".join(ids) and len(flat) == 4 * BLOCK * len(starts)
    for lo, hi in ((0, n), (n // 3, n // 2), (n // 2, n // 2), (n - 1, n + 9), (n + 5, n + 9), (BLOCK - 1, BLOCK + 1)):
        assert part_of(data, lo, hi).tobytes() == b"".join(ids)[4 * max(lo, 0) : 4 * hi]


def test_documents(spark):
    texts = {5: "Some text.", 1: None, 9: "", 3: "the same", 7: "long " * 5000, 4: "é\n\n😀", 20: "the same"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, part int")
    tok = Tokenizer.from_file(PATH)
    want, at = {}, 0
    for k in sorted(texts):
        ids = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        want[k] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = read_files(write_files(df, PATH, file_ids=100)).collect()
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert read_files(write_files(df.limit(0), PATH)).count() == 0
    with pytest.raises(TypeError, match="whole number"):
        write_files(df.withColumn("doc_id", df["text"]), PATH)
    same = df.union(df).union(spark.createDataFrame([(None, "x", 1)], df.schema))
    got = sorted(read_files(write_files(same, PATH)).collect(), key=lambda r: r.start)
    assert got[0].id is None and len(got) == 2 * len(texts) + 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
