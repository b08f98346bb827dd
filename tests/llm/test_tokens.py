import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from proofline.llm import tokens

PIECES = ["the", "The", " ", "  ", "\n", "\n\n", "\t", ",", "...", "'s", "'", "é", "É", "12", "\x01", "\x0b", "ñandú", "𝔘", "é", "²", "İ", "Σ", " ", "a", "###", "_x", "\x1c", "word", "中文", "<|endoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_whole_text(name, monkeypatch):
    e = tokens.Encoder(public_tokenizers.path(name))

    def whole(t):
        return np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.one_of(st.sampled_from(PIECES), st.just(" ")), max_size=14).map("".join))
    def run(t):
        assert e.encode(t) == whole(t)

    run()
    monkeypatch.setattr(tokens, "SLICE", 50)
    long = "Some words, of a text.\nThat goes on " * 40
    assert e.encode(long) == whole(long)
    texts = [long, "a", None, "x  y", " b c", "\n\n\nq", long[:40], "Été\nÀ", ""]
    assert list(e.encode_column(pa.array(texts))) == [whole(t or "") for t in texts]
    monkeypatch.setattr(e, "most", 0)
    e.known.clear()
    assert e.encode(long) == whole(long) and e.encode("") == b""


def test_a_tokenizer_whose_tokens_cross_words_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    letters = {chr(c): k for k, c in enumerate(range(9, 127))}
    other = Tokenizer(models.BPE(vocab={**letters, "d ": 200, "d a": 201}, merges=[("d", " "), ("d ", "a")]))
    other.save(str(tmp_path / "t.json"))
    e = tokens.Encoder(str(tmp_path / "t.json"))
    texts = ["and a cad and", "", None, "plain"]
    assert e.whole and list(e.encode_column(pa.array(texts))) == [np.array(other.encode(t or "").ids, "<u4").tobytes() for t in texts]
    assert not tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")).whole and not tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")).whole
