import itertools
import random
import zlib

import numpy as np
from proofline.llm import languages
from proofline.llm.languages import CHAIN, Lexicon, Model, chain_marginals, features, fit, identify, language_stage, learn, word_hashes
from proofline.llm.letters import Words
from pyspark.sql import functions as F

SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "ung", "ß"], "cc": ["ñe", "ción", "rra", "mi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_words():
    w = Words("Ab, cd1É")
    assert [w.text[a:b] for a, b in zip(w.text_starts, w.text_ends, strict=True)] == ["ab", "cd", "é"]
    assert w.chars.tolist() == [0, 97, 98, 0, 99, 100, 0, 233, 0] and w.starts.tolist() == [1, 4, 7]
    assert len(Words("")) == 0 and len(Words("12 !")) == 0


def test_features_depend_on_the_word_alone():
    one, first = features(Words("abc"), 0, 1, Lexicon())
    two, at = features(Words("x, abc!"), 0, 2, Lexicon())
    assert one.tolist() == two[at[1] :].tolist() and first.tolist() == [0]
    big = Words("x abc yz")
    assert features(big, 1, 2, Lexicon())[0].tolist() == one.tolist()


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, t = rng.standard_normal((n, 3)), rng.standard_normal((3, 3))
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(scores[k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
            for k, y in enumerate(path):
                want[k, y] += w
        want /= want.sum(1, keepdims=True)
        got, _ = chain_marginals(np.concatenate([scores, scores]), t, np.array([n, 0, n]))
        assert np.allclose(got, np.concatenate([want, want]))


def plain_marginals(scores, t):
    """Forward-backward of one chain, word after word."""
    e, t = np.exp(scores), np.exp(t)
    ahead, back = [e[0] / e[0].sum()], [np.ones(e.shape[1])]
    for x in e[1:]:
        a = (ahead[-1] @ t) * x
        ahead.append(a / a.sum())
    for x in e[:0:-1]:
        b = t @ (x * back[-1])
        back.append(b / b.sum())
    p = np.array(ahead) * np.array(back[::-1])
    return p / p.sum(1, keepdims=True)


def plain_pairs(scores, t, gold):
    """Transitions that a chain of one label has beyond those expected."""
    h = 1e-5
    n, m = scores.shape

    def log_z(t):
        a = scores[0]
        for x in scores[1:]:
            a = np.logaddexp.reduce(a[:, None] + t, axis=0) + x
        return np.logaddexp.reduce(a)

    out = np.zeros((m, m))
    for i, j in itertools.product(range(m), repeat=2):
        d = np.zeros((m, m))
        d[i, j] = h
        out[i, j] = (n - 1) * (i == j == gold) - (log_z(t + d) - log_z(t - d)) / (2 * h)
    return out


def test_texts_longer_than_a_piece_are_one_chain():
    rng = np.random.default_rng(4)
    counts = np.array([CHAIN, 0, 1, 3 * CHAIN + 5, CHAIN + 1])
    scores, t = 2 * rng.standard_normal((counts.sum(), 3)), 2 * rng.standard_normal((3, 3))
    gold = np.array([0, 0, 2, 1, 2])
    got, pairs = chain_marginals(scores, t, counts, gold)
    parts = [x for x in np.split(scores, np.cumsum(counts)[:-1])]
    assert np.allclose(got, np.concatenate([plain_marginals(x, t) for x in parts if len(x)]))
    want = sum(plain_pairs(x, t, g) for x, g in zip(parts, gold, strict=True) if len(x))
    assert np.allclose(pairs, want, atol=1e-4)


def test_a_text_read_in_slices_gives_the_same(monkeypatch):
    rng = random.Random(3)
    model = fit([text(rng, x, 40) for x in SYLLABLES for _ in range(9)], [x for x in SYLLABLES for _ in range(9)])
    long = " ".join(text(rng, rng.choice(list(SYLLABLES)), 10) for _ in range(60))
    want, chances = model.predict([long]), np.concatenate([p for p, _ in model.marginals([long])])
    monkeypatch.setattr(languages, "SLICE", 2 * CHAIN)
    assert model.predict(["x", long, "y"])[1] == want[0]
    assert np.allclose(np.concatenate([p for p, _ in model.marginals([long])]), chances)


def test_lexicon():
    texts = ["der hund und die katze", "und der mann", "the dog and the cat", "and the man"]
    words = Words("und and hund zebra")
    lexicon = Lexicon.learn(texts, [0, 0, 1, 1], 2)
    assert lexicon.find(word_hashes(words, 0, 4)).tolist() == [1, 2, 0, 0]  # hund is in one text only
    assert Lexicon.learn([], [], 2).find(word_hashes(words, 0, 4)).tolist() == [0] * 4


def test_held_out_accuracy_and_code_switching(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, lang := rng.choice(list(SYLLABLES)), rng.randrange(5, 90)), lang, 0.0) for k in range(240)]
    odd = [(1000, None, "aa", 0.0), (1001, "", "aa", 0.0), (1002, "12 -- 34", None, 0.0), (None, "kalo miru", None, 0.0), (1004, text(rng, "aa", 90_000), None, 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = learn(df)
    out = {r.id: r for r in identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 30 and sum(out[i].lang_pred == x for i, _, x, _ in held) >= 0.97 * len(held)
    assert [out[k].lang_pred for k in (1000, 1001, 1002, None, 1004)] == ["und"] * 3 + ["aa"] * 2
    assert out[1000].score == 0 and all(0 <= r.score <= 1 for r in out.values()) and out[1004].n_words == 90_000
    mixed = text(rng, "bb", 8) + " " + text(rng, "cc", 8)
    labels = [x[2] for x in model.spans(mixed)]
    assert labels == ["bb"] * 8 + ["cc"] * 8
    kept = language_stage(spark, df.where("doc_id is not null"), "")
    assert kept.columns == df.columns and kept.count() == len(rows) + 1
    assert identify(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in identify(df, learn(df.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_texts_of_a_batch_do_not_touch():
    rng = random.Random(2)
    model = fit([text(rng, x, 40) for x in SYLLABLES for _ in range(9)], [x for x in SYLLABLES for _ in range(9)])
    texts = [text(rng, "aa", 5), None, text(rng, "bb", 200), "", text(rng, "cc", 1)]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]
    assert Model([]).predict(["a"]) == [("und", 0.0, 1)]


def test_letters_that_become_two_in_lower_case():
    """Texts whose lower-cased words are twice as many as their characters let one think are grouped by what they become."""
    model = fit(["the cat sat on the mat"] * 5 + ["le chat est sur la table"] * 5, ["en"] * 5 + ["fr"] * 5)
    texts = ["\u0130" * 32_000, "\u0130" * 32_000, "the mat", "\u0130 " * 40_000]
    got = model.predict(texts)
    assert len(got) == 4 and [g[:2] for g in got] == [model.predict([t])[0][:2] for t in texts]
