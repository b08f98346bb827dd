import itertools
import random
import zlib

from proofline.llm import toxicity as X
from pyspark.sql import functions as F

PLAIN = ["ale", "barrel", "malt", "hops", "river", "stone", "garden", "bread"]
INSULTS = ["dolt", "twerp"]
STEM = "zagru"


def doc(rng, bad, n=40):
    words = [rng.choice(PLAIN) + rng.choice(["", "", "s", "ed"]) for _ in range(n)]
    if bad:
        for _ in range(2):
            words[rng.randrange(n)] = rng.choice([*INSULTS, STEM + rng.choice("abcdefghij")])
    return " ".join(words)


def test_composition_does_what_its_parts_do_in_turn():
    parts = [X.scope("N", 3, {"I": "i", "T": "t"}, X.OUTPUT), X.reported(X.OUTPUT), X.scope("Y", 4, {"I": "J", "T": "U"}, X.OUTPUT)]
    for string in itertools.product(X.LEXICAL, repeat=5):
        states, want = [0, 0, 0], ""
        for x in string:
            for k, p in enumerate(parts):
                states[k], x = p.step(states[k], x)
            want += x
        state, got = 0, ""
        for x in string:
            state, y = X.GRAMMAR.step(state, x)
            got += y
        assert got == want


def test_clauses_weigh_context():
    m = X.Model({"dolt": 2.0, "zagru*": 1.0})
    read = lambda t: [(c[3], round(c[2], 3)) for c in m.clauses(t)]
    assert read("A dolt.") == [("oI", 2.0)]
    assert read("You are a DOLT!") == [("YooJ", 2.6)]
    assert read("he is not a dolt; it is fine") == [("YoNoi", 0.6)]
    assert read("she said the dolt left") == [("YRoqo", 0.8)]
    assert read("adolt dolts") == [] and read("zagrubig.") == [("I", 1.0)]
    assert [c[3] for c in m.clauses("dolt. fine. dolt dolt\nzagrux")] == ["I", "II", "I"]
    assert read("dolt, you are.") == [("JYo", 2.6)] and read("A dolt he is not.") == [("oiYoN", 0.6)]
    assert read("not here. A dolt, not a friend.") == [("oINoo", 2.0)]  # that negation ends no clause
    assert m.clauses("") == [] and [c[3] for c in m.clauses("dolt " * 5000)] == ["I" * 5000]


def test_reading_from_the_end_does_what_its_parts_do_in_turn():
    parts = [X.scope("Y", 4, {"I": "J", "T": "U"}, X.OUTPUT), X.denied(4, {"I": "i", "J": "i", "T": "t", "U": "t"}, X.OUTPUT)]
    for string in itertools.product("oIJYN", repeat=6):
        states, state = [0, 0], 0
        for x in string:
            y = x
            for k, p in enumerate(parts):
                states[k], y = p.step(states[k], y)
            state, got, weight = X.ARCS[state, x]
            assert got == y and weight == X.WEIGHTS.get(y, 0.0)


def test_scopes_reach_over_the_ends_of_what_is_read():
    m = X.Model({"dolt": 2.0})
    for k in range(12):  # the target comes after the entry, wherever the reading of the entry before ends
        text = "dolt " + "malt " * ((X.REACH - 30) // 5) + "x " * k + "dolt ale you"
        assert "".join(c[3] for c in m.clauses(text)).endswith("JoY"), k
    assert m.clauses("dolt " + "malt " * 900 + "not")[0][3].startswith("Io")


def test_long_clauses_are_cut_between_words_and_read_on():
    m = X.Model({"dolt": 2.0, "dolts": 2.0})
    symbols = lambda t: "".join(c[3] for c in m.clauses(t))
    for k in range(12):  # an insult at every place across the first window's end
        text = "dolt " + "a" * (k + 1) + " malt" * ((X.REACH - 12) // 5) + " dolt ale dolts"
        assert symbols(text).count("I") == 3, k
    assert symbols("dolt " + "malt " * 395 + "x " * 11 + "not dolt") == "I" + "o" * 406 + "Ni"
    for k in range(20):
        text = "dolt" + " malt" * 397 + " x" * k + " is not a dolt"
        assert symbols(text) == "I" + "o" * (398 + k) + "Noi", k
    assert symbols("she said " + "malt " * 3000 + "dolt") == "YR" + "o" * 3000 + "q"
    assert symbols("she said dolt " + "malt " * 3000 + "dolt. dolt")[-2:] == "qI"
    assert symbols("never " * 1 + "malt " * 900 + "dolt").endswith("oI")


def test_copies_bring_no_words_in():
    rng = random.Random(3)
    copied = doc(rng, False, 60).replace("ale", "quixote") + " quixote dolt"
    texts = [doc(rng, True) for _ in range(60)] + [copied + f" {k}" for k in range(50)] + [doc(rng, False) for _ in range(120)]
    got = X.learn_lexicon(texts, [1] * 110 + [0] * 120)
    assert any("dolt".startswith(x.rstrip("*")) for x in got) and not any(x.startswith("quix") for x in got)


def test_held_out(spark):
    rng = random.Random(7)
    rows = [(k, doc(rng, k % 4 == 0), int(k % 4 == 0)) for k in range(1200)]
    docs = spark.createDataFrame([(k, t, 0.5, 0) for k, t, _ in rows] + [(5000, None, 0.0, 0), (5001, "", 0.0, 0), (None, "a dolt", 0.0, 0), (5002, "malt " * 60_000 + "dolt", 0.0, 0)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(k, y, 1) for k, _, y in rows] + [(1, None, 0), (5000, 1, 1), (999_999, 1, 1)], "doc_id long, toxic int, quality int")
    model = X.learn(docs, labels)
    out = {r.id: r for r in X.toxicity(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(out[k].predicted == y for k, _, y in held) >= 0.97 * len(held) > 150
    assert out[5000].score == out[5001].score < 0.5 and out[None].predicted == 1 == out[5002].predicted
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert X.toxicity(docs.limit(0), model).count() == 0
    nothing = X.learn(docs, labels.where("false"))
    assert {r.predicted for r in X.toxicity(docs, nothing).collect()} == {0}
    one = X.learn(docs, labels.where("toxic = 0"))
    assert X.toxicity(docs, one).agg(F.max("predicted")).first()[0] == 0
