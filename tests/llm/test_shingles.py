import random

from proofline.llm.shingles import prefix, shingle_set
from proofline.llm.simhash import near_duplicate_stage


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def first_of_each_group(rows):
    """Brute force: the smallest id of each chain of texts with a Jaccard similarity of 0.8 or more."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted((rows[k][0] for k in range(len(rows)) if top(k) == k), key=lambda x: (x is None, x))


def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(500)]
    line = " ".join(rng.choice(words) for _ in range(12))
    out = []
    for _ in range(30):  # near copies around the threshold, a line that all share
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 150]))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(len(base) // 20 + 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy[rng.randrange(3) :]) + (" " + line if len(base) > 100 else ""))
    base = [rng.choice(words) for _ in range(200)]  # a large group
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{k}"
        out.append(" ".join(copy))
    return [*out, None, "", " \t", "one", "ONE ", "one two", "one two three four five"]


def test_stage_matches_brute_force_jaccard(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = first_of_each_group(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 60 < len(want) < len(rows) - 60


def test_similar_sets_share_a_prefix_shingle():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(2000):
        n = rng.integers(1, 60)
        pool = np.unique(rng.integers(0, 1 << 62, 80, np.uint64))
        x, y = (np.sort(rng.permutation(pool[: n + 5])[: rng.integers(n, n + 5)]) for _ in range(2))
        common = np.sort(pool[::3])
        rank = rng.permutation(common.size) + 1
        both = np.intersect1d(x, y).size
        if 5 * both >= 4 * (x.size + y.size - both):
            assert np.intersect1d(prefix(x, common, rank), prefix(y, common, rank)).size
    assert shingle_set(b"").size == 0 and shingle_set(b"a b").size == 1 and shingle_set(b"a b c d e f").size == 2


def test_sketches_never_tell_sets_further_apart_than_they_are():
    import numpy as np
    from proofline.llm.shingles import sketch, sketches_differ

    rng = np.random.default_rng(2)
    for _ in range(500):
        n = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n, np.uint64))
        x = np.sort(rng.permutation(pool)[:n])
        y = np.sort(np.concatenate([rng.permutation(x)[: int(rng.integers(0, x.size + 1))], rng.integers(1 << 62, 1 << 63, int(rng.integers(0, n + 1)), np.uint64)]))
        if y.size:
            apart = x.size + y.size - 2 * np.intersect1d(x, y).size
            assert sketches_differ(sketch(x), sketch(y)) <= apart and sketches_differ(sketch(x), sketch(x)) == 0
    far = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert sketches_differ(sketch(far), sketch(far + np.uint64(1))) > 2000 / 9


def test_pairs_of_any_distance_in_a_posting_come_up_once():
    import numpy as np
    from proofline.llm.shingles import _open_pairs_of

    n = 150
    rows = np.stack([np.zeros(n, np.int64), np.full(n, 50), np.arange(n), np.zeros(n, np.int64), np.arange(n) % 30])
    found = [set(), set()]
    for k, spans in enumerate(([(1, None)], [(1, 2), (2, 13), (13, None)])):
        for lo, hi in spans:
            for b in _open_pairs_of(rows, lo, hi):
                new = set(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                assert not new & found[k]
                found[k] |= new
    assert found[0] == found[1] == {(a, b) for b in range(n) for a in range(b) if a % 30 != b % 30}


def test_stage_keeps_one_row_of_each_group(spark):
    a, b, c = ("alpha beta gamma delta epsilon " + x for x in ("one", "two", "three"))
    rows = [(1, a, "en"), (1, a, "en"), (1, a, None), (2, b, "en"), (1, b, "en"), (None, c, "en"), (None, c, "en"), (None, c, "fr"), (None, a, "en"), (3, None, "en"), (4, "", "en")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, None)], key=str)
