import random
import re
from collections import Counter, defaultdict

import numpy as np
from proofline.llm import mixing
from proofline.llm.mixing import draws, mix, mixing_stage, permuted, shard_draw, source_targets, split_draw, taken_words


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            assert sorted(permuted(np.arange(n), n, key).tolist()) == list(range(n))


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 2 * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in open_}
        capped |= {s: 2.0 * sizes[s] for s in over}


def table(spark):
    rng, rows = random.Random(5), []
    for k in range(900):
        source = rng.choice(["a", "a", "a", "b", "c", "Z", None, "é", "d"])
        rows.append((k, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(300))), "en", source, 0, 0))
    rows += [(None, "a b c", "en", "a", 0, 0), (None, "a b c", "en", "a", 0, 0), (900, None, "en", "n", 0, 0), (901, "", None, None, 0, 0), (902, "  one\x0btwo\t", "en", "b", 0, 0), (903, "w " * 20_000, "en", "a", 0, 0), rows[5], rows[5]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int")


def test_mix(spark):
    rows, df = table(spark)
    placed, spans = mix(df, block=16, shard=50)
    got = taken_words(placed, spans).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((r[0], count(r[1])) for r in rows), key=str)
    sizes, taken, of = defaultdict(int), defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken <= 2 * r["size"]
        sizes[of[r.doc_id]] += r["size"]
        taken[of[r.doc_id]] += r.taken
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[of[r.doc_id]] and abs(r.target - want[of[r.doc_id]]) <= 1e-9 * max(1, r.target)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = taken_words(*mix(df.repartition(7), block=16, shard=50)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    shards = spans.groupBy("shard").count().collect()
    assert len(shards) > 5
    empty = mix(df.limit(0))
    assert taken_words(*empty).count() == 0


def plain_draw(slots, shard, seed):
    """Every shard's counts by halving all of them in order, and the first slot of each source there."""
    todo, out = [(0, -(-sum(slots) // shard), np.zeros(len(slots), int), np.array(slots))], {}
    while todo:
        lo, hi, first, own = todo.pop()
        if hi - lo == 1:
            out[lo] = (first.tolist(), own.tolist())
        else:
            mid = (lo + hi) // 2
            here = split_draw(np.random.default_rng([seed, lo, hi]), own, (mid - lo) * shard)
            todo += [(lo, mid, first, here), (mid, hi, first + here, own - here)]
    return out


def test_shards_draw_alone_what_all_draw_together():
    for slots, shard in (([70, 0, 31, 200], 20), ([5], 7), ([1, 1, 1], 1), ([0, 9], 3)):
        want = plain_draw(slots, shard, 3)
        got = {h: tuple(x.tolist() for x in shard_draw(np.array(slots), h, shard, 3)) for h in want}
        assert got == want
        assert np.sum([own for _, own in got.values()], axis=0).tolist() == slots
        sizes = [sum(got[h][1]) for h in sorted(got)]
        assert all(n == shard for n in sizes[:-1]) and 0 < sizes[-1] <= shard


def test_counts_of_a_shard_are_multinomial():
    slots, shard, shares = np.array([6000, 3000, 1000]), 100, []
    for seed in range(300):
        shares.append(shard_draw(slots, seed % 100, shard, seed)[1])
    mean, spread = np.mean(shares, axis=0), np.std(shares, axis=0)
    p = slots / slots.sum()
    assert np.allclose(mean, shard * p, atol=1.5) and np.allclose(spread, np.sqrt(shard * p * (1 - p)), rtol=0.2)


def test_draws_beyond_the_exact_generator(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_EXACT", 0)
    for slots, take in (([70, 0, 31, 200], 33), ([2, 1], 3), ([1, 1, 1], 1), ([10**12, 3], 10**11)):
        got = split_draw(np.random.default_rng(1), np.array(slots), take)
        assert got.sum() == take and (got >= 0).all() and (got <= slots).all()


def test_each_block_comes_as_often_as_its_source_needs(spark):
    sources = spark.createDataFrame([(1, 640, 900.0), (2, 100, 200.0), (3, 0, 0.0), (4, 7, 3.0), (5, 65, 129.6)], "source_id long, source_size long, target double")
    got = [tuple(r) for r in draws(sources, block=16, shard=10).collect()]
    for sid, size, target in ((1, 640, 900), (2, 100, 200), (4, 7, 3), (5, 65, 130)):
        n, mine = -(-size // 16), sorted((r[3], r[1], r[4]) for r in got if r[0] == sid)
        words = lambda block, most, size=size, n=n: min(most, size - 16 * (n - 1) if block == n - 1 else 16)
        assert sum(words(b, m) for _, b, m in mine) == target
        times = Counter(b for _, b, _ in mine)
        assert len(set(mine)) == len(mine) and max(times.values()) - min(times[b] for b in range(n)) <= 1
    assert {r[2] for r in got} == set(range(-(-len(got) // 10)))


def test_small_sources_come_near_their_targets(spark):
    for sizes in ((20, 65, 30), (1, 20, 65), (1, 1, 5000), (63, 64, 129)):
        rows = [(k, " ".join(["w"] * n), "en", f"s{k}") for k, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        taken = {r.doc_id: r.taken for r in taken_words(*mix(df)).collect()}
        want = plain_targets({f"s{k}": n for k, n in enumerate(sizes)})
        assert all(abs(taken[k] - want[f"s{k}"]) <= 0.5 + 1e-6 for k in taken), (taken, want)


def test_targets_where_all_are_capped_or_empty(spark):
    for rows in ([("a", 0), ("b", 0)], [("a", 5)], [("a", 1), ("b", 1000), ("c", 3), (None, 7)]):
        df = spark.createDataFrame(rows, "source string, size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = plain_targets(dict(rows))
        assert all(abs(got[s] - t) < 1e-9 for s, t in want.items())


def test_stage_keeps_only_taken_words(spark):
    rows, df = table(spark)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = mixing_stage(spark, df, "").collect()  # the column `block` is the table's own
    assert sorted(((r.doc_id, count(r.text)) for r in out), key=str) == sorted(((r.doc_id, r.taken) for r in taken_words(*mix(df)).collect() if r.taken), key=str)
    assert all(r.n_chars == len(r.text) and r.block == 0 for r in out)
    bare = mixing_stage(spark, df.drop("n_chars", "block"), "").collect()
    assert sorted(r.text for r in bare) == sorted(r.text for r in out)


def test_stage_gives_repeated_rows_their_own_words(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    rows = [(7, text, "en", "a", 0)] * 4 + [(7, text, "fr", "b", 0), (7, text, "fr", None, 0), (None, text, "en", "a", 0), (None, text, "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = mixing_stage(spark, df, "").collect()
    got = sorted((r.doc_id is None, count(r.text)) for r in out)
    assert got == sorted((r.doc_id is None, r.taken) for r in taken_words(*mix(df)).collect() if r.taken)
    assert all(n <= 2 * 1000 for _, n in got)
