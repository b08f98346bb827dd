import hashlib
import math
import random
import re
import zlib
from collections import Counter

from proofline.llm import resampling as R
from proofline.llm.tournament import Losers, merge


def test_merge():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randrange(30), rng.randrange(5)) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(9))]
        blocks = []
        for run in runs:
            k = 0
            while k < len(run):
                n = rng.randrange(1, 9)
                blocks.append((run[k], run[k : k + n]))
                k += n
        blocks.sort(key=lambda b: b[0])
        assert list(merge(blocks)) == sorted(sum(runs, []))
    tree = Losers()
    assert tree.head() is None
    tree.open([])
    assert tree.head() is None


def test_a_merge_opens_a_block_a_run_at_most():
    open_ = []

    def block(rows):
        open_.append(1)
        yield from rows
        open_.pop()

    runs = [[(k * 10 + r) for k in range(100)] for r in range(3)]
    blocks = sorted((run[k], block(run[k : k + 5])) for run in runs for k in range(0, 100, 5))
    for _ in merge(blocks):
        assert len(open_) <= 6


def plain(rows, target, percent, buckets, longest, least, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc_id, text in rows:
        words, own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words >= least])
    due = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(due[: percent * len(due) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def test_resample(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["Été", "日本"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(40)))) for k in range(600)]
    rows += [(700, None), (701, ""), (702, "a1-B2, a1 " * 60_000), (None, "w1 " * 30), (None, "w1 " * 30), (5, "w2 " * 25), *[(9, "w3 " * 25)] * 300]
    target = ["w1 w2 w3 W4 w5", None, "", "w1 w1"]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "doc_id long, text string, score string, row int").repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    see = lambda d: sorted(map(tuple, d.collect()), key=repr)
    got = R.resample(df, goal)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5 and see(got) == plain(rows, target, 10, 10_000, 1, 20)
    monkeypatch.setattr(R, "LEAST_RANGE", 16)  # many ranges, blocks of few rows, equal ids over several ranges
    monkeypatch.setattr(R, "SPREAD", 1)
    monkeypatch.setattr(R, "BLOCK", 3)
    monkeypatch.setattr(R, "OUT", 7)
    for percent, buckets, longest in ((50, 64, 1), (100, 1000, 3)):
        assert see(R.resample(df, goal, percent, buckets=buckets, longest_run=longest)) == plain(rows, target, percent, buckets, longest, 20)
    assert see(R.resample(df, goal.limit(0), 0)) == plain(rows, [], 0, 10_000, 1, 20)
    assert R.resample(df.limit(0), goal).count() == 0


def test_runs_go_on_across_slices(monkeypatch):
    from proofline.llm import byte_words

    text = b"a b c d e f g h"
    whole = sorted(h for _, x in R.features(text, 3) for h in x.tolist())
    monkeypatch.setattr(byte_words, "SLICE", 3)
    assert sorted(h for _, x in R.features(text, 3) for h in x.tolist()) == whole and len(whole) == 8 + 7 + 6


def test_string_ids(spark):
    rows = [(f"d{k}", "w1 w2 " * (10 + k % 3)) for k in range(50)]
    got = R.resample(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([("w1",)], "text string"), 40).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21))
    order = sorted(got, key=lambda r: (-r.score, r.id))
    assert [r.rank for r in order][:20] == list(range(1, 21))
