import hashlib
import random
from itertools import combinations

import numpy as np
from proofline.llm import digests as D


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuwé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_collisions():
    data = np.frombuffer(words(random.Random(1), 60).encode() + b"a" * 70, np.uint8)
    want = [sum(a == b for a, b in combinations(data[k : k + D.WINDOW].tolist(), 2)) for k in range(data.size - D.WINDOW + 1)]
    assert D.collisions(data).tolist() == want and D.collisions(data[:5]).size == 0


def plain(text, ranks):
    data = text.encode()
    if len(data) < D.WINDOW:
        return D.text_features([data], ranks)[0].tolist()
    arr = np.frombuffer(data, np.uint8)
    n = arr.size - D.WINDOW + 1
    hashes = [int(D.window_hashes(arr[k : k + D.WINDOW])[0]) for k in range(n)]
    key = [(int(ranks[c]), h >> 16) for c, h in zip(D.collisions(arr).tolist(), hashes, strict=True)]
    out = [hashes[k] for k in range(n) if key[k] == min(key[max(0, k - D.REACH) : k + D.REACH + 1])]
    return list(dict.fromkeys(out))


def test_choice_against_plain_form_and_slices(monkeypatch):
    rng = random.Random(2)
    ranks = np.array(rng.sample(range(D.LEVELS), D.LEVELS), np.uint16)
    texts = [words(rng, n) for n in (0, 1, 4, 5, 6, 30, 200)] + ["ab " * 300, "", "x" * 31, "x" * 32, "x" * 33]
    want = [plain(t, ranks) for t in texts]
    assert [x.tolist() for x in D.text_features([t.encode() for t in texts], ranks)] == want
    monkeypatch.setattr(D, "SLICE", 100)
    assert [x.tolist() for x in D.text_features([t.encode() for t in texts], ranks)] == want


def test_likeness_falls_with_change():
    rng = random.Random(3)
    ranks = np.arange(D.LEVELS, dtype=np.uint16)
    chain = lambda t: D.filters(D.text_features([t.encode()], ranks)[0])
    base = words(rng, 4000).split()
    near = []
    for share in (0, 0.1, 0.5, 1):
        other = base[: int(4000 * (1 - share))] + words(rng, int(4000 * share)).split()
        near.append(D.likeness(chain(" ".join(base)), chain(" ".join(other))))
    assert near[0] == 1 and near[0] > near[1] > 0.8 and 0.35 < near[2] < 0.65 and near[3] < 0.1
    assert D.likeness(chain(""), chain("")) == 1 and D.likeness(chain(""), chain("a")) == 0
    assert (D.from_string(D.to_string(chain(" ".join(base)))) == chain(" ".join(base))).all()


def test_rows(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(120)) for _ in range(90)] + [None, "", "😀é" * 7, words(rng, 60_000)]
    ids = rng.sample(range(10_000), len(texts))
    rows = sorted(zip(ids, texts, strict=True), reverse=True) + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, bucket int, fingerprint string")
    ranks = D.rarity(df)
    counts = np.zeros(D.LEVELS, int)
    for _, t in rows:
        np.add.at(counts, D.collisions(np.frombuffer((t or "").encode(), np.uint8)), 1)
    assert np.argsort(ranks).tolist() == sorted(range(D.LEVELS), key=lambda k: (counts[k], k))
    chain = lambda t: D.filters(D.text_features([t.encode()], ranks)[0])
    for bucket_rows in (2000, 7):
        got = {r.doc_id: r for r in D.fingerprints_with_next(df, bucket_rows=bucket_rows).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            h = len(t) // 2
            edited = t[: len(t) - h] + after[:h]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (D.to_string(chain(t)), D.to_string(chain(edited)))
            assert abs(r.near_edited - D.likeness(chain(t), chain(edited))) < 1e-12 and abs(r.near_next - D.likeness(chain(t), chain(after))) < 1e-12
    one = D.fingerprints_with_next(df.where("doc_id is null")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert D.fingerprints_with_next(df.limit(0)).count() == 0
    twice = D.fingerprints_with_next(df.union(df), bucket_rows=7).collect()
    assert len(twice) == 2 * len(rows)
