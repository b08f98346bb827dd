import random

import xxhash
from proofline.llm.simhash import fingerprint, links, near_duplicates


def plain(text):
    w = text.lower().split()
    g = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h)) if h else 0


def components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        t = " ".join(rng.choice(["A", "bÄ", "cc", "D"]) for _ in range(n)).encode()
        assert fingerprint(t) == plain(t)


def test_rows_match_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(150)]
        for c in range(6):
            copy = list(base)
            for _ in range(c // 2):
                copy[rng.randrange(150)] = "new"
            texts.append(" ".join(copy))
    texts += [None, "", " \t", "one", "one", "one two"]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp long")
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in near_duplicates(docs).collect()}
    fps = [plain((t or "").encode()) for t in texts]
    assert got == {k: (f, c) for k, (f, c) in enumerate(zip(fps, components(fps), strict=True))}
    empty = near_duplicates(docs.limit(0))
    assert empty.count() == 0


def test_dense_postings_link_alike(spark):
    rng = random.Random(3)
    fps = set()
    while len(fps) < 600:
        x = 0x123456789ABCDEF
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = components([x & (2**64 - 1) for x in fps])

    def joined(split):
        from proofline.llm.components import connected_components

        root = {r.node: r.root for r in connected_components(links(df, split)).collect()}
        return [fps.index(root.get(x, x)) for x in fps]

    assert joined(1 << 17) == want
    assert joined(10) == want


def test_masks():
    import numpy as np
    from proofline.llm.simhash import _by_masks

    rng = random.Random(4)
    fps = list({0xFFFF0000 ^ rng.getrandbits(14) for _ in range(300)})
    got = _by_masks(np.array(fps, np.uint64), np.arange(len(fps)), 0, len(fps))
    assert list(got) == components(fps)
