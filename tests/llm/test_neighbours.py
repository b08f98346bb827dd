import numpy as np
from proofline.llm.neighbours import Borders, Tree, chi_square_quantile, kd_leaves, nearest

BAD = [None, [0.0] * 6, [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [None] + [1.0] * 5, []]


def brute(rows, asked, k):
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for a, x in good:
        if a in asked:
            hits = sorted((-float((v * x).sum()), i) for i, v in good if i != a)[:k]
            out |= {(a, r, i, -s) for r, (s, i) in enumerate(hits, 1)}
    return out


def test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_leaves_hold_each_point_once():
    points = np.random.default_rng(0).standard_normal((1000, 4))
    points[:400] = 1
    leaves = kd_leaves(points)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 64


def test_recall_and_work_saved():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 8000)] + 0.3 * rng.standard_normal((8000, 64))
    q = x[::100]
    tree = Tree(x, float((x * x).sum(1).max()))
    got, _ = tree.search(q, 20)
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got.tolist(), want.tolist(), strict=True)])
    assert recall >= 0.95
    assert tree.verified < 0.9 * len(q) * len(x)


def test_a_known_product_spares_work():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 64))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 64))
    q, top = x[:50], float((x * x).sum(1).max())
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    free, known = Tree(x, top), Tree(x, top)
    _, scores = free.search(q, 10)
    _, above = known.search(q, 10, want[:, 9])
    assert known.verified <= free.verified < 0.95 * 50 * 4000
    assert all(np.isclose(np.sort(b)[::-1][:5], w[:5]).mean() >= 0.8 for b, w in zip(above, want, strict=True))
    none = Tree(x, top)
    assert none.search(q, 10, np.full(50, np.inf))[0].max() == -1 and none.verified == 0


def test_borders_deal_any_point_to_one_leaf():
    rng = np.random.default_rng(0)
    points = rng.standard_normal((5000, 8))
    for leaves in (1, 2, 5, 16):
        borders = Borders(points, leaves)
        n = np.bincount(borders.find(points), minlength=borders.leaves)
        assert borders.leaves == leaves and n.min() > 0.5 * 5000 / leaves and n.max() < 2 * 5000 / leaves
    assert Borders(np.ones((5000, 8)), 9).leaves == 1 and Borders(points[:0], 4).find(points).max() == 0
    far = Borders(points, 16).find(100 * rng.standard_normal((50, 8)))
    assert far.min() >= 0 and far.max() < 16


def test_recall_over_shards_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = 2 * rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 4000)] + 0.3 * rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(f"v{i:05d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    asked = list(range(0, 4000, 100))
    got = nearest(df, df.where("int(substring(vec_id, 2)) % 100 = 0"), shard_rows=250).collect()
    want = np.argsort(-(x[asked] @ x.T), axis=1)
    best = {(f"v{a:05d}", f"v{j:05d}") for a, row in zip(asked, want, strict=True) for j in [j for j in row if j != a][:20]}
    assert len(got) == 20 * len(asked) and all(r.query_id != r.vec_id for r in got)
    assert len(best & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(best)


def test_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(500)]
    rows += [(1000 + i, [3.0, 3.0, 3.0, 3.0, 3.0, 3.0]) for i in range(200)] + [(2000 + i, v) for i, v in enumerate(BAD)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<double>, shard int, score double")
    asked = {i for i, _ in rows if i % 20 == 0}
    got = nearest(df, df.where("vec_id % 20 = 0"), certainty=0.999999, shard_rows=100)
    assert {tuple(r) for r in got.collect()} == brute(rows, asked, 20)
    few = df.where("vec_id in (1000, 1001, 2000)")
    assert {tuple(r) for r in nearest(few, few).collect()} == {(1000, 1, 1001, 54.0), (1001, 1, 1000, 54.0)}
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0
    assert nearest(df.union(df), df.where("vec_id = 20").union(df.where("vec_id = 20"))).count() == 20


def test_ties_go_to_the_smaller_id(spark):
    """399 different vectors of one product with the query, by rounding or exactly, over one shard and several."""
    rng = np.random.default_rng(8)
    ids = rng.permutation(np.arange(1, 400)).tolist()
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(a), float(b)]) for i, (a, b) in zip(ids, rng.standard_normal((399, 2)), strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (16_384, 100):
        got = nearest(df, df.where("vec_id = 0"), shard_rows=shard_rows, certainty=0.999999).collect()
        assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k, k, 1.0) for k in range(1, 21)]


def test_huge_and_tiny_vectors(spark):
    for size in (1e200, 1e-200):
        rows = [(i, [size * 1e-50 * i, size * 1e-50]) if size > 1 else (i, [size * 1e50 * i, size * 1e50]) for i in range(1, 31)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = nearest(df, df.where("vec_id = 20"), k=5).collect()
        assert sorted((r.rank, r.vec_id) for r in got) == [(1, 30), (2, 29), (3, 28), (4, 27), (5, 26)]
        known = dict(rows)
        assert all(r.score == float((np.array(known[r.vec_id]) * np.array(known[20])).sum()) for r in got)
    rows = [(i, [1e300 if i == 3 else float(i), 1.0]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert nearest(df, df.where("vec_id = 20"), k=5).count() == 5
