"""Vector searches against brute force."""

import numpy as np
import pytest

from ledgerlake.llm import ann, exact_search

ODD = [(900, None), (901, []), (902, [None] * 8), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [1.0] * 8), (905, [1.0] * 3)]


def vectors(spark, x, extra=ODD):
    rows = [(i * 10, [float(v) for v in r]) for i, r in enumerate(x)] + extra
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(x, ids, query, score, k, high):
    s = score(x, x[query])
    order = [i for i in np.lexsort((ids, -s if high else s)) if i != query][:k]
    return [(int(ids[i]), s[i]) for i in order]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_exact_search(spark, scale):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(300, 8)) * scale).astype(np.float32)
    x[50:90] = x[7]  # ties
    v = np.floor(256.0 * x.astype(float))
    ids = np.arange(300) * 10
    found = exact_search.top_inner_products(vectors(spark, x), k=5, every=50, block=64, query_block=16).collect()
    for q in range(0, 300, 5):
        got = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q * 10]
        want = sorted(((int(ids[i]), sum(int(a) * int(b) for a, b in zip(v[i], v[q], strict=True))) for i in range(300) if i != q), key=lambda p: (-p[1], p[0]))[:5]
        assert got == want


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 64))
    for s in (1, 2, 4, 8, 16):
        stats = exact_search.segment_statistics(x, s)
        assert (stats @ stats.T + 1e-9 >= x @ x.T).all()


def test_neighbours_have_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32)) * 3
    x = (centres[rng.integers(0, 20, 6000)] + rng.normal(size=(6000, 32))).astype(np.float32)
    found = ann.nearest(vectors(spark, x, [(7, None), (17, [0.0] * 32)]), k=10, every=1000, block=512, sample_rows=1500).collect()
    hit = total = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(np.square(x.astype(float) - x[q].astype(float)).sum(1))
        d[q] = np.inf
        want = set((np.lexsort((np.arange(6000), d))[:10] * 10).tolist())
        mine = [r for r in found if r.query_id == q * 10]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r.score)] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id // 10]) < 1e-9 for r in mine)
        hit, total = hit + len(want & {r.vec_id for r in mine}), total + 10
    assert hit >= 0.9 * total


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8, 1e9])
def test_neighbours_far_from_the_origin(spark, offset):
    x = np.random.default_rng(5).normal(size=(600, 16)) + offset
    rows = spark.createDataFrame([(i * 10, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = ann.nearest(rows).collect()
    distance = lambda x, q: np.sqrt(np.square(x - q).sum(1))
    for q in range(0, 600, 60):
        got = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q * 10]
        assert got == brute(x, np.arange(600) * 10, q, distance, 10, False)


def test_neighbours_in_a_crowded_cell(spark):
    """A third of the rows are in one cell of the top bits. Neighbours that are near in the order of keys, as
    the fit measured them, are all met, within a cell and across its borders."""
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, size=(3000, 1)).astype(np.float32)
    x[::3] = rng.uniform(0.6, 0.65, size=(1000, 1))
    d = np.abs(x.astype(float) - x[:, 0].astype(float))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]  # ties to the smaller id
    made, share, _ = ann.fit(x.astype(float), 1, 10, 0.95)
    key = made.keys(x.astype(float))[0]
    cell = key >> (ann.DIMS * ann.BITS - ann.CELL_BITS)
    assert np.unique(cell, return_counts=True)[1].max() >= 1000 and share < 0.1
    rank = np.empty(3000, int)
    rank[np.argsort(key, kind="stable")] = np.arange(3000)
    found = {(r.query_id // 10, r.vec_id // 10) for r in ann.nearest(vectors(spark, x, []), k=10, every=10, curves=1, block=16, sample_rows=3000).collect()}
    pairs = [(q, int(v)) for q in range(3000) for v in near[q]]
    reached = [p for p in pairs if abs(rank[p[0]] - rank[p[1]]) <= share / 2 * 3000]
    assert any(cell[q] != cell[v] for q, v in reached)
    assert [p for p in reached if p not in found] == []
    assert len(found & set(pairs)) >= 0.95 * len(pairs)


def test_blocks_keep_the_order_of_keys(spark):
    """Rows stand in the block of their rank (of their cell's, at most a block before), at any depth of the cut."""
    rng = np.random.default_rng(5)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 56, 500), (5 << 50) + rng.integers(0, 1 << 20, 1500), np.full(700, 9 << 45), [0, (1 << 56) - 1]]))
    block = 64
    leaves = ann.cut(spark.createDataFrame([(0, int(k)) for k in keys], "curve int, key long"), block)[0]
    order = ann.Blocks(leaves, -(-len(keys) // block), 1)
    first, parts, low, high = order.places(keys)
    once = (keys != 9 << 45)
    assert (parts[once] == 1).all() and (parts[~once] == 11).all()
    rank = np.arange(len(keys))
    assert ((first * block <= rank) & (rank < (first + 2) * block))[once].all()
    dealt = first[~once][0]
    meets = (low <= dealt + 10) & (high >= dealt)
    assert (low[meets] <= dealt).all() and (high[meets] >= dealt + 10).all() and meets[once].any()


def test_hilbert_neighbours_differ_in_one_step():
    side = 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = ann.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(side**3))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_few_and_no_vectors(spark):
    x = np.array([[1.0] * 8, [2.0] * 8, [0.0] * 8])
    near = ann.nearest(vectors(spark, x), k=10, every=10).collect()
    assert sorted((r.query_id, r.vec_id) for r in near) == [(0, 10), (10, 0)]  # zero and odd vectors take no part
    top = exact_search.top_inner_products(vectors(spark, x), k=5, every=10).collect()
    assert sorted((r.query_id, r.vec_id) for r in top) == [(0, 10), (0, 20), (10, 0), (10, 20), (20, 0), (20, 10)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none).count() == 0 and exact_search.top_inner_products(none).count() == 0
    again = exact_search.top_inner_products(vectors(spark, np.vstack([x, x])).withColumn("vec_id", __import__("pyspark").sql.functions.col("vec_id") % 30), k=5, every=10).collect()
    assert sorted((r.query_id, r.vec_id) for r in again) == [(0, 10), (0, 20), (10, 0), (10, 20), (20, 0), (20, 10)]


def test_repeated_ids_one_vector_and_other_lengths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 8))
    copies = [(50, [float(v) for v in x[0] + 0.001 * k]) for k in range(60)]  # sixty near copies of one id
    short = [(1000 + 10 * k, [1.0 * k + 1]) for k in range(3)]
    found = ann.nearest(vectors(spark, x, copies + short), k=10, every=10).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == len(set(v)) == 10 for q, v in by.items() if q < 1000) and len(by[0]) == 10
    assert sorted(by[1000]) == [1010, 1020] and sorted(by[1020]) == [1000, 1010]
    assert ann.nearest(vectors(spark, x[:1], [])).count() == 0
