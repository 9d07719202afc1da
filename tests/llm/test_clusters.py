import hashlib

import numpy as np
import pytest

from photonloom.llm import clusters as module
from photonloom.llm.clusters import BallTree, clustered, next_centroids, squared


def plain(rows, k=16, rounds=3):
    """rows of (id, vector): (id, cluster, distance, cluster inertia, inertia, hash), by whole numbers of any size."""
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    z = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(z)), key=lambda j: (far(v, z[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        z = [[sum(c) // len(c) for c in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else z[j] for j in range(len(z))]
    found = [(i, j := nearest(v), far(v, z[j])) for i, v in kept]
    by = {j: sum(d for _, o, d in found if o == j) for _, j, _ in found}
    return sorted(((i, j, d, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, z[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def made(n=300, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 64))
    rows = [(k, (centres[k % 5] + rng.normal(size=64) * (0.01 if k % 3 else 1)).astype(np.float32).tolist()) for k in range(n)]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (2**53 + 1, rows[9][1])] + [(10_000 + k, [0.5] * 64) for k in range(100)]


BAD = [(900, None), (901, [1.0] * 63), (902, [*([1.0] * 63), None]), (903, [*([1.0] * 63), float("nan")]), (904, [float("inf")] * 64), (905, [])]
SCHEMA = "vec_id long, embedding array<float>, cluster int, ids string"


@pytest.mark.parametrize(("tree", "leaf"), [(4096, 32), (50, 3), (7, 1)])
def test_equals_plain(spark, tree, leaf):
    rows = made()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows + BAD], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in clustered(df, tree_rows=tree, leaf_rows=leaf).collect()), key=str)
    assert got == plain(rows)


def test_few_ties_and_empty(spark):
    four = [(k, [float(v)] * 64) for k, v in enumerate((0, 0, 1, 3))]
    df = spark.createDataFrame([(*r, 0, "") for r in four], SCHEMA)
    assert sorted((tuple(r) for r in clustered(df).collect()), key=str) == plain(four)
    assert clustered(df.limit(0)).count() == 0
    far = spark.createDataFrame([(1, [3e6] * 64, 0, ""), (2, [-1e38] * 64, 0, "")], SCHEMA)
    with pytest.raises(Exception, match="beyond"):
        clustered(far)
    large = [(1, [2e6] * 64), (2, [-2e6] * 64), (3, [1.9e6] * 64)]
    assert sorted((tuple(r) for r in clustered(spark.createDataFrame([(*r, 0, "") for r in large], SCHEMA)).collect()), key=str) == plain(large)


def test_balls_hold_their_vectors_and_whole_ones_are_right():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-3, 3, (200, 64)) + 100 * k for k in range(4)]).astype(np.int64)
    tree, order = BallTree.grown(v, 8)
    assert sorted(order) == list(range(800)) and (tree.vectors == v[order]).all()
    for b, e, r, s in zip(tree.begin, tree.end, tree.radius, tree.sums):
        own = tree.vectors[b:e]
        assert (own.sum(axis=0) == s).all() and np.sqrt(((own - s / len(own)) ** 2).sum(axis=1)).max() <= r
    z = np.array([np.full(64, 100 * k) for k in range(4)])
    balls, at, own = tree.meet(z)
    assert sum(len(n) for n, _ in balls) > 0 and len(at) < 100
    near = squared(tree.vectors, z).argmin(axis=1)
    for nodes, cluster in balls:
        for n, c in zip(nodes, cluster):
            assert (near[tree.begin[n] : tree.end[n]] == c).all()
    assert (near[at] == own).all()


def test_one_round_returns_sums_only(spark):
    df = spark.createDataFrame([(*r, 5, "x") for r in made(100)], SCHEMA).repartition(2)
    trees = module.ball_trees(module.whole_vectors(df), 20, 4)
    z = np.arange(3 * 64).reshape(3, 64)
    v = np.array([np.floor(64 * np.array(x, np.float32).astype(float)) for _, x in made(100)], np.int64)
    near = squared(v, z).argmin(axis=1)
    want = [v[near == k].sum(axis=0) // max(1, (near == k).sum()) if (near == k).any() else z[k] for k in range(3)]
    assert (next_centroids(trees, z) == np.array(want)).all()
