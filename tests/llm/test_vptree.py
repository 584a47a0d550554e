from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import vptree

SCHEMA = "id long, embedding array<float>, embedding_model string, shard int, h long, vec string"


def table(spark, rows):
    """Rows with extra columns whose names clash with those that the operator uses inside."""
    plain = lambda e: e if e is None else [x if x is None else float(x) for x in e]
    return spark.createDataFrame([(i, plain(e), m, 1, 2, "x") for i, e, m in rows], SCHEMA)


def brute(rows, k, limit=None, size=8):
    ok = [(i, np.array(e, np.float32).astype(float), m or "") for i, e, m in rows if i is not None and e is not None and len(e) == size and np.isfinite(np.array(e, float)).all() and any(e)]
    out = {}
    for i, a, m in ok:
        a = a / np.linalg.norm(a)
        near = [(-round(float(a @ (b / np.linalg.norm(b))), 6), j) for j, b, n in ok if j != i and n == m]
        out[i] = [(j, -c) for c, j in sorted(near)[:k] if limit is None or -c >= limit]
    return out


def clustered(n, size=8, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, size))
    return [(i, (c[i % 6] + 0.4 * rng.normal(size=size)).tolist(), "ab"[i % 5 == 0]) for i in range(n)]


def found(df):
    out = {}
    for r in df.orderBy("id", "position").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["cosine"], 6)))
    return out


@pytest.mark.parametrize(("limit", "slot"), [(None, 32768), (None, 20), (0.9, 32768), (0.9, 50)])
def test_exact_with_factor_one(spark, monkeypatch, limit, slot):
    monkeypatch.setattr(vptree, "QUERIES_A_SLOT", slot)
    rows = clustered(300)
    got = found(vptree.similar_vectors(table(spark, rows), k=5, factor=1.0, min_cosine=limit, size=8, shard_rows=40))
    want = {i: v for i, v in brute(rows, 5, limit).items() if v}
    assert set(got) == set(want)
    assert all(np.allclose([c for _, c in got[i]], [c for _, c in want[i]], atol=3e-6) for i in want)
    assert sum({j for j, _ in got[i]} == {j for j, _ in want[i]} for i in want) > 0.99 * len(want)


def test_relaxed_recall(spark):
    rows = clustered(400, seed=2)
    got = found(vptree.similar_vectors(table(spark, rows), k=5, factor=0.4, size=8, shard_rows=60))
    want = brute(rows, 5)
    hit = sum(len({j for j, _ in got.get(i, [])} & {j for j, _ in v}) for i, v in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_recall_on_the_catalog(spark):
    """Recall against brute force over all rows, of the queries of p1_neighbours."""
    df = spark.read.parquet("/root/testdata/sf0.01/fingerprints.parquet")
    asked = df.where("id % 50 = 0").select("id")
    got = found(vptree.similar_vectors(df, k=10, queries=asked))
    rows = [(r["id"], r["embedding"], r["embedding_model"]) for r in df.select("id", "embedding", "embedding_model").collect()]
    want = {i: v for i, v in brute(rows, 10, size=64).items() if i % 50 == 0}
    assert set(got) == {i for i, v in want.items() if v}
    hit = sum(len({j for j, _ in got[i]} & {j for j, _ in v}) for i, v in want.items() if v)
    assert hit >= 0.9 * sum(map(len, want.values()))


def test_hostile_rows(spark):
    good = [1.0, 0, 0, 0, 0, 0, 0, 0]
    near = [0.99, 0.05, 0, 0, 0, 0, 0, 0]
    rows = [
        (1, good, "m"), (2, near, "m"), (3, good, None), (4, near, None), (5, None, "m"), (6, [], "m"), (7, [1.0], "m"), (8, [float("nan")] * 8, "m"),
        (9, [float("inf")] + [0.0] * 7, "m"), (10, [0.0] * 8, "m"), (None, good, "m"), (2, near, "m"), (11, [1.0, None] + [0.0] * 6, "m"), (12, good, "other"),
        (13, [1e-30] + [0.0] * 7, "n"), (14, [1e30] + [0.0] * 7, "n"),
    ]
    pairs = sorted(tuple(r) for r in vptree_pairs(table(spark, rows)).collect())
    assert pairs == [(1, 2), (3, 4), (13, 14)]
    assert vptree_pairs(table(spark, [])).count() == 0


def vptree_pairs(df):
    near = vptree.similar_vectors(df, k=10, factor=1.0, min_cosine=0.97, size=8)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def test_masses_of_copies(spark):
    """A third of all rows are one vector: each has the k smallest other ids, at cosine 1, and no task holds them all."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] + [0.0] * 7, "m") for i in range(500)] + [(1000 + i, rng.normal(size=8).tolist(), "m") for i in range(1000)]
    got = found(vptree.similar_vectors(table(spark, rows), k=3, factor=1.0, size=8, shard_rows=100))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0)] and got[2] == [(0, 1.0), (1, 1.0), (3, 1.0)] and got[499] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert all(len(got[i]) == 3 for i, _, _ in rows)


def test_a_small_model_among_many_shards(spark):
    """Three rows of one model have each other, however many shards the other model fills."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), "big") for i in range(900)] + [(5000 + i, rng.normal(size=8).tolist(), "small") for i in range(3)]
    got = found(vptree.similar_vectors(table(spark, rows), k=5, factor=0.25, size=8, shard_rows=40))
    assert all({j for j, _ in got[i]} == {5000, 5001, 5002} - {i} for i in (5000, 5001, 5002))


def test_trees_keep_every_row():
    rng = np.random.default_rng(0)
    m = vptree.unit(np.vstack([rng.normal(size=(200, 8)), np.ones((100, 8))]))
    tree, seen, stack = vptree.build_tree(m, 10), [], []
    stack.append(tree)
    while stack:
        node = stack.pop()
        if node.point is None:
            seen += node.rows.tolist()
        else:
            stack += [node.inner, node.outer]
    assert sorted(seen) == list(range(300))
