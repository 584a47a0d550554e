from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np

from gradeloom.llm import cooccurrence as co

TAGS = "id long, tag string, project_name string, filename string, item string, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, p, f, "x", 1) for i, (t, p, f) in enumerate(rows)], TAGS)


def brute(rows, least):
    sets: dict[tuple, set] = {}
    for t, p, f in rows:
        if p is not None and f is not None and t is not None and t.strip(" "):
            sets.setdefault((p, f), set()).add(t.strip(" ").lower())
    n = Counter(x for s in sets.values() for x in s)
    pairs = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (c, n[a], n[b], len(sets)) for (a, b), c in pairs.items() if c >= least}


def random_rows(n, files=60, seed=0):
    rnd = random.Random(seed)
    words = ["Warm ", "cold", "dusk", " noir", "teal", "teal", "rare%d", None, "  ", "ÄRGER", "zz"]
    return [((w % rnd.randrange(40) if w and "%" in w else w), rnd.choice(["p", "q", None]), rnd.choice([f"f{rnd.randrange(files)}", None] + [f"f{i}" for i in range(5)])) for w in (rnd.choice(words) for _ in range(n))]


def got(spark, rows, least=5):
    out = co.surprising_pairs(co.tag_records(table(spark, rows)), least).collect()
    return {(r["tag_a"], r["tag_b"]): r for r in out}


def test_counts_against_brute_force(spark):
    rows = random_rows(1500)
    want, have = brute(rows, 5), got(spark, rows)
    assert {k: (r["n_ab"], r["n_a"], r["n_b"], r["records"]) for k, r in have.items()} == want
    for (a, b), r in have.items():
        assert a < b and math.isclose(r["lift"], r["n_ab"] * r["records"] / (r["n_a"] * r["n_b"]))
        assert r["log10_p"] <= 0 and r["log10_p"] <= r["log10_q"] + 1e-9 <= 1e-9


def test_large_records_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_ITEMS", 7)
    rows = [(f"t{i:02d}", "p", f"f{j}") for j in range(6) for i in range(40)]
    assert {k: r["n_ab"] for k, r in got(spark, rows).items()} == {k: v[0] for k, v in brute(rows, 5).items()}


def test_empty_and_single(spark):
    assert got(spark, []) == {}
    assert got(spark, [("a", "p", "f")] * 9) == {}
    assert got(spark, [(None, "p", "f"), ("a", None, "f"), ("a", "p", None), (" ", "p", "f")]) == {}
    # everything everywhere: no surprise
    all_ = got(spark, [(t, "p", f"f{i}") for i in range(9) for t in "abc"])
    assert len(all_) == 3 and all(r["log10_p"] > -0.01 for r in all_.values())


def test_null_keeps_degrees_and_sizes():
    degree, items = np.array([2.0, 5.0, 30.0]), np.array([50.0, 20.0, 4.0])
    size, records = np.array([1.0, 3.0, 8.0]), np.array([64.0, 20.0, 12.0])
    size = size * (degree * items).sum() / (size * records).sum()
    x, y = co.fit_null(degree, items, size, records)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * records).sum(1), degree, rtol=1e-6) and np.allclose((p * items[:, None]).sum(0), size, rtol=1e-6)


def test_tails_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        m, q = rng.integers(1, 40, 4).astype(float), rng.random(4) * 0.3
        pmf = np.ones(1)
        for mi, qi in zip(m, q):
            pmf = np.convolve(pmf, [math.comb(int(mi), j) * qi**j * (1 - qi) ** (int(mi) - j) for j in range(int(mi) + 1)])
        k = int(rng.integers(1, max(2, min(len(pmf) - 1, int((m * q).sum() * 2) + 2))))
        assert math.isclose(co.log_tail(k, q, m), math.log10(pmf[k:].sum()), abs_tol=1e-3)


def test_saddlepoint_near_exact(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(60):
        m, q = rng.integers(100, 3000, 6).astype(float), rng.random(6) * 0.01
        k = int((m * q).sum() + rng.random() * 30 + 3)
        exact = math.log10(co._exact_tail(k, q, m))
        monkeypatch.setattr(co, "EXACT_TAIL", 0)
        near = co.log_tail(k, q, m)
        monkeypatch.setattr(co, "EXACT_TAIL", 64)
        assert abs(near - exact) < 0.08


def test_false_discovery_against_the_definition(spark):
    rng = np.random.default_rng(3)
    p = [co._rounded_tail(float(x)) for x in np.concatenate([-rng.exponential(2, 200), -rng.exponential(3e5, 50), -rng.exponential(3000, 50), np.zeros(30)])] * 2
    tests = math.log10(5000)
    df = spark.createDataFrame([(x, 1) for x in p], "log10_p double, n long").repartition(3)
    have = {r["log10_p"]: r["log10_q"] for r in co.false_discovery(df, tests).collect()}
    order = sorted(p)
    rank = {x: sum(1 for z in order if z <= x) for x in set(p)}
    for x in set(p):
        want = min(0.0, min(z + tests - math.log10(rank[z]) for z in rank if z >= x))
        assert math.isclose(have[x], want, abs_tol=1e-6)


def test_rare_pairs_count_in_the_ranks(spark):
    """Two items of five records each that meet four times are rarer by chance than what comes out; they take their rank."""
    rows = [(f"t{k % 4}", "p", f"f{k}") for k in range(400)] + [("a", "p", f"f{k}") for k in range(5)] + [("b", "p", f"f{k}") for k in range(1, 6)]
    rows += [("c", "p", f"f{k}") for k in range(100, 180)] + [("d", "p", f"f{k}") for k in range(150, 230)]
    out = co.surprising_pairs(co.tag_records(table(spark, rows)), 5)
    have = {(r["tag_a"], r["tag_b"]): r for r in out.collect()}
    assert ("a", "b") not in have
    c_d = have[("c", "d")]
    strong = sum(r["log10_p"] <= c_d["log10_p"] for r in have.values())
    family = 8 * 7 / 2
    alone = c_d["log10_p"] + math.log10(family) - math.log10(strong)
    assert c_d["log10_q"] < alone - 1e-6 or c_d["log10_q"] == 0.0


def test_blocks_of_degrees_fit_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    degree, items = np.unique(rng.integers(1, 200, 60)).astype(float), None
    items = rng.integers(1, 30, len(degree)).astype(float)
    size, records = np.arange(1, 12.0), rng.integers(50, 400, 11).astype(float)
    size = size * (degree * items).sum() / (size * records).sum()
    one = co.fit_null(degree, items, size, records)
    monkeypatch.setattr(co, "CELLS", 25)
    two = co.fit_null(degree, items, size, records)
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
