"""Most similar vectors for every vector with sharded vantage-point trees (problem 1).

A *top tree* of vantage points, fitted on a bounded sample, cuts the space into shards;
every row is indexed in the shard it falls into. A query also visits the other shards
its search ball may reach. In each shard a vantage-point tree over all of its rows is
searched, all queries at once.

Both trees prune by the triangle inequality: with distance d of a query to the vantage
point, median m and search radius r, the inner side can only hold a match if d <= m + r
and the outer side if d >= m - r. `factor` shrinks r in these tests. Factor 1 is exact;
smaller factors skip sides that hold a match only if the match lies nearly in line with
the vantage point, which is rare in many dimensions.

Distances are chords of unit vectors, a true metric: d * d = 2 - 2 * cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.topn import top_n
from gradeloom.storage import materialize, shuffle_partitions, spread

#: Rows of the sample that the top tree is fitted on; every row is indexed.
SAMPLE_ROWS = 4096
#: Rows a shard should hold; a shard of more is cut by a hash of the row, and queries visit all its cuts.
SHARD_ROWS = 16_384
#: Queries that one copy of a shard should answer.
QUERIES_A_SLOT = 65_536
LEAF_ROWS = 64
#: The top tree goes to every executor, so its sample is held to this size. It has enough rows for the shards of some
#: 2 * 10**9 rows; beyond, shards hold more than SHARD_ROWS, are cut by the hash, and queries visit all cuts: as exact, at more cost.
TOP_TREE_MB = 64
#: What chords of single-precision vectors may be off, where the triangle inequality decides.
SLACK = 1e-3


def sound_vectors(df: DataFrame, column: str, size: int = 64) -> DataFrame:
    """Rows whose vector has `size` elements, all finite and not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0))


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@dataclass
class Node:
    """Inner node: vantage point, median, children; leaf: number or row indices."""

    point: np.ndarray | None = None
    median: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    leaf: int = -1
    rows: np.ndarray | None = None


def _chords(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (m @ p), 0.0))


def _vantage(m: np.ndarray, rng: np.random.Generator, tries: int = 6, probe: int = 256) -> np.ndarray:
    """Of a few rows, the one whose distances to a probe spread most."""
    picks = m[rng.choice(len(m), min(tries, len(m)), replace=False)]
    some = m[rng.choice(len(m), min(probe, len(m)), replace=False)]
    spread_of = np.sqrt(np.maximum(2 - 2 * some @ picks.T, 0)).var(axis=0)
    return picks[int(np.argmax(spread_of))]


def build_tree(m: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 7, max_leaves: int | None = None) -> Node:
    """A vantage-point tree over the rows of `m` (unit vectors); leaves are numbered in order."""
    rng = np.random.default_rng(seed)
    count = 0

    def grow(rows: np.ndarray, leaves: int | None) -> Node:
        nonlocal count
        if len(rows) <= leaf_rows or (leaves is not None and leaves < 2):
            count += 1
            return Node(leaf=count - 1, rows=rows)
        point = _vantage(m[rows], rng)
        d = _chords(m[rows], point)
        cut = float(np.median(d))
        near = d <= cut
        if near.all():  # many equal distances: nothing to divide by the median
            near = d < cut
            cut = float(d[near].max()) if near.any() else cut
        if not near.any() or near.all():
            count += 1
            return Node(leaf=count - 1, rows=rows)
        half = None if leaves is None else leaves // 2
        return Node(point=point, median=cut, inner=grow(rows[near], half), outer=grow(rows[~near], half))

    return grow(np.arange(len(m)), max_leaves)


def home_leaves(tree: Node, m: np.ndarray) -> np.ndarray:
    """The leaf each row falls into."""
    out = np.zeros(len(m), np.int32)
    stack = [(tree, np.arange(len(m)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.point is None:
            out[rows] = node.leaf
            continue
        near = _chords(m[rows], node.point) <= node.median
        stack += [(node.inner, rows[near]), (node.outer, rows[~near])]
    return out


def visited_leaves(tree: Node, m: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[Node, np.ndarray]]:
    """Each leaf with the rows of `m` whose relaxed ball reaches it. `radius` may shrink between leaves."""
    stack = [(tree, np.arange(len(m)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.point is None:
            yield node, rows
            continue
        d, r = _chords(m[rows], node.point), factor * (radius[rows] + SLACK)
        stack += [(node.outer, rows[d >= node.median - r]), (node.inner, rows[d <= node.median + r])]


def shard_neighbours(
    ids: np.ndarray, m: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float, min_cosine: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, cosine) of each query's best k rows of one shard other than itself; ties by row id."""
    m32, q32 = m.astype(np.float32), q.astype(np.float32)
    tree = build_tree(m32)
    limit = -1.0 if min_cosine is None else min_cosine
    radius = np.full(len(q), np.sqrt(max(2 - 2 * limit, 0)) + 1e-6, np.float32)
    slack = 1e-4
    best = None
    if min_cosine is None:  # a first pass into the home leaf bounds the radius
        best = np.full((len(q), k), -2.0, np.float32)
        home = home_leaves(tree, q32)
        leaves, stack = {}, [tree]
        while stack:
            node = stack.pop()
            if node.point is None:
                leaves[node.leaf] = node
            else:
                stack += [node.inner, node.outer]
        for leaf in np.unique(home):
            rows = np.flatnonzero(home == leaf)
            sims = q32[rows] @ m32[leaves[leaf].rows].T
            sims[query_ids[rows][:, None] == ids[leaves[leaf].rows][None, :]] = -2
            keep = min(k, sims.shape[1])
            best[rows[:, None], np.arange(keep)] = -np.partition(-sims, keep - 1, axis=1)[:, :keep]
        worst = best.min(axis=1)
        radius = np.sqrt(np.maximum(2 - 2 * worst, 0)).astype(np.float32) + 1e-6
    floor = np.full(len(q), limit, np.float32) if best is None else best.min(axis=1)
    a, b = [], []
    for node, rows in visited_leaves(tree, q32, radius, factor):
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            sims = q32[part] @ m32[node.rows].T
            i, j = np.nonzero(sims >= floor[part][:, None] - slack)
            a.append(part[i])
            b.append(node.rows[j])
            if best is not None and len(i):
                # the radius shrinks as better rows are met (a row met in the first pass may count again,
                # so only rows outside the own home leaf move the bound)
                other = home[part] != node.leaf
                if other.any():
                    own = sims[other]
                    own[query_ids[part[other]][:, None] == ids[node.rows][None, :]] = -2
                    both = np.concatenate([best[part[other]], own], axis=1)
                    best[part[other]] = -np.partition(-both, k - 1, axis=1)[:, :k]
                    floor[part] = best[part].min(axis=1)
                    radius[part] = np.sqrt(np.maximum(2 - 2 * floor[part], 0)) + 1e-6
    a = np.concatenate(a) if a else np.zeros(0, int)
    b = np.concatenate(b) if b else np.zeros(0, int)
    own = query_ids[a] != ids[b]
    a, b = a[own], b[own]
    cosine = np.einsum("ij,ij->i", q[a], m[b])
    sure = cosine >= limit
    a, b, cosine = a[sure], b[sure], np.minimum(cosine[sure], 1.0)
    order = np.lexsort((ids[b], -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    new = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
    top = place < k
    return query_ids[a[top]], ids[b[top]], cosine[top]


def hash_sample(df: DataFrame, rows: int, want: int, seed: int) -> DataFrame:
    """About `want` of `rows` rows, chosen by the hash of their id where they are read, so no task sends more than its share."""
    if rows <= want:
        return df
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(cells)) < int(cells * want / rows) + 1)


def fit_top_tree(vectors: DataFrame, rows: int, seed: int = 7, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[Node, np.ndarray]:
    """The top tree over `rows` rows of (id, vec binary float32), from a bounded sample taken by hash, and the sample."""
    leaves = 1
    while leaves * shard_rows < rows:
        leaves *= 2
    want = min(rows, max(sample_rows, 16 * leaves))
    if want * 256 > TOP_TREE_MB * 1e6:
        want = int(TOP_TREE_MB * 1e6 / 256)
    got = hash_sample(vectors.select("id", "vec"), rows, want, seed).toPandas()
    if not len(got):
        return Node(leaf=0, rows=np.zeros(0, int)), np.zeros((0, 0), np.float32)
    m = np.frombuffer(b"".join(got["vec"]), np.float32).reshape(len(got), -1)
    tree = build_tree(m, leaf_rows=2, seed=seed, max_leaves=leaves)

    def bare(node: Node) -> None:
        node.rows = None
        if node.point is not None:
            bare(node.inner)
            bare(node.outer)

    bare(tree)
    return tree, m


def pack_vectors(df: DataFrame, id_col: str, vec_col: str, model_col: str, size: int = 64) -> DataFrame:
    """(id, model, vec binary): unit vectors as float32 bytes, of the rows with a sound vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                m = unit(np.stack(x["v"].to_numpy())).astype(np.float32)
                yield pd.DataFrame({"id": x["id"], "model": x["model"], "vec": [r.tobytes() for r in m]})

    rows = sound_vectors(df.where(F.col(id_col).isNotNull()), vec_col, size)
    rows = rows.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(model_col).cast("string"), F.lit("")).alias("model"), F.col(vec_col).alias("v")
    )
    return rows.mapInPandas(run, "id long, model string, vec binary")


def _mixed(ids: pd.Series) -> np.ndarray:
    """Evenly spread non-negative numbers from ids."""
    return ((ids.to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def similar_vectors(
    df: DataFrame,
    k: int = 10,
    factor: float = 0.25,
    min_cosine: float | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    model_col: str = "embedding_model",
    size: int = 64,
    queries: DataFrame | None = None,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(id, neighbour, cosine, position): the k most similar other rows of the same model for every row.

    With `min_cosine` only neighbours of at least that cosine count, and it bounds the
    search radius; without it a first pass into each query's own shard does. `queries`
    (a column `id`) restricts whose neighbours are sought, always against all rows.

    Rows with a null id or an unsound vector (null, wrong size, null or non-finite
    elements, all zero) have no neighbours and are none. A null model is a model of its
    own. Ties in cosine go to the smaller id. Exact copies: each distinct vector takes
    part with its k + 1 smallest ids; further copies have those as neighbours (cosine 1),
    as the tie rule demands, so a mass of copies never meets in one shard. Repeated rows of
    one id count once. An empty table has an empty result.
    """
    packed = pack_vectors(df, id_col, vec_col, model_col, size)
    packed = packed.withColumn("h", F.xxhash64("vec"))
    active = top_n(packed, ["model", "h"], [F.col("id").asc()], k + 1, "id").drop("position")
    active = materialize(active, "vectors")
    rows = active.count()
    crowded = active.groupBy("model", "h").agg(F.count("*").alias("n")).where(F.col("n") > k).select("model", "h")
    has_crowds = bool(crowded.head(1))

    tree, some = fit_top_tree(active, rows, shard_rows=shard_rows)
    asked = active if queries is None else active.join(queries.select("id").distinct(), "id", "left_semi")
    limit = min_cosine

    schema = "model string, shard int, cut int, slot int, role int, id long, vec binary"
    loads = {}
    # a model of few rows has one shard, or its rows would lie thinly among those of the others
    small = {r["model"] for r in active.groupBy("model").count().where(F.col("count") <= shard_rows).select("model").collect()}
    placed = materialize(_place(active, tree, small), "placed")
    for r in placed.groupBy("model", "shard").count().collect():  # one row per shard: rows / shard_rows of them
        loads[(r["model"], r["shard"])] = -(-r["count"] // (2 * shard_rows))
    cuts = {key: n for key, n in loads.items() if n > 1}
    # shards that many queries visit get several slots, each with all of the shard's rows and a share of the queries
    def slots_for(m: np.ndarray, radius: np.ndarray, n: int) -> dict[int, int]:
        """Slots of each shard, from the visits of a sample (m, radius) of n queries."""
        if not len(m):
            return {}
        visits = {node.leaf: len(at) for node, at in visited_leaves(tree, m, radius, factor)}
        return {leaf: -(-c * n // (len(m) * QUERIES_A_SLOT)) for leaf, c in visits.items()}

    slots = {}
    if min_cosine is not None:
        slots = slots_for(some, np.full(len(some), np.sqrt(max(2 - 2 * min_cosine, 0)), np.float32), rows)
    both = queries is None and min_cosine is not None  # rows of undivided shards are query and data at once

    def route(radius_col: bool, slots: dict[int, int]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                if not len(x):
                    continue
                m = _matrix(x["vec"])
                radius = x["radius"].to_numpy(np.float32) if radius_col else np.full(len(x), np.sqrt(max(2 - 2 * limit, 0)), np.float32)
                alone = np.array([g in small for g in x["model"]])
                visits = [(node.leaf, at[~alone[at]]) for node, at in visited_leaves(tree, m, radius, factor)]
                for leaf, at in [*visits, (0, np.flatnonzero(alone))]:
                    part = x.iloc[at]
                    part = part[np.array([(g, leaf) in loads for g in part["model"]], bool)]  # not to shards without a row of the model
                    if radius_col:
                        part = part[part["shard"] != leaf]
                    elif both and slots.get(leaf, 1) == 1:
                        part = part[np.array([s != leaf or (g, s) in cuts for g, s in zip(part["model"], part["shard"])], bool)]
                    for cut in range(max(cuts.values(), default=1)):
                        has = part if cut == 0 else part[np.array([cuts.get((g, leaf), 1) > cut for g in part["model"]], bool)]
                        if len(has):
                            slot = _mixed(has["id"]) % slots.get(leaf, 1)
                            yield pd.DataFrame({"model": has["model"], "shard": leaf, "cut": cut, "slot": slot, "role": 1, "id": has["id"], "vec": has["vec"]})

        return run

    def stored(slots: dict[int, int]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in frames:
                n = np.array([cuts.get(key, 1) for key in zip(x["model"], x["shard"])], np.int64)
                wide = np.array([slots.get(s, 1) for s in x["shard"]], np.int64)
                role = np.where((n == 1) & (wide == 1), 2, 0) if both else 0
                frame = pd.DataFrame({"model": x["model"], "shard": x["shard"], "cut": _mixed(x["id"]) % n, "slot": 0, "role": role, "id": x["id"], "vec": x["vec"]})
                for slot in range(int(wide.max(initial=1))):
                    yield frame[wide > slot].assign(slot=slot)

        return run

    def at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once for every cut of its own shard."""
        for x in frames:
            n = np.array([cuts.get(key, 1) for key in zip(x["model"], x["shard"])], np.int64)
            at = np.repeat(np.arange(len(x)), n)
            cut = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield x.iloc[at][["model", "shard", "id", "vec"]].assign(cut=cut, slot=0, role=1)[["model", "shard", "cut", "slot", "role", "id", "vec"]]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        data, ask = frame[frame["role"] != 1], frame[frame["role"] != 0]
        if not len(data) or not len(ask):
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []})
        m, q = _matrix(data["vec"]).astype(np.float64), _matrix(ask["vec"]).astype(np.float64)
        a, b, c = shard_neighbours(data["id"].to_numpy(), m, ask["id"].to_numpy(), q, k, factor, limit)
        return pd.DataFrame({"id": a, "neighbour": b, "cosine": c})

    asked_places = placed if queries is None else placed.join(asked.select("id"), "id", "left_semi").select(placed.columns)
    found_schema = "id long, neighbour long, cosine double"

    def searched(ask: DataFrame, slots: dict[int, int]) -> DataFrame:
        keys = ["model", "shard", "cut", "slot"]
        # twice as many partitions as groups, so that few of them meet in one task, at any number of rows
        groups = sum(cuts.get(key, 1) * slots.get(key[1], 1) for key in loads)
        tasks = max(2 * groups, shuffle_partitions(df.sparkSession))
        return placed.mapInPandas(stored(slots), schema).unionByName(ask).repartition(tasks, *keys).groupBy(*keys).applyInPandas(search, found_schema)

    if min_cosine is not None:
        found = searched(asked_places.mapInPandas(route(False, slots), schema), slots)
    else:
        # as many queries as rows meet at home, so no slots are needed there
        first = materialize(searched(asked_places.mapInPandas(at_home, schema), {}), "home")
        worst = first.groupBy("id").agg(F.count("*").alias("n"), F.array_min(F.slice(F.sort_array(F.collect_list("cosine"), False), 1, k)).alias("c"))
        radius = F.when(F.col("n") >= k, F.sqrt(F.greatest(2 - 2 * F.col("c"), F.lit(0.0)))).otherwise(F.lit(2.0)).alias("radius")
        far = asked_places.join(worst, "id", "left").select(*asked_places.columns, F.coalesce(radius, F.lit(2.0)).alias("radius"))
        if queries is not None:
            far = materialize(far, "far")  # few rows that are counted, sampled and sent
        n_asked = rows if queries is None else far.count()
        probe = hash_sample(far.select("id", "vec", "radius"), n_asked, SAMPLE_ROWS, 13).toPandas()
        wide = slots_for(_matrix(probe["vec"]), probe["radius"].to_numpy(np.float32), n_asked) if len(probe) else {}
        found = first.unionByName(searched(far.mapInPandas(route(True, wide), schema), wide))
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), F.col("neighbour").asc())
    best = found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    if not has_crowds:
        return best
    crowd = packed.select("id", "model", "h").join(crowded, ["model", "h"], "left_semi")
    further = crowd.join(active.select("id"), "id", "left_anti").distinct()
    if queries is not None:
        further = further.join(queries.select("id").distinct(), "id", "left_semi")
    firsts = active.join(crowded, ["model", "h"], "left_semi").groupBy("model", "h").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids"))
    copies = further.join(firsts, ["model", "h"]).select("id", F.posexplode("ids").alias("p", "neighbour"))
    copies = copies.select("id", "neighbour", F.lit(1.0).alias("cosine"), (F.col("p") + 1).alias("position"))
    return best.unionByName(copies)


def _place(active: DataFrame, tree: Node, small: set[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                shard = np.where([g in small for g in x["model"]], 0, home_leaves(tree, _matrix(x["vec"])))
                yield pd.DataFrame({"id": x["id"], "model": x["model"], "shard": shard, "vec": x["vec"]})

    return spread(active).mapInPandas(run, "id long, model string, shard int, vec binary")


def similar_pairs(df: DataFrame, min_cosine: float = 0.97, k: int = 10, factor: float = 0.25) -> DataFrame:
    """(id_a, id_b): pairs id_a < id_b of which at least one row lists the other among its k neighbours."""
    near = similar_vectors(df, k=k, factor=factor, min_cosine=min_cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
