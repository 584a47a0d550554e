"""Items that appear together, and how surprising that is (problem 2).

Pair counts are exact. The null is the bipartite configuration model: item a is in a
record of size s with probability x_a y_s / (1 + x_a y_s), where x and y are fitted so
that every item's expected number of records and every record's expected size are the
observed ones. Under it the number of common records of two items is Poisson-binomial;
its upper tail gives the p-value. The tested family is every pair of items that are in at least
`least` records each, fixed by the items before any pair is looked at; Benjamini-Hochberg
over that family gives the q-value. Pairs of the family that never meet have p = 1; all
others are counted and ranked, also those too rare to come out.

Tails are summed exactly up to counts of EXACT_TAIL; above, the saddlepoint of Lugannani
and Rice serves, and within a fifth of a deviation of the mean, where it divides by
almost nothing, the normal tail. Tests hold all three to the exact sum.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.storage import materialize, shuffle_partitions

#: Items of a record that are paired at once; larger records are cut into blocks that are paired with each other.
BLOCK_ITEMS = 256
#: Counts up to which the tail is summed exactly; above, by the Lugannani-Rice saddlepoint.
EXACT_TAIL = 64
#: Numbers of (degree, size) cells that the fit holds at once.
CELLS = 4_000_000
#: Items up to which item tables are broadcast.
BROADCAST_ITEMS = 200_000


def tag_records(tags: DataFrame) -> DataFrame:
    """(r1, r2, item): distinct trimmed lower-case tags of each (project_name, filename); null or blank parts are skipped."""
    item = F.lower(F.trim("tag"))
    return (
        tags.select(F.col("project_name").alias("r1"), F.col("filename").alias("r2"), item.alias("item"))
        .where("r1 IS NOT NULL AND r2 IS NOT NULL AND item <> ''")
        .distinct()
    )


class PairCounter:
    """Counts pairs of items of many small sets, before anything is shuffled."""

    def __init__(self, most: int = 500_000):
        self.code: dict[str, int] = {}
        self.names: list[str] = []
        self.keys = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.most = most

    def codes(self, items) -> np.ndarray:
        out = np.empty(len(items), np.int64)
        for i, x in enumerate(items):
            c = self.code.get(x)
            if c is None:
                c = self.code[x] = len(self.names)
                self.names.append(x)
            out[i] = c
        return out

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        keys = np.concatenate([self.keys, a << 32 | b])
        counts = np.concatenate([self.counts, np.ones(len(a), np.int64)])
        self.keys, back = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(back, counts, len(self.keys)).astype(np.int64)

    def take(self) -> pd.DataFrame:
        a = [self.names[i] for i in self.keys >> 32]
        b = [self.names[i] for i in self.keys & 0xFFFFFFFF]
        out = pd.DataFrame({"tag_a": np.where([x < y for x, y in zip(a, b)], a, b), "tag_b": np.where([x < y for x, y in zip(a, b)], b, a), "n": self.counts})
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        self.code, self.names = {}, []
        return out


def _within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of items of one block, by shifting the flat list of all blocks against itself."""
    c = PairCounter()
    for x in frames:
        for at in range(0, len(x), 2048):
            part = x["items"].iloc[at : at + 2048]
            flat = c.codes([i for items in part for i in items])
            basket = np.repeat(np.arange(len(part)), [len(i) for i in part])
            a, b = [], []
            for shift in range(1, int(max((len(i) for i in part), default=1))):
                same = np.flatnonzero(basket[shift:] == basket[:-shift])
                a.append(flat[same])
                b.append(flat[same + shift])
            if a:
                c.add(np.concatenate(a), np.concatenate(b))
            if len(c.keys) > c.most:
                yield c.take()
    if len(c.keys):
        yield c.take()


def _across(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of items of two blocks of one record."""
    c = PairCounter()
    for x in frames:
        for left, right in zip(x["items"], x["others"]):
            a, b = c.codes(left), c.codes(right)
            c.add(np.repeat(a, len(b)), np.tile(b, len(a)))
            if len(c.keys) > c.most:
                yield c.take()
    if len(c.keys):
        yield c.take()


def _oriented(pairs: DataFrame, least: int) -> DataFrame:
    return pairs.groupBy("tag_a", "tag_b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= least)


def pair_counts(records: DataFrame, often: DataFrame, least: int, largest: int) -> DataFrame:
    """(tag_a, tag_b, n_ab) of all pairs with at least `least` common records.

    `often` has the items of at least `least` records; others can't be in such a pair and are left out first.
    Items of a record lie in hashed blocks of about BLOCK_ITEMS; only records larger than that have several.
    Where the largest record (of `largest` items) fits a block, none is divided.
    """
    rows = records.join(often, "item", "left_semi")
    schema = "tag_a string, tag_b string, n long"
    if largest <= BLOCK_ITEMS:
        sets = rows.groupBy("r1", "r2").agg(F.collect_list("item").alias("items"))
        return _oriented(sets.select("items").mapInPandas(_within, schema), least)
    large = rows.groupBy("r1", "r2").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK_ITEMS)
    blocks = F.ceil(F.coalesce(F.col("size"), F.lit(1)) / BLOCK_ITEMS)
    blocked = rows.join(large, ["r1", "r2"], "left").select("r1", "r2", "item", F.pmod(F.xxhash64("item"), blocks).alias("block"), blocks.alias("blocks"))
    sets = blocked.groupBy("r1", "r2", "block").agg(F.collect_list("item").alias("items"), F.first("blocks").alias("blocks"))
    inner = sets.select("items").mapInPandas(_within, schema)
    # each pair of blocks is a key of its own, so the largest record is spread over as many tasks as it has pairs of blocks
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = sets.where("blocks > 1").select("r1", "r2", "block", "items", other.alias("other")).where("block <> other")
    met = sent.groupBy("r1", "r2", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list("items").alias("both"))
    outer = met.where(F.size("both") == 2).select(F.col("both")[0].alias("items"), F.col("both")[1].alias("others")).mapInPandas(_across, schema)
    return _oriented(inner.unionByName(outer), least)


def fit_null(degree: np.ndarray, items: np.ndarray, size: np.ndarray, records: np.ndarray, steps: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses x of each item degree and y of each record size; `items` and `records` are how many have it.

    The degrees go through in blocks, so memory holds CELLS numbers whatever the number of
    classes. A fit whose expected degrees are not within a thousandth of the observed ones
    after all steps is told by a warning.
    """
    total = float((degree * items).sum())
    x, y = degree / math.sqrt(total), size / math.sqrt(total)
    full_x, full_y = degree >= records.sum(), size >= items.sum()
    block = max(1, CELLS // max(len(size), 1))
    parts = [slice(i, i + block) for i in range(0, len(degree), block)]
    for _ in range(steps):
        nx = np.concatenate([degree[p] / ((y * records) / (1 + np.outer(x[p], y))).sum(axis=1) for p in parts])
        nx = np.where(full_x, 1e12, nx)
        reach = sum(((nx[p] * items[p])[:, None] / (1 + np.outer(nx[p], y))).sum(axis=0) for p in parts)
        ny = np.where(full_y, 1e12, size / reach)
        moved = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max())
        x, y = nx, ny
        if moved < tol:
            break
    expected = np.concatenate([(np.outer(x[p], y * records) / (1 + np.outer(x[p], y))).sum(axis=1) for p in parts])
    off = float(np.abs(expected / degree - 1).max())
    if off > 1e-3:
        warnings.warn(f"the null model is not fitted: expected degrees are off by up to {off:.2g}", stacklevel=2)
    return x, y


def _exact_tail(k: int, q: np.ndarray, m: np.ndarray) -> float:
    """P(X >= k) for a sum of Binomial(m, q), from sums of non-negative terms only."""
    sure = int(m[q >= 1].sum())
    q, m = q[(q > 0) & (q < 1)], m[(q > 0) & (q < 1)]
    if k <= sure:
        return 1.0
    k -= sure
    if not len(q):
        return 0.0
    # terms shrink at least by this ratio from k on
    ratio = float((m * q / (1 - q)).sum()) / (k + 1)
    further = 48 + int(8 * math.sqrt(k))
    top = k + (further if ratio >= 1 else min(further, 2 + int(14 / -math.log(ratio)) if ratio > 0 else 2))
    j = np.arange(1, top + 1)
    steps = np.log(np.maximum(m[:, None] - j + 1, 1e-300) / j) + (np.log(q) - np.log1p(-q))[:, None]
    b = np.exp((m * np.log1p(-q))[:, None] + np.concatenate([np.zeros((len(q), 1)), np.cumsum(steps, axis=1)], axis=1))
    p = b[0]
    for other in b[1:]:
        p = np.convolve(p, other)[: top + 1]
    low, high = float(p[:k].sum()), float(p[k:].sum())
    return min(1.0, high if low > 0.1 or high < 0.1 else 1 - low)


def log_tail(k: float, q: np.ndarray, m: np.ndarray) -> float:
    """log10 P(X >= k); saddlepoint of the Poisson-binomial for large counts."""
    mu = float((m * q).sum())
    if k <= EXACT_TAIL and mu < EXACT_TAIL:
        p = _exact_tail(int(k), q, m)
        if p > 1e-290:
            return math.log10(p)
    if k >= m.sum():
        return float((m * np.log10(np.maximum(q, 1e-300))).sum())
    sd = math.sqrt(float((m * q * (1 - q)).sum())) or 1e-9
    z = (k - 0.5 - mu) / sd
    if abs(z) < 0.2:
        return math.log10(0.5 * math.erfc(z / math.sqrt(2)))
    t = math.log(max(k, 0.5) / mu) if mu > 0 else 1.0
    for _ in range(60):
        e = q * math.exp(t)
        r = e / (1 - q + e)
        step = (float((m * r).sum()) - k) / max(float((m * r * (1 - r)).sum()), 1e-300)
        t -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-12:
            break
    e = q * math.exp(t)
    r = e / (1 - q + e)
    cumulant = float((m * np.log1p(q * (math.exp(t) - 1))).sum())
    var = float((m * r * (1 - r)).sum())
    w = math.copysign(math.sqrt(max(2 * (t * k - cumulant), 1e-300)), t)
    u = (1 - math.exp(-t)) * math.sqrt(var)
    if w > 5:  # log of the tail, as the tail itself may underflow
        phi = -0.5 * w * w - 0.5 * math.log(2 * math.pi)
        inner = 1 / w - 1 / w**3 + 3 / w**5 + (1 / u - 1 / w)
        return (phi + math.log(max(inner, 1e-300))) / math.log(10)
    p = 0.5 * math.erfc(w / math.sqrt(2)) + math.exp(-0.5 * w * w) / math.sqrt(2 * math.pi) * (1 / u - 1 / w)
    return math.log10(min(max(p, 1e-300), 1.0))


def _rounded_tail(log10_p: float) -> float:
    """Three places, or six digits where that is coarser: equal tails stay equal, whatever the order they were summed in."""
    return round(log10_p, 3) if log10_p > -1000 else float(f"{log10_p:.6g}")


def false_discovery(scored: DataFrame, tests: float, p: str = "log10_p") -> DataFrame:
    """(p, log10_q) of every distinct log10 p-value: Benjamini-Hochberg over 10 ** `tests` hypotheses; `scored` says how many (n) have which p.

    Values are ranked inside bins of about one per cent of log10 p; only bins are ordered
    as a whole, of which a double has at most 66,000.
    """
    by_p = scored.groupBy(p).agg(F.sum("n").alias("n")).withColumn("bin", -F.floor(F.log2(1 - F.col(p)) * 64))
    bins = by_p.groupBy("bin").agg(F.sum("n").alias("n_bin"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("n_bin").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bin").orderBy(p)
    raw = by_p.join(F.broadcast(bins), "bin").withColumn("rank", F.col("before") + F.sum("n").over(inside)).withColumn("raw", F.col(p) + F.lit(tests) - F.log10("rank"))
    least = raw.groupBy("bin").agg(F.min("raw").alias("low"))
    behind = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select("bin", F.min("low").over(behind).alias("later"))
    onwards = Window.partitionBy("bin").orderBy(F.col(p).desc())
    return raw.join(F.broadcast(least), "bin").select(p, F.least(F.lit(0.0), F.min("raw").over(onwards), "later").alias("log10_q"))


def surprising_pairs(records: DataFrame, least: int = 5) -> DataFrame:
    """(tag_a, tag_b, n_ab, n_a, n_b, records, expected, lift, log10_p, log10_q) of every pair in at least `least` records.

    `lift` is n_ab * records / (n_a * n_b); `expected` and the tails are of the fitted
    null, and log10_q ranks the tails of the whole family. `records` has distinct
    (r1, r2, item); empty tables and records of one item give no pair.
    """
    records = materialize(records, "records")
    degrees = records.groupBy("item").agg(F.count("*").alias("n_a"))
    sizes = records.groupBy("r1", "r2").agg(F.count("*").alias("size"))
    # by class: distinct degrees and sizes, of which there are at most sqrt(2 * rows)
    item_classes = np.array(degrees.groupBy("n_a").count().orderBy("n_a").collect(), np.float64).reshape(-1, 2)
    size_classes = np.array(sizes.groupBy("size").count().orderBy("size").collect(), np.float64).reshape(-1, 2)
    spark = records.sparkSession
    if not len(item_classes):
        schema = "tag_a string, tag_b string, n_ab long, n_a long, n_b long, records long, expected double, lift double, log10_p double, log10_q double"
        return spark.createDataFrame([], schema)
    degree, items = item_classes.T
    size, count = size_classes.T
    x, y = fit_null(degree, items, size, count)
    n_records, n_items = int(count.sum()), int(items.sum())

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitness = dict(zip(degree.astype(int).tolist(), x.tolist()))
        for f in frames:
            mu, lp = [], []
            for k, a, b in zip(f["n_ab"], f["lo"], f["hi"]):
                xa, xb = fitness[a], fitness[b]
                q = xa * y / (1 + xa * y) * (xb * y / (1 + xb * y))
                mu.append(float((count * q).sum()))
                lp.append(_rounded_tail(min(log_tail(float(k), q, count), 0.0)))
            yield f.assign(expected=mu, log10_p=lp)

    few = degrees.where(F.col("n_a") >= least)
    few = materialize(few, "items")
    hint = F.broadcast if n_items <= BROADCAST_ITEMS else (lambda x: x)
    family = few.count()
    pairs = pair_counts(records, hint(few.select("item")), 1, int(size.max()))
    a = hint(few.select(F.col("item").alias("tag_a"), "n_a"))
    b = hint(few.select(F.col("item").alias("tag_b"), F.col("n_a").alias("n_b")))
    pairs = materialize(pairs.join(a, "tag_a").join(b, "tag_b").select("tag_a", "tag_b", "n_ab", "n_a", "n_b"), "pairs")
    # the tail depends on the three counts alone, which many pairs share
    lo, hi = F.least("n_a", "n_b").alias("lo"), F.greatest("n_a", "n_b").alias("hi")
    kinds = pairs.groupBy("n_ab", lo, hi).agg(F.count("*").alias("n"))
    # few bytes and much to compute, so the tasks follow the cores, not the size
    kinds = kinds.repartition(2 * max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))
    kinds = materialize(kinds.mapInPandas(tails, "n_ab long, lo long, hi long, n long, expected double, log10_p double"), "tails")
    ranked = false_discovery(kinds, math.log10(max(family * (family - 1) / 2, 1)))
    known = kinds.where(F.col("n_ab") >= least).join(ranked, "log10_p").select("n_ab", "lo", "hi", "expected", "log10_p", "log10_q")
    lift = F.col("n_ab") * F.lit(n_records).cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
    out = pairs.where(F.col("n_ab") >= least).withColumns({"lo": F.least("n_a", "n_b"), "hi": F.greatest("n_a", "n_b")}).join(known, ["n_ab", "lo", "hi"])
    return out.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", F.lit(n_records).cast("long").alias("records"), "expected", lift.alias("lift"), "log10_p", "log10_q")
