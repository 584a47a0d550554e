"""Filling containers of fixed capacity by fitted length patterns (problem 8).

All decisions are taken on the histogram of item lengths, which has at most `capacity`
rows however many items there are:

1. lengths are put on a coarse grid, all patterns of one to four grid lengths that fill
   the capacity are enumerated, and their repeat counts are fitted to the histogram by
   non-negative least squares and rounded down;
2. every pattern is spelled out in true lengths, and the room it leaves is filled with
   the longest remaining items that fit (best fit);
3. what rounding left over is packed the same way, longest first.

The plan is a list of container groups with equal content. Items get their container from
their ordinal number among the items of their length, counted without gathering them.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from gradeloom.storage import materialize, spread

CAPACITY = 2048
GRID = 64
PATTERN_ITEMS = 4
#: Grid lengths up to this are left to fill gaps; patterns are for longer items.
SMALL = 4


def patterns(grid: int = GRID, most: int = PATTERN_ITEMS, least: int = SMALL + 1) -> np.ndarray:
    """Counts per grid length (columns) of every set of up to `most` lengths of at least `least`, of a sum within `SMALL` of the grid."""
    out = []

    def grow(left: int, top: int, parts: list[int]) -> None:
        if parts and left <= SMALL:
            out.append(parts)
        if len(parts) < most:
            for p in range(min(top, left), least - 1, -1):
                grow(left - p, p, [*parts, p])

    grow(grid, grid, [])
    a = np.zeros((grid + 1, len(out)))
    for j, parts in enumerate(out):
        for p in parts:
            a[p, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """min |a x - b| over x >= 0, by an active set."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    tol = 1e-9 * max(np.abs(w).max(initial=0), 1e-300)
    for _ in range(steps):
        if passive.all() or w[~passive].max(initial=-1) <= tol:
            break
        passive[int(np.argmax(np.where(passive, -np.inf, w)))] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if not passive.any() or s[passive].min() > 0:
                break
            bad = passive & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
        x = s
        w = a.T @ (b - a @ x)
    return np.maximum(x, 0)


class Plan:
    """Container groups: (content as {length: how many}, repeats), for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, fitted: bool = True):
        self.capacity = capacity
        self.left = {k: int(n) for k, n in histogram.items() if n > 0}
        if any(k < 1 or k > capacity for k in self.left):
            raise ValueError("lengths must be within 1 and the capacity")
        self.sorted = sorted(self.left)
        self.groups: list[tuple[dict[int, int], int]] = []
        if fitted:
            self._fitted()
        while self.sorted:
            longest = self.sorted[-1]
            each = min(capacity // longest, self.left[longest])
            self._open({longest: each}, self.left[longest] // each)

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            del self.left[length]
            self.sorted.pop(bisect.bisect_left(self.sorted, length))

    def _open(self, content: dict[int, int], repeats: int) -> None:
        for k, c in content.items():
            self._take(k, c * repeats)
        self._fill(content, repeats)

    def _fill(self, content: dict[int, int], repeats: int) -> None:
        """Best fit: the longest remaining length that fits goes into all containers of the group, which is split if there are too few."""
        todo = [(content, repeats)]
        while todo:
            content, repeats = todo.pop()
            gap = self.capacity - sum(k * c for k, c in content.items())
            while gap:
                at = bisect.bisect_right(self.sorted, gap)
                if not at:
                    break
                length = self.sorted[at - 1]
                have = self.left[length]
                if have < repeats:
                    todo.append((dict(content), repeats - have))
                    repeats = have
                each = min(gap // length, have // repeats)
                self._take(length, each * repeats)
                content = {**content, length: content.get(length, 0) + each}
                gap -= each * length
            self.groups.append((content, repeats))

    def _fitted(self) -> None:
        unit = self.capacity / GRID
        grid_of = {k: int(np.ceil(k / unit)) for k in self.left}
        b = np.zeros(GRID + 1)
        for k, n in self.left.items():
            b[grid_of[k]] += n
        b[: SMALL + 1] = 0
        if not b.any():
            return
        a = patterns()
        repeats = np.floor(nnls(a, b) + 1e-9).astype(np.int64)
        runs: dict[int, list[list[int]]] = {}
        for k in sorted(self.left, reverse=True):
            runs.setdefault(grid_of[k], []).append([k, self.left[k]])
        fitted = []
        for j in sorted(np.flatnonzero(repeats), key=lambda j: -repeats[j]):
            parts = np.repeat(np.arange(GRID + 1), a[:, j].astype(int))
            need = {p: int(c) for p, c in zip(*np.unique(parts, return_counts=True))}
            todo = int(repeats[j])
            while todo > 0:
                # each slot takes the next run of equal true lengths; the shortest run bounds the group
                slots, used = [], {}
                for p in parts:
                    row = next((r for r in runs.get(int(p), []) if r[1] - used.get(r[0], 0) > 0), None)
                    if row is None:
                        break
                    used[row[0]] = used.get(row[0], 0) + 1
                    slots.append(row)
                if len(slots) < len(parts):
                    break
                n = min(todo, *[next(r[1] for r in slots if r[0] == k) // c for k, c in used.items()])
                for r in slots:
                    r[1] -= n
                fitted.append((used, n))
                todo -= n
            del need
        for content, n in fitted:
            for k, c in content.items():
                self._take(k, c * n)
        # the widest gaps are filled last, when only short items are left for narrow ones anyway
        heap = [(self.capacity - sum(k * c for k, c in g[0].items()), i) for i, g in enumerate(fitted)]
        heapq.heapify(heap)
        while heap:
            _, i = heapq.heappop(heap)
            self._fill(*fitted[i])

    @property
    def containers(self) -> int:
        return sum(repeats for _, repeats in self.groups)

    def slots(self) -> pd.DataFrame:
        """(length, first, each, repeats, container, offset): which ordinals of a length go where."""
        rows, used, base = [], {}, 0
        for content, repeats in self.groups:
            offset = 0
            for length, each in sorted(content.items(), reverse=True):
                first = used.get(length, 0)
                rows.append((length, first, each, base, offset))
                used[length] = first + each * repeats
                offset += length * each
            base += repeats
        return pd.DataFrame(rows, columns=["length", "first", "each", "container", "offset"]).sort_values(["length", "first"], ignore_index=True)


def best_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The fitted plan, or the one without patterns where a few odd lengths leave it with fewer containers.

    Both place every item; which one is taken depends on their numbers of containers alone. On
    histograms of documents the fitted plan is at the lower bound (README).
    """
    fitted, plain = Plan(histogram, capacity), Plan(histogram, capacity, fitted=False)
    return fitted if fitted.containers <= plain.containers else plain


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(id, part, n_tokens, container, offset) of every item; the capacity is at most 2**22.

    An item over the capacity is cut into full parts, each with its own container, and a
    rest, which is packed like any item; no other item is cut. Null ids, null sizes and
    sizes under 1 are skipped. Repeated rows are items of their own; ties fall as the rows
    are stored. An empty table has an empty result.
    """
    if not 1 <= capacity <= 1 << 22:
        raise ValueError("the capacity must be within 1 and 2**22")
    cap = F.lit(capacity)
    rows = sizes.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where("id IS NOT NULL AND n >= 1")
    count = F.ceil(F.col("n") / cap).cast("int")
    parts = rows.select("id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    parts = parts.select("id", "part", F.least(cap.cast("long"), F.col("n") - F.col("part") * cap).cast("int").alias("length"))
    kind = parts.schema["id"].dataType.simpleString()

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(capacity + 1, np.int64)
        for x in frames:
            k = x["length"].to_numpy()
            order = np.argsort(k, kind="stable")
            first = np.r_[True, k[order][1:] != k[order][:-1]] if len(k) else np.zeros(0, bool)
            start = np.flatnonzero(first)
            place = np.empty(len(k), np.int64)
            place[order] = np.arange(len(k)) - np.repeat(start, np.diff(np.r_[start, len(k)]))
            yield x.assign(k=place + seen[k])
            seen += np.bincount(k, minlength=capacity + 1)

    numbered = parts.withColumn("task", F.spark_partition_id()).mapInPandas(number, f"id {kind}, part int, length int, task int, k long")
    numbered = materialize(numbered, "numbered")  # the numbers must not change any more
    per_task = numbered.groupBy("length", "task").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("length", "task", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    histogram = {r["length"]: r["c"] for r in per_task.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    plan = best_plan(histogram, capacity)
    slots = plan.slots()
    # groups of containers follow the lengths, not the items; the key orders (length, first)
    keys = slots["length"].to_numpy(np.int64) << 40 | slots["first"].to_numpy(np.int64)
    each, base, offset = (slots[c].to_numpy(np.int64) for c in ("each", "container", "offset"))
    first = slots["first"].to_numpy(np.int64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            k, length = x["ordinal"].to_numpy(np.int64), x["length"].to_numpy(np.int64)
            at = np.searchsorted(keys, length << 40 | k, "right") - 1
            d = k - first[at]
            yield pd.DataFrame(
                {"id": x["id"], "part": x["part"], "n_tokens": length, "container": base[at] + d // each[at], "offset": offset[at] + d % each[at] * length}
            )

    ordinals = numbered.join(starts, ["length", "task"]).select("id", "part", "length", (F.col("k") + F.col("start")).alias("ordinal"))
    return ordinals.mapInPandas(place, f"id {kind}, part int, n_tokens int, container long, offset int").withColumnRenamed("id", id_col)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None) -> DataFrame:
    """Containers of `capacity` tokens filled with the non-empty documents of `df`."""
    texts = spread(df.select(id_col, text_col).where(F.col(text_col) != ""))
    return fill_containers(count_tokens(texts, id_col, text_col, vocabulary, folder), capacity, id_col)
