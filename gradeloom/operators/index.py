"""An index of embeddings for search: cells around centroids, stored as partitions of a table.

Centroids are fitted on a bounded sample; every row is stored in the cell of its nearest
centroid. A search ranks the centroids of the query's model, joins the few nearest cells as a
broadcast side on the partition columns, so only their files are read, and ranks the rows of
those exactly. With all cells (`probes=None`) the search is exact.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import vector as v
from gradeloom.operators.search import ranked, with_query

#: Rows that the centroids of all models are fitted on; every row is indexed.
SAMPLE_ROWS = 20_000
#: Rows a cell should hold, up to MOST_CELLS cells a model.
CELL_ROWS, MOST_CELLS = 256, 4096
#: Rows of a model under which its only cell holds all of them.
FEWEST = 1000
PROBES = 24


@dataclass(frozen=True)
class VectorIndex:
    """rows: (id, embedding, embedding_model, size, cell), partitioned by bucket; cells: (embedding_model, size, cell, bucket, centroid, rows)."""

    rows: DataFrame
    cells: DataFrame


def sound(embeddings: DataFrame) -> DataFrame:
    """(id, embedding, embedding_model, size) of the rows with a model and a finite vector that isn't all zero."""
    e = F.col("embedding")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return embeddings.where("id IS NOT NULL AND embedding_model IS NOT NULL AND size(embedding) > 0").where(good).select("id", "embedding", "embedding_model", F.size("embedding").alias("size"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def centroids(m: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; an empty cell takes a row of the fullest one."""
    rng = np.random.default_rng(seed)
    c = m[rng.choice(len(m), min(cells, len(m)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmax(m[i : i + 4096] @ c.T, axis=1) for i in range(0, len(m), 4096)])
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, m)
        for empty in np.flatnonzero(n == 0):
            sums[empty] = m[rng.choice(np.flatnonzero(at == int(np.argmax(n))))]
        c = _unit(sums)
    return c


def build(embeddings: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS) -> VectorIndex:
    """Fits, assigns and stores the index under `path`; tables of any size pass the cluster once for counts, once for the sample and once for the cells.

    Rows without model or sound vector are left out. A model of few rows has one cell. An empty table gives an empty index.
    """
    spark = embeddings.sparkSession
    rows = sound(embeddings)
    counts = rows.groupBy("embedding_model", "size").agg(F.count("*").alias("n"))
    sizes = {(r["embedding_model"], r["size"]): r["n"] for r in counts.collect()}  # a row per model
    total = sum(sizes.values())
    grid, table = {}, []
    if total:
        share = min(1.0, sample_rows / total)
        cut = 1 << 30
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(cut)) < int(cut * share) + 1).toPandas()
        for key, n in sorted(sizes.items()):
            mine = some[(some["embedding_model"] == key[0]) & (some["size"] == key[1])]
            if not len(mine) or n < FEWEST:
                grid[key] = np.zeros((1, key[1]))
            else:
                grid[key] = centroids(_unit(np.stack(mine["embedding"].to_numpy()).astype(float)), max(1, min(MOST_CELLS, n // cell_rows, len(mine) // 4)))
    base, at = 0, {}
    for key, c in grid.items():
        at[key] = base
        table += [(key[0], int(key[1]), base + i, x.tolist()) for i, x in enumerate(c)]
        base += len(c)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for key, part in x.groupby(["embedding_model", "size"], sort=False):
                c = grid[(key[0], key[1])]
                m = _unit(np.stack(part["embedding"].to_numpy()).astype(float))
                yield part.assign(bucket=at[(key[0], key[1])] + (np.argmax(m @ c.T, axis=1) if len(c) > 1 else 0))

    placed = rows.mapInPandas(assign, "id long, embedding array<float>, embedding_model string, size int, bucket long")
    placed.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(os.path.join(path, "rows"))
    meta = spark.createDataFrame(table, "embedding_model string, size int, bucket long, centroid array<double>").withColumn("indexed", F.lit(total).cast("long"))
    meta.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "cells"))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    kinds = "id long, embedding array<float>, embedding_model string, size int, bucket long"
    cells = spark.read.schema("embedding_model string, size int, bucket long, centroid array<double>, indexed long").parquet(os.path.join(path, "cells"))
    return VectorIndex(spark.read.schema(kinds).parquet(os.path.join(path, "rows")), cells)


def load_or_build(embeddings: DataFrame, path: str, **options: int) -> VectorIndex:
    """The stored index, or a new one where there is none or the number of sound rows isn't the indexed one."""
    from pyspark.errors import AnalysisException

    spark = embeddings.sparkSession
    try:
        found = load(spark, path)
        head = found.cells.select("indexed").head(1)
    except AnalysisException:
        return build(embeddings, path, **options)
    if head and head[0]["indexed"] == sound(embeddings).count():
        return found
    return build(embeddings, path, **options)


def nearest_cells(index: VectorIndex, embeddings: DataFrame, query_id: int, probes: int | None) -> DataFrame:
    """(bucket) of the query's model and size, the `probes` nearest by their centroids; at most MOST_CELLS rows by construction."""
    q = sound(embeddings.where(F.col("id") == query_id)).select(F.col("embedding").alias("q"), "embedding_model", "size").limit(1)
    c = index.cells.join(F.broadcast(q), ["embedding_model", "size"])
    if probes is None:
        return c.select("bucket")
    return c.select("bucket", v.cosine(F.col("centroid"), F.col("q")).alias("near")).orderBy(F.col("near").desc(), "bucket").limit(probes).select("bucket")


def search(index: VectorIndex, embeddings: DataFrame, query_id: int, k: int = 10, probes: int | None = PROBES, among: DataFrame | None = None) -> DataFrame:
    """(id, score, rank): the best k by cosine out of the nearest cells; the query's vector comes from `embeddings`.

    `among` (column id) restricts the candidates before the ranking. A query without a sound vector has no result.
    """
    near = nearest_cells(index, embeddings, query_id, probes)
    rows = index.rows.join(F.broadcast(near), "bucket").select("id", "embedding", "embedding_model")
    if among is not None:
        rows = rows.join(among.select("id").distinct(), "id", "left_semi")
    own = sound(embeddings.where(F.col("id") == query_id)).select("id", "embedding", "embedding_model")
    x = with_query(rows, own, query_id, ["embedding", "embedding_model"]).where("embedding_model = q_embedding_model AND size(embedding) = size(q_embedding)")
    return ranked(x.select("id", v.cosine(F.col("embedding"), F.col("q_embedding")).alias("score")), k, ["id"])


def recall(index: VectorIndex, embeddings: DataFrame, query_ids: list[int], k: int = 10, probes: int = PROBES) -> float:
    """Share of the exact best k that the index finds, over some queries in one pass."""
    q = sound(embeddings.where(F.col("id").isin(query_ids))).select(F.col("id").alias("q_id"), F.col("embedding").alias("q"), "embedding_model", "size")
    near = index.cells.join(F.broadcast(q), ["embedding_model", "size"]).select("q_id", "bucket", v.cosine(F.col("centroid"), F.col("q")).alias("c"))
    by = Window.partitionBy("q_id").orderBy(F.col("c").desc(), "bucket")
    near = near.withColumn("n", F.row_number().over(by)).where(F.col("n") <= probes).select("q_id", "bucket", F.lit(True).alias("probed"))
    pairs = index.rows.join(F.broadcast(q), ["embedding_model", "size"]).where("id <> q_id").select("q_id", "id", "bucket", v.cosine(F.col("embedding"), F.col("q")).alias("c"))
    top = pairs.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("c").desc(), "id"))).where(F.col("n") <= k)
    got = top.join(F.broadcast(near), ["q_id", "bucket"], "left").agg(F.avg(F.coalesce(F.col("probed"), F.lit(False)).cast("int")).alias("r")).first()
    return float(got["r"] or 0.0)
