"""embed_missing bit for bit as its SQL, over sound and odd embeddings."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from gradeloom.plans import registry
from tests.conftest import DATA
from tests.oracle import connect

QUERIES, SQL = registry.load()


def both(spark, folder):
    """Rows as text, where -0.0 isn't 0.0."""
    got = sorted(repr(tuple(r)) for r in QUERIES["embed_missing"](spark, folder).select("id", "embedding", "filled").collect())
    return got, sorted(map(repr, connect(folder).execute(f"SELECT id, embedding, filled FROM ({SQL['embed_missing']})").fetchall()))


def test_odd_embeddings(spark, tmp_path):
    rng = np.random.default_rng(0)
    size = 10.0 ** rng.integers(-9, 30, 4000)
    odd = ["NULL", "[]", "[NULL]", "[1, NULL, -0.00000004]", "['nan'::FLOAT, 1]", "['inf'::FLOAT]", "['-inf'::FLOAT, NULL]", "[-0.0, 0.0, -4e-7, 4e-7, 5e-7, -5e-7, -0.0078125, 0.0078125, -3.4e38, 1e-45]", str((rng.normal(size=4000) * size).tolist())]
    rows = ", ".join(f"({i}, {e}::FLOAT[])" for i, e in enumerate(odd))
    duckdb.sql(f"COPY (SELECT id::BIGINT AS id, embedding, 0.5::DOUBLE AS luminance_mean, 0.5::DOUBLE AS luminance_stddev FROM (VALUES {rows}) t(id, embedding)) TO '{tmp_path}/fingerprints.parquet'")
    got, want = both(spark, str(tmp_path))
    assert got == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_catalog(spark, size):
    got, want = both(spark, f"{DATA}/{size}")
    assert got == want
