"""The llm queries against their SQL, and p7 and p9 against the reference tokenizer, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from gradeloom.llm import bpe, queries
from tests.conftest import DATA
from tests.oracle import compare

SF = f"{DATA}/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() >= 0


def test_tokens(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    enc = bpe.encoder()
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p7_ids(spark, SF).collect()}
    assert got == {i: enc.encode(t) for i, t in docs}
    assert {r["doc_id"] for r in queries.p9_found(spark, SF).collect()} == {i for i, t in docs if enc.count(t) > 1024}
