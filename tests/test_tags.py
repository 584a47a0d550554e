"""The query that renames a tag, over tables where nothing or too much is hit."""

from __future__ import annotations

import duckdb
import pytest

from gradeloom.plans import registry
from tests.oracle import compare

QUERIES, SQL = registry.load()
CASES = {
    "no such tag": [(1, 1, "warm", "glass_estuary"), (2, 2, "gilded_skyline", "other"), (3, 2, "gilded_skyline", None), (4, None, "gilded_skyline", "other")],
    "new name taken": [(1, 1, "gilded_skyline", "glass_estuary"), (2, 1, "gilded_horizon", "glass_estuary"), (3, 2, "gilded_skyline", "glass_estuary")],
    "no project": [(1, 1, "gilded_skyline", "other")],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_renaming_refuses_nothing(spark, tmp_path, case):
    rows = ", ".join("({}, {}::BIGINT, '{}', {})".format(i, "NULL" if f is None else f, t, "NULL" if p is None else f"'{p}'") for i, f, t, p in CASES[case])
    table = f"SELECT id::BIGINT AS id, fingerprint_id, tag, 'manual' AS source, project_name, TIMESTAMP '2026-01-01' AS ingested_at FROM (VALUES {rows}) t(id, fingerprint_id, tag, project_name)"
    duckdb.sql(f"COPY ({table}) TO '{tmp_path}/tags.parquet'")
    compare(spark, QUERIES["tag_renamed_in_project"], SQL["tag_renamed_in_project"], str(tmp_path))
