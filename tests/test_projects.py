"""Distances of projects: many groups, blocks that meet, the mean without pairs."""

from __future__ import annotations

import numpy as np
import pytest

from gradeloom.operators import features as ft

NAMES = ["hist_r", "hist_g", "hist_b"]


def table(spark, groups, each=2, bins=8, seed=0):
    """Histograms of the named groups, and the mean distance of every two groups."""
    rng = np.random.default_rng(seed)
    h = {g: rng.random((each, 3, bins)) for g in groups}
    rows = [(g, *[c.tolist() for c in x]) for g, xs in h.items() for x in xs]
    mean = {g: x.mean(0) for g, x in h.items() if g is not None}
    want = {(a, b): float(np.abs(mean[a] - mean[b]).sum() / 3) for a in mean for b in mean if a < b}
    return spark.createDataFrame(rows, "project string, hist_r array<double>, hist_g array<double>, hist_b array<double>"), want


GROUPS = [None, "", "Z", "a", "aa", "é", "￮", "\U0001f3ac", *[f"p{i}" for i in range(30)]]


def test_project_distances_of_blocks(spark):
    df, want = table(spark, GROUPS)
    for rows in (5, 1024):
        got = [tuple(r) for r in ft.project_distances(df, "project", NAMES, rows).select("a", "b", "distance").collect()]
        assert len(got) == len(want)
        assert {(a, b): d for a, b, d in got} == pytest.approx(want)
    assert ft.project_distances(df.limit(0), "project", NAMES).count() == 0
    assert ft.project_distances(df.where("project = 'a'"), "project", NAMES).count() == 0


def test_pairs_are_not_shuffled_by_bin(spark):
    """What goes between tasks are centroids; 64 rows a pair filled the disk at 12,000 projects."""
    df, _ = table(spark, GROUPS)
    plan = ft.project_distances(df, "project", NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(a#" not in plan


def test_mean_distance_makes_no_pairs(spark):
    from gradeloom.plans import pixels

    df, want = table(spark, GROUPS, seed=1)
    mean = lambda x: ft.mean_distance(x, "project", NAMES).first()["overall"]
    assert mean(df) == pytest.approx(np.mean(list(want.values())))
    assert mean(df.limit(0)) == 0 and mean(df.where("project = 'a' OR project IS NULL")) == 0
    plan = pixels.overall_consistency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "a < b" not in plan and " < b#" not in plan and "FlatMapGroupsIn" not in plan
