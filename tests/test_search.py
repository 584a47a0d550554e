"""Index recall, missing signals, unsound texts and NaN measurements."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions.vector import histogram
from gradeloom.operators import index as vectors
from gradeloom.operators import search as ops
from tests.conftest import DATA

SF = f"{DATA}/sf0.1"


def test_index_finds_nine_of_ten(spark, tmp_path):
    e = Catalog(spark, SF).fingerprints.select("id", "embedding", "embedding_model")
    path = f"file://{tmp_path}/index"
    index = vectors.load_or_build(e, path)
    assert index.rows.count() == vectors.sound(e).count()
    asked = [r["id"] for r in vectors.sound(e).where("id % 101 = 0").select("id").collect()]
    assert vectors.recall(index, e, asked) >= 0.9
    again = vectors.load_or_build(e, path)  # nothing changed, so the stored one serves
    assert again.rows.inputFiles() == index.rows.inputFiles()
    exact = ops.image_search(e.withColumn("embedding", ops.finite_embedding()), asked[0], 10).select("id", F.round("score", 9)).collect()
    assert vectors.search(index, e, asked[0], 10, probes=None).select("id", F.round("score", 9)).collect() == exact


def test_index_reads_only_its_cells(spark, tmp_path):
    e = Catalog(spark, SF).fingerprints.select("id", "embedding", "embedding_model")
    index = vectors.build(e, f"file://{tmp_path}/cells")
    plan = vectors.search(index, e, 7)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_index_of_few_and_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "a"), (3, [float("nan"), 1.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [1.0, 0.0], None), (7, [1.0, 0.0, 0.0], "a"), (8, [1.0, 0.0], "b")]
    e = spark.createDataFrame(rows, "id long, embedding array<float>, embedding_model string")
    index = vectors.build(e, f"file://{tmp_path}/few")
    assert [r["id"] for r in vectors.search(index, e, 1).collect()] == [2]
    assert vectors.search(index, e, 3).collect() == [] and vectors.search(index, e, 99).collect() == []
    none = vectors.build(e.limit(0), f"file://{tmp_path}/none")
    assert vectors.search(none, e, 1).collect() == []


def test_histogram_texts(spark):
    sound = ["1,2,3", " 1 , 2,3 ", "1,,2,3", ",1,2,3,", "+1,.5,2e-1", "1.,2,3"]
    bad = ["1,2", "1,2,3,4", "1,x,3", "1,nan,3", "1,1e999,3", "1 2,3,4", "0x1,2,3", "1d,2,3", "", ",,,", "1,Infinity,2", "-1e999,2,3", "1,\t2,3", None]
    df = spark.createDataFrame([(t,) for t in sound + bad], "t string").select("t", histogram(F.col("t"), 3).alias("h"))
    got = {r["t"]: r["h"] for r in df.collect()}
    assert all(got[t] is not None and len(got[t]) == 3 for t in sound) and not any(got[t] for t in bad)
    assert got["+1,.5,2e-1"] == [1.0, 0.5, 0.2]


def test_nan_measurements_are_null(spark):
    f = Catalog(spark, SF).fingerprints
    assert f.where("isnan(luminance_mean) OR isnan(luminance_stddev)").count() == 0
    assert Catalog(spark, SF).table("fingerprints").where("isnan(luminance_mean)").count() > 0


def test_hybrid_keeps_candidates_without_embedding_and_skips_the_own_file(spark):
    h = [1.0] + [0.0] * 63
    rows = [(1, 10, [1.0, 0.0], "m"), (2, 11, None, None), (3, 11, [float("nan"), 0.0], "m"), (4, 10, [1.0, 0.0], "m"), (5, 12, [1.0, 0.0], "m")]
    f = spark.createDataFrame([(*r, "video", None) for r in rows], "id long, file_id long, embedding array<float>, embedding_model string, color_space_tag string, feature_status string")
    features = spark.createDataFrame([(i, h, h, h) for i in (1, 2, 3, 4)], "id long, n_r array<double>, n_g array<double>, n_b array<double>")
    tags = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "fingerprint_id long, tag string")
    got = {r["id"]: r for r in ops.hybrid_search(ops.hybrid_inputs(f, features, tags), 1, (0.4, 0.4, 0.2), None).collect()}
    assert sorted(got) == [2, 3]  # 4 is of the same file, 5 has no grading features
    assert got[2]["clip"] is None and got[3]["clip"] is None and got[3]["tag"] is None and got[2]["stale"]
    assert np.isclose(got[2]["score"], (0.4 * got[2]["grading"] + 0.2 * 0.5) / 0.6) and np.isclose(got[3]["score"], got[3]["grading"])


def test_style_description(spark):
    flat = [1.0] * 64
    low = [1.0] + [0.0] * 63
    cases = [(flat, 0.4, 0.0, 0.0), (low, 0.2, 0.0, 0.1), (low, 0.26, 0.01, 0.1), (None, 0.4, 0.0, 0.0)]
    df = spark.createDataFrame(cases, "h array<double>, l double, a double, b double")
    got = [r[0] for r in df.select(ops.style_description(F.col("h"), F.col("l"), F.col("a"), F.col("b"))).collect()]
    assert got[0] == "高对比度 · 高光柔和延展 · 饱和度低" and got[3] == "风格中性" and got[1] == "暗部偏暖" and got[2] == "高对比度"
