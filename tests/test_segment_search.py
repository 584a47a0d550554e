"""Segment features and segment search over the movies' images."""

from __future__ import annotations

from gradeloom.plans import media, registry
from tests.conftest import DATA

QUERIES, _ = registry.load()


def test_segments_hold_every_pixel(spark):
    pixels = {r["movie"]: r["count"] for r in media.strip(spark, f"{DATA}/sf0.001").groupBy("movie").count().collect()}
    got = QUERIES["superpixel_features"](spark, f"{DATA}/sf0.001").select("movie", "label", "x0", "y0", "x1", "y1", "pixels").collect()
    assert {m: sum(r["pixels"] for r in got if r["movie"] == m) for m in pixels} == pixels
    assert all(r["pixels"] <= (r["x1"] - r["x0"] + 1) * (r["y1"] - r["y0"] + 1) for r in got)


def test_segment_search_ranks_the_other_movies(spark):
    movies = {r["movie"] for r in media.strip(spark, f"{DATA}/sf0.001").select("movie").distinct().collect()}
    got = QUERIES["segment_search"](spark, f"{DATA}/sf0.001").collect()
    assert {r["id"] for r in got} == movies - {media.QUERY_MOVIE}
    assert all(0 < r["score"] <= 1 for r in got) and [r["rank"] for r in sorted(got, key=lambda r: -r["score"])] == list(range(1, len(got) + 1))
