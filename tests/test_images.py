"""Images with missing and repeated pixels."""

from __future__ import annotations

import struct

from gradeloom.operators import images


def test_incomplete_images_are_labelled(spark):
    cells = [(i, x, y) for i in (1, 2) for y in range(8) for x in range(8) if (i, x, y) != (1, 3, 3)]
    rows = [(i, x, y, *[float(x > 3)] * 6) for i, x, y in [*cells, (2, 5, 5)]]
    pixels = spark.createDataFrame(rows, "image long, x long, y long, r double, g double, b double, ok_l double, ok_a double, ok_b double")
    got = [(r["image"], r["x"], r["y"]) for r in images.segment_images(pixels, segments=4).collect()]
    assert sorted(got) == sorted(cells)


def test_incomplete_strips_are_drawn(spark):
    rows = [(m, f, r, 0.5, 0.5, 0.5) for m in (1, 2, 3) for r in range(4) for f in range(6) if (m, f, r) != (1, 2, 2) and (m, f) != (3, 2)]
    strip = spark.createDataFrame([*rows, (2, 0, 0, 0.5, 0.5, 0.5)], "movie long, frame long, row long, r double, g double, b double")
    got = {r["movie"]: bytes(r["strip_png"]) for r in images.strip_pictures(strip, 16).collect()}
    assert set(got) == {1, 2, 3}
    assert {struct.unpack(">II", v[16:24]) for v in got.values()} == {(6, 4)} and len(set(got.values())) == 1
