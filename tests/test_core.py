"""Small tables for what queries over the large ones don't reach: prompts, texts, configuration, films, imports, changes."""

from __future__ import annotations

import json
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.config import ConfigError, search_weights
from gradeloom.functions import display, prompts
from gradeloom.operators import films, images, lut, sql, strips, tags
from gradeloom.operators import search as ops
from gradeloom.sinks import importer
from gradeloom.sources import media
from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


def plain_prompt(text, path):
    """Joins by looking at all pairs again after every merge."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    letters = prompts.byte_letters()
    ids = [prompts.START]
    import re

    for match in re.findall(prompts.PATTERN, text.lower()):
        parts = [letters[b] for b in match.encode("utf-8")]
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
            if best is None:
                break
            first = best[1]
            parts[first : first + 2] = ["".join(parts[first : first + 2])]
        ids += [model["vocab"][p] for p in parts if p in model["vocab"]]
    ids = [*ids[:76], prompts.END]
    return ids + [0] * (77 - len(ids))


def test_prompts(spark):
    path = "/opt/tokenizers/word_bpe_49k.json"
    texts = ["a photo with warm shadows", "", "Teal & ORANGE, it's high-contrast 2383", "漢字 🎬", "word " * 200, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", None, "\n\t "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.prompt_ids(F.col("t"), path)).collect()
    assert [r[0] for r in got] == [None if t is None else plain_prompt(t, path) for t in texts]
    letters = prompts.byte_letters()
    assert len(set(letters)) == 256 and letters[32] == "Ġ" and letters[65] == "A"


def test_display(spark):
    df = spark.createDataFrame([(0, "short"), (999, "exactly ten"), (1500, "漢字漢字漢字"), (187_000, "a🎬bcdefgh"), (None, None)], "ms long, t string")
    rows = df.select(display.duration_text(F.col("ms")), display.shortened(F.col("t"), 8), display.moment_text(F.col("ms")), display.display_width(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["0ms", "999ms", "1.5s", "3m 7s", None]
    assert [r[1] for r in rows] == ["short", "exactly…", "漢字漢…", "a🎬bcde…", None]
    assert [r[2] for r in rows][:2] == ["1970-01-01 00:00:00", "1970-01-01 00:16:39"] and [r[3] for r in rows] == [5, 11, 12, 10, None]
    assert spark.range(1).select(display.two_places(F.lit(2.345))).first()[0] == 2.35


def test_config_cascade(tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    user = tmp_path / "user.toml"
    assert search_weights(deep, user) == ops.PRESETS["grading-first"]
    user.write_text('[search]\ndefault_mode = "balanced"\n')
    assert search_weights(deep, user) == ops.PRESETS["balanced"]
    own = tmp_path / "a" / ".gradeloom"
    own.mkdir()
    (own / "config").write_text("[search]\ngrading_weight = 0.5\nclip_weight = 0.3\ntag_weight = 0.2\n")
    assert search_weights(deep, user) == (0.5, 0.3, 0.2)
    assert search_weights(deep, user, {"grading": 1.0}) == (1.0, 0.0, 0.0)
    for bad in ("[search]\ngrading_weight = 0.9\n", "[search]\ngrading_weight = nan\n", "[search]\ntag_weight = 'x'\n", "not toml [", "[search]\ngrading_weight = 0.95\nclip_weight = 0.05\ntag_weight = 0.0\n"):
        (own / "config").write_text(bad)
        with pytest.raises(ConfigError):
            search_weights(deep, user)
    (own / "config").write_text('[search]\ndefault_mode = "odd"\n')
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert search_weights(deep, user) == ops.PRESETS["grading-first"] and seen


def test_weights():
    assert ops.parse_weights("grading=0.6, clip=0.3,tag=0.1") == (0.6, 0.3, 0.1)
    for bad in ("grading", "grading=1,grading=0", "x=1", "grading=0.5", "grading=nan"):
        with pytest.raises(ValueError):
            ops.parse_weights(bad)
    assert ops.explain_few(0) and ops.explain_few(2) and ops.explain_few(3) is None


def test_guarded_sql(spark):
    c = Catalog(spark, SF)
    before = {t.name for t in spark.catalog.listTables()}
    assert sql.select(c, "SELECT 'read from files now' AS x, '{a}' AS y FROM projects LIMIT 1").first().asDict() == {"x": "read from files now", "y": "{a}"}
    assert sql.select(c, "-- files\nSELECT count(*) AS n FROM files f, projects p WHERE f.project_id = p.id;").first()["n"] > 0
    assert sql.select(c, "/* a */ select f.n from (select count(*) as n from files) f").count() == 1
    for bad in ("DROP TABLE files", "WITH x AS (SELECT 1) SELECT * FROM x", "", "SELECT 1; SELECT 2", "SELECT 1) UNION (SELECT 2", "SELECT TRANSFORM(id) USING 'cat' FROM files", f"SELECT * FROM parquet.`{SF}/files.parquet`", "INSERT INTO files SELECT 1"):
        with pytest.raises(Exception):  # noqa: B017, PT011
            sql.select(c, bad).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_film_strips(spark):
    rng = np.random.default_rng(0)
    frames = [rng.random((5, 4, 3)) for _ in range(4)]
    files = [(f"/x/one/{i:03d}.ppm", "ppm", bytearray(media.ppm_bytes(4, 5, f.reshape(-1, 3)))) for i, f in enumerate(frames)]
    files += [("/x/one/001b.ppm", "ppm", bytearray(b"P6 broken")), ("/x/one/001c.ppm", "ppm", bytearray(media.ppm_bytes(2, 2, np.zeros((4, 3))))), ("/x/two/a.ppm", "ppm", bytearray(b""))]
    film = films.film_strips(spark.createDataFrame(files, "path string, format string, content binary"), every=2)
    got = {(r["frame"], r["row"]): (r["r"], r["g"], r["b"]) for r in film.strip.where("movie = 'one'").collect()}
    q = [np.floor(f * 255 + 0.5) / 255 for f in frames]
    assert len(got) == 20 and all(np.allclose(got[(i, y)], q[i][y].mean(0)) for i in range(4) for y in range(5))
    thumbs = {(r["frame"], r["x"], r["y"]): r["r"] for r in film.thumbnails.collect()}
    assert {k[0] for k in thumbs} == {0, 2} and np.isclose(thumbs[(2, 1, 2)], q[2][4:, 2:, 0].mean()) and np.isclose(thumbs[(0, 0, 0)], q[0][:2, :2, 0].mean())
    assert sorted(r["path"] for r in film.left_out.collect()) == ["/x/one/001b.ppm", "/x/one/001c.ppm", "/x/two/a.ppm"]
    centre = films.film_strips(spark.createDataFrame(files, "path string, format string, content binary"), mode="center").strip
    assert np.isclose(centre.where("frame = 0 AND row = 1").first()["g"], q[0][1, 2, 1])


def test_external_frames(spark, tmp_path):
    """A stand-in tool writes a frame; a missing tool and a failing one are told."""
    f = spark.createDataFrame([("/a.mov",), ("/b.mov",)], "path string")
    ok = media.extract_frames(f, lambda path, target: ["sh", "-c", f"printf 'P6 1 1 255\\nabc' > {target}/1.ppm"], str(tmp_path)).collect()
    assert all(r["error"] is None for r in ok) and len(list(tmp_path.glob("*/1.ppm"))) == 2
    assert all(r["error"] for r in media.extract_frames(f, media.frame_command(2, 5, tool="no-such-tool"), str(tmp_path)).collect())
    assert all("bad" in r["error"] for r in media.extract_frames(f, lambda p, t: ["sh", "-c", "echo bad >&2; exit 3"], str(tmp_path)).collect())
    assert media.keyframe_command()("x", "y")[0] == "ffmpeg"


def test_upsert_takes_the_latest_by_its_columns(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id long, name string, at long")
    new = spark.createDataFrame([(1, "zz", 1), (1, "aa", 2), (3, "c", 1)], "id long, name string, at long")
    assert sorted(tuple(r) for r in importer.upsert(old, new, ["id"], ["at"]).collect()) == [(1, "aa", 2), (2, "old", 0), (3, "c", 1)]
    again = importer.append_first(old, new, ["id"], ["at"])
    assert sorted(tuple(r) for r in again.collect()) == [(1, "old", 0), (2, "old", 0), (3, "c", 1)]


def test_saved_partitions_and_buckets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string")
    path = str(tmp_path / "t")
    importer.save(df, path, ["p"])
    importer.save(spark.createDataFrame([(9, "a")], "id long, p string"), path, ["p"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "p").collect()) == [(2, "b"), (9, "a")]


def test_tag_changes(spark):
    t = spark.createDataFrame([(1, "a", "ai"), (1, "b", "manual"), (2, "a", "ai")], "fingerprint_id long, tag string, source string")
    f = spark.createDataFrame([(1,), (2,), (3,)], "fingerprint_id long")
    assert tags.add_tag(t, 2, "c").table.count() == 4
    assert tags.remove_tag(t, 1, "b").touched.count() == 1
    assert sorted(r["fingerprint_id"] for r in tags.add_to_project(t, f, "b").touched.collect()) == [2, 3]
    assert tags.remove_from_project(t, f, "a").table.count() == 1
    for wrong in (lambda: tags.add_tag(t, 1, "a"), lambda: tags.add_tag(t, 1, " "), lambda: tags.remove_tag(t, 1, "z"), lambda: tags.rename_tag(t, f, "a", "b"), lambda: tags.rename_tag(t, f, "z", "y")):
        with pytest.raises(tags.TagError):
            wrong()
    assert tags.rename_tag(t, f, "a", "c").table.where("tag = 'c'").count() == 2
    assert tags.needs_calibration("ai", "remove") and not tags.needs_calibration("ai, manual", "remove") and tags.needs_calibration(None, "add")
    row = tags.calibration_row("p", None, ["a"], [], [("a", "b")], spark, 5).first()
    assert json.loads(row["renamed_tags"]) == [["a", "b"]] and row["fingerprint_id"] is None


def test_sessions_and_branches(spark):
    s = tags.new_session(spark, "s1", 10).unionByName(tags.new_session(spark, "s2", 20))
    assert [r["session_id"] for r in tags.sessions_listed(s).collect()] == ["s2", "s1"] and tags.sessions_listed(s, 1).count() == 1
    none = spark.createDataFrame([], "session_id string, branch_id string, parent_id string, branch_point_seq long, name string, created_at long")
    one = tags.new_branch(none, "s1", "b1", "main", 1).table
    two = tags.new_branch(one, "s1", "b2", "other", 2, "b1", 4).table
    assert [r["name"] for r in tags.branches_of(two, "s1").collect()] == ["main", "other"] and tags.branch_by_name(two, "s1").first()["branch_id"] == "b1"
    for wrong in (("s1", "b3", "main", 3), ("s1", "b3", "x", 3, "b9"), ("s2", "b3", "x", 3, "b1")):
        with pytest.raises(tags.TagError):
            tags.new_branch(two, *wrong)


def test_branches_of_any_depth(spark):
    rows = [(1, i, i - 1 if i else None, f"n{i}") for i in range(150)] + [(1, 500, 501, "x"), (1, 501, 500, "y"), (1, 600, 999, "z"), (2, 7, None, "r"), (2, 8, 7, "s")]
    b = spark.createDataFrame(rows, "session_id long, branch_id long, parent_id long, name string")
    got = {(r["session_id"], r["branch_id"]): r for r in tags.branch_tree(b).collect()}
    assert len(got) == 152 and all(got[(1, i)]["level"] == i and got[(1, i)]["root"] == 0 for i in range(150))
    assert got[(1, 149)]["path"] == "/".join(f"n{i}" for i in range(150)) and got[(2, 8)]["path"] == "r/s"
    assert tags.branch_tree(b, depth=3).count() == 6 and tags.branch_tree(b.limit(0)).count() == 0


def test_compaction(spark):
    m = spark.createDataFrame([(1, "main", i, "user", f"t{i}", False) for i in range(5)], "session_id long, branch string, seq long, role string, content string, is_compacted boolean")
    done = tags.compact(m, 1, "main", 2, "so far")
    assert done.touched.count() == 3 and [r["content"] for r in tags.branch_messages(done.table, 1).collect()] == ["so far", "t3", "t4"]
    assert tags.next_sequence(m).first()["next_seq"] == 5


def test_edit_sessions_protect_regions(spark):
    t = lut.identity(spark, 5)
    s = lut.EditSession.load(t, protected=("highlights",))
    regions = {r["region"] for r in lut.anchors(t).select("region").collect()}
    s.apply(lut.Edit("lift", (0.1,), "shadows"))
    assert len(s.versions) == 2 and s.undo() is t
    with pytest.raises(lut.LutError):
        s.undo()
    assert "full" in regions
    if "highlights" in regions:
        with pytest.raises(lut.LutError):
            s.apply(lut.Edit("gain", (0.5,)))
    lut.validate(t, 5)
    for bad in (t.limit(100), t.withColumn("r", F.lit(float("nan")))):
        with pytest.raises(lut.LutError):
            lut.validate(bad, 5)


def plain_iris(strip, size, inner=0.15):
    h, w, _ = strip.shape

    def at(x, y):
        x, y = min(max(x, 0), w - 1), min(max(y, 0), h - 1)
        x0, y0 = int(x), int(y)
        x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
        fx, fy = x - x0, y - y0
        return (strip[y0, x0] * (1 - fx) + strip[y0, x1] * fx) * (1 - fy) + (strip[y1, x0] * (1 - fx) + strip[y1, x1] * fx) * fy

    taps = [np.exp(-k * k / 2.88) for k in (-2, -1, 0, 1, 2)]
    out, seen = np.zeros((size, size, 3)), np.zeros((size, size), bool)
    for i in range(size):
        for j in range(size):
            got = []
            for sy in (0.25, 0.75):
                for sx in (0.25, 0.75):
                    y, x = (i + sy) / size * 2 - 1, (j + sx) / size * 2 - 1
                    r = np.hypot(x, y)
                    if inner <= r <= 1:
                        frame, row = (r - inner) / (1 - inner) * (w - 1), np.arctan2(y, x) % (2 * np.pi) / (2 * np.pi) * (h - 1)
                        got.append(sum(t * at(frame + k, row) for t, k in zip(taps, (-2, -1, 0, 1, 2))) / sum(taps))
            if got:
                out[i, j], seen[i, j] = np.mean(got, axis=0), True
    blurred = np.zeros_like(out)
    for i in range(size):
        for j in range(size):
            if seen[i, j]:
                blurred[i, j] = np.mean([out[min(max(a, 0), size - 1), min(max(b, 0), size - 1)] for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1)], axis=0)
    return blurred


def test_iris_against_a_plain_form():
    strip = np.random.default_rng(2).random((7, 30, 3))
    assert np.allclose(images.iris(strip, 24), plain_iris(strip, 24))
    with pytest.raises(ValueError):
        images.iris(strip, 1)


def test_superpixels_against_a_plain_form():
    """The same rule, one pixel and seed at a time, on an image of four fields with noise."""
    rng = np.random.default_rng(1)
    lab = np.zeros((16, 20, 3))
    lab[:8, :10], lab[:8, 10:], lab[8:, :10], lab[8:, 10:] = (0.2, 0, 0), (0.8, 0.1, 0), (0.5, -0.1, 0.1), (0.9, 0.2, -0.2)
    lab += 0.004 * rng.normal(size=lab.shape)
    got = images.slic_labels(lab, 4)
    fields = [got[:8, :10], got[:8, 10:], got[8:, :10], got[8:, 10:]]
    assert all(len(np.unique(f)) == 1 for f in fields) and len({int(f[0, 0]) for f in fields}) == 4
    label = rng.integers(0, 3, (9, 11))
    pieces = images.connected(label, 1)
    for a in range(9):
        for b in range(11):
            for c, d in ((a + 1, b), (a, b + 1)):
                if c < 9 and d < 11:
                    assert (label[a, b] == label[c, d]) == (pieces[a, b] == pieces[c, d]) or label[a, b] != label[c, d]
    assert len(np.unique(images.connected(label, 100))) == 1 or images.connected(label, 100).max() < pieces.max()


def test_movie_search_among(spark):
    rng = np.random.default_rng(3)
    strip = spark.createDataFrame([(m, f, r, *map(float, rng.random(3))) for m in range(4) for f in range(3) for r in range(2)], "movie int, frame long, row long, r double, g double, b double")
    dna = strips.color_dna(strip)
    assert {r["movie"] for r in strips.movie_search(dna, 0, among=[0, 2, 99]).collect()} == {2}
    assert strips.movie_search(dna, 0, among=[]).count() == 0 and strips.movie_search(dna, 0).count() == 3


def test_scene_cuts_without_a_cap(spark):
    d = spark.createDataFrame([("m", 20 * i, 0.5) for i in range(30)], "movie string, frame long, distance double")
    assert strips.boundary_frames(d, most=5).count() == 5 and strips.boundary_frames(d, most=None).count() == 30


def test_trend_of_a_feedback_stream(spark, tmp_path):
    """Weeks come out once the watermark has passed them; a row delivered twice counts once."""
    from gradeloom.operators.analytics import feedback_trend_stream

    rows = [(1, "accepted", "2024-01-04 10:00:00"), (1, "accepted", "2024-01-04 10:00:00"), (2, "rejected", "2024-01-05 10:00:00"), (3, "accepted", "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, action string, t string").selectExpr("id", "action", "CAST(t AS TIMESTAMP) AS ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = feedback_trend_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("trend").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = [tuple(r)[1:] for r in spark.table("trend").collect()]
    finally:
        q.stop()
    assert got == [(1, 2, 0.5)] or got == [(1, 2, 50.0)]


def test_intermediate_tables_are_deleted(spark):
    import os

    from gradeloom import storage

    kept = storage.materialize(spark.range(3), "gone")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and storage.release() >= 1 and not os.path.exists(path)


def test_sidecars_and_samples(spark, tmp_path):
    for name, body in {"a.dpx": b"", "b.EXR": b"", "c.dpx": b"", "a.json": b'{"material_type": "dpx", "color_space": "log", "grading_style_tags": ["x"]}', "c.json": b"broken"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r["image_path"].rsplit("/", 1)[-1]: r for r in media.read_sidecars(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.dpx", "b.EXR", "c.dpx"} and got["a.dpx"]["grading_style_tags"] == ["x"]
    assert got["a.dpx"]["has_sidecar"] and not got["b.EXR"]["has_sidecar"] and got["c.dpx"]["material_type"] is None
    found = media.scan(spark, str(tmp_path)).collect()
    assert {(r["filename"], r["format"]) for r in found} == {("a.dpx", "dpx"), ("b.EXR", "exr"), ("c.dpx", "dpx")}
    pcm = spark.createDataFrame([("t", bytearray(np.array([1, -2, 32767], "<i2").tobytes() + b"x"))], "path string, content binary")
    assert [tuple(r) for r in media.pcm_samples(pcm).collect()] == [("t", 0, 1), ("t", 1, -2), ("t", 2, 32767)]
    bars = strips.waveform_bars(strips.waveform(media.pcm_samples(pcm), 3), 10).groupBy("bin").count().collect()
    assert {r["bin"]: r["count"] for r in bars} == {2: 10}
    assert media.audio_command(16000)("a", "b")[-1] == "b/audio.pcm"


def test_lut_files_are_read_and_never_overwritten(spark, tmp_path):
    from gradeloom.sources import lutfiles

    t = lut.sampled(spark, 3, lut.Cdl((1.2, 0.9, 0.8), (0.0, 0.05, 0.0), (1.0, 1.1, 1.0), 0.7))
    for kind in ("cube", "look", "csp"):
        lutfiles.export_lut(t, 3, str(tmp_path / f"x.{kind}"), "a title")
    with pytest.raises(FileExistsError):
        lutfiles.export_lut(t, 3, str(tmp_path / "x.cube"))
    for bad in ("y.cdl", "y.txt"):
        with pytest.raises(lut.LutError):
            lutfiles.export_lut(t, 3, str(tmp_path / bad))
    (tmp_path / "z.cube").write_text("broken")
    rows = lutfiles.read_luts(spark, str(tmp_path)).collect()
    assert [r["error"] is not None for r in rows].count(True) == 1 and len(rows) == 3 * 27 + 1
    want = {(r["ri"], r["gi"], r["bi"]): (r["r"], r["g"], r["b"]) for r in t.collect()}
    assert all(np.allclose((r["r"], r["g"], r["b"]), want[(r["ri"], r["gi"], r["bi"])], atol=1e-6) for r in rows if r["error"] is None)
    assert lut.diff(t, lutfiles.from_table(spark, lutfiles.to_table(t, 3))).where("changed > 0").count() == 0
    with pytest.raises(lut.LutError):
        lut.diff(t, lut.identity(spark, 4))


def test_small_color_rules(spark):
    from gradeloom.functions import color

    with pytest.raises(ValueError):
        color.aces_steps("acescct", "rec709")
    row = spark.range(1).select(
        color.normalised_angle(F.lit(-0.5)).alias("a"), color.channels_descriptor(F.array(*map(F.lit, "BGR"))).alias("b"), color.channels_descriptor(F.array(*map(F.lit, "ABGR"))).alias("c"), color.channels_descriptor(F.array(*map(F.lit, "YZ"))).alias("d")
    ).first()
    assert np.isclose(row["a"], 2 * np.pi - 0.5) and (row["b"], row["c"], row["d"]) == ("rgb", "rgba", "Y,Z")


def test_vocabulary_files(tmp_path):
    from gradeloom.operators.lookup import vocabulary_of

    f = tmp_path / "v.toml"
    f.write_text('tags = ["b", " a ", "B", ""]')
    assert vocabulary_of(str(f), ["z"]) == ["b", "a"]
    f.write_text("tags = []")
    assert vocabulary_of(str(f), ["z"]) == []
    for text in ("tags = 5", "tags = 'abc'", "other = 1", "not toml ["):
        f.write_text(text)
        assert vocabulary_of(str(f), ["z"]) == ["z"]
    assert vocabulary_of(str(tmp_path / "none.toml"), ["z"]) == ["z"]


def test_stored_tiles(spark):
    t = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 0, 0), (2, 0, 0)], "id long, tile_row int, tile_col int")
    assert [tuple(r)[1:] for r in ops.stored_tiles(t, 1).collect()] == [(0, 0), (0, 1), (1, 0)]
