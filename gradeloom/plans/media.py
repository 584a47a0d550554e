"""Source and sink queries: files of known content are encoded, decoded again and compared with what SQL says they hold.

Each movie of the strip tables is one image: x is the frame, y the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions.vector import normalised, total
from gradeloom.operators import features as ft
from gradeloom.operators import films as film_operators
from gradeloom.operators import images as im
from gradeloom.operators import lut as lut_ops
from gradeloom.operators.films import Film
from gradeloom.operators.search import tile_search
from gradeloom.plans.pixels import FRAMES, IMAGE, PX, image, rounded, strip
from gradeloom.plans.registry import query
from gradeloom.plans.sqltext import INFO, LUTS, with_
from gradeloom.sinks import importer
from gradeloom.sources import lutfiles, media
from gradeloom.storage import materialize, scratch, spread

QUERY_MOVIE = 1


def encoded(spark: SparkSession, sf_dir: str, kind: str, encode: Callable[[int, int, np.ndarray], bytes]) -> DataFrame:
    """(path, filename, format, content): each movie as an image file."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["row", "frame"])
        w, h, name = p["frame"].nunique(), p["row"].nunique(), f"m{p['movie'].iloc[0]}.{kind}"
        return pd.DataFrame({"path": [f"/{name}"], "filename": [name], "format": [kind], "content": [encode(w, h, p[["r", "g", "b"]].to_numpy(float))]})

    return strip(spark, sf_dir).groupBy("movie").applyInPandas(run, "path string, filename string, format string, content binary")


def quantised(top: int) -> str:
    return ", ".join(f"round(floor({c} * {top} + 0.5) / {top}::DOUBLE, 6) AS {c}" for c in "rgb")


def _decoded(name: str, kind: str, encode: Callable[[int, int, np.ndarray], bytes], values: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = media.read_pixels(encoded(spark, sf_dir, kind, encode))
        return rounded(p.select(F.regexp_extract("path", r"m(\d+)", 1).cast("int").alias("movie"), "x", "y", "r", "g", "b"))

    run.__name__ = name
    query(name, with_(FRAMES, PX, IMAGE) + f"SELECT movie, x, y, {values} FROM im")(run)


for _depth in (8, 10, 16):
    _decoded(f"dpx_{_depth}_bit", "dpx", lambda w, h, v, d=_depth: media.dpx_bytes(w, h, v, d, big=d != 16), quantised((1 << _depth) - 1))
_decoded("ppm_8_bit", "ppm", lambda w, h, v: media.ppm_bytes(w, h, v), quantised(255))
_decoded("ppm_16_bit", "ppm", lambda w, h, v: media.ppm_bytes(w, h, v, 65535), quantised(65535))
_decoded("exr_rle", "exr", lambda w, h, v: media.exr_bytes(w, h, v, "float", "rle"), ", ".join(f"round(({c})::FLOAT::DOUBLE, 6) AS {c}" for c in "rgb"))
_decoded("exr_float", "exr", lambda w, h, v: media.exr_bytes(w, h, v, "float"), ", ".join(f"round(({c})::FLOAT::DOUBLE, 6) AS {c}" for c in "rgb"))
_decoded("exr_zip", "exr", lambda w, h, v: media.exr_bytes(w, h, v, "float", "zip"), ", ".join(f"round(({c})::FLOAT::DOUBLE, 6) AS {c}" for c in "rgb"))


SMALL = with_(FRAMES, PX, IMAGE, "im2 AS (SELECT movie, x, y, w, h, r::FLOAT::DOUBLE AS r, g::FLOAT::DOUBLE AS g, b::FLOAT::DOUBLE AS b FROM im)", "sz AS (SELECT *, CASE WHEN greatest(w, h) <= 16 THEN w ELSE greatest(round(w * (16::DOUBLE / greatest(w, h))), 1) END::BIGINT AS nw, CASE WHEN greatest(w, h) <= 16 THEN h ELSE greatest(round(h * (16::DOUBLE / greatest(w, h))), 1) END::BIGINT AS nh FROM im2)")


@query(
    "decoded_small",
    SMALL + "SELECT movie, tx AS x, ty AS y, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, first(nw) AS width, first(nh) AS height FROM sz, range(16) a(tx), range(16) c(ty) WHERE tx < nw AND ty < nh AND x >= tx * w // nw AND x < ((tx + 1) * w + nw - 1) // nw AND y >= ty * h // nh AND y < ((ty + 1) * h + nh - 1) // nh GROUP BY 1, 2, 3",
)
def decoded_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images brought down to 16 points a side where they are decoded."""
    p = media.read_pixels(encoded(spark, sf_dir, "exr", lambda w, h, v: media.exr_bytes(w, h, v, "float", "zip")), 16)
    return rounded(p.select(F.regexp_extract("path", r"m(\d+)", 1).cast("int").alias("movie"), "x", "y", "r", "g", "b", "width", "height"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with each movie as a 16-bit DPX or a float EXR file, a film, and a broken file of each kind."""
    import os
    import uuid

    folder = scratch(spark, "files")
    local = urlparse(folder).path if folder.startswith("file:") else folder
    dpx = encoded(spark, sf_dir, "dpx", lambda w, h, v: media.dpx_bytes(w, h, v, 16))
    exr = encoded(spark, sf_dir, "exr", lambda w, h, v: media.exr_bytes(w, h, v, "float", "rle"))
    movie = F.regexp_extract("path", r"m(\d+)", 1).cast("int")
    film = media.mov_bytes(64, 36, 24, [(48, 1)], sync=[1, 25])
    odd = [("broken.dpx", b"SDPX" + bytes(100)), ("empty.exr", b""), ("short.dpx", media.dpx_bytes(4, 4, np.zeros((16, 3)), 16)[:-9]), ("packed.exr", media.exr_bytes(2, 2, np.zeros((4, 3))).replace(b"compression\0compression\0\x01\0\0\0\0", b"compression\0compression\0\x01\0\0\0\x06")), ("film.MOV", film), ("film2.mov", film[:60])]
    rows = dpx.where(movie % 2 == 0).unionByName(exr.where(movie % 2 == 1)).select("filename", "content")
    rows = rows.unionByName(spark.createDataFrame([(n, bytearray(d)) for n, d in odd], "filename string, content binary"))

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            os.makedirs(local, exist_ok=True)
            for name, data in zip(x["filename"], x["content"]):
                # a task that runs again writes the same file
                with open(f"{local}/.{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(f.name, f"{local}/{name}")
            yield pd.DataFrame({"filename": x["filename"]})

    rows.mapInPandas(save, "filename string").count()
    return folder


#: What the files of `written` hold, as rows of r, g, b.
STORED = "vx AS (SELECT movie, w, h, " + ", ".join(f"CASE WHEN movie % 2 = 0 THEN floor({c} * 65535 + 0.5) / 65535::DOUBLE ELSE {c}::FLOAT::DOUBLE END AS {c}" for c in "rgb") + " FROM im)"


@query(
    "import_files",
    with_(FRAMES, PX, IMAGE, STORED, "vy AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM vx)")
    + """SELECT 'm' || movie || CASE WHEN movie % 2 = 0 THEN '.dpx' ELSE '.exr' END AS filename, CASE WHEN movie % 2 = 0 THEN 'dpx' ELSE 'exr' END AS format, first(w) AS width, first(h) AS height,
  CASE WHEN movie % 2 = 0 THEN 'log' ELSE 'linear' END AS color_tag, round(avg(y), 6) AS luminance_mean, round(stddev_pop(y), 6) AS luminance_stddev, 0::BIGINT AS keyframes, false AS failed FROM vy GROUP BY movie
  UNION ALL SELECT * FROM (VALUES ('empty.exr', NULL, NULL, NULL, NULL, NULL, NULL, 0, true), ('broken.dpx', NULL, NULL, NULL, NULL, NULL, NULL, 0, true), ('short.dpx', 'dpx', 4, 4, 'log', NULL, NULL, 0, true), ('packed.exr', 'exr', 2, 2, 'linear', NULL, NULL, 0, true),
  ('film.MOV', 'mov', 64, 36, 'linear', NULL, NULL, 2, false), ('film2.mov', NULL, NULL, NULL, NULL, NULL, NULL, 0, true))""",
)
def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files imported: every file comes out, with its header, its luminance or its failure."""
    got = importer.import_project(spark, written(spark, sf_dir), "p")
    name = F.element_at(F.split("path", "/"), -1)
    head = got.files.select(name.alias("filename"), "format", "width", "height", "color_tag")
    lum = got.fingerprints.select(name.alias("filename"), "luminance_mean", "luminance_stddev")
    frames = got.keyframes.groupBy(name.alias("filename")).agg(F.count("*").alias("keyframes"))
    bad = got.skipped.select(name.alias("filename"), F.lit(True).alias("failed"))
    out = head.join(lum, "filename", "left").join(frames, "filename", "left").join(bad, "filename", "full")
    return rounded(out.fillna(0, ["keyframes"]).fillna(False, ["failed"]))


@query("resumed_folder", with_(FRAMES, PX) + "SELECT 'm' || movie || '.exr' AS filename FROM px WHERE movie % 2 = 1 GROUP BY movie")
def resumed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an import adds when the project has all others already."""
    folder = written(spark, sf_dir)
    known = media.scan(spark, folder, ("dpx", "mov")).select(F.lit("p").alias("project_name"), "filename").unionByName(spark.createDataFrame([("p", "packed.exr")], "project_name string, filename string"))
    return importer.import_project(spark, folder, "p", known).files.select("filename")


@query("dpx_headers", with_(FRAMES, PX, IMAGE) + "SELECT movie, first(w) AS width, first(h) AS height, 10::BIGINT AS bit_depth, 'printing_density' AS transfer, 'rgb' AS descriptor, 'log' AS color_tag FROM im GROUP BY 1")
def dpx_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.operators.lookup import color_tag

    h = media.read_headers(encoded(spark, sf_dir, "dpx", lambda w, h, v: media.dpx_bytes(w, h, v, 10)))
    return h.select(F.regexp_extract("path", r"m(\d+)", 1).cast("int").alias("movie"), "width", "height", "bit_depth", "transfer", "descriptor", color_tag(F.col("format"), F.col("transfer")).alias("color_tag"))


def films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every catalogued film file as a film without frames: its size, and one to four frames a tick of its length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            data = [media.mov_bytes(int(i % 500) + 1, 100, 24, [(int(i % 90) + 30, 1)], sync=list(range(1, int(i % 90) + 31, 12))) for i in x["id"]]
            yield pd.DataFrame({"path": x["id"].astype(str), "filename": x["filename"], "format": "mov", "content": data})

    f = Catalog(spark, sf_dir).files.where("format = 'mov'").select("id", "filename")
    return f.mapInPandas(run, "path string, filename string, format string, content binary")


@query("mov_headers", "SELECT id, (id % 500 + 1) AS width, 'H.264' AS codec, 24.0::DOUBLE AS fps, round((id % 90 + 30) / 24::DOUBLE, 6) AS duration, (id % 90 + 30) AS frame_count FROM files WHERE format = 'mov'")
def mov_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = media.read_headers(films(spark, sf_dir))
    return rounded(h.select(F.col("path").cast("long").alias("id"), "width", "codec", "fps", "duration", "frame_count"))


@query("mov_keyframes", "SELECT id, k AS frame_number, round(k / 24::DOUBLE, 6) AS timestamp_secs FROM files, range(1, 200, 12) t(k) WHERE format = 'mov' AND k <= id % 90 + 30")
def mov_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = media.read_keyframes(films(spark, sf_dir))
    return rounded(k.where("error IS NULL").select(F.col("path").cast("long").alias("id"), "frame_number", "timestamp_secs"))


@query("embedding_blobs", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS embedding FROM embeddings")
def embedding_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings to float32 blobs and back."""
    e = Catalog(spark, sf_dir).table("embeddings").withColumn("blob", media.blob("embedding", "float"))
    return e.select("vec_id", F.transform(media.floats("blob", "float"), lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query("feature_blobs", "SELECT vec_id, list_transform(e, lambda x: round(x, 6)) AS hist_l, list_transform(e, lambda x: round(-x, 6)) AS hist_a, list_transform(e, lambda x: round(2 * x, 6)) AS hist_b, list_transform(e[1:12], lambda x: round(x * x, 6)) AS moments FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def feature_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three different histograms and twelve moments in one blob, taken apart by position."""
    e = Catalog(spark, sf_dir).table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    all_ = F.concat("e", F.transform("e", lambda x: -x), F.transform("e", lambda x: x * 2), F.transform(F.slice("e", 1, 12), lambda x: x * x))
    return rounded(e.select("vec_id", all_.alias("v")).withColumn("blob", media.blob("v")).select("vec_id", *media.combined_features("blob")))


SIDE = 5


def decision(i: int) -> lut_ops.Cdl:
    """A color decision that follows from a number and treats every channel in its own way."""
    return lut_ops.Cdl((1 + i % 7 / 10, 1.0, 1 + i % 3 / 10), (0.0, i % 5 / 50, 0.01), (1.1, 1.2 + i % 2 / 2, 1.3 + i % 3 / 4), 0.5 + i % 4 / 4)


DECIDED = f"""gx AS (SELECT l.id, i % {SIDE} AS ri, i // {SIDE} % {SIDE} AS gi, i // {SIDE * SIDE} AS bi, (i % {SIDE})::DOUBLE / {SIDE - 1} AS r, (i // {SIDE} % {SIDE})::DOUBLE / {SIDE - 1} AS g, (i // {SIDE * SIDE})::DOUBLE / {SIDE - 1} AS b FROM lt l, range({SIDE**3}) t(i) WHERE l.format = '@kind'),
  gd AS (SELECT id, ri, gi, bi, pow(r * (1 + id % 7 / 10::DOUBLE), 1.1::DOUBLE) AS r, pow(g + id % 5 / 50::DOUBLE, 1.2::DOUBLE + id % 2 / 2::DOUBLE) AS g, pow(b * (1 + id % 3 / 10::DOUBLE) + 0.01::DOUBLE, 1.3::DOUBLE + id % 3 / 4::DOUBLE) AS b FROM gx),
  gs AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y, 0.5::DOUBLE + id % 4 / 4::DOUBLE AS s FROM gd)"""


def _text(kind: str, value: str) -> None:
    """Every table of the catalog in one format: written as a file, read again, compared point by point."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            i = np.arange(SIDE**3)
            for x in frames:
                for k in x["id"]:
                    back = lutfiles.parse_bytes(lutfiles.WRITERS[kind](lutfiles.cdl_table(decision(int(k)), SIDE)).encode(), kind)
                    yield pd.DataFrame({"id": k, "ri": i % SIDE, "gi": i // SIDE % SIDE, "bi": i // SIDE**2, "r": back.values[:, 0], "g": back.values[:, 1], "b": back.values[:, 2]})

        ids = Catalog(spark, sf_dir).luts.where(F.col("format") == kind).select("id")
        return rounded(spread(ids).mapInPandas(turn, "id long, ri long, gi long, bi long, r double, g double, b double"))

    run.__name__ = f"lut_text_{kind}"
    shown = ", ".join(f"round({value.format(f'(y + s * ({c} - y))')}, 6) AS {c}" for c in "rgb")
    query(f"lut_text_{kind}", with_(INFO, LUTS, DECIDED.replace('@kind', kind)) + f"SELECT id, ri, gi, bi, {shown} FROM gs")(run)


for _kind in ("cube", "look", "csp"):
    _text(_kind, "{}")
_text("3dl", "floor(least(greatest({}, 0), 1) * 4095 + 0.5) / 4095::DOUBLE")


@query("session_upsert", "SELECT session_id, command, created_at FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ingested_at DESC) AS n FROM analytics_sessions WHERE created_at >= 1515500000) WHERE n = 1 UNION ALL SELECT DISTINCT session_id, command, 0::BIGINT FROM analytics_sessions WHERE session_id NOT IN (SELECT session_id FROM analytics_sessions WHERE created_at >= 1515500000)")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with time 0 takes the newer part of the log."""
    s = Catalog(spark, sf_dir).table("analytics_sessions").select("session_id", "created_at", "ingested_at", "command")
    stored = s.select("session_id", "command").distinct().withColumn("created_at", F.lit(0).cast("long"))
    return importer.upsert(stored, s.where("created_at >= 1515500000").select("command", "session_id", "ingested_at", "created_at"), ["session_id"], ["created_at", "ingested_at"]).select("session_id", "command", "created_at")


@query("resumed_import", "SELECT id, project_id, filename FROM files WHERE format <> 'mov'")
def resumed_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that an import resumed after all films would still add."""
    f = Catalog(spark, sf_dir).files
    return importer.delete(f, f.where("format = 'mov'").select("project_id", "filename")).select("id", "project_id", "filename")


@query("reextract_outcomes", "SELECT CASE WHEN f.format = 'mov' THEN 'skipped' WHEN p.id IS NULL THEN 'error' ELSE 'reextracted' END AS outcome, count(*) AS n FROM files f LEFT JOIN (SELECT min(id) AS id, file_id FROM fingerprints GROUP BY 2) p ON p.file_id = f.id GROUP BY 1")
def reextract_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    new = c.fingerprints.groupBy("file_id").agg(F.min("id").alias("feature")).withColumnRenamed("file_id", "id")
    return importer.reextract(c.files, new, "id")[1]


@query("embed_missing", "SELECT id, CASE WHEN embedding IS NULL THEN list_transform(range(64), lambda i: round((id + i) % 11 / 11::DOUBLE, 6)) WHEN coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true) THEN list_transform(embedding, lambda x: round(x::DOUBLE, 6)) END AS embedding, embedding IS NULL AS filled FROM fingerprints")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing embeddings come from the model's column, the others stay as they are; unsound ones are shown as null."""
    f = Catalog(spark, sf_dir).fingerprints.withColumn("filled", F.col("embedding").isNull())
    new = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (((F.col("id") + i) % 11) / 11).cast("float"))
    # elements that are null don't make a vector unsound
    sound = F.when(F.forall("embedding", lambda x: x.isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))), F.col("embedding"))
    return importer.embed_missing(f, new).select("id", F.transform(sound, lambda x: _sql_round(x.cast("double"))).alias("embedding"), "filled")


def _sql_round(x: Column, places: int = 6) -> Column:
    """round() as DuckDB has it, bit for bit: half away from zero after scaling, and a negative number that becomes zero stays negative zero."""
    scale = 10.0**places
    size = F.abs(x * scale)
    whole = F.floor(size).cast("double")
    size = F.when(size < 2.0**52, whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(size)
    return F.when(size == 0, x * 0.0).when(x < 0, -size / scale).otherwise(size / scale)


@query("segments")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superpixels of every movie's image: label and size. SQL has no segmentation; tests set it against a plain form."""
    from gradeloom.functions.color import with_oklab

    p = with_oklab(strip(spark, sf_dir).select("movie", F.col("frame").alias("x"), F.col("row").alias("y"), "r", "g", "b"))
    return im.segment_images(p, "movie", 16).groupBy("movie", "label").agg(F.count("*").alias("pixels"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, size and features of every movie's superpixels; labelled once, as each histogram reads the labels again."""
    from gradeloom.functions.color import with_oklab

    p = with_oklab(strip(spark, sf_dir).select("movie", F.col("frame").alias("x"), F.col("row").alias("y"), "r", "g", "b"))
    return im.segment_features(materialize(im.segment_images(p, "movie", 16), "segments"), "movie", 16)


@query("superpixel_features")
def superpixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, size and grading features of every superpixel of every movie's image (G41)."""
    return rounded(_segments(spark, sf_dir))


@query("segment_search")
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies by the best tile, anywhere, for each superpixel of movie QUERY_MOVIE (R15)."""
    sums = {f"s_{n}": total(F.col(f"hist_{n}")) for n in "lab"}
    shown = [normalised(F.col(f"hist_{n}"), F.col(f"s_{n}")).alias(f"n_{c}") for n, c in zip("lab", "rgb")]
    asked = _segments(spark, sf_dir).where(F.col("movie") == QUERY_MOVIE).withColumns(sums)
    asked = asked.select(F.col("movie").alias("id"), F.col("label").alias("tile_row"), F.lit(0).alias("tile_col"), *shown)
    tiles = ft.tile_features(image(spark, sf_dir), ["movie"], "w", "h", 4, 16).where(F.col("movie") != QUERY_MOVIE).withColumns(sums)
    tiles = tiles.select(F.col("movie").alias("id"), "tile_row", "tile_col", *shown)
    return tile_search(asked.unionByName(tiles), QUERY_MOVIE, "any").withColumn("score", F.round("score", 6))


@query("strip_pictures", with_(FRAMES, PX, IMAGE) + f"SELECT movie, w AS width, h AS height, x, y, {quantised(255)} FROM im")
def strip_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strip of every movie as a PNG file, read again point by point."""
    p = im.strip_pictures(strip(spark, sf_dir), 64)
    files = p.select(F.concat(F.lit("m"), F.col("movie").cast("string")).alias("path"), F.lit("png").alias("format"), F.col("strip_png").alias("content"))
    return rounded(media.read_pixels(files).select(F.substring("path", 2, 9).cast("int").alias("movie"), "width", "height", "x", "y", "r", "g", "b"))


@query("iris_pictures")
def iris_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polar picture of every movie as a PNG file: its size and mean color. Tests set the picture against a plain form."""
    p = im.strip_pictures(strip(spark, sf_dir), 64)
    files = p.select(F.concat(F.lit("m"), F.col("movie").cast("string")).alias("path"), F.lit("png").alias("format"), F.col("iris_png").alias("content"))
    return rounded(media.read_pixels(files).groupBy(F.substring("path", 2, 9).cast("int").alias("movie")).agg(F.first("width").alias("width"), F.first("height").alias("height"), *[F.avg(c).alias(c) for c in "rgb"]))


@query("poster_layout", with_(FRAMES, PX, IMAGE) + "SELECT movie, p::INT AS position, floor((p + 0.5) * w / least(12, w))::BIGINT AS frame, round(r, 6) AS mean_r FROM (SELECT movie, first(w) AS w, avg(r) AS r FROM im GROUP BY 1), range(12) t(p) WHERE p < w")
def poster_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(im.poster_layout(strip(spark, sf_dir)).select("movie", "position", "frame", "mean_r"))


@query("film_strips", with_(FRAMES, PX) + """SELECT 'm' || movie AS movie, frame - CASE WHEN frame > 5 THEN 1 ELSE 0 END AS frame, "row" // 3 AS row, round(avg(floor(r * 255 + 0.5) / 255), 6) AS r, round(avg(floor(g * 255 + 0.5) / 255), 6) AS g, round(avg(floor(b * 255 + 0.5) / 255), 6) AS b FROM px WHERE frame <> 5 GROUP BY 1, 2, 3""")
def film_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips from the frames of every film as PPM files of three by seven points; frame 5 of each film is broken and left out."""
    return rounded(films_of_frames(spark, sf_dir).strip)


@query("film_thumbnails", with_(FRAMES, PX) + """SELECT 'm' || movie AS movie, frame - CASE WHEN frame > 5 THEN 1 ELSE 0 END AS frame, "row" % 3 // 2 AS x, "row" // 3 // 2 AS y, round(avg(floor(r * 255 + 0.5) / 255), 6) AS r, round(avg(floor(g * 255 + 0.5) / 255), 6) AS g, round(avg(floor(b * 255 + 0.5) / 255), 6) AS b
  FROM px WHERE frame <> 5 AND (frame - CASE WHEN frame > 5 THEN 1 ELSE 0 END) % 10 = 0 GROUP BY 1, 2, 3, 4""")
def film_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth sound frame by half."""
    return rounded(films_of_frames(spark, sf_dir).thumbnails)


def films_of_frames(spark: SparkSession, sf_dir: str) -> Film:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("row")
        data = media.ppm_bytes(3, 7, p[["r", "g", "b"]].to_numpy(float))
        frame = int(p["frame"].iloc[0])
        return pd.DataFrame({"path": [f"/films/m{p['movie'].iloc[0]}/{frame:08d}.ppm"], "format": ["ppm"], "content": [data[:-1] if frame == 5 else data]})

    return film_operators.film_strips(strip(spark, sf_dir).groupBy("movie", "frame").applyInPandas(run, "path string, format string, content binary"), 10)
