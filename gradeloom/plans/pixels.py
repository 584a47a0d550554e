"""Pixel and strip queries G20-G40, F14, W2-W8, X1-X45, over strips made of the embeddings table.

Each embedding is a frame of 21 pixels: its first 63 values in threes, moved from -1..1 to 0..1; a label is a movie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions import color
from gradeloom.operators import features as ft
from gradeloom.operators import strips as st
from gradeloom.plans.registry import query
from gradeloom.plans.sqltext import HISTS, INFO, measured_sql, with_

FRAMES = "fr AS (SELECT label AS movie, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings)"
PX = 'px AS (SELECT movie, frame, i AS "row", (e[3 * i + 1]::DOUBLE + 1) / 2 AS r, (e[3 * i + 2]::DOUBLE + 1) / 2 AS g, (e[3 * i + 3]::DOUBLE + 1) / 2 AS b FROM fr, range(21) t(i))'


def lin_sql(c: str) -> str:
    return f"CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"


def lab_sql(source: str, keys: str, name: str = "lab", decode=lin_sql) -> str:
    """Oklab columns of a source with r, g, b, as two CTEs."""
    d = lambda x: f"{x}::DOUBLE"
    lms = [f"cbrt({d(a)} * lr + {d(b)} * lg + {d(c)} * lb)" for a, b, c in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    lab = [f"{d(a)} * l_ + {d(b)} * m_ + {d(c)} * s_" for a, b, c in ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))]
    return (
        f"{name}_1 AS (SELECT {keys}, r, g, b, {decode('r')} AS lr, {decode('g')} AS lg, {decode('b')} AS lb FROM {source}), "
        f"{name}_2 AS (SELECT {keys}, r, g, b, {lms[0]} AS l_, {lms[1]} AS m_, {lms[2]} AS s_ FROM {name}_1), "
        f"{name} AS (SELECT {keys}, r, g, b, {lab[0]} AS ok_l, {lab[1]} AS ok_a, {lab[2]} AS ok_b FROM {name}_2)"
    )


LAB = lab_sql("px", 'movie, frame, "row"')
HUE = "CASE WHEN atan2(ok_b, ok_a) < 0 THEN atan2(ok_b, ok_a) + 2 * pi() ELSE atan2(ok_b, ok_a) END"
CHROMA = "sqrt(ok_a * ok_a + ok_b * ok_b)"
BASE = (FRAMES, PX, LAB)
BINS = 32


def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Catalog(spark, sf_dir).table("embeddings")
    frame = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    f = e.select(F.col("label").alias("movie"), frame.cast("long").alias("frame"), "embedding")
    v = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(*[((F.get(F.col("embedding"), i * 3 + j).cast("double") + 1) / 2).alias(c) for j, c in enumerate("rgb")]))
    x = f.select("movie", "frame", F.posexplode(v).alias("row", "p"))
    return x.select("movie", "frame", F.col("row").cast("long").alias("row"), "p.r", "p.g", "p.b")


def rounded(df: DataFrame, *but: str, places: int = 6) -> DataFrame:
    """Doubles and arrays of doubles rounded, as sums depend on their order."""
    out = {}
    for name, kind in df.dtypes:
        if name in but:
            continue
        if kind == "double":
            out[name] = F.round(name, places)
        elif kind == "array<double>":
            out[name] = F.transform(name, lambda x: F.round(x, places))
    return df.withColumns(out)


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) AS {name or x}"


def moments_sql(src: str, keys: str, cols: tuple[str, ...] = ("l", "a", "b")) -> str:
    """One row per key with the twelve moments, by central sums around the mean."""
    mean = ", ".join(f"avg(ok_{c}) OVER (PARTITION BY {keys}) AS m_{c}" for c in cols)
    out = []
    for c in cols:
        d = f"(ok_{c} - m_{c})"
        v = f"avg({d} * {d})"
        out.append(f"round(avg(ok_{c}), 6) AS {c}_mean, round(CASE WHEN {v} <= 1e-12 THEN 0 ELSE sqrt({v}) END, 6) AS {c}_std")
        out.append(f"round(CASE WHEN {v} <= 1e-12 THEN 0 ELSE avg({d} * {d} * {d}) / pow({v}, 1.5) END, 6) AS {c}_skew, round(CASE WHEN {v} <= 1e-12 THEN 0 ELSE avg({d} * {d} * {d} * {d}) / ({v} * {v}) - 3 END, 6) AS {c}_kurt")
    return f"SELECT {keys}, {', '.join(out)} FROM (SELECT *, {mean} FROM {src}) GROUP BY {keys}"


@query("pixel_oklab", with_(*BASE) + f"""SELECT movie, frame, "row", {', '.join(r6(c) for c in ('ok_l', 'ok_a', 'ok_b'))} FROM lab""")
def pixel_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(color.with_oklab(strip(spark, sf_dir)).select("movie", "frame", "row", "ok_l", "ok_a", "ok_b"))


@query(
    "luminance_stats",
    with_(FRAMES, PX) + "SELECT movie, frame, round(avg(y), 6) AS luminance_mean, round(stddev_pop(y), 6) AS luminance_stddev, count(*) AS pixels FROM (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM px) GROUP BY 1, 2",
)
def luminance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.fingerprint(strip(spark, sf_dir), ["movie", "frame"], "stats"))


SHARES = "sh AS (SELECT movie, channel, bin, count(*)::DOUBLE / (SELECT count(*) FROM px p WHERE p.movie = x.movie) AS share FROM (" + " UNION ALL ".join(f"SELECT movie, '{c}' AS channel, least(floor(least(greatest({c}, 0), 1) * 64), 63)::INT AS bin FROM px" for c in "rgb") + ") x GROUP BY 1, 2, 3)"


@query("rgb_histogram", with_(FRAMES, PX, SHARES) + "SELECT movie, channel, bin, round(share, 6) AS share FROM sh")
def rgb_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.rgb_histogram(strip(spark, sf_dir), ["movie"]))


@query(
    "fingerprint_compact",
    with_(FRAMES, PX, SHARES, "ce AS (SELECT movie, " + ", ".join(f"sum(share * (bin + 0.5::DOUBLE) / 64) FILTER (channel = '{c}') AS {c}_mean" for c in "rgb") + " FROM sh GROUP BY 1)")
    + "SELECT s.*, round(r_mean, 6) AS r_mean, round(g_mean, 6) AS g_mean, round(b_mean, 6) AS b_mean, round(sqrt((r_mean - g_mean) ** 2 + (g_mean - b_mean) ** 2), 6) AS chroma FROM (SELECT movie, round(avg(y), 6) AS luminance_mean, round(stddev_pop(y), 6) AS luminance_stddev, count(*) AS pixels FROM (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM px) GROUP BY 1) s JOIN ce USING (movie)",
)
def fingerprint_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.fingerprint(strip(spark, sf_dir), ["movie"], "compact"))


@query("fingerprint_full", with_(FRAMES, PX, SHARES) + "SELECT m.movie, list(round(coalesce(share, 0), 6) ORDER BY b) AS hist_g FROM (SELECT DISTINCT movie FROM px) m, range(64) t(b) LEFT JOIN sh ON sh.movie = m.movie AND sh.bin = b AND channel = 'g' GROUP BY 1")
def fingerprint_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.fingerprint(strip(spark, sf_dir), ["movie"]).select("movie", "hist_g"))


@query("color_moments", with_(*BASE) + moments_sql("lab", "movie"))
def color_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.moments(color.with_oklab(strip(spark, sf_dir)), ["movie"]))


def soft_sql(source: str, keys: str, cols: dict[str, tuple[str, float, float]], bins: int = 64) -> str:
    """Soft histograms of several channels as one list column each, in CTEs named so_<channel>."""
    out = []
    for n, (col, lo, hi) in cols.items():
        out.append(f"sv_{n} AS (SELECT {keys}, s, least(greatest(floor(s), 0), {bins - 1})::INT AS i FROM (SELECT {keys}, ({col} - ({lo}::DOUBLE)) / {hi - lo}::DOUBLE * {bins} AS s FROM {source}))")
        out.append(f"sx_{n} AS (SELECT {keys}, i AS bin, CASE WHEN s <= 0 OR i = {bins - 1} THEN 1 ELSE 1 - (s - i) END AS w FROM sv_{n} UNION ALL SELECT {keys}, i + 1, s - i FROM sv_{n} WHERE s > 0 AND i < {bins - 1})")
        out.append(f"so_{n} AS (SELECT {keys}, list(round(coalesce(w, 0), 6) ORDER BY bin) AS hist_{n} FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM {source}) m, (SELECT range AS bin FROM range({bins}))) m LEFT JOIN (SELECT {keys}, bin, sum(w) AS w FROM sx_{n} GROUP BY ALL) x USING ({keys}, bin) GROUP BY {keys})")
    return ", ".join(out)


OK_CHANNELS = {"l": ("ok_l", 0.0, 1.0), "a": ("ok_a", -0.5, 0.5), "b": ("ok_b", -0.5, 0.5)}
SOFT = """sb AS (SELECT movie, s, least(greatest(floor(s), 0), 63)::INT AS i FROM (SELECT movie, ok_l * 64 AS s FROM lab)),
  sw AS (SELECT movie, i AS bin, CASE WHEN s <= 0 OR i = 63 THEN 1 ELSE 1 - (s - i) END AS w FROM sb UNION ALL SELECT movie, i + 1, s - i FROM sb WHERE s > 0 AND i < 63)"""


@query("soft_histogram", with_(*BASE, SOFT) + "SELECT movie, bin, round(sum(w), 6) AS weight FROM sw WHERE w > 0 GROUP BY 1, 2")
def soft_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.soft_histogram(color.with_oklab(strip(spark, sf_dir)), ["movie"], "ok_l", 0.0, 1.0))


@query("grading_features", with_(*BASE, f"mo AS ({moments_sql('lab', 'movie')})", soft_sql("lab", "movie", OK_CHANNELS)) + "SELECT mo.*, so_l.hist_l, so_a.hist_a, so_b.hist_b FROM mo JOIN so_l USING (movie) JOIN so_a USING (movie) JOIN so_b USING (movie)")
def grading_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.grading_features(strip(spark, sf_dir), ["movie"]))


@query(
    "style_descriptions",
    with_(*BASE, "mm AS (SELECT movie, frame, CASE WHEN var_pop(ok_l) <= 1e-12 THEN 0 ELSE stddev_pop(ok_l) END AS l_std, avg(ok_a) AS a_mean, avg(ok_b) AS b_mean FROM lab GROUP BY 1, 2)", soft_sql("lab", "movie, frame", {"l": OK_CHANNELS["l"]}),
          "pc AS (SELECT *, list_position(list_transform(range(1, 65), lambda i: c[i] >= 0.95::DOUBLE * t AND h[i] > 0), true) AS k FROM (SELECT movie, frame, hist_l AS h, list_sum(hist_l) AS t, list_transform(range(1, 65), lambda i: list_sum(hist_l[1:i])) AS c FROM so_l))",
          "st AS (SELECT mm.*, a_mean * a_mean + b_mean * b_mean AS c2, CASE WHEN t <= 0 THEN 0 ELSE (k - 1 + (0.95::DOUBLE * t - coalesce(c[k - 1], 0)) / h[k]) / 64 END AS p95 FROM mm JOIN pc USING (movie, frame))",
          """sw AS (SELECT *, concat_ws(' · ', CASE WHEN l_std > 0.35 THEN '高对比度' WHEN l_std < 0.15 THEN '低对比度' END, CASE WHEN a_mean < -0.03 THEN '暗部偏冷' WHEN a_mean > 0.03 THEN '暗部偏暖' END,
            CASE WHEN p95 > 0.85 THEN '高光柔和延展' END, CASE WHEN c2 > 0.02 THEN '饱和度偏高' WHEN c2 < 0.005 THEN '饱和度低' END) AS words,
            list_sort([{'d': least(abs(l_std - 0.25) / 0.1, 1.0::DOUBLE), 'p': 0, 't': CASE WHEN l_std >= 0.25 THEN '高对比度' ELSE '低对比度' END}, {'d': least(abs(a_mean) / 0.03, 1.0::DOUBLE), 'p': 1, 't': CASE WHEN a_mean >= 0 THEN '暗部偏暖' ELSE '暗部偏冷' END},
            {'d': least((0.85 - p95) / 0.85, 1.0::DOUBLE), 'p': 2, 't': '高光柔和延展'}, {'d': least(abs(c2 - 0.0125) / 0.0075, 1.0::DOUBLE), 'p': 3, 't': CASE WHEN c2 >= 0.0125 THEN '饱和度偏高' ELSE '饱和度低' END}])[1].t AS near FROM st)""")
    + "SELECT movie, frame, CASE WHEN words = '' THEN near ELSE words END AS style FROM sw",
)
def style_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's style in words."""
    from gradeloom.operators.search import style_description

    g = ft.grading_features(strip(spark, sf_dir), ["movie", "frame"])
    return g.select("movie", "frame", style_description(F.col("hist_l"), F.col("l_std"), F.col("a_mean"), F.col("b_mean")).alias("style"))


@query(
    "split_tones",
    with_(HISTS) + """SELECT id, round(list_sum(hist_r[1:16]), 6) AS shadows, round(list_sum(hist_r[17:48]), 6) AS midtones, round(list_sum(hist_r[49:64]), 6) AS highlights FROM hi""",
)
def split_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.functions.vector import total

    x = Catalog(spark, sf_dir).histograms.select("id", *ft.split_tones(F.col("hist_r")))
    return rounded(x.select("id", *[total(F.col(c)).alias(c) for c in ("shadows", "midtones", "highlights")]))


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each movie as an image: x is the frame, y the row."""
    s = strip(spark, sf_dir)
    size = s.groupBy("movie").agg((F.max("frame") + 1).alias("w"), (F.max("row") + 1).alias("h"))
    return s.select("movie", F.col("frame").alias("x"), F.col("row").alias("y"), "r", "g", "b").join(size, "movie")


IMAGE = 'im AS (SELECT movie, frame AS x, "row" AS y, r, g, b, max(frame) OVER (PARTITION BY movie) + 1 AS w, max("row") OVER (PARTITION BY movie) + 1 AS h FROM px)'


@query("tile_features", with_(FRAMES, PX, IMAGE, "tp AS (SELECT movie, floor(y / ceil(h / 4))::INT AS tile_row, floor(x / ceil(w / 4))::INT AS tile_col, r, g, b FROM im)", lab_sql("tp", "movie, tile_row, tile_col")) + moments_sql("lab", "movie, tile_row, tile_col"))
def tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ft.tile_features(image(spark, sf_dir), ["movie"], "w", "h", 4, 16)
    return rounded(t.drop("hist_l", "hist_a", "hist_b"))


@query(
    "downsample",
    with_(FRAMES, PX, IMAGE, "sz AS (SELECT *, CASE WHEN greatest(w, h) <= 16 THEN w ELSE greatest(round(w * (16::DOUBLE / greatest(w, h))), 1) END::BIGINT AS nw, CASE WHEN greatest(w, h) <= 16 THEN h ELSE greatest(round(h * (16::DOUBLE / greatest(w, h))), 1) END::BIGINT AS nh FROM im)")
    + "SELECT movie, tx AS x, ty AS y, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b, first(nw) AS width, first(nh) AS height FROM sz, range(16) a(tx), range(16) c(ty) WHERE tx < nw AND ty < nh AND x >= tx * w // nw AND x < ((tx + 1) * w + nw - 1) // nw AND y >= ty * h // nh AND y < ((ty + 1) * h + nh - 1) // nh GROUP BY 1, 2, 3",
)
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.downsample(image(spark, sf_dir), ["movie"], "w", "h", 16))


# Projects.

NAMES = ["hist_r", "hist_g", "hist_b"]
PROJECT_HISTS = "ph AS (SELECT h.id, i.project_name, hist_r, hist_g, hist_b FROM hi h JOIN inf i ON i.id = h.id)"
CENTRES = "cc AS (SELECT project_name, bin, avg(hist_r[bin]) AS r, avg(hist_g[bin]) AS g, avg(hist_b[bin]) AS b FROM ph, range(1, 65) t(bin) GROUP BY 1, 2)"


def project_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return c.histograms.join(c.info.select("id", "project_name"), "id").select("id", "project_name", *NAMES)


@query("project_summaries", with_(INFO, HISTS, PROJECT_HISTS, CENTRES) + "SELECT project_name, round(avg(r), 12) AS hist_r_centroid, round(avg(g), 12) AS hist_g_centroid, round(avg(b), 12) AS hist_b_centroid, (SELECT count(*) FROM ph p WHERE p.project_name = cc.project_name) AS fingerprints FROM cc GROUP BY 1")
def project_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.project_summaries(project_histograms(spark, sf_dir), "project_name", NAMES), places=12)


@query("project_distances", with_(INFO, HISTS, PROJECT_HISTS, CENTRES) + "SELECT x.project_name AS a, y.project_name AS b, round(sum(abs(x.r - y.r) + abs(x.g - y.g) + abs(x.b - y.b)) / 3, 12) AS distance FROM cc x JOIN cc y ON x.bin = y.bin AND x.project_name < y.project_name GROUP BY 1, 2")
def project_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.project_distances(project_histograms(spark, sf_dir), "project_name", NAMES), places=12)


DIST = "dd AS (SELECT p.id, p.project_name, sum(abs(hist_r[bin] - r) + abs(hist_g[bin] - g) + abs(hist_b[bin] - b)) / 3 AS distance FROM ph p JOIN cc USING (project_name) GROUP BY 1, 2)"


@query("project_outliers", with_(INFO, HISTS, PROJECT_HISTS, CENTRES, DIST) + "SELECT id, project_name, round(distance, 12) AS distance FROM (SELECT *, avg(distance) OVER (PARTITION BY project_name) AS m, count(*) OVER (PARTITION BY project_name) AS n FROM dd) WHERE n > 1 AND distance > 1.2::DOUBLE * m")
def project_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lower factor than the default, so that these data have outliers."""
    return rounded(ft.outliers(project_histograms(spark, sf_dir), "project_name", NAMES, 1.2), places=12)


@query("overall_consistency", with_(INFO, HISTS, PROJECT_HISTS, CENTRES) + "SELECT round(coalesce(avg(d), 0), 12) AS overall FROM (SELECT sum(abs(x.r - y.r) + abs(x.g - y.g) + abs(x.b - y.b)) / 3 AS d FROM cc x JOIN cc y ON x.bin = y.bin AND x.project_name < y.project_name GROUP BY x.project_name, y.project_name)")
def overall_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.mean_distance(project_histograms(spark, sf_dir), "project_name", NAMES), places=12)


@query("average_features", with_(INFO, HISTS, PROJECT_HISTS, CENTRES) + "SELECT project_name, list(round(r, 12) ORDER BY bin) AS hist_r FROM cc GROUP BY 1")
def average_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ft.average_features(project_histograms(spark, sf_dir), "project_name", NAMES).select("project_name", "hist_r"), places=12)


DELTA = "list_transform(list_zip(x.{0}, y.{0}), lambda z: abs(z[1] - z[2]))"


@query(
    "compare_fingerprints",
    with_(HISTS, "hp AS (SELECT hi.*, " + measured_sql("f.luminance_mean") + " AS luminance_mean FROM hi JOIN fingerprints f ON f.id = hi.id)", "dl AS (SELECT x.id AS pair, abs(x.luminance_mean - y.luminance_mean) AS lm, " + ", ".join(f"{DELTA.format(n)} AS {n}" for n in NAMES) + " FROM hp x JOIN hp y ON y.id = x.id + 1)")
    + "SELECT pair, round(lm, 9) AS luminance_mean_delta, " + ", ".join(f"round(list_sum({n}) / 64, 9) AS {n}_mean, round(list_max({n}), 9) AS {n}_max, round(list_sum({n}), 9) AS {n}_l1, (list_position({n}, list_max({n})) - 1)::BIGINT AS {n}_bin" for n in NAMES) + ", round((list_sum(hist_r) + list_sum(hist_g) + list_sum(hist_b)) / 64 / 3, 9) AS overall FROM dl",
)
def compare_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fingerprint against the one with the next id."""
    c = Catalog(spark, sf_dir)
    h = c.histograms.join(c.fingerprints.select("id", "luminance_mean"), "id")
    return rounded(ft.compare(h.withColumn("pair", F.col("id")), h.withColumn("pair", F.col("id") - 1), NAMES, ["luminance_mean"]), places=9)


@query("histogram_cdf", with_(HISTS) + "SELECT id, bin, round(CASE WHEN list_sum(hist_g) = 0 THEN NULL ELSE list_sum(hist_g[1:bin + 1]) / list_sum(hist_g) END, 6) AS cdf FROM hi, range(64) t(bin)")
def histogram_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = Catalog(spark, sf_dir).histograms.select("id", F.posexplode("hist_g").alias("bin", "n"))
    x = ft.cdf(h.withColumn("n", F.col("n")), ["id"])
    return rounded(x.select("id", F.col("bin").cast("long").alias("bin"), "cdf"))


# Strips.

DISTANCES = """ds AS (SELECT movie, frame, avg(gap) AS distance FROM (SELECT movie, frame, (abs(lead(ok_l) OVER w - ok_l) + abs(lead(ok_a) OVER w - ok_a) + abs(lead(ok_b) OVER w - ok_b)) / 3 AS gap
  FROM lab WINDOW w AS (PARTITION BY movie, "row" ORDER BY frame)) WHERE gap IS NOT NULL GROUP BY 1, 2)"""
MEANS = "fm AS (SELECT movie, frame, avg(ok_l) AS ok_l, avg(ok_a) AS ok_a, avg(ok_b) AS ok_b FROM lab GROUP BY 1, 2)"
#: The threshold and gap of these strips, whose frames all differ alike: about a third of them are candidates.
THRESHOLD, GAP = 0.038, 3


@query("frame_distances", with_(*BASE, DISTANCES) + "SELECT movie, frame, round(distance, 6) AS distance FROM ds")
def frame_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.frame_distances(strip(spark, sf_dir)))


# the fold of candidates as a recursive query: each candidate follows the one before it and carries group and anchor
FOLD = f"""cd AS (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY frame) AS k FROM ds WHERE distance > {THRESHOLD}::DOUBLE),
  fo AS (SELECT movie, k, frame AS anchor, distance AS best, 0 AS grp FROM cd WHERE k = 1 UNION ALL
    SELECT c.movie, c.k, CASE WHEN c.frame - f.anchor > {GAP} OR c.distance > f.best THEN c.frame ELSE f.anchor END, CASE WHEN c.frame - f.anchor > {GAP} OR c.distance > f.best THEN c.distance ELSE f.best END,
    CASE WHEN c.frame - f.anchor > {GAP} THEN f.grp + 1 ELSE f.grp END FROM fo f JOIN cd c ON c.movie = f.movie AND c.k = f.k + 1),
  bo AS (SELECT movie, grp AS ordinal, arg_max(anchor, k) AS frame, arg_max(best, k) AS distance FROM fo GROUP BY 1, 2)"""
RECURSIVE = with_(*BASE, DISTANCES, FOLD).replace("WITH ", "WITH RECURSIVE ", 1)


@query("scene_cuts", RECURSIVE + f"SELECT movie, ordinal::INT AS ordinal, frame, round(distance, 6) AS distance, round(least(greatest((distance - {THRESHOLD}::DOUBLE) / {THRESHOLD}::DOUBLE, 0), 1), 6) AS confidence FROM bo")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.boundary_frames(st.frame_distances(strip(spark, sf_dir)), THRESHOLD, GAP, 1 << 30))


@query(
    "scene_boundaries",
    RECURSIVE.rstrip() + ",\n" + MEANS + """, bn AS (SELECT *, coalesce(lag(frame) OVER w + 1, 0) AS p0, coalesce(lead(frame) OVER w - 1, (SELECT max(frame) FROM fm WHERE fm.movie = bo.movie)) AS n1 FROM bo WINDOW w AS (PARTITION BY movie ORDER BY frame))
  SELECT movie, ordinal::INT AS ordinal, frame, """
    + ", ".join(f"round((SELECT avg(ok_{c}) FROM fm WHERE fm.movie = bn.movie AND fm.frame BETWEEN p0 AND bn.frame), 6) AS before_{c}, round((SELECT avg(ok_{c}) FROM fm WHERE fm.movie = bn.movie AND fm.frame BETWEEN bn.frame + 1 AND greatest(n1, bn.frame + 1)), 6) AS after_{c}" for c in "lab")
    + " FROM bn",
)
def scene_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = st.scene_boundaries(strip(spark, sf_dir), THRESHOLD, GAP, 1 << 30)
    return rounded(b.drop("distance", "confidence"))


MOOD = "CASE WHEN ok_l < 0.3 AND sqrt(ok_a * ok_a + ok_b * ok_b) < 0.05 THEN 'dark' WHEN ok_a > 0.05 THEN 'warm' WHEN ok_l > 0.6 AND sqrt(ok_a * ok_a + ok_b * ok_b) > 0.15 THEN 'vivid' WHEN ok_a < -0.05 OR ok_b > 0.1 THEN 'cool' ELSE 'neutral' END"


@query(
    "mood_timeline",
    with_(*BASE, MEANS) + f"""SELECT movie, segment, min(frame) AS first_frame, max(frame) AS last_frame, round(avg(ok_l), 6) AS ok_l, round(avg(ok_a), 6) AS ok_a, round(avg(ok_b), 6) AS ok_b, {MOOD.replace('ok_l', 'avg(ok_l)').replace('ok_a', 'avg(ok_a)').replace('ok_b', 'avg(ok_b)')} AS mood
  FROM (SELECT *, frame // 10 AS segment FROM fm) GROUP BY 1, 2""",
)
def mood_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a boundary at every tenth frame."""
    s = strip(spark, sf_dir)
    cuts = s.select("movie", "frame").distinct().where("frame % 10 = 0 AND frame > 0")
    return rounded(st.mood_timeline(s, cuts))


DNA = f"""hb AS (SELECT *, {CHROMA} AS c, CASE WHEN {CHROMA} > 0.001 THEN least(floor(({HUE}) / (2 * pi()) * 12), 11) END AS h FROM lab),
  dna AS (SELECT movie, avg(ok_l) AS ok_l, avg(ok_a) AS ok_a, avg(ok_b) AS ok_b, stddev_pop(ok_l) AS contrast, avg(ok_a) AS warmth, avg(c) AS saturation,
    [{', '.join(f'CASE WHEN count(h) > 0 THEN count(*) FILTER (h = {i})::DOUBLE / count(h) ELSE 1.0::DOUBLE / 12 END' for i in range(12))}] AS hues FROM hb GROUP BY 1)"""


@query(
    "pixel_pyramid",
    with_(FRAMES, PX, IMAGE, "tp AS (SELECT movie, level, floor(y / ceil(h / side))::INT AS tile_row, floor(x / ceil(w / side))::INT AS tile_col, r, g, b FROM im, (VALUES (0, 1::DOUBLE), (1, 2::DOUBLE), (2, 4::DOUBLE)) v(level, side))",
          lab_sql("tp", "movie, level, tile_row, tile_col"), f"mo AS ({moments_sql('lab', 'movie, level, tile_row, tile_col')})", soft_sql("lab", "movie, level, tile_row, tile_col", {"l": OK_CHANNELS["l"]}, 16))
    + "SELECT mo.*, so_l.hist_l FROM mo JOIN so_l USING (movie, level, tile_row, tile_col)",
)
def pixel_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the whole image, its quarters and its sixteenths, from the pixels."""
    from gradeloom.operators.search import pyramid_of_pixels

    return rounded(pyramid_of_pixels(image(spark, sf_dir), ["movie"], "w", "h", bins=16).drop("hist_a", "hist_b"))


@query("color_dna", with_(*BASE, DNA) + "SELECT movie, round(ok_l, 6) AS ok_l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b, round(contrast, 6) AS contrast, round(warmth, 6) AS warmth, round(saturation, 6) AS saturation, list_transform(hues, lambda x: round(x, 6)) AS hues FROM dna")
def color_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.color_dna(strip(spark, sf_dir)))


@query(
    "movie_search",
    with_(*BASE, DNA) + """SELECT movie, round(s, 6) AS similarity, round(h, 6) AS hue_similarity, round(cg, 6) AS contrast_gap, round(wg, 6) AS warmth_gap, row_number() OVER (ORDER BY s DESC, movie) AS rank FROM
  (SELECT c.movie, 1 - least(greatest(sqrt((q.ok_l - c.ok_l) ** 2 + (q.ok_a - c.ok_a) ** 2 + (q.ok_b - c.ok_b) ** 2), 0), 1) AS s, least(list_sum(list_transform(list_zip(q.hues, c.hues), lambda z: sqrt(greatest(z[1], 1e-10::DOUBLE) * greatest(z[2], 1e-10::DOUBLE)))), 1) AS h,
  least(abs(q.contrast - c.contrast), 1) AS cg, least(abs(q.warmth - c.warmth), 1) AS wg FROM dna c, dna q WHERE q.movie = 0 AND c.movie <> 0) QUALIFY rank <= 10""",
)
def movie_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.movie_search(st.color_dna(strip(spark, sf_dir)), 0, 10))


@query(
    "movie_search_listed",
    with_(*BASE, DNA) + """SELECT movie, round(s, 6) AS similarity, round(h, 6) AS hue_similarity, round(cg, 6) AS contrast_gap, round(wg, 6) AS warmth_gap, row_number() OVER (ORDER BY s DESC, movie) AS rank FROM
  (SELECT c.movie, 1 - least(greatest(sqrt((q.ok_l - c.ok_l) ** 2 + (q.ok_a - c.ok_a) ** 2 + (q.ok_b - c.ok_b) ** 2), 0), 1) AS s, least(list_sum(list_transform(list_zip(q.hues, c.hues), lambda z: sqrt(greatest(z[1], 1e-10::DOUBLE) * greatest(z[2], 1e-10::DOUBLE)))), 1) AS h,
  least(abs(q.contrast - c.contrast), 1) AS cg, least(abs(q.warmth - c.warmth), 1) AS wg FROM dna c, dna q WHERE q.movie = 0 AND c.movie <> 0 AND c.movie IN (0, 2, 3, 77)) QUALIFY rank <= 10""",
)
def movie_search_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.movie_search(st.color_dna(strip(spark, sf_dir)), 0, 10, [0, 2, 3, 77]))


def kind_sql(a: str, b: str) -> str:
    def both(lo1, hi1, lo2, hi2):
        inside = lambda x, lo, hi: f"({x} >= {lo} {'AND' if lo <= hi else 'OR'} {x} <= {hi})"
        return f"({inside(a, lo1, hi1)} AND {inside(b, lo2, hi2)} OR {inside(b, lo1, hi1)} AND {inside(a, lo2, hi2)})"

    return f"CASE WHEN {both(15, 50, 160, 200)} THEN 'teal-orange' WHEN {both(200, 260, 50, 70)} THEN 'blue-yellow' WHEN {both(340, 20, 160, 200)} THEN 'red-cyan' WHEN {both(280, 340, 80, 160)} THEN 'magenta-green' ELSE 'other' END"


@query(
    "dominant_pairs",
    with_(*BASE, f"hh AS (SELECT movie, bin, n::DOUBLE / sum(n) OVER (PARTITION BY movie) AS p FROM (SELECT movie, least(floor(({HUE}) / (2 * pi()) * 24), 23)::INT AS bin, count(*) AS n FROM lab WHERE {CHROMA} >= 0.03 GROUP BY 1, 2))")
    + f"""SELECT movie, position::INT AS position, round(bin / 24 * 2 * pi(), 6) AS hue_a, round((bin + 12) / 24 * 2 * pi(), 6) AS hue_b, round(score / max(score) OVER (PARTITION BY movie), 6) AS strength, {kind_sql('(bin * 15)', '((bin + 12) * 15)')} AS kind FROM
  (SELECT a.movie, a.bin, a.p * b.p AS score, row_number() OVER (PARTITION BY a.movie ORDER BY a.p * b.p DESC, a.bin) AS position FROM hh a JOIN hh b ON b.movie = a.movie AND b.bin = a.bin + 12 WHERE a.bin < 12 AND a.p * b.p > 0.0001 AND a.p > 0.01 AND b.p > 0.01) WHERE position <= 6""",
)
def dominant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.dominant_pairs(strip(spark, sf_dir)))


@query(
    "color_distribution",
    with_(*BASE) + f"""SELECT movie, color, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY movie), 6) AS share, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM
  (SELECT *, CASE WHEN c < 0.03 THEN 'neutral' WHEN d >= 15 AND d < 45 AND c < 0.15 AND ok_l > 0.3 THEN 'skin' WHEN d >= 345 OR d < 45 THEN 'red' WHEN d < 70 THEN 'yellow' WHEN d < 165 THEN 'green' WHEN d < 200 THEN 'cyan' WHEN d < 270 THEN 'blue' ELSE 'magenta' END AS color FROM
  (SELECT *, {CHROMA} AS c, ({HUE}) * 180 / pi() AS d FROM lab)) GROUP BY 1, 2""",
)
def color_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.color_distribution(strip(spark, sf_dir)))


@query("scatter", with_(*BASE) + """SELECT movie, frame, round(ok_l, 6) AS ok_l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b FROM lab WHERE "row" = 10""")
def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.scatter(strip(spark, sf_dir)))


@query(
    "scatter_density",
    with_(*BASE) + """SELECT movie, ga, gb, round(n::DOUBLE / max(n) OVER (PARTITION BY movie), 6) AS density FROM (SELECT movie, least(greatest(trunc((ok_a + 0.5::DOUBLE) / 0.03125::DOUBLE), 0), 31)::INT AS ga,
  least(greatest(trunc((ok_b + 0.5::DOUBLE) / 0.03125::DOUBLE), 0), 31)::INT AS gb, count(*) AS n FROM lab WHERE "row" = 10 GROUP BY 1, 2, 3)""",
)
def scatter_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.scatter_density(strip(spark, sf_dir)))


@query(
    "vectorscope",
    with_(*BASE) + f"""SELECT movie, angle, radius, round(n::DOUBLE / max(n) OVER (PARTITION BY movie), 6) AS density FROM (SELECT movie, least(floor(({HUE}) * 180 / pi() / 360 * 36), 35)::INT AS angle,
  least(floor({CHROMA} / (0.4::DOUBLE / 16)), 15)::INT AS radius, count(*) AS n FROM lab WHERE {CHROMA} >= 0.001 GROUP BY 1, 2, 3)""",
)
def vectorscope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.vectorscope(strip(spark, sf_dir)))


def hard_sql(n: str, col: str, lo: str) -> str:
    """The hard histogram of one channel over movie and segment, as a list column in the CTE sh_<channel>."""
    bins = f"SELECT movie, segment, floor(least(greatest({col} - ({lo}::DOUBLE), 0), 1) * {BINS - 1})::INT AS bin, count(*) AS n FROM sg GROUP BY 1, 2, 3"
    return (
        f"sl_{n} AS (SELECT movie, segment, bin, n::DOUBLE / sum(n) OVER (PARTITION BY movie, segment) AS share FROM ({bins})), "
        f"sh_{n} AS (SELECT m.movie, m.segment, list(round(coalesce(share, 0), 6) ORDER BY b) AS hist_{n} FROM (SELECT DISTINCT movie, segment FROM sg) m, range({BINS}) t(b) LEFT JOIN sl_{n} s ON s.movie = m.movie AND s.segment = m.segment AND s.bin = b GROUP BY 1, 2)"
    )


@query(
    "segment_features",
    with_(*BASE, "sg AS (SELECT *, least(frame // (fs // 4), 3)::INT AS segment FROM (SELECT *, max(frame) OVER (PARTITION BY movie) + 1 AS fs FROM lab))", f"mo AS ({moments_sql('sg', 'movie, segment')})",
          hard_sql("l", "ok_l", "0.0"), hard_sql("a", "ok_a", "-0.5"), hard_sql("b", "ok_b", "-0.5"))
    + "SELECT mo.*, sh_l.hist_l, sh_a.hist_a, sh_b.hist_b FROM mo JOIN sh_l USING (movie, segment) JOIN sh_a USING (movie, segment) JOIN sh_b USING (movie, segment)",
)
def segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(st.segment_features(strip(spark, sf_dir), 4, BINS))


@query("frame_columns", with_(FRAMES, PX) + 'SELECT movie, "row", round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM px GROUP BY 1, 2')
def frame_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each movie as one image column: row means."""
    x = strip(spark, sf_dir).withColumnRenamed("row", "y")
    return rounded(st.frame_columns(x, ["movie"]))


@query(
    "waveform",
    """SELECT track, bin, round(max(abs(sample) / 32767.0::DOUBLE), 6) AS peak FROM (SELECT user_id AS track, least(floor((pos * 8 + 7) / n)::INT, 7) AS bin, sample FROM
  (SELECT user_id, round(value * 100)::INT % 32768 AS sample, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY 1, 2""",
)
def waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of every user's events as samples of a track."""
    e = Catalog(spark, sf_dir).table("events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    s = e.select(F.col("user_id").alias("track"), pos.alias("pos"), (F.round(F.col("value") * 100).cast("int") % 32768).alias("sample"))
    return rounded(st.waveform(s, 8))
