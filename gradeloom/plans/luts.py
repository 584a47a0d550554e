"""Color space and LUT queries X1-X55, T1-T19, G42, G45, G46, G49."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions import color as co
from gradeloom.operators import lut as ops
from gradeloom.plans.pixels import FRAMES, PX, lab_sql, lin_sql, rounded, strip
from gradeloom.plans.registry import query
from gradeloom.plans.sqltext import with_

N = 17


def grid_sql(n: int = N) -> str:
    return f"gr AS (SELECT (i % {n})::INT AS ri, (i // {n} % {n})::INT AS gi, (i // {n * n})::INT AS bi, (i % {n})::DOUBLE / {n - 1} AS r, (i // {n} % {n})::DOUBLE / {n - 1} AS g, (i // {n * n})::DOUBLE / {n - 1} AS b FROM range({n**3}) t(i))"


def mat_sql(m: co.Matrix, x: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple("(" + " + ".join(f"({k})::DOUBLE * ({c})" for k, c in zip(row, x)) + ")" for row in m)


def cols_sql(x: tuple[str, str, str], names: tuple[str, str, str] = ("r", "g", "b")) -> str:
    return ", ".join(f"round({c}, 6) AS {n}" for c, n in zip(x, names))


RGB = ("r", "g", "b")
TONE = "({0} * (2.51::DOUBLE * {0} + 0.03::DOUBLE) / ({0} * (2.43::DOUBLE * {0} + 0.59::DOUBLE) + 0.14::DOUBLE))"


def _lut(name: str, sql: str, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(f(spark, sf_dir))

    run.__name__ = name
    query(name, sql)(run)


def gamma_sql(x: str) -> str:
    return f"pow(least(greatest({x}, 0), 1), 1 / 2.2::DOUBLE)"


_lut("lut_identity", with_(grid_sql()) + "SELECT ri, gi, bi, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM gr", lambda s, d: ops.identity(s, N))
_lut(
    "lut_acescg_rec709",
    with_(grid_sql()) + f"SELECT ri, gi, bi, {cols_sql(tuple(gamma_sql(x) for x in mat_sql(co.AP1_TO_AP0, tuple(TONE.format(c) for c in RGB))))} FROM gr",
    lambda s, d: ops.generate(s, N, "acescg", "rec709"),
)
_lut("lut_aces2065_acescg", with_(grid_sql()) + f"SELECT ri, gi, bi, {cols_sql(mat_sql(co.AP0_TO_AP1, RGB))} FROM gr", lambda s, d: ops.generate(s, N, "aces2065-1", "acescg"))
_lut("lut_acescg_aces2065", with_(grid_sql()) + f"SELECT ri, gi, bi, {cols_sql(mat_sql(co.AP1_TO_AP0, RGB))} FROM gr", lambda s, d: ops.generate(s, N, "acescg", "aces2065-1"))
WHITE = "(2.54::DOUBLE / 3.16::DOUBLE)"


def inverse_sql(y: str) -> str:
    p, q, r = f"(2.51::DOUBLE - 2.43::DOUBLE * {y})", f"(0.03::DOUBLE - 0.59::DOUBLE * {y})", f"(-0.14::DOUBLE * {y})"
    return f"CASE WHEN {y} >= {WHITE} THEN 1 WHEN {y} <= 0 THEN 0 ELSE (-{q} + sqrt({q} * {q} - 4 * {p} * {r})) / (2 * {p}) END"


_lut(
    "lut_rec709_acescg",
    with_(grid_sql(), "li AS (SELECT ri, gi, bi, " + ", ".join(f"{m} AS {c}" for m, c in zip(mat_sql(co.AP0_TO_AP1, tuple(f"CASE WHEN {c} <= 0 THEN 0 ELSE pow({c}, 2.2::DOUBLE) END" for c in RGB)), RGB)) + " FROM gr)")
    + f"SELECT ri, gi, bi, {cols_sql(tuple(inverse_sql(c) for c in RGB))} FROM li",
    lambda s, d: ops.generate(s, N, "rec709", "acescg"),
)
CDL = ops.Cdl((1.1, 0.95, 1.02), (0.01, -0.02, 0.03), (0.9, 1.1, 1.0), 1.2)


def sat_sql(x: tuple[str, str, str], k: float) -> tuple[str, str, str]:
    y = f"(0.2126::DOUBLE * {x[0]} + 0.7152::DOUBLE * {x[1]} + 0.0722::DOUBLE * {x[2]})"
    return tuple(f"({y} + {k}::DOUBLE * ({c} - {y}))" for c in x)


CDL_STEP = tuple(f"pow(greatest({c} * {s}::DOUBLE + ({o})::DOUBLE, 0), {p}::DOUBLE)" for c, s, o, p in zip(RGB, CDL.slope, CDL.offset, CDL.power))
CDL_CTE = "cd AS (SELECT ri, gi, bi, " + ", ".join(f"{x} AS {c}" for x, c in zip(CDL_STEP, RGB)) + " FROM gr)"
_lut("lut_cdl", with_(grid_sql(), CDL_CTE) + f"SELECT ri, gi, bi, {cols_sql(sat_sql(RGB, CDL.saturation))} FROM cd", lambda s, d: ops.sampled(s, N, CDL))
GRADE = ops.PowerGrade(3, 1.0, (1.2, 0.9, 1.1), (0.02, 0.0, -0.03), (0.9, 1.0, 1.2), (0.0, 0.0, 0.0), 0.8)
GRADE_STEP = tuple(f"pow(greatest(CASE WHEN {c} + ({li})::DOUBLE > 0.5 THEN ({c} + ({li})::DOUBLE - 0.5::DOUBLE) * {ga}::DOUBLE + 0.5::DOUBLE ELSE {c} + ({li})::DOUBLE END, 0), {p}::DOUBLE)" for c, li, ga, p in zip(RGB, GRADE.lift, GRADE.gain, GRADE.power))
_lut(
    "lut_powergrade",
    with_(grid_sql(), "pg AS (SELECT ri, gi, bi, " + ", ".join(f"{x} AS {c}" for x, c in zip(GRADE_STEP, RGB)) + " FROM gr)") + f"SELECT ri, gi, bi, {cols_sql(sat_sql(RGB, GRADE.saturation))} FROM pg",
    lambda s, d: ops.sampled(s, N, GRADE),
)
DIFF = "SELECT channel, round(avg(d), 6) AS mean, round(max(d), 6) AS max, count(*) FILTER (d > 1e-6) AS changed FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, abs(x.{c} - y.{c}) AS d FROM gr x JOIN od y USING (ri, gi, bi)" for c in RGB) + ") GROUP BY 1"
_lut(
    "lut_diff",
    with_(grid_sql(), CDL_CTE, "od AS (SELECT ri, gi, bi, " + ", ".join(f"{x} AS {c}" for x, c in zip(sat_sql(RGB, CDL.saturation), RGB)) + " FROM cd)") + DIFF,
    lambda s, d: ops.diff(ops.identity(s, N), ops.sampled(s, N, CDL)),
)
REGION = "CASE WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b <= 0.25 THEN 'shadows' WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b <= 0.75 THEN 'midtones' ELSE 'highlights' END"


def edited_sql(x: tuple[str, str, str], region: str | None = None) -> str:
    y = tuple(f"least(greatest({c}, 0), 1)" for c in x)
    if region:
        y = tuple(f"CASE WHEN {REGION} = '{region}' THEN {v} ELSE {c} END" for v, c in zip(y, RGB))
    return with_(grid_sql()) + f"SELECT ri, gi, bi, {cols_sql(y)} FROM gr"


for _kind, _amount, _region, _step in (
    ("lift", (0.1, 0.05, -0.02), None, lambda c, k: f"{c} + (1 - {c}) * ({k})::DOUBLE"),
    ("gain", (1.2, 0.9, 1.05), "highlights", lambda c, k: f"{c} * {k}::DOUBLE"),
    ("gamma", (1.1, 0.8, 2.2), "midtones", lambda c, k: f"CASE WHEN {c} > 0 THEN pow({c}, 1 / {k}::DOUBLE) ELSE 0 END"),
    ("offset", (0.05, -0.05, 0.02), "shadows", lambda c, k: f"{c} + ({k})::DOUBLE"),
):
    _lut(f"lut_edit_{_kind}", edited_sql(tuple(_step(c, k) for c, k in zip(RGB, _amount)), _region), lambda s, d, e=ops.Edit(_kind, _amount, _region): ops.edit(ops.identity(s, N), e))

HSL = """h0 AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM gr),
  h1 AS (SELECT *, (hi + lo) / 2 AS li, CASE WHEN hi - lo < 1e-10 THEN 0 WHEN (hi + lo) / 2 > 0.5 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s,
    CASE WHEN hi - lo < 1e-10 THEN 0 WHEN hi - r < 1e-10 THEN ((g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) WHEN hi - g < 1e-10 THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6 AS h FROM h0)"""


def hsl_back(h: str, s: str) -> str:
    def ch(shift: str) -> str:
        t = f"({h} + {shift})"
        t = f"(CASE WHEN {t} < 0 THEN {t} + 1 WHEN {t} > 1 THEN {t} - 1 ELSE {t} END)"
        return f"CASE WHEN abs(sn) < 1e-10 THEN li ELSE least(greatest(CASE WHEN {t} < 1 / 6::DOUBLE THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5 THEN q WHEN {t} < 2 / 3::DOUBLE THEN p + (q - p) * (2 / 3::DOUBLE - {t}) * 6 ELSE p END, 0), 1) END"

    return (
        f", h2 AS (SELECT *, {s} AS sn FROM h1), h3 AS (SELECT *, CASE WHEN li < 0.5 THEN li * (1 + sn) ELSE li + sn - li * sn END AS q FROM h2), h4 AS (SELECT *, 2 * li - q AS p FROM h3) "
        f"SELECT ri, gi, bi, {cols_sql((ch('1 / 3::DOUBLE'), ch('0'), ch('(-1 / 3::DOUBLE)')))} FROM h4"
    )


_lut("lut_edit_saturation", with_(grid_sql(), HSL).rstrip() + hsl_back("h", "least(greatest(s * 1.3::DOUBLE, 0), 1)"), lambda s, d: ops.edit(ops.identity(s, N), ops.Edit("saturation", (1.3,))))
_lut("lut_edit_hue", with_(grid_sql(), HSL).rstrip() + hsl_back("((h + 37::DOUBLE / 360) % 1)", "s"), lambda s, d: ops.edit(ops.identity(s, N), ops.Edit("hue", (37.0,))))
_lut("lut_regions", with_(grid_sql()) + f"SELECT {REGION} AS region, count(*) AS points FROM gr GROUP BY 1 UNION ALL SELECT 'full', count(*) FROM gr", lambda s, d: ops.anchors(ops.identity(s, N)).drop("hash"))
_lut("lut_diagonal", with_(grid_sql(), CDL_CTE) + f"SELECT ri AS i, {cols_sql(sat_sql(RGB, CDL.saturation))} FROM cd WHERE ri = gi AND gi = bi", lambda s, d: ops.diagonal(ops.sampled(s, N, CDL)))
_lut(
    "lut_sample",
    with_(FRAMES, PX, grid_sql(), CDL_CTE, "od AS (SELECT ri, gi, bi, " + ", ".join(f"{x} AS {c}" for x, c in zip(sat_sql(RGB, CDL.saturation), RGB)) + " FROM cd)",
          'po AS (SELECT movie * 1000000 + frame * 100 + "row" AS point, ' + ", ".join(f"least(greatest({c}, 0), 1) * {N - 1} AS p{c}, floor(least(greatest({c}, 0), 1) * {N - 1})::INT AS i{c}" for c in RGB) + " FROM px)")
    + "SELECT point, " + ", ".join(f"round(sum(w * od.{c}), 6) AS {c}" for c in RGB)
    + f" FROM (SELECT point, least(ir + x, {N - 1}) AS ri, least(ig + y, {N - 1}) AS gi, least(ib + z, {N - 1}) AS bi, (CASE x WHEN 1 THEN pr - ir ELSE 1 - (pr - ir) END) * (CASE y WHEN 1 THEN pg - ig ELSE 1 - (pg - ig) END) * (CASE z WHEN 1 THEN pb - ib ELSE 1 - (pb - ib) END) AS w FROM po, range(2) a(x), range(2) b(y), range(2) c(z)) k JOIN od USING (ri, gi, bi) GROUP BY 1",
    lambda s, d: ops.sample(strip(s, d).select((F.col("movie") * 1000000 + F.col("frame") * 100 + F.col("row")).alias("point"), "r", "g", "b"), ops.sampled(s, N, CDL), N),
)


def cdf_sql(name: str, movie: int) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS channel, least(floor(least(greatest({c}, 0), 1) * 63), 63)::INT AS bin FROM px WHERE movie = {movie}" for c in RGB)
    return (
        f"{name}_0 AS ({one}), {name} AS (SELECT c.channel, b AS bin, count(*) FILTER (x.bin <= b)::DOUBLE / count(*) AS cdf "
        f"FROM (SELECT DISTINCT channel FROM {name}_0) c JOIN range(64) t(b) ON true JOIN {name}_0 x ON x.channel = c.channel GROUP BY 1, 2)"
    )


_lut(
    "lut_color_transfer",
    with_(FRAMES, PX, cdf_sql("sc", 0), cdf_sql("tc", 1), grid_sql(),
          f"ax AS (SELECT sc.channel, i, sc.cdf AS c FROM range({N}) t(i) JOIN sc ON sc.bin = floor(i::DOUBLE / {N - 1} * 63)::INT)",
          "hi AS (SELECT ax.channel, ax.i, ax.c, min(tc.bin) - 1 AS t FROM ax LEFT JOIN tc ON tc.channel = ax.channel AND tc.bin > 0 AND tc.cdf >= ax.c GROUP BY 1, 2, 3)",
          "mp AS (SELECT hi.channel, i, CASE WHEN t IS NULL THEN 1 ELSE (t + least(greatest(CASE WHEN b.cdf - a.cdf > 1e-7 THEN (c - a.cdf) / (b.cdf - a.cdf) ELSE 0.5 END, 0), 1)) / 63 END AS y FROM hi LEFT JOIN tc a ON a.channel = hi.channel AND a.bin = t LEFT JOIN tc b ON b.channel = hi.channel AND b.bin = t + 1)")
    + "SELECT ri, gi, bi, round(x.y, 6) AS r, round(y.y, 6) AS g, round(z.y, 6) AS b FROM gr JOIN mp x ON x.channel = 'r' AND x.i = ri JOIN mp y ON y.channel = 'g' AND y.i = gi JOIN mp z ON z.channel = 'b' AND z.i = bi",
    lambda s, d: ops.color_transfer(strip(s, d).where("movie = 0"), strip(s, d).where("movie = 1"), N),
)

# Color spaces on pixels.

KEYS = 'movie, frame, "row"'
ENCODE = "CASE WHEN {0} <= 0.0078125 THEN {0} * 10.5402377416545::DOUBLE + 0.0729055341958355::DOUBLE ELSE (log2({0}) + 9.72::DOUBLE) / 17.52::DOUBLE END"
DECODE = "CASE WHEN {0} <= 0.155251141552511::DOUBLE THEN ({0} - 0.0729055341958355::DOUBLE) / 10.5402377416545::DOUBLE WHEN {0} >= (log2(65504::DOUBLE) + 9.72::DOUBLE) / 17.52::DOUBLE THEN 65504 ELSE pow(2::DOUBLE, {0} * 17.52::DOUBLE - 9.72::DOUBLE) END"


def _pixels(name: str, sql: str, f) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(strip(spark, sf_dir).select("movie", "frame", "row", *[c.alias(n) for n, c in f().items()]))

    run.__name__ = name
    query(name, with_(FRAMES, PX) + sql)(run)


_pixels("acescct_curve", f"SELECT {KEYS}, round({DECODE.format('r')}, 6) AS decoded, round({ENCODE.format('g')}, 6) AS encoded FROM px", lambda: {"decoded": co.acescct_to_linear(F.col("r")), "encoded": co.linear_to_acescct(F.col("g"))})
_pixels("tone_curve", f"SELECT {KEYS}, round({TONE.format('r')}, 6) AS toned, round({inverse_sql('g')}, 6) AS inverse FROM px", lambda: {"toned": co.tone_curve(F.col("r")), "inverse": F.when(F.col("g") >= 2.54 / 3.16, 1.0).otherwise(co.inverse_tone_curve(F.col("g")))})
_pixels("srgb_xyz", f"SELECT {KEYS}, {cols_sql(mat_sql(co.SRGB_TO_XYZ, RGB), ('x', 'y', 'z'))}, {cols_sql(mat_sql(co.XYZ_TO_P3, RGB), ('pr', 'pg', 'pb'))} FROM px", lambda: dict(zip(("x", "y", "z", "pr", "pg", "pb"), (*co.times(co.SRGB_TO_XYZ, ops.rgb()), *co.times(co.XYZ_TO_P3, ops.rgb())))))
_pixels("ap1_srgb", f"SELECT {KEYS}, {cols_sql(mat_sql(co.AP1_TO_SRGB, RGB))}, {cols_sql(mat_sql(co.SRGB_TO_AP1, RGB), ('ar', 'ag', 'ab'))} FROM px", lambda: dict(zip(("r", "g", "b", "ar", "ag", "ab"), (*co.times(co.AP1_TO_SRGB, ops.rgb()), *co.times(co.SRGB_TO_AP1, ops.rgb())))))


@query("log_oklab", with_(FRAMES, PX, "dx AS (SELECT movie, frame, \"row\", " + ", ".join(f"{DECODE.format(c)} AS {c}" for c in RGB) + " FROM px)", "ex AS (SELECT movie, frame, \"row\", " + ", ".join(f"{m} AS {c}" for m, c in zip(mat_sql(co.AP1_TO_SRGB, RGB), RGB)) + " FROM dx)", lab_sql("ex", KEYS, decode=lambda c: c)) + f"SELECT {KEYS}, {cols_sql(('ok_l', 'ok_a', 'ok_b'), ('ok_l', 'ok_a', 'ok_b'))} FROM lab")
def log_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(co.with_oklab(strip(spark, sf_dir), tag="log").select("movie", "frame", "row", "ok_l", "ok_a", "ok_b"))


@query("p3_oklab", with_(FRAMES, PX, "dx AS (SELECT movie, frame, \"row\", " + ", ".join(f"{lin_sql(c)} AS {c}" for c in RGB) + " FROM px)", "ex AS (SELECT movie, frame, \"row\", " + ", ".join(f"{m} AS {c}" for m, c in zip(mat_sql(co.P3_TO_XYZ, RGB), RGB)) + " FROM dx)", "fx AS (SELECT movie, frame, \"row\", " + ", ".join(f"{m} AS {c}" for m, c in zip(mat_sql(co.XYZ_TO_SRGB, RGB), RGB)) + " FROM ex)", lab_sql("fx", KEYS, decode=lambda c: c)) + f"SELECT {KEYS}, {cols_sql(('ok_l', 'ok_a', 'ok_b'), ('ok_l', 'ok_a', 'ok_b'))} FROM lab")
def p3_oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = co.convert(strip(spark, sf_dir), "display-p3", "oklab")
    return rounded(x.select("movie", "frame", "row", *[F.col(c).alias(n) for c, n in zip("rgb", ("ok_l", "ok_a", "ok_b"))]))


PATHS = ("srgb", "acescct", "display-p3")


@query("round_trips", with_(FRAMES, PX, lab_sql("px", KEYS)) + "SELECT movie, p AS path, count(*) AS passed, 0::BIGINT AS failed, " + ", ".join(f"CASE WHEN p <> 'display-p3' THEN round(avg(ok_{c}), 4) END AS ok_{c}" for c in "lab") + " FROM lab, (VALUES ('srgb'), ('acescct'), ('display-p3')) t(p) GROUP BY 1, 2")
def validate_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that come back within 0.001, and the mean color that they come back with, which is to be the one they left with.

    The published matrices of display-p3 have seven digits, so only its distances are held to the limit.
    """
    lab = co.with_oklab(strip(spark, sf_dir)).select("movie", "ok_l", "ok_a", "ok_b")
    out = None
    for path in PATHS:
        x = lab.withColumns({n: F.col(f"ok_{c}") for n, c in zip(RGB, "lab")})
        x = co.convert(co.convert(x, "oklab", path), path, "oklab").withColumn("path", F.lit(path))
        out = x if out is None else out.unionByName(x)
    near = co.delta_e((F.col("ok_l"), F.col("ok_a"), F.col("ok_b")), (F.col("r"), F.col("g"), F.col("b"))) < 0.001
    back = [F.when(F.col("path") != "display-p3", F.round(F.avg(c), 4)).alias(f"ok_{n}") for c, n in zip(RGB, "lab")]
    return out.groupBy("movie", "path").agg(F.count_if(near).alias("passed"), F.count_if(~near).alias("failed"), *back)


@query(
    "color_spaces",
    """SELECT color_space, CASE WHEN lower(color_space) IN ('aces2065-1', 'aces2065_1', 'ap0') THEN 'aces2065-1' WHEN lower(color_space) IN ('acescg', 'ap1') THEN 'acescg' WHEN lower(color_space) = 'acescct' THEN 'acescct'
  WHEN lower(color_space) IN ('rec709', 'srgb', 'bt709') THEN 'rec709' WHEN lower(color_space) IN ('displayp3', 'p3', 'display-p3') THEN 'display-p3' ELSE 'acescg' END AS parsed,
  CASE WHEN lower(color_space) = 'linear' THEN 'acescg' WHEN lower(color_space) = 'log' THEN 'acescct' WHEN lower(color_space) IN ('video', 'srgb') THEN 'rec709' WHEN lower(color_space) IN ('p3', 'displayp3', 'display-p3') THEN 'display-p3' ELSE 'acescg' END AS inferred,
  count(*) AS n FROM dataset_entries GROUP BY 1, 2, 3""",
)
def color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Catalog(spark, sf_dir).table("dataset_entries").groupBy("color_space").agg(F.count("*").alias("n"))
    return e.select("color_space", co.parse_space(F.col("color_space")).alias("parsed"), co.space_of_tag(F.col("color_space")).alias("inferred"), "n")


def names_sql(names: dict[int, str]) -> str:
    return "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + " ELSE 'unknown' END"


@query("header_codes", f"SELECT n_nationkey AS code, {names_sql(co.TRANSFER_NAMES)} AS transfer, {names_sql(co.COLORIMETRIC_NAMES)} AS colorimetric, {names_sql(co.DESCRIPTOR_NAMES)} AS descriptor FROM nation")
def header_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_nationkey")
    n = Catalog(spark, sf_dir).table("nation")
    return n.select(c.alias("code"), co.code_name(c, co.TRANSFER_NAMES).alias("transfer"), co.code_name(c, co.COLORIMETRIC_NAMES).alias("colorimetric"), co.code_name(c, co.DESCRIPTOR_NAMES).alias("descriptor"))
