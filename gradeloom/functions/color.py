"""Color spaces as column expressions on triples of columns, and as steps that become projections."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]
Step = Callable[[Rgb], Rgb]
Matrix = tuple[tuple[float, float, float], tuple[float, float, float], tuple[float, float, float]]

# Published matrices and curves.
LINEAR_TO_LMS: Matrix = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_OKLAB: Matrix = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OKLAB_TO_LMS: Matrix = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_LINEAR: Matrix = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
AP1_TO_SRGB: Matrix = ((1.7050509927, -0.6217921207, -0.0832588720), (-0.1302564175, 1.1408047366, -0.0105483191), (-0.0240033568, -0.1289689761, 1.1529723329))
SRGB_TO_AP1: Matrix = ((0.6130974024, 0.3395231462, 0.0473794514), (0.0701937225, 0.9163538791, 0.0134523985), (0.0206155929, 0.1095697729, 0.8698146342))
SRGB_TO_XYZ: Matrix = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_TO_SRGB: Matrix = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
P3_TO_XYZ: Matrix = ((0.4865709486, 0.2656676930, 0.1982174952), (0.2289745680, 0.6913675516, 0.0798577308), (0.0, 0.0451133837, 1.0439443689))
XYZ_TO_P3: Matrix = ((2.4934969119, -0.9313836179, -0.4027107845), (-0.8294889696, 1.7626640603, 0.0236246858), (0.0358458302, -0.0761723893, 0.9568845240))
AP1_TO_AP0: Matrix = ((0.6954522414, 0.1406786965, 0.1638690622), (0.0447945634, 0.8596711185, 0.0955343182), (-0.0055258826, 0.0040252103, 1.0015006723))
AP0_TO_AP1: Matrix = ((1.4514393161, -0.2365107469, -0.2149285693), (-0.0765537734, 1.1762296998, -0.0996759264), (0.0083161484, -0.0060324498, 0.9977163014))
#: The second matrix as older exports used it: one digit differs.
AP0_TO_AP1_COMPAT: Matrix = ((1.4514393161, -0.2365107469, -0.2149285693), (-0.0765537734, 1.1762296998, -0.0996959264), (0.0083161484, -0.0060324498, 0.9977163014))
TONE = (2.51, 0.03, 2.43, 0.59, 0.14)
ACESCCT = {"slope": 10.5402377416545, "offset": 0.0729055341958355, "linear_cut": 0.0078125, "cut": 0.155251141552511, "log_scale": 17.52, "log_offset": 9.72, "top": 65504.0}
LUMA = (0.2126, 0.7152, 0.0722)
SPACES = ("aces2065-1", "acescg", "acescct", "rec709", "display-p3")


def times(m: Matrix, x: Rgb) -> Rgb:
    return tuple(row[0] * x[0] + row[1] * x[1] + row[2] * x[2] for row in m)  # type: ignore[return-value]


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, 1 / 2.4) * 1.055 - 0.055)


def acescct_to_linear(c: Column) -> Column:
    """The published curve: linear toe, then powers of two up to the largest half float."""
    k = ACESCCT
    top = (math.log2(k["top"]) + k["log_offset"]) / k["log_scale"]
    power = F.when(c >= top, k["top"]).otherwise(F.pow(F.lit(2.0), c * k["log_scale"] - k["log_offset"]))
    return F.when(c <= k["cut"], (c - k["offset"]) / k["slope"]).otherwise(power)


def linear_to_acescct(c: Column, compat: bool = False) -> Column:
    """Encodes; with `compat` values up to 0 become 0 instead of following the toe."""
    k = ACESCCT
    curve = F.when(c <= k["linear_cut"], c * k["slope"] + k["offset"]).otherwise((F.log2(c) + k["log_offset"]) / k["log_scale"])
    return F.when(c <= 0, 0.0).otherwise(curve) if compat else curve


def linear_to_oklab(x: Rgb) -> Rgb:
    return times(LMS_TO_OKLAB, tuple(F.cbrt(c) for c in times(LINEAR_TO_LMS, x)))


def oklab_to_linear(x: Rgb) -> Rgb:
    return times(LMS_TO_LINEAR, tuple(c * c * c for c in times(OKLAB_TO_LMS, x)))


def each(f: Callable[[Column], Column]) -> Step:
    return lambda x: tuple(map(f, x))


def by(m: Matrix) -> Step:
    return lambda x: times(m, x)


FROM_LINEAR: list[Step] = [by(LINEAR_TO_LMS), each(F.cbrt), by(LMS_TO_OKLAB)]
TO_LINEAR: list[Step] = [by(OKLAB_TO_LMS), each(lambda c: c * c * c), by(LMS_TO_LINEAR)]
#: The steps of each way; `through` gives every step a projection of its own.
STEPS: dict[tuple[str, str], list[Step]] = {
    ("linear", "oklab"): FROM_LINEAR,
    ("oklab", "linear"): TO_LINEAR,
    ("srgb", "oklab"): [each(srgb_to_linear), *FROM_LINEAR],
    ("oklab", "srgb"): [*TO_LINEAR, each(linear_to_srgb)],
    ("acescct", "oklab"): [each(acescct_to_linear), by(AP1_TO_SRGB), *FROM_LINEAR],
    ("oklab", "acescct"): [*TO_LINEAR, by(SRGB_TO_AP1), each(linear_to_acescct)],
    ("display-p3", "oklab"): [each(srgb_to_linear), by(P3_TO_XYZ), by(XYZ_TO_SRGB), *FROM_LINEAR],
    ("oklab", "display-p3"): [*TO_LINEAR, by(SRGB_TO_XYZ), by(XYZ_TO_P3), each(linear_to_srgb)],
}


def through(df: DataFrame, columns: tuple[str, str, str], *steps: Step) -> DataFrame:
    """Takes three columns through steps, one projection each.

    A matrix names each input three times, so a chain in one expression would grow
    threefold a step; separate projections compute every value once.
    """
    rest = [F.col(c) for c in df.columns if c not in columns]
    for f in steps:
        out = f(tuple(F.col(c) for c in columns))
        df = df.select(*rest, *[c.alias(n) for c, n in zip(out, columns)])
    return df


def convert(df: DataFrame, source: str, target: str, columns: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Three columns from one space to another, by way of Oklab where both are encodings; the names stay."""
    if source == target:
        return df
    if (source, target) in STEPS:
        return through(df, columns, *STEPS[source, target])
    try:
        return through(df, columns, *STEPS[source, "oklab"], *STEPS["oklab", target])
    except KeyError:
        raise ValueError(f"no way from {source!r} to {target!r}") from None


def with_oklab(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), tag: str = "video") -> DataFrame:
    """Adds ok_l, ok_a, ok_b. Intermediate values are columns, so each is computed once a row."""
    spaces = {"video": "srgb", "log": "acescct", "linear": "linear"}
    if tag not in spaces:
        raise ValueError(f"unknown color tag: {tag!r}")
    lab = ("ok_l", "ok_a", "ok_b")
    x = df.withColumns({n: F.col(c) for n, c in zip(lab, rgb)})
    return through(x, lab, *STEPS[spaces[tag], "oklab"])


def tone_curve(x: Column) -> Column:
    a, b, c, d, e = TONE
    return x * (x * a + b) / (x * (x * c + d) + e)


def inverse_tone_curve(y: Column) -> Column:
    """The positive root of the curve's quadratic, exact where an iteration would only approach it; 0 for y <= 0."""
    a, b, c, d, e = TONE
    # (a - c y) x^2 + (b - d y) x - e y = 0
    p, q, r = F.lit(a) - y * c, F.lit(b) - y * d, y * (-e)
    root = (-q + F.sqrt(q * q - p * r * 4)) / (p * 2)
    return F.when(y <= 0, 0.0).otherwise(root)


def _gamma(x: Column) -> Column:
    return F.pow(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 1 / 2.2)


def aces_steps(source: str, target: str, compat: bool = False) -> list[Step]:
    """Steps between legal ACES spaces; other pairs give NaN, and a log source is refused.

    Older exports had the two matrices between AP0 and AP1 swapped: `compat` keeps their numbers.
    """
    if source in ("acescct", "log"):
        raise ValueError("a log source has no direct transform")
    out, back = (AP0_TO_AP1_COMPAT, AP1_TO_AP0) if compat else (AP1_TO_AP0, AP0_TO_AP1)
    white = (TONE[0] + TONE[1]) / (TONE[2] + TONE[3] + TONE[4])
    known: dict[tuple[str, str], list[Step]] = {
        ("acescg", "rec709"): [each(tone_curve), by(out), each(_gamma)],
        ("rec709", "acescg"): [
            each(lambda c: F.when(c <= 0, 0.0).otherwise(F.pow(c, 2.2))), by(back),
            each(lambda c: F.when(c >= white, 1.0).otherwise(inverse_tone_curve(c))),
        ],
        ("aces2065-1", "acescg"): [by(back)],
        ("acescg", "aces2065-1"): [by(out)],
    }
    if source == target:
        return []
    return known.get((source, target)) or [each(lambda c: F.lit(float("nan")))]


def luma(x: Rgb) -> Column:
    return LUMA[0] * x[0] + LUMA[1] * x[1] + LUMA[2] * x[2]


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Angle in [0, 2 pi)."""
    t = F.atan2(b, a)
    return F.when(t < 0, t + 2 * math.pi).otherwise(t)


def normalised_angle(t: Column) -> Column:
    return F.pmod(t, F.lit(2 * math.pi))


def degrees(t: Column) -> Column:
    return t * (180 / math.pi)


def delta_e(x: Rgb, y: Rgb) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(x[1:], y[1:])), (x[0] - y[0]) * (x[0] - y[0])))


def hue_class(l_: Column, a: Column, b: Column, min_chroma: float = 0.03) -> Column:
    """Seven hue classes and neutral; skin comes before the reds it lies in."""
    c, d = chroma(a, b), degrees(hue(a, b))
    skin = (d >= 15) & (d < 45) & (c < 0.15) & (l_ > 0.3)
    return (
        F.when(c < min_chroma, "neutral").when(skin, "skin").when((d >= 345) | (d < 45), "red").when(d < 70, "yellow")
        .when(d < 165, "green").when(d < 200, "cyan").when(d < 270, "blue").otherwise("magenta")
    )


def mood(l_: Column, a: Column, b: Column) -> Column:
    """The first that holds: dark, warm, vivid, cool, neutral."""
    c = chroma(a, b)
    return (
        F.when((l_ < 0.3) & (c < 0.05), "dark").when(a > 0.05, "warm").when((l_ > 0.6) & (c > 0.15), "vivid")
        .when((a < -0.05) | (b > 0.1), "cool").otherwise("neutral")
    )


def pair_class(deg_a: Column, deg_b: Column) -> Column:
    """Kind of a complementary pair of hues in degrees, in either order."""

    def both(lo1: float, hi1: float, lo2: float, hi2: float) -> Column:
        def inside(x: Column, lo: float, hi: float) -> Column:
            return (x >= lo) & (x <= hi) if lo <= hi else (x >= lo) | (x <= hi)

        return (inside(deg_a, lo1, hi1) & inside(deg_b, lo2, hi2)) | (inside(deg_b, lo1, hi1) & inside(deg_a, lo2, hi2))

    return (
        F.when(both(15, 50, 160, 200), "teal-orange").when(both(200, 260, 50, 70), "blue-yellow")
        .when(both(340, 20, 160, 200), "red-cyan").when(both(280, 340, 80, 160), "magenta-green").otherwise("other")
    )


def luminance_region(x: Rgb) -> Column:
    y = luma(x)
    return F.when(y <= 0.25, "shadows").when(y <= 0.75, "midtones").otherwise("highlights")


def rgb_to_hsl(x: Rgb) -> Rgb:
    r, g, b = x
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d, light = hi - lo, (hi + lo) / 2
    flat = d < 1e-10
    s = F.when(flat, 0.0).when(light > 0.5, d / (F.lit(2.0) - hi - lo)).otherwise(d / (hi + lo))
    h = F.when(flat, 0.0).when(hi - r < 1e-10, (g - b) / d + F.when(g < b, 6.0).otherwise(0.0)).when(hi - g < 1e-10, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return h / 6, s, light


def hsl_to_rgb(x: Rgb) -> Rgb:
    h, s, light = x
    q = F.when(light < 0.5, light * (s + 1)).otherwise(light + s - light * s)
    p = light * 2 - q

    def channel(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        v = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6).otherwise(p)
        return F.when(F.abs(s) < 1e-10, light).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))

    return channel(h + 1 / 3), channel(h), channel(h - 1 / 3)


def parse_space(name: Column) -> Column:
    """Canonical name of a color space; null and unknown names are ACEScg."""
    n = F.lower(name)
    return (
        F.when(n.isin("aces2065-1", "aces2065_1", "ap0"), "aces2065-1").when(n.isin("acescg", "ap1"), "acescg").when(n == "acescct", "acescct")
        .when(n.isin("rec709", "srgb", "bt709"), "rec709").when(n.isin("displayp3", "p3", "display-p3"), "display-p3").otherwise("acescg")
    )


def space_of_tag(tag: Column) -> Column:
    """The space that an encoding tag suggests."""
    t = F.lower(tag)
    return (
        F.when(t == "linear", "acescg").when(t == "log", "acescct").when(t.isin("video", "srgb"), "rec709")
        .when(t.isin("p3", "displayp3", "display-p3"), "display-p3").otherwise("acescg")
    )


#: Names of header codes.
TRANSFER_NAMES = {
    0: "user_defined", 1: "printing_density", 2: "linear", 3: "logarithmic", 4: "unspecified_video", 5: "smpte_274m",
    6: "bt709", 7: "bt601_bg", 8: "bt601_m", 9: "ntsc_composite", 10: "pal_composite",
}
COLORIMETRIC_NAMES = {k: v for k, v in TRANSFER_NAMES.items() if k not in (2, 3)}
DESCRIPTOR_NAMES = {
    0: "user_defined", 1: "red", 2: "green", 3: "blue", 4: "alpha", 6: "luminance", 7: "chrominance", 8: "depth", 9: "composite_video",
    50: "rgb", 51: "rgba", 52: "abgr", 100: "cbYcrY_422", 101: "cbYaCrYa_4224", 102: "cbYcr_444", 103: "cbYcrA_4444",
}


def code_name(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit("unknown"))


def channels_descriptor(channels: Column) -> Column:
    """rgb, rgba, or the names as they are; `channels` is sorted."""
    joined = F.array_join(channels, ",")
    return F.when(joined == "B,G,R", "rgb").when(joined == "A,B,G,R", "rgba").otherwise(joined)
