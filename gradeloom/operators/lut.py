"""3D lookup tables as data: one row per grid point (ri, gi, bi, r, g, b), red fastest.

Grids are made by Spark (range), so tables of 256 points a side stay distributed; text
formats are the only place where one is gathered, as a file is one object.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.color import Rgb, aces_steps, hsl_to_rgb, luma, luminance_region, rgb_to_hsl, through
from gradeloom.operators.features import clamp01, hard_bin

INDEX = ["ri", "gi", "bi"]


class LutError(ValueError):
    """A table or operation that the rules refuse."""


def check_grid(n: int, most: int = 256) -> int:
    if not 2 <= n <= most:
        raise LutError(f"grid size {n} is not within 2 and {most}")
    return n


def identity(spark: SparkSession, n: int) -> DataFrame:
    check_grid(n)
    g = spark.range(n**3).select((F.col("id") % n).cast("int").alias("ri"), F.expr(f"cast((id div {n}) % {n} as int)").alias("gi"), F.expr(f"cast(id div {n * n} as int)").alias("bi"))
    return g.select(*INDEX, *[(F.col(i) / (n - 1)).alias(c) for i, c in zip(INDEX, "rgb")])


def rgb() -> Rgb:
    return F.col("r"), F.col("g"), F.col("b")


def mapped(lut: DataFrame, out: Rgb) -> DataFrame:
    return lut.select(*INDEX, *[c.alias(n) for c, n in zip(out, "rgb")])


def generate(spark: SparkSession, n: int, source: str, target: str, compat: bool = False) -> DataFrame:
    """The transform between two color spaces on a grid."""
    return through(identity(spark, n), ("r", "g", "b"), *aces_steps(source, target, compat))


def validate(lut: DataFrame, n: int, domain: tuple[float, float] = (0.0, 1.0)) -> None:
    """Raises unless the table is complete, has each point once, finite values and a sound domain."""
    check_grid(n)
    if domain[0] >= domain[1]:
        raise LutError("the domain is empty")
    inside = " AND ".join(f"{i} BETWEEN 0 AND {n - 1}" for i in INDEX)
    bad = " OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('infinity')" for c in "rgb")
    s = lut.agg(F.count_distinct(*INDEX).alias("points"), F.count("*").alias("rows"), F.count_if(~F.expr(inside)).alias("out"), F.count_if(F.expr(bad)).alias("bad")).first()
    if s["points"] != n**3 or s["rows"] != n**3 or s["out"] or s["bad"]:
        raise LutError(f"not a sound table of {n} points a side: {s.asDict()}")


def diff(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per channel: mean and greatest absolute difference and number of points that differ by more than the tolerance."""
    x = a.join(b.select(*INDEX, *[F.col(c).alias(f"o{c}") for c in "rgb"]), INDEX, "full")
    sides = x.agg(F.count_if(F.col("r").isNull() | F.col("or").isNull()).alias("n")).first()["n"]
    if sides:
        raise LutError("the grids differ")
    gaps = F.array(*[F.struct(F.lit(c).alias("channel"), F.abs(F.col(c) - F.col(f"o{c}")).alias("d")) for c in "rgb"])
    return x.select(F.explode(gaps).alias("e")).groupBy("e.channel").agg(F.avg("e.d").alias("mean"), F.max("e.d").alias("max"), F.count_if(F.col("e.d") > tolerance).alias("changed"))


@dataclass(frozen=True)
class Cdl:
    """Slope, offset, power and saturation of a color decision."""

    slope: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    power: tuple[float, float, float] = (1.0, 1.0, 1.0)
    saturation: float = 1.0

    def apply(self, x: Rgb) -> Rgb:
        y = tuple(F.pow(F.greatest(c * s + o, F.lit(0.0)), p) for c, s, o, p in zip(x, self.slope, self.offset, self.power))
        return saturated(y, self.saturation)


def saturated(x: Rgb, amount: float) -> Rgb:
    y = luma(x)
    return tuple(y + (c - y) * amount for c in x)


@dataclass(frozen=True)
class PowerGrade:
    """Parameters of a stored grade node."""

    version: int = 2
    gamma: float = 1.0
    gain: tuple[float, float, float] = (1.0, 1.0, 1.0)
    lift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    power: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    saturation: float = 1.0
    nodes: int = 1

    def apply(self, x: Rgb) -> Rgb:
        """Lift, gain around one half for what lies above it, power, saturation."""
        out = []
        for c, lift, gain, power in zip(x, self.lift, self.gain, self.power):
            v = c + lift
            v = F.when(v > 0.5, (v - 0.5) * gain + 0.5).otherwise(v)
            out.append(F.pow(F.greatest(v, F.lit(0.0)), power))
        return saturated(tuple(out), self.saturation)


def sampled(spark: SparkSession, n: int, grade: Cdl | PowerGrade) -> DataFrame:
    """A decision or grade as a table."""
    return mapped(identity(spark, n), grade.apply(rgb()))


@dataclass(frozen=True)
class Edit:
    """One edit; `kind` is lift, gain, gamma, offset, saturation or hue."""

    kind: str
    amount: tuple[float, ...]
    region: str | None = None

    def apply(self, x: Rgb) -> Rgb:
        a = self.amount if len(self.amount) == 3 else self.amount * 3
        if self.kind == "lift":
            y = tuple(clamp01(c + (1 - c) * k) for c, k in zip(x, a))
        elif self.kind == "gain":
            y = tuple(clamp01(c * k) for c, k in zip(x, a))
        elif self.kind == "gamma":
            if any(k == 0 for k in a):
                raise LutError("gamma must not be 0")
            y = tuple(clamp01(F.when(c > 0, F.pow(c, 1 / k)).otherwise(0.0)) for c, k in zip(x, a))
        elif self.kind == "offset":
            y = tuple(clamp01(c + k) for c, k in zip(x, a))
        elif self.kind in ("saturation", "hue"):
            raise LutError("hue and saturation are edits of a table, see edit()")
        else:
            raise LutError(f"unknown edit: {self.kind!r}")
        if self.region is None:
            return y
        here = luminance_region(x) == self.region
        return tuple(F.when(here, n).otherwise(c) for n, c in zip(y, x))


def edit(lut: DataFrame, *edits: Edit) -> DataFrame:
    for e in edits:
        lut = _edit_hsl(lut, e) if e.kind in ("saturation", "hue") else mapped(lut, e.apply(rgb()))
    return lut


def _edit_hsl(lut: DataFrame, e: Edit) -> DataFrame:
    """Hue, saturation and lightness are columns of their own on the way, so none is computed twice."""
    x = lut.select(*INDEX, *rgb(), *[c.alias(n) for c, n in zip(rgb_to_hsl(rgb()), ("h", "s", "l"))])
    h, s, light = F.col("h"), F.col("s"), F.col("l")
    turned = F.pmod(h + e.amount[0] / 360, F.lit(1.0)) if e.kind == "hue" else h
    x = x.withColumns({"h": turned, "s": clamp01(s * e.amount[0]) if e.kind == "saturation" else s})
    new = hsl_to_rgb((h, s, light))
    if e.region is not None:
        here = luminance_region(rgb()) == e.region
        new = tuple(F.when(here, n).otherwise(c) for n, c in zip(new, rgb()))
    return mapped(x, new)


def anchors(lut: DataFrame) -> DataFrame:
    """(region, points, hash): content of each luminance region and of the 'full' table; the hash doesn't depend on row order."""
    h = F.xxhash64(*INDEX, "r", "g", "b")
    x = lut.select(F.explode(F.array(luminance_region(rgb()), F.lit("full"))).alias("region"), h.alias("h"))
    return x.groupBy("region").agg(F.count("*").alias("points"), F.bit_xor("h").alias("hash"))


def changed_regions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Regions whose anchors differ."""
    a, b = anchors(before), anchors(after).withColumnsRenamed({"points": "points_after", "hash": "hash_after"})
    return a.join(b, "region", "full").where(~(F.col("hash").eqNullSafe(F.col("hash_after")) & F.col("points").eqNullSafe(F.col("points_after")))).select("region")


@dataclass
class EditSession:
    """Versions of a table; DataFrames are immutable, so undo is a step back in the list."""

    versions: list[DataFrame] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    protected: tuple[str, ...] = ()

    @classmethod
    def load(cls, lut: DataFrame, protected: tuple[str, ...] = ()) -> EditSession:
        return cls([lut], ["load"], protected)

    @property
    def current(self) -> DataFrame:
        return self.versions[-1]

    def apply(self, e: Edit) -> DataFrame:
        """Adds a version; refused if it would change a protected region."""
        new = edit(self.current, e)
        if self.protected:
            hit = {r["region"] for r in changed_regions(self.current, new).collect()} & set(self.protected)
            if hit:
                raise LutError(f"the edit changes protected regions: {sorted(hit)}")
        self.versions.append(new)
        self.labels.append(e.kind)
        return new

    def undo(self) -> DataFrame:
        if len(self.versions) < 2:
            raise LutError("nothing to undo")
        self.versions.pop()
        self.labels.pop()
        return self.current


def diagonal(lut: DataFrame) -> DataFrame:
    """The gray axis: points with equal indices."""
    return lut.where("ri = gi AND gi = bi").select(F.col("ri").alias("i"), "r", "g", "b").orderBy("i")


def sample(points: DataFrame, lut: DataFrame, n: int, key: str = "point") -> DataFrame:
    """Trilinear values of `lut` at points (key, r, g, b): eight weighted corners per point, joined on the grid index."""
    pos = points.select(key, *[(clamp01(F.col(c)) * (n - 1)).alias(f"p{c}") for c in "rgb"])
    pos = pos.select(key, *[F.col(f"p{c}") for c in "rgb"], *[F.floor(f"p{c}").cast("int").alias(f"i{c}") for c in "rgb"])
    corners = []
    for k in range(8):
        w, cell = F.lit(1.0), []
        for j, c in enumerate("rgb"):
            f = F.col(f"p{c}") - F.col(f"i{c}")
            up = k >> j & 1
            w = w * (f if up else 1 - f)
            cell.append(F.least(F.col(f"i{c}") + up, F.lit(n - 1)).alias(INDEX[j]))
        corners.append(F.struct(*cell, w.alias("w")))
    x = pos.select(key, F.explode(F.array(*corners)).alias("k")).select(key, *[F.col(f"k.{i}") for i in INDEX], F.col("k.w").alias("w")).where("w > 0")
    return x.join(lut, INDEX).groupBy(key).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in "rgb"])


def channel_cdf(strip: DataFrame, bins: int = 64) -> DataFrame:
    """(channel, cdf array): cumulative shares of floor(v * (bins - 1)); one row per channel."""
    one = F.array(*[F.struct(F.lit(c).alias("channel"), hard_bin(F.col(c), bins, closed=False).alias("bin")) for c in "rgb"])
    n = strip.select(F.explode(one).alias("e")).groupBy("e.channel", "e.bin").agg(F.count("*").alias("n"))
    m = n.groupBy("channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total"))
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    x = m.select("channel", "total", full.alias("h"))
    run = F.transform(F.sequence(F.lit(1), F.lit(bins)), lambda i: F.aggregate(F.slice("h", 1, i), F.lit(0).cast("long"), lambda s, v: s + v) / F.col("total"))
    return x.select("channel", run.alias("cdf"))


def through_cdf(value: Column, source: Column, target: Column, bins: int = 64) -> Column:
    """The value whose share in the target is the value's share in the source, linear between bins."""
    share = F.element_at(source, hard_bin(value, bins, closed=False) + 1)
    rising = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bins - 2)), lambda t: F.struct(t.alias("t"), F.element_at(target, t + 1).alias("lo"), F.element_at(target, t + 2).alias("hi"))), lambda s: s["hi"] >= share)
    hit = F.get(rising, 0)
    width = hit["hi"] - hit["lo"]
    part = clamp01(F.when(width > 1e-7, (share - hit["lo"]) / width).otherwise(0.5))
    return F.when(F.size(rising) == 0, 1.0).otherwise((hit["t"] + part) / (bins - 1))


def color_transfer(source: DataFrame, target: DataFrame, n: int, bins: int = 64) -> DataFrame:
    """The table that gives the source strip the target's distribution per channel; the identity for equal distributions of equal strips is left to the caller."""
    check_grid(n, 129)
    spark = source.sparkSession
    both = channel_cdf(source, bins).withColumnRenamed("cdf", "s").join(channel_cdf(target, bins).withColumnRenamed("cdf", "t"), "channel")
    axis = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") / (n - 1)).alias("v"))
    m = axis.join(F.broadcast(both)).select("channel", "i", through_cdf(F.col("v"), F.col("s"), F.col("t"), bins).alias("y"))
    out = identity(spark, n).select(*INDEX)
    for c, i in zip("rgb", INDEX):
        out = out.join(F.broadcast(m.where(F.col("channel") == c).select(F.col("i").alias(i), F.col("y").alias(c))), i)
    return out.select(*INDEX, "r", "g", "b")
