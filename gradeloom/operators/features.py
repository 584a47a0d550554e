"""Features of pixels in long form: one row per pixel, with key columns and r, g, b in 0..1.

Every feature is a hash aggregate with map-side combine on (keys, bin), so the shuffle
carries bins, not pixels, whatever the size of an image or the skew between movies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.color import LUMA, with_oklab
from gradeloom.functions.vector import l1, total
from gradeloom.storage import materialize

#: Value range of each Oklab channel in histograms.
RANGES = {"l": (0.0, 1.0), "a": (-0.5, 0.5), "b": (-0.5, 0.5)}
CHANNELS = {"l": "ok_l", "a": "ok_a", "b": "ok_b"}


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(ok)


def dense(binned: DataFrame, keys: list[str], bins: int, value: str, name: str) -> DataFrame:
    """(keys, name array<double>): sparse (keys, bin, value) rows as an array of all bins."""
    m = binned.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("__m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0.0))).alias(name))


def soft_histogram(df: DataFrame, keys: list[str], column: str, lo: float, hi: float, bins: int = 64) -> DataFrame:
    """(keys, bin, weight): each value is shared by two neighbouring bins by its place between them; values beyond the range go to the edge bins whole."""
    s = (F.col(column) - lo) / (hi - lo) * bins
    x = df.select(*keys, s.alias("__s")).withColumn("__i", F.least(F.greatest(F.floor("__s"), F.lit(0)), F.lit(bins - 1)).cast("int"))
    part = F.when((F.col("__s") <= 0) | (F.col("__i") == bins - 1), 0.0).otherwise(F.col("__s") - F.col("__i"))
    both = F.array(F.struct(F.col("__i").alias("bin"), (1 - F.col("__f")).alias("w")), F.struct((F.col("__i") + 1).alias("bin"), F.col("__f").alias("w")))
    x = x.withColumn("__f", part).select(*keys, F.explode(both).alias("e")).where("e.w > 0")
    return x.groupBy(*keys, F.col("e.bin").alias("bin")).agg(F.sum("e.w").alias("weight"))


def hard_bin(c: Column, bins: int = 64, closed: bool = True) -> Column:
    """Bin of a value in 0..1: floor(v * bins) with a closed last bin, or floor(v * (bins - 1))."""
    return F.least(F.floor(clamp01(c) * (bins if closed else bins - 1)), F.lit(bins - 1)).cast("int")


def rgb_histogram(pixels: DataFrame, keys: list[str], bins: int = 64) -> DataFrame:
    """(keys, channel, bin, share) for the bins that occur."""
    one = F.array(*[F.struct(F.lit(c).alias("channel"), hard_bin(F.col(c), bins).alias("bin")) for c in "rgb"])
    n = pixels.select(*keys, F.explode(one).alias("e")).groupBy(*keys, "e.channel", "e.bin").agg(F.count("*").alias("n"))
    size = n.where("channel = 'r'").groupBy(*keys).agg(F.sum("n").alias("size"))
    return n.join(size, keys).select(*keys, "channel", "bin", (F.col("n") / F.col("size")).alias("share"))


def luminance_stats(pixels: DataFrame, keys: list[str]) -> DataFrame:
    y = LUMA[0] * F.col("r") + LUMA[1] * F.col("g") + LUMA[2] * F.col("b")
    return pixels.groupBy(*keys).agg(F.avg(y).alias("luminance_mean"), F.stddev_pop(y).alias("luminance_stddev"), F.count("*").alias("pixels"))


def fingerprint(pixels: DataFrame, keys: list[str], mode: str = "full", bins: int = 64) -> DataFrame:
    """'full': three histograms and luminance; 'compact': luminance, channel centres of the histograms and a chroma figure; 'stats': luminance only."""
    stats = luminance_stats(pixels, keys)
    if mode == "stats":
        return stats
    h = rgb_histogram(pixels, keys, bins)
    if mode == "compact":
        c = h.groupBy(*keys).agg(*[F.sum(F.when(F.col("channel") == ch, F.col("share") * (F.col("bin") + 0.5) / bins)).alias(f"{ch}_mean") for ch in "rgb"])
        d1, d2 = F.col("r_mean") - F.col("g_mean"), F.col("g_mean") - F.col("b_mean")
        return stats.join(c.withColumn("chroma", F.sqrt(d1 * d1 + d2 * d2)), keys)
    if mode != "full":
        raise ValueError("mode must be 'full', 'compact' or 'stats'")
    out = stats
    for ch in "rgb":
        out = out.join(dense(h.where(F.col("channel") == ch), keys, bins, "share", f"hist_{ch}"), keys)
    return out


def moments(df: DataFrame, keys: list[str], columns: dict[str, str] = CHANNELS) -> DataFrame:
    """mean, std, skew and excess kurtosis (population) per channel; shapes of a constant channel are 0."""
    aggs = []
    for n, c in columns.items():
        flat = F.var_pop(c) <= 1e-12
        aggs += [F.avg(c).alias(f"{n}_mean"), F.when(flat, 0.0).otherwise(F.stddev_pop(c)).alias(f"{n}_std")]
        aggs += [F.when(flat, 0.0).otherwise(F.coalesce(F.skewness(c), F.lit(0.0))).alias(f"{n}_skew"), F.when(flat, 0.0).otherwise(F.coalesce(F.kurtosis(c), F.lit(0.0))).alias(f"{n}_kurt")]
    return df.groupBy(*keys).agg(*aggs)


def grading_features(pixels: DataFrame, keys: list[str], bins: int = 64, tag: str = "video") -> DataFrame:
    """Soft Oklab histograms and the twelve moments; pixels that aren't finite are dropped first."""
    lab = with_oklab(finite(pixels, ["r", "g", "b"]), tag=tag)
    out = moments(lab, keys)
    for n, c in CHANNELS.items():
        lo, hi = RANGES[n]
        out = out.join(dense(soft_histogram(lab, keys, c, lo, hi, bins), keys, bins, "weight", f"hist_{n}"), keys)
    return out


def split_tones(h: Column, shadow: float = 0.25, highlight: float = 0.75) -> list[Column]:
    """A lightness histogram cut into shadows, midtones and highlights by bin centres; bins of other parts are 0."""
    centre = lambda i: (i + 0.5) / F.size(h)
    return [
        F.transform(h, lambda x, i: F.when(centre(i) < shadow, x).otherwise(0.0)).alias("shadows"),
        F.transform(h, lambda x, i: F.when((centre(i) >= shadow) & (centre(i) < highlight), x).otherwise(0.0)).alias("midtones"),
        F.transform(h, lambda x, i: F.when(centre(i) >= highlight, x).otherwise(0.0)).alias("highlights"),
    ]


def tiles(pixels: DataFrame, keys: list[str], width: str, height: str, side: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds tile_row and tile_col of a grid of `side`: tiles are ceil(size / side) wide, so the last may be smaller."""
    tw, th = F.ceil(F.col(width) / side), F.ceil(F.col(height) / side)
    return pixels.withColumns({"tile_row": F.floor(F.col(y) / th).cast("int"), "tile_col": F.floor(F.col(x) / tw).cast("int")})


def tile_features(pixels: DataFrame, keys: list[str], width: str, height: str, side: int, bins: int = 64) -> DataFrame:
    return grading_features(tiles(pixels, keys, width, height, side), [*keys, "tile_row", "tile_col"], bins)


def downsample(pixels: DataFrame, keys: list[str], width: str, height: str, longest: int = 512) -> DataFrame:
    """Box means over the source range of every target pixel; ranges of neighbours may share a row or column.

    Target sizes keep the aspect; images within `longest` pass unchanged. Each source pixel
    names the one to two targets per axis that cover it, so no range join is needed.
    """
    w, h = F.col(width), F.col(height)
    scale = F.lit(float(longest)) / F.greatest(w, h)
    small = F.greatest(w, h) <= longest
    nw = F.when(small, w).otherwise(F.greatest(F.round(w * scale), F.lit(1.0))).cast("long")
    nh = F.when(small, h).otherwise(F.greatest(F.round(h * scale), F.lit(1.0))).cast("long")
    x = pixels.select(*keys, "x", "y", "r", "g", "b", w.alias("__w"), h.alias("__h"), nw.alias("__nw"), nh.alias("__nh"))

    def targets(at: str, size: str, new: str) -> Column:
        # t covers s if floor(t * size / new) <= s < ceil((t + 1) * size / new)
        first = F.expr(f"({at} * {new}) div {size}")
        last = F.least(F.expr(f"(({at} + 1) * {new} - 1) div {size}"), F.col(new) - 1)
        return F.sequence(first, last)

    x = x.withColumn("__tx", F.explode(targets("x", "__w", "__nw"))).withColumn("__ty", F.explode(targets("y", "__h", "__nh")))
    out = x.groupBy(*keys, F.col("__tx").alias("x"), F.col("__ty").alias("y")).agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), F.first("__nw").alias("width"), F.first("__nh").alias("height"))
    return out


# Histograms of whole projects.


def centroids(histograms: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(group, bin, <names>): element-wise means over the histograms of a group, in long form."""
    zipped = histograms.select(group, F.posexplode(F.arrays_zip(*names)).alias("bin", "v"))
    return zipped.groupBy(group, "bin").agg(*[F.avg(f"v.{n}").alias(n) for n in names])


def centroid_arrays(histograms: DataFrame, group: str, names: list[str]) -> DataFrame:
    c = centroids(histograms, group, names).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("bin", *names))).alias("v"))
    return c.select(group, *[F.col(f"v.{n}").alias(n) for n in names])


def average_features(features: DataFrame, group: str, names: list[str]) -> DataFrame:
    """Element-wise means of array features; groups with arrays of different sizes have none."""
    sizes = features.groupBy(group).agg(*[F.count_distinct(F.size(n)).alias(f"d_{n}") for n in names])
    same = sizes.where(" AND ".join(f"d_{n} = 1" for n in names)).select(group)
    return centroid_arrays(features.join(same, group, "left_semi"), group, names)


def project_summaries(histograms: DataFrame, group: str, names: list[str]) -> DataFrame:
    c = centroids(histograms, group, names).groupBy(group).agg(*[F.avg(n).alias(f"{n}_centroid") for n in names])
    return c.join(histograms.groupBy(group).agg(F.count("*").alias("fingerprints")), group)


def project_distances(histograms: DataFrame, group: str, names: list[str], rows: int = 1024) -> DataFrame:
    """(a, b, distance): mean L1 distance of the centroids of every two groups, a before b; histograms have one size.

    Pairs of groups are the result itself. The centroids, one row a group, are cut into blocks of some `rows`, and
    every two blocks meet in one task. So each pair is made once, with all its bins, and what is shuffled are
    centroids, once for each block.
    """
    c = materialize(centroid_arrays(histograms.where(F.col(group).isNotNull()), group, names), "centroids")
    parts = max(1, -(-c.count() // rows))
    own, other = F.col("__own"), F.col("__other")
    x = c.withColumn("__own", F.pmod(F.xxhash64(group), F.lit(parts)).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    x = x.select(F.least(own, other).alias("__i"), F.greatest(own, other).alias("__j"), own, F.col(group).alias("__name"), *names)
    kind = dict(x.dtypes)["__name"]

    def run(t: pa.Table) -> pa.Table:
        by = np.argsort(np.array(t["__name"].to_pylist(), object), kind="stable")  # strings by code point, as their bytes in SQL
        name, side = t["__name"].combine_chunks().take(pa.array(by)), t["__own"].to_numpy()[by]
        m = np.hstack([t[n].combine_chunks().flatten().to_numpy().reshape(len(by), -1) for n in names])[by]
        i, j = t["__i"][0].as_py(), t["__j"][0].as_py()
        right = np.flatnonzero(side == j)
        ends, far = [], []
        for k in np.flatnonzero(side == i):
            r = right if i != j else right[k + 1 :]
            ends.append(np.stack([np.minimum(k, r), np.maximum(k, r)]))
            far.append(np.abs(m[r] - m[k]).sum(axis=1) / len(names))
        a, b = np.hstack(ends) if ends else np.zeros((2, 0), int)
        return pa.table({"a": name.take(pa.array(a)), "b": name.take(pa.array(b)), "distance": np.concatenate([*far, np.zeros(0)])})

    return x.groupBy("__i", "__j").applyInArrow(run, f"a {kind}, b {kind}, distance double")


def mean_distance(histograms: DataFrame, group: str, names: list[str]) -> DataFrame:
    """One row `overall`: the mean of `project_distances`, 0 without a pair; histograms have one size.

    No pair is made: of n sorted means of a bin, the gap after the k-th lies between both ends of k * (n - k) pairs.
    """
    c = centroids(histograms.where(F.col(group).isNotNull()), group, names)
    each = Window.partitionBy("bin", "channel")
    place = each.orderBy("v")
    x = c.select("bin", F.posexplode(F.array(*names)).alias("channel", "v"))
    x = x.select(F.count("*").over(each).alias("n"), F.row_number().over(place).alias("k"), (F.lead("v").over(place) - F.col("v")).alias("gap"))
    s = x.agg(F.max("n").alias("n"), F.sum(F.col("k") * (F.col("n") - F.col("k")) * F.col("gap")).alias("s"))
    return s.select(F.when(F.col("n") > 1, F.col("s") / len(names) / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(0.0).alias("overall"))


def outliers(histograms: DataFrame, group: str, names: list[str], factor: float = 2.0) -> DataFrame:
    """(id, group, distance): members further from their centroid than `factor` times the group's mean distance; groups of one have none."""
    c = centroid_arrays(histograms, group, names).select(group, *[F.col(n).alias(f"c_{n}") for n in names])
    d = histograms.join(c, group)
    gap = sum((l1(F.col(n), F.col(f"c_{n}")) for n in names[1:]), l1(F.col(names[0]), F.col(f"c_{names[0]}"))) / len(names)
    d = d.select("id", group, gap.alias("distance"))
    mean = d.groupBy(group).agg(F.avg("distance").alias("m"), F.count("*").alias("n")).where("n > 1")
    return d.join(mean, group).where(F.col("distance") > factor * F.col("m")).select("id", group, "distance")


def compare(a: DataFrame, b: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
    """Deltas of paired rows (same `pair`): per channel mean, max, total and peak bin, the gaps of `extra`, and the mean of the means."""
    left = a.select("pair", *[F.col(c).alias(f"a_{c}") for c in [*names, *extra]])
    right = b.select("pair", *[F.col(c).alias(f"b_{c}") for c in [*names, *extra]])
    x = left.join(right, "pair").select("pair", *[F.zip_with(f"a_{n}", f"b_{n}", lambda p, q: F.abs(p - q)).alias(n) for n in names], *[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"{c}_delta") for c in extra])
    from gradeloom.functions.vector import first_peak

    cols = ["pair", *[f"{c}_delta" for c in extra]]
    out = x.select(*cols, *[y for n in names for y in ((total(F.col(n)) / F.size(n)).alias(f"{n}_mean"), F.array_max(n).alias(f"{n}_max"), total(F.col(n)).alias(f"{n}_l1"), first_peak(F.col(n)).cast("long").alias(f"{n}_bin"))])
    mean = sum((F.col(f"{n}_mean") for n in names[1:]), F.col(f"{names[0]}_mean")) / len(names)
    return out.withColumn("overall", mean)


def cdf(binned: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Adds the cumulative share over bins; a key has at most as many rows as bins."""
    w = Window.partitionBy(*keys)
    run = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return binned.withColumn("cdf", F.sum(value).over(run) / F.sum(value).over(w))
