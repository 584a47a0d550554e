"""Analytics of frame strips: (movie, frame, row, r, g, b), one row per pixel."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.color import chroma, degrees, hue, hue_class, mood, pair_class, with_oklab
from gradeloom.functions.vector import CLAMP, total
from gradeloom.operators.features import clamp01, dense, moments

TWO_PI = 2 * math.pi


def frame_columns(pixels: DataFrame, keys: list[str], mode: str = "mean", width: str = "width") -> DataFrame:
    """(keys, row, r, g, b): each frame as one column, by the mean of every row, or by the pixel in the middle ('center')."""
    if mode == "mean":
        return pixels.groupBy(*keys, F.col("y").alias("row")).agg(*[F.avg(c).alias(c) for c in "rgb"])
    return pixels.where(F.col("x") == F.expr(f"{width} div 2")).select(*keys, F.col("y").alias("row"), "r", "g", "b")


def frame_means(strip: DataFrame) -> DataFrame:
    """(movie, frame, ok_l, ok_a, ok_b): mean Oklab color of every frame."""
    return with_oklab(strip).groupBy("movie", "frame").agg(*[F.avg(c).alias(c) for c in ("ok_l", "ok_a", "ok_b")])


def frame_distances(strip: DataFrame) -> DataFrame:
    """(movie, frame, distance) to the next frame: mean over rows of the mean absolute Oklab gap.

    The window is over one row of one movie, so its size is the number of frames.
    """
    lab = with_oklab(strip)
    w = Window.partitionBy("movie", "row").orderBy("frame")
    gap = sum((F.abs(F.lead(c).over(w) - F.col(c)) for c in ("ok_a", "ok_b")), F.abs(F.lead("ok_l").over(w) - F.col("ok_l"))) / 3
    return lab.select("movie", "frame", gap.alias("gap")).where("gap IS NOT NULL").groupBy("movie", "frame").agg(F.avg("gap").alias("distance"))


def boundary_frames(distances: DataFrame, threshold: float = 0.3, min_gap: int = 12, most: int | None = 1024) -> DataFrame:
    """(movie, ordinal, frame, distance, confidence) of the scene cuts.

    Candidates lie above the threshold. Going by frame, a candidate within `min_gap` of the
    strongest of its group joins it (and becomes the anchor if stronger); else it starts a
    group. The anchor moves, so this is a fold over the sorted candidates of a movie,
    whose number is bounded by its frames. At most `most` groups come out, all with None.
    """
    c = distances.where(F.col("distance") > threshold).groupBy("movie").agg(F.sort_array(F.collect_list(F.struct(F.col("frame").cast("long").alias("frame"), "distance"))).alias("c"))
    none = F.array().cast("array<struct<frame:bigint,distance:double>>")

    def step(done: Column, x: Column) -> Column:
        near = (F.size(done) > 0) & (x["frame"] - F.try_element_at(done, F.lit(-1))["frame"] <= min_gap)
        stronger = x["distance"] > F.try_element_at(done, F.lit(-1))["distance"]
        return F.when(near & stronger, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(x))).when(near, done).otherwise(F.concat(done, F.array(x)))

    cuts = c.select("movie", F.aggregate("c", none, step).alias("cuts"))
    x = cuts.select("movie", F.posexplode("cuts" if most is None else F.slice("cuts", 1, most)).alias("ordinal", "x"))
    sure = clamp01((F.col("x.distance") - threshold) / max(threshold, 0.001))
    return x.select("movie", "ordinal", F.col("x.frame").alias("frame"), F.col("x.distance").alias("distance"), sure.alias("confidence"))


def scene_boundaries(strip: DataFrame, threshold: float = 0.3, min_gap: int = 12, most: int | None = 1024) -> DataFrame:
    """Scene cuts with the mean color of the stretch before and after each.

    The stretch before a cut begins after the previous one and includes the cut frame; the
    one after ends before the frame of the next cut. Each is a difference of running sums.
    """
    cuts = boundary_frames(frame_distances(strip), threshold, min_gap, most)
    w = Window.partitionBy("movie").orderBy("frame")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = frame_means(strip).withColumn("n", F.count("*").over(run)).withColumns({f"s_{c}": F.sum(c).over(run) for c in ("ok_l", "ok_a", "ok_b")})
    sums = m.select("movie", F.col("frame").cast("long").alias("frame"), "n", "s_ok_l", "s_ok_a", "s_ok_b")
    ends = m.groupBy("movie").agg(F.max(F.col("frame").cast("long")).alias("last"))
    b = cuts.join(ends, "movie").withColumns({"prev": F.lag("frame").over(w), "next": F.lead("frame").over(w)})
    b = b.withColumns({"p_lo": F.coalesce("prev", F.lit(-1)), "p_hi": F.col("frame"), "n_lo": F.col("frame"), "n_hi": F.coalesce(F.col("next") - 1, F.col("last"))})
    b = b.withColumn("n_hi", F.greatest("n_hi", F.least(F.col("n_lo") + 1, F.col("last"))))

    def at(frame: str, p: str) -> DataFrame:
        return sums.select("movie", F.col("frame").alias(frame), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "s_ok_l", "s_ok_a", "s_ok_b")])

    x = b.join(at("p_lo", "a"), ["movie", "p_lo"], "left").join(at("p_hi", "b"), ["movie", "p_hi"]).join(at("n_hi", "c"), ["movie", "n_hi"])

    def mean(hi: str, lo: str, c: str) -> Column:
        return (F.col(f"{hi}_s_ok_{c}") - F.coalesce(f"{lo}_s_ok_{c}", F.lit(0.0))) / (F.col(f"{hi}_n") - F.coalesce(f"{lo}_n", F.lit(0)))

    cols = [mean("b", "a", c).alias(f"before_{c}") for c in "lab"] + [mean("c", "b", c).alias(f"after_{c}") for c in "lab"]
    return x.select("movie", "ordinal", "frame", "distance", "confidence", *cols)


def mood_timeline(strip: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(movie, segment, first_frame, last_frame, ok_l, ok_a, ok_b, mood): a boundary frame begins a segment.

    Frames learn their segment from a count of boundaries so far over the frames of a movie.
    """
    cuts = boundaries.select("movie", F.col("frame").cast("long").alias("frame"), F.lit(1).alias("cut")).distinct()
    f = frame_means(strip).withColumn("frame", F.col("frame").cast("long")).join(cuts, ["movie", "frame"], "left")
    seg = F.sum(F.coalesce("cut", F.lit(0))).over(Window.partitionBy("movie").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = f.withColumn("segment", seg).groupBy("movie", "segment").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), *[F.avg(c).alias(c) for c in ("ok_l", "ok_a", "ok_b")])
    return s.withColumn("mood", mood(F.col("ok_l"), F.col("ok_a"), F.col("ok_b")))


def color_dna(strip: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean color, twelve-part hue distribution, contrast, warmth and saturation of every movie, in one aggregate."""
    keys = keys or ["movie"]
    lab = with_oklab(strip).withColumn("c", chroma(F.col("ok_a"), F.col("ok_b")))
    lab = lab.withColumn("h", F.when(F.col("c") > 0.001, F.least(F.floor(hue(F.col("ok_a"), F.col("ok_b")) / TWO_PI * 12), F.lit(11))))
    g = lab.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in ("ok_l", "ok_a", "ok_b")], F.stddev_pop("ok_l").alias("contrast"), F.avg("ok_a").alias("warmth"), F.avg("c").alias("saturation"),
        *[F.count_if(F.col("h") == i).alias(f"__{i}") for i in range(12)], F.count("h").alias("__n"),
    )
    hues = F.array(*[F.when(F.col("__n") > 0, F.col(f"__{i}") / F.col("__n")).otherwise(1 / 12) for i in range(12)])
    return g.select(*keys, "ok_l", "ok_a", "ok_b", "contrast", "warmth", "saturation", hues.alias("hues"))


def compare_dna(a: str, b: str) -> list[Column]:
    """Similarity by mean color, hue distribution, contrast and warmth; a and b are struct columns of color_dna."""
    gap = F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2) for c in ("ok_a", "ok_b")), F.pow(F.col(f"{a}.ok_l") - F.col(f"{b}.ok_l"), 2)))
    bc = total(F.zip_with(f"{a}.hues", f"{b}.hues", lambda x, y: F.sqrt(F.greatest(x, F.lit(CLAMP)) * F.greatest(y, F.lit(CLAMP)))))
    return [
        (1 - clamp01(gap)).alias("similarity"), clamp01(bc).alias("hue_similarity"),
        clamp01(F.abs(F.col(f"{a}.contrast") - F.col(f"{b}.contrast"))).alias("contrast_gap"), clamp01(F.abs(F.col(f"{a}.warmth") - F.col(f"{b}.warmth"))).alias("warmth_gap"),
    ]


def movie_search(dna: DataFrame, movie, k: int = 10, among: list | None = None) -> DataFrame:
    """Movies by similarity to one movie's color DNA; ties by movie. `among` lists the candidates; unknown ones and the movie itself are skipped, and an empty list has an empty result."""
    cols = [c for c in dna.columns if c != "movie"]
    q = dna.where(F.col("movie") == movie).select(F.struct(*cols).alias("q")).limit(1)
    c = dna.where(F.col("movie") != movie)
    if among is not None:
        c = c.where(F.col("movie").isin(*among)) if among else c.limit(0)
    x = c.select("movie", F.struct(*cols).alias("c")).join(F.broadcast(q))
    x = x.select("movie", *compare_dna("q", "c")).orderBy(F.col("similarity").desc(), "movie").limit(k)
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), "movie")).cast("long"))


def dominant_pairs(strip: DataFrame, min_chroma: float = 0.03, most: int = 6) -> DataFrame:
    """(movie, hue_a, hue_b, strength, kind): opposite hues that are both common, strongest first, relative to the strongest."""
    lab = with_oklab(strip)
    c = chroma(F.col("ok_a"), F.col("ok_b"))
    n = lab.where(c >= min_chroma).groupBy("movie", F.least(F.floor(hue(F.col("ok_a"), F.col("ok_b")) / TWO_PI * 24), F.lit(23)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    share = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("movie")))
    b = share.select("movie", (F.col("bin") - 12).alias("bin"), F.col("p").alias("q"))
    x = share.where("bin < 12").join(b, ["movie", "bin"]).withColumn("score", F.col("p") * F.col("q")).where("score > 0.0001 AND p > 0.01 AND q > 0.01")
    w = Window.partitionBy("movie").orderBy(F.col("score").desc(), "bin")
    x = x.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
    top = F.max("score").over(Window.partitionBy("movie"))
    ha, hb = F.col("bin") / 24 * TWO_PI, (F.col("bin") + 12) / 24 * TWO_PI
    return x.select("movie", "position", ha.alias("hue_a"), hb.alias("hue_b"), (F.col("score") / top).alias("strength"), pair_class(degrees(ha), degrees(hb)).alias("kind"))


def color_distribution(strip: DataFrame, min_chroma: float = 0.03) -> DataFrame:
    """(movie, color, share, r, g, b): share and mean color of each hue class."""
    lab = with_oklab(strip).withColumn("color", hue_class(F.col("ok_l"), F.col("ok_a"), F.col("ok_b"), min_chroma))
    g = lab.groupBy("movie", "color").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    return g.select("movie", "color", (F.col("n") / F.sum("n").over(Window.partitionBy("movie"))).alias("share"), "r", "g", "b")


def scatter(strip: DataFrame) -> DataFrame:
    """(movie, frame, ok_l, ok_a, ok_b) of the middle row of every frame."""
    h = strip.groupBy("movie").agg((F.max("row") + 1).alias("height"))
    mid = strip.join(h, "movie").where(F.col("row") == F.least(F.expr("height div 2"), F.col("height") - 1))
    return with_oklab(mid).select("movie", "frame", "ok_l", "ok_a", "ok_b")


def _relative(grid: DataFrame) -> DataFrame:
    return grid.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy("movie"))).drop("n")


def scatter_density(strip: DataFrame, size: int = 32, reach: float = 0.5) -> DataFrame:
    """(movie, ga, gb, density) of the cells that occur; values beyond the reach go to the edge."""

    def cell(c: str) -> Column:
        # toward zero, as a cast: beyond the reach the sign doesn't matter after the clamp
        return F.least(F.greatest(((F.col(c) + reach) / (2 * reach / size)).cast("int"), F.lit(0)), F.lit(size - 1))

    return _relative(scatter(strip).groupBy("movie", cell("ok_a").alias("ga"), cell("ok_b").alias("gb")).agg(F.count("*").alias("n")))


def vectorscope(strip: DataFrame, angles: int = 36, radii: int = 16, max_chroma: float = 0.4) -> DataFrame:
    """(movie, angle, radius, density): polar cells of hue and chroma; grays are skipped."""
    lab = with_oklab(strip).withColumn("c", chroma(F.col("ok_a"), F.col("ok_b"))).where("c >= 0.001")
    angle = F.least(F.floor(degrees(hue(F.col("ok_a"), F.col("ok_b"))) / 360 * angles), F.lit(angles - 1)).cast("int")
    radius = F.least(F.floor(F.col("c") / (max_chroma / radii)), F.lit(radii - 1)).cast("int")
    return _relative(lab.groupBy("movie", angle.alias("angle"), radius.alias("radius")).agg(F.count("*").alias("n")))


def segment_features(strip: DataFrame, segments: int = 4, bins: int = 32) -> DataFrame:
    """Hard Oklab histograms and moments of `segments` equal parts of every movie; the last part takes the remainder."""
    size = strip.groupBy("movie").agg((F.max("frame") + 1).alias("frames"))
    if segments < 1:
        raise ValueError("segments must be positive")
    x = strip.join(size, "movie").where(F.col("frames") >= segments)
    x = with_oklab(x.withColumn("segment", F.least(F.expr(f"frame div (frames div {segments})"), F.lit(segments - 1)).cast("int")))
    keys = ["movie", "segment"]
    out = moments(x, keys)
    for n, c, lo in (("l", "ok_l", 0.0), ("a", "ok_a", -0.5), ("b", "ok_b", -0.5)):
        b = F.least(F.floor(clamp01(F.col(c) - lo) * (bins - 1)), F.lit(bins - 1)).cast("int")
        h = x.groupBy(*keys, b.alias("bin")).agg(F.count("*").cast("double").alias("n"))
        h = h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
        out = out.join(dense(h, keys, bins, "share", f"hist_{n}"), keys)
    return out


def waveform(samples: DataFrame, bins: int) -> DataFrame:
    """(track, bin, peak): greatest absolute sample of each of `bins` equal parts of a track of 16-bit samples (track, pos, sample)."""
    size = samples.groupBy("track").agg((F.max("pos") + 1).alias("size"))
    # part i holds floor(i * size / bins) <= pos < floor((i + 1) * size / bins)
    part = F.floor(((F.col("pos") + 1) * bins - 1) / F.col("size")).cast("int")
    x = samples.join(size, "track").select("track", F.least(part, F.lit(bins - 1)).alias("bin"), (F.abs(F.col("sample")) / 32767.0).alias("v"))
    return x.groupBy("track", "bin").agg(F.max("v").alias("peak"))


def waveform_bars(peaks: DataFrame, height: int) -> DataFrame:
    """(track, bin, y) of the lit pixels of a waveform image."""
    half = F.col("peak") * (height / 2)
    lo, hi = F.round(F.lit(height / 2) - half).cast("int"), F.least(F.round(F.lit(height / 2) + half), F.lit(height)).cast("int")
    return peaks.where(hi > lo).select("track", "bin", F.explode(F.sequence(lo, hi - 1)).alias("y"))
