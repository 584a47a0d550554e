"""From the frames of films to strips: one column a frame, thumbnails, and a check that frames fit together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.strips import frame_columns
from gradeloom.sources import media
from gradeloom.storage import materialize


@dataclass(frozen=True)
class Film:
    """strip: (movie, frame, row, r, g, b); thumbnails: (movie, frame, x, y, r, g, b); left_out: (movie, path, error)."""

    strip: DataFrame
    thumbnails: DataFrame
    left_out: DataFrame


def halved(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Means of 2 x 2 points; a last odd row or column is a mean of those it has."""
    at = [F.expr("cast(x div 2 as long)").alias("x"), F.expr("cast(y div 2 as long)").alias("y")]
    return pixels.groupBy(*keys, *at).agg(*[F.avg(c).alias(c) for c in "rgb"])


def film_strips(files: DataFrame, every: int = 24, mode: str = "mean") -> Film:
    """Strips of all films whose frames are files (path, format, content) in a folder a film, in order of their names.

    A frame that can't be decoded, or has another size than the film's first sound frame, is
    left out and named; the frames after it move up. Frames become columns before they
    meet, so a film is rows * frames points, not its pixels. Thumbnails are every
    `every`-th frame by half.
    """
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    points = media.read_pixels(files)
    whole = materialize(points.withColumn("movie", folder), "frames")
    sizes = whole.where("error IS NULL AND x = 0 AND y = 0").select("movie", "path", "width", "height")
    first = sizes.groupBy("movie").agg(F.min(F.struct("path", "width", "height")).alias("f")).select("movie", F.col("f.width").alias("w"), F.col("f.height").alias("h"))
    fits = sizes.join(first, "movie").withColumn("ok", (F.col("width") == F.col("w")) & (F.col("height") == F.col("h")))
    frame = F.row_number().over(Window.partitionBy("movie").orderBy("path")) - 1  # a row per frame of a film
    order = fits.where("ok").select("movie", "path", frame.cast("long").alias("frame"))
    good = whole.where("error IS NULL").drop("movie", "error").join(order, "path")
    strip = frame_columns(good, ["movie", "frame"], mode)
    thumbs = halved(good.where(F.col("frame") % every == 0), ["movie", "frame"])
    broken = whole.where("error IS NOT NULL").select("movie", "path", "error")
    odd = fits.where("NOT ok").select("movie", "path", F.lit("another size than the first frame").alias("error"))
    return Film(strip, thumbs, broken.unionByName(odd))
