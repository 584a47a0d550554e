"""Import of a project and changes of stored tables, as transforms that end in one write.

Nothing is changed in place: each function returns the rows to append or the new table, and
`save` swaps a finished copy in, so a lost executor or a failed job leaves the old table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.features import fingerprint, grading_features, tile_features
from gradeloom.operators.lookup import color_tag
from gradeloom.sources import media
from gradeloom.storage import keep_latest, materialize

LONGEST = 512


@dataclass
class Imported:
    """What an import adds."""

    files: DataFrame
    skipped: DataFrame
    fingerprints: DataFrame
    features: DataFrame
    tiles: DataFrame | None
    variants: DataFrame
    keyframes: DataFrame


def import_project(spark: SparkSession, folder: str, project: str, known: DataFrame | None = None, tile_side: int | None = None, longest: int = LONGEST) -> Imported:
    """New files of a folder with headers, fingerprints, grading features, keyframes and, on demand, tiles.

    Files whose name the project has already (`known`: project_name, filename) are left
    out, so an import can be resumed. No file is lost without a word: one whose header is
    broken comes out in `skipped` only, one whose pixels or time table are in `files` and in
    `skipped` with the error. Films have a header and keyframes. Images are brought down to
    `longest` points in the task that decodes them. Features are keyed by path.
    """
    found = media.scan(spark, folder, content=True)
    if known is not None:
        mine = known.where(F.col("project_name") == project).select("filename").distinct()
        found = found.join(mine, "filename", "left_anti")
    headers = materialize(media.read_headers(found), "headers")
    good = headers.where("error IS NULL").withColumn("project_name", F.lit(project)).withColumn("color_tag", color_tag(F.col("format"), F.col("transfer")))
    sound = found.join(good.select("path"), "path", "left_semi")
    # decoded once; five features read it
    points = materialize(media.read_pixels(sound.where(F.col("format").isin("dpx", "exr")), longest), "pixels")
    small = points.where("error IS NULL").drop("error")
    frames = materialize(media.read_keyframes(sound), "keyframes")
    skipped = headers.select("path", "error").unionByName(points.select("path", "error")).unionByName(frames.select("path", "error")).where("error IS NOT NULL")
    tag = good.select("path", "color_tag")
    prints = fingerprint(small, ["path"]).join(tag, "path")
    tagged = small.join(tag, "path")
    feats = None
    for t in ("linear", "log", "video"):
        f = grading_features(tagged.where(F.col("color_tag") == t).drop("color_tag"), ["path"], tag=t)
        feats = f if feats is None else feats.unionByName(f)
    tiles = tile_features(small, ["path"], "width", "height", tile_side) if tile_side else None
    variant = F.concat_ws(" ", "format", F.coalesce("codec", "compression"), F.concat(F.col("bit_depth").cast("string"), F.lit(" bit")))
    variants = good.groupBy(variant.alias("variant")).agg(F.count("*").alias("files"))
    return Imported(good, skipped, prints, feats, tiles, variants, frames.where("error IS NULL").drop("error"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """New rows replace those of the same key; of several new ones with one key the latest by `by` counts, then the greatest by the other columns."""
    once = keep_latest(new, keys, by)
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(once, allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.distinct(), keys.columns, "left_anti")


def append_first(table: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Adds rows whose key is not there yet; of several new ones the first by `by`."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*by, *[c for c in rest if c not in by])).alias("f"))
    first = first.select(*keys, *[F.col(f"f.{c}").alias(c) for c in rest])
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def reextract(items: DataFrame, features: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(items with new features, outcomes): films are skipped, missing images are errors, the rest is re-extracted."""
    x = items.join(features.withColumn("__new", F.lit(True)), key, "left")
    outcome = F.when(F.col("format") == "mov", "skipped").when(F.col("__new").isNull(), "error").otherwise("reextracted")
    x = x.withColumn("outcome", outcome).drop("__new")
    return x, x.groupBy("outcome").agg(F.count("*").alias("n"))


def embed_missing(fingerprints: DataFrame, embed, force: bool = False) -> DataFrame:
    """Fills embeddings that are null (all with `force`) by `embed`, a column of new ones."""
    keep = F.lit(False) if force else F.col("embedding").isNotNull()
    return fingerprints.withColumn("embedding", F.when(keep, F.col("embedding")).otherwise(embed))


def save(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Writes a table, or with partition columns only the partitions that `df` has."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partitions:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    w.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its join key, so that joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
