"""Catalog queries: listings, lookups, joins and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions.vector import first_peak, last_peak, total

#: Transfer characteristics by family.
LOG_TRANSFERS = ("printing_density", "logarithmic")
VIDEO_TRANSFERS = ("bt709", "bt601_bg", "bt601_m", "smpte_274m", "unspecified_video", "ntsc_composite", "pal_composite")


def list_projects(c: Catalog) -> DataFrame:
    """Projects with their numbers of files and fingerprints, counted before the joins."""
    files = c.files.groupBy("project_id").agg(F.count("*").alias("file_count"))
    prints = c.fingerprints.select("file_id").join(c.files.select(F.col("id").alias("file_id"), "project_id"), "file_id")
    prints = prints.groupBy("project_id").agg(F.count("*").alias("fingerprint_count"))
    p = c.projects.withColumnRenamed("id", "project_id")
    out = p.join(files, "project_id", "left").join(prints, "project_id", "left").withColumnRenamed("project_id", "id")
    return out.fillna(0, ["file_count", "fingerprint_count"]).orderBy(F.col("created_at").desc(), "id")


def list_files(c: Catalog, project: str) -> DataFrame:
    prints = c.fingerprints.groupBy("file_id").agg(F.count("*").alias("fingerprint_count"))
    p = c.projects.where(F.col("name") == project).select(F.col("id").alias("project_id"))
    f = c.files.join(p, "project_id", "left_semi").select(F.col("id").alias("file_id"), "filename", "format", "created_at")
    out = f.join(prints, "file_id", "left").fillna(0, ["fingerprint_count"])
    return out.select(F.col("file_id").alias("id"), "filename", "format", "fingerprint_count", "created_at").orderBy(F.col("created_at").desc(), "id")


def list_tags(c: Catalog, project: str | None = None) -> DataFrame:
    i = c.info.select(F.col("id").alias("fingerprint_id"), F.col("project_name").alias("project"), F.col("filename").alias("file"))
    if project is not None:
        i = i.where(F.col("project") == project)
    t = c.tags.select("id", "fingerprint_id", "tag", "source", "created_at")
    return t.join(i, "fingerprint_id").select("id", "tag", "source", "project", "file", "created_at").orderBy(F.col("created_at").desc(), "id")


def list_luts(c: Catalog) -> DataFrame:
    p = c.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return c.luts.join(p, "project_id").select("id", "project_name", "title", "format", "grid_size", "output_path", "created_at").orderBy(F.col("created_at").desc(), "id")


def resolve_file(c: Catalog, project: str, filename: str) -> DataFrame:
    p = c.projects.where(F.col("name") == project).select(F.col("id").alias("project_id"))
    return c.files.where(F.col("filename") == filename).join(p, "project_id").agg(F.min("id").alias("file_id")).where("file_id IS NOT NULL")


def resolve_fingerprint(c: Catalog, project: str, filename: str) -> DataFrame:
    i = c.info.where((F.col("project_name") == project) & (F.col("filename") == filename))
    return i.agg(F.min("id").alias("fingerprint_id")).where("fingerprint_id IS NOT NULL")


def resolve_fingerprints(c: Catalog) -> DataFrame:
    """(project_name, filename, fingerprint_id): the smallest fingerprint of every file at once."""
    return c.info.groupBy("project_name", "filename").agg(F.min("id").alias("fingerprint_id"))


def resolve_images(c: Catalog, paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, file_id, matches): the file with the base name of a path; the smallest id if several, which `matches` tells."""
    asked = paths.select(F.col(path_col).alias("path"), F.element_at(F.split(path_col, "/"), -1).alias("filename")).distinct()
    found = asked.join(c.files.select("id", "filename"), "filename").groupBy("path").agg(F.min("id").alias("file_id"), F.count("*").alias("matches"))
    return asked.select("path").join(found, "path", "left").select("path", "file_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def histogram_summary(h: Column, name: str) -> list[Column]:
    return [(total(h) / F.size(h)).alias(f"{name}_mean"), last_peak(h).cast("long").alias(f"{name}_peak")]


def fingerprint_info(c: Catalog, with_tags: bool = True) -> DataFrame:
    """Every sound fingerprint with its file, project, channel summaries and sorted tags."""
    i = c.info.select("id", "project_name", "filename", "format", "luminance_mean", "luminance_stddev", "color_space_tag")
    h = c.histograms.select("id", *[x for ch in "rgb" for x in histogram_summary(F.col(f"hist_{ch}"), ch)])
    out = i.join(h, "id")
    if not with_tags:
        return out
    tags = c.tags.groupBy(F.col("fingerprint_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("tag")), "|").alias("tags"))
    return out.join(tags, "id", "left").fillna("", ["tags"])


def fingerprints_by_project(c: Catalog) -> DataFrame:
    return c.info.select("id", "project_name", F.concat_ws("/", "path", "filename").alias("file_path"))


def fingerprints_by_path(c: Catalog, file_path: str) -> DataFrame:
    return fingerprints_by_project(c).where(F.col("file_path") == file_path)


def first_features(c: Catalog) -> DataFrame:
    """The first fingerprint with sound features of every file."""
    h = c.histograms.select("id", "file_id")
    return h.groupBy("file_id").agg(F.min("id").alias("fingerprint_id"))


def lut_dependencies(c: Catalog) -> DataFrame:
    """The newest export of every path, with its project and source file, through the fingerprint's file."""
    w = Window.partitionBy("output_path").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = c.luts.withColumn("n", F.row_number().over(w)).where("n = 1")
    fp = c.fingerprints.select(F.col("id").alias("fingerprint_id"), "file_id")
    f = c.files.select(F.col("id").alias("file_id"), "filename")
    p = c.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    out = newest.join(p, "project_id").join(fp, "fingerprint_id", "left").join(f, "file_id", "left")
    return out.select("output_path", F.col("id").alias("lut_id"), "project_name", "filename", "format", "grid_size", "created_at")


def lut_source_space(c: Catalog) -> DataFrame:
    """Color tag of each project's first fingerprint: the space an export without fingerprint takes."""
    first = c.info.groupBy("project_name").agg(F.min_by("color_space_tag", "id").alias("color_space_tag"), F.min("id").alias("fingerprint_id"))
    return first


def transfer_tag(transfer: Column) -> Column:
    return F.when(transfer.isin(*LOG_TRANSFERS), "log").when(transfer.isin(*VIDEO_TRANSFERS), "video").otherwise("linear")


def color_tag(format_: Column, transfer: Column) -> Column:
    """dpx files by their transfer characteristic; all else is linear."""
    return F.when(format_ == "dpx", transfer_tag(transfer)).otherwise("linear")


def color_tag_code(tag: Column) -> Column:
    return F.when(tag == "log", 1).when(tag == "video", 2).otherwise(0)


def vocabulary_of(path: str, default: list[str], key: str = "tags") -> list[str]:
    """The tags that a TOML file lists, trimmed, each once whatever its case, blank ones left out; the default if there is no such file or list."""
    import tomllib

    try:
        with open(path, "rb") as f:
            listed = tomllib.load(f)[key]
        if isinstance(listed, str):
            return default
        found: dict[str, str] = {}
        for t in listed:
            found.setdefault(t.strip().lower(), t.strip())
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return default
    return [t for t in found.values() if t]


def validate_entries(entries: DataFrame, vocabulary: DataFrame, materials: tuple[str, ...], spaces: tuple[str, ...], sidecar: str | None = None) -> DataFrame:
    """(entry_id, status, errors): enumerations, emptiness and vocabulary of dataset entries.

    A null field counts as unknown, a null tag array as empty; null elements are unknown tags.
    The vocabulary is joined, not listed, so it may have any size. `sidecar` names a boolean column that tells whether the
    metadata file exists; without it the only error is that it's missing.
    """
    e = entries.select("entry_id", "material_type", "color_space", "grading_style_tags", *([sidecar] if sidecar else []))
    known = vocabulary.select(F.col("tag").alias("t")).distinct().withColumn("known", F.lit(1))
    tags = e.select("entry_id", F.posexplode("grading_style_tags").alias("pos", "t")).join(known, "t", "left").where("known IS NULL")
    bad = tags.groupBy("entry_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: F.concat(F.lit("tag:"), F.coalesce(x["t"], F.lit("null")))).alias("bad"))
    x = e.join(bad, "entry_id", "left")
    field = lambda name, allowed: F.when(~F.coalesce(F.col(name), F.lit("")).isin(*allowed), F.concat(F.lit(f"{name}:"), F.coalesce(F.col(name), F.lit("null"))))
    empty = F.when(F.coalesce(F.size("grading_style_tags"), F.lit(0)) <= 0, F.lit("tags:empty"))
    errors = F.concat(F.array_compact(F.array(field("material_type", materials), field("color_space", spaces), empty)), F.coalesce("bad", F.array().cast("array<string>")))
    if sidecar:
        errors = F.when(F.col(sidecar), errors).otherwise(F.array(F.lit("sidecar:missing")))
    out = x.select("entry_id", errors.alias("errors"))
    return out.select("entry_id", F.when(F.size("errors") == 0, "valid").otherwise("invalid").alias("status"), F.array_join("errors", "; ").alias("errors"))


def last_search_start(sessions: DataFrame) -> DataFrame:
    return sessions.where("command = 'search'").groupBy("user").agg(F.max("started_at").alias("last_search"))


def search_to_export(sessions: DataFrame, slice_ms: int = 86_400_000) -> DataFrame:
    """(session_id, latency_ms): from each export back to its user's latest earlier search; only positive ones.

    An as-of join without a window over a user's whole log: events are sliced by time,
    ranked inside the slice, and the last search before a slice comes from a window over
    slices, whose number is bounded by time.
    """
    e = sessions.where("command IN ('search', 'export') AND user IS NOT NULL AND started_at IS NOT NULL").select("session_id", "user", "command", "started_at")
    e = e.withColumn("slice", F.floor(F.col("started_at") / slice_ms)).withColumn("s", F.when(F.col("command") == "search", F.col("started_at")))
    lasts = e.groupBy("user", "slice").agg(F.max("s").alias("m"))
    before = Window.partitionBy("user").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("user", "slice", F.max("m").over(before).alias("carried"))
    w = Window.partitionBy("user", "slice").orderBy("started_at").rangeBetween(Window.unboundedPreceding, -1)
    x = e.withColumn("here", F.max("s").over(w)).where("command = 'export'").join(carried, ["user", "slice"])
    x = x.select("session_id", (F.col("started_at") - F.coalesce("here", "carried")).alias("latency_ms"))
    return x.where("latency_ms > 0")


def histogram_delta(a: Column, b: Column, name: str) -> list[Column]:
    """Mean, greatest and total absolute difference, and the bin of the greatest (the first of equals)."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return [
        (total(d) / F.size(d)).alias(f"{name}_mean"), F.array_max(d).alias(f"{name}_max"), first_peak(d).cast("long").alias(f"{name}_bin"), total(d).alias(f"{name}_l1"),
    ]
