"""Catalog queries P1-P23."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.operators import lookup as ops
from gradeloom.plans.registry import query
from gradeloom.plans.sqltext import HISTS, INFO, LUTS, SESSIONS, TAGS, measured_sql, with_

PROJECT = "glass_estuary"
MATERIALS, SPACES = ("dpx", "exr", "mov"), ("srgb", "acescct", "linear", "rec709", "log")


def mean_sql(h: str) -> str:
    return f"round(list_sum({h}) / len({h}), 6)"


def last_peak_sql(h: str) -> str:
    return f"(len({h}) - list_position(list_reverse({h}), list_max({h})))"


@query(
    "catalog_projects",
    """SELECT p.id, p.name, p.path, p.dpx_count, p.exr_count, p.mov_count, p.created_at, coalesce(fc.n, 0) AS file_count, coalesce(fp.n, 0) AS fingerprint_count
  FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n FROM files GROUP BY 1) fc ON fc.project_id = p.id
  LEFT JOIN (SELECT f.project_id, count(*) AS n FROM fingerprints x JOIN files f ON f.id = x.file_id GROUP BY 1) fp ON fp.project_id = p.id""",
)
def catalog_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_projects(Catalog(spark, sf_dir))


@query(
    "catalog_files",
    f"""SELECT f.id, f.filename, f.format, coalesce(c.n, 0) AS fingerprint_count, f.created_at FROM files f JOIN projects p ON p.id = f.project_id
  LEFT JOIN (SELECT file_id, count(*) AS n FROM fingerprints GROUP BY 1) c ON c.file_id = f.id WHERE p.name = '{PROJECT}'""",
)
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_files(Catalog(spark, sf_dir), PROJECT)


TAG_LIST = "SELECT t.id, t.tag, t.source, i.project_name AS project, i.filename AS file, t.created_at FROM tg t JOIN inf i ON i.id = t.fingerprint_id"


@query("catalog_tags", with_(TAGS, INFO) + TAG_LIST)
def catalog_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_tags(Catalog(spark, sf_dir))


@query("catalog_tags_of_project", with_(TAGS, INFO) + TAG_LIST + f" WHERE i.project_name = '{PROJECT}'")
def catalog_tags_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_tags(Catalog(spark, sf_dir), PROJECT)


@query("catalog_luts", with_(INFO, LUTS) + "SELECT l.id, p.name AS project_name, l.title, l.format, l.grid_size, l.output_path, l.created_at FROM lt l JOIN projects p ON p.id = l.project_id")
def catalog_luts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_luts(Catalog(spark, sf_dir))


@query("catalog_sql", "SELECT coalesce(CAST(format AS VARCHAR), 'NULL') AS format, CAST(count(*) AS VARCHAR) AS n, coalesce(CAST(max(bit_depth) AS VARCHAR), 'NULL') AS deepest FROM files GROUP BY format")
def catalog_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gradeloom.operators.sql import select_as_text

    return select_as_text(Catalog(spark, sf_dir), "SELECT format, count(*) AS n, max(bit_depth) AS deepest FROM files GROUP BY format", ["files"])


@query("resolve_files", "SELECT concat_ws('/', p.path, f.filename) AS path, min(g.id) AS file_id, count(*) AS matches FROM files f JOIN projects p ON p.id = f.project_id JOIN files g ON g.filename = f.filename GROUP BY 1")
def resolve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image path against base names: smallest file id and how many match."""
    c = Catalog(spark, sf_dir)
    paths = c.files.join(c.projects.select(F.col("id").alias("project_id"), "path"), "project_id").select(F.concat_ws("/", "path", "filename").alias("path"))
    return ops.resolve_images(c, paths)


FIRST_NAME = f"SELECT min(f.filename) FROM files f JOIN projects p ON p.id = f.project_id WHERE p.name = '{PROJECT}'"


def _first_name(c: Catalog) -> str:
    """A file name that the project has, whatever the tables."""
    p = c.projects.where(F.col("name") == PROJECT).select(F.col("id").alias("project_id"))
    return c.files.join(p, "project_id", "left_semi").agg(F.min("filename")).first()[0]


@query("resolve_file_id", f"SELECT min(f.id) AS file_id FROM files f JOIN projects p ON p.id = f.project_id WHERE p.name = '{PROJECT}' AND f.filename = ({FIRST_NAME}) HAVING min(f.id) IS NOT NULL")
def resolve_file_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return ops.resolve_file(c, PROJECT, _first_name(c))


@query("resolve_fingerprint_id", f"SELECT min(x.id) AS fingerprint_id FROM fingerprints x JOIN files f ON f.id = x.file_id JOIN projects p ON p.id = f.project_id WHERE p.name = '{PROJECT}' AND f.filename = (SELECT min(filename) FROM files g JOIN fingerprints y ON y.file_id = g.id JOIN projects p ON p.id = g.project_id WHERE p.name = '{PROJECT}')")
def resolve_fingerprint_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    name = c.info.where(F.col("project_name") == PROJECT).agg(F.min("filename")).first()[0]
    return ops.resolve_fingerprint(c, PROJECT, name)


@query("fingerprints_by_path", with_(INFO) + "SELECT id, project_name, path || '/' || filename AS file_path FROM inf WHERE path || '/' || filename = (SELECT max(path || '/' || filename) FROM inf)")
def fingerprints_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return ops.fingerprints_by_path(c, ops.fingerprints_by_project(c).agg(F.max("file_path")).first()[0])


@query("resolve_fingerprint_ids", with_(INFO) + "SELECT project_name, filename, min(id) AS fingerprint_id FROM inf GROUP BY 1, 2")
def resolve_fingerprint_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.resolve_fingerprints(Catalog(spark, sf_dir))


INFO_COLS = ", ".join(f"{mean_sql('h.hist_' + c)} AS {c}_mean, {last_peak_sql('h.hist_' + c)} AS {c}_peak" for c in "rgb")


@query(
    "fingerprint_info",
    with_(INFO, HISTS, TAGS) + f"""SELECT i.id, i.project_name, i.filename, i.format, {measured_sql('i.luminance_mean')} AS luminance_mean, {measured_sql('i.luminance_stddev')} AS luminance_stddev, i.color_space_tag, {INFO_COLS}, coalesce(t.tags, '') AS tags
  FROM inf i JOIN hi h ON h.id = i.id LEFT JOIN (SELECT fingerprint_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (SELECT DISTINCT fingerprint_id, tag FROM tg) GROUP BY 1) t ON t.fingerprint_id = i.id""",
)
def fingerprint_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ops.fingerprint_info(Catalog(spark, sf_dir))
    return x.withColumns({f"{c}_mean": F.round(f"{c}_mean", 6) for c in "rgb"})


@query("fingerprints_by_project", with_(INFO) + "SELECT id, project_name, path || '/' || filename AS file_path FROM inf")
def fingerprints_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fingerprints_by_project(Catalog(spark, sf_dir))


@query("first_features", with_(HISTS) + "SELECT file_id, min(id) AS fingerprint_id FROM hi GROUP BY 1")
def first_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_features(Catalog(spark, sf_dir))


@query(
    "lut_dependencies",
    with_(INFO, LUTS) + """SELECT output_path, l.id AS lut_id, p.name AS project_name, f.filename, l.format, l.grid_size, l.created_at FROM
  (SELECT *, row_number() OVER (PARTITION BY output_path ORDER BY created_at DESC, id DESC) AS n FROM lt) l JOIN projects p ON p.id = l.project_id
  LEFT JOIN fingerprints x ON x.id = l.fingerprint_id LEFT JOIN files f ON f.id = x.file_id WHERE n = 1""",
)
def lut_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lut_dependencies(Catalog(spark, sf_dir))


@query("lut_source_space", with_(INFO) + "SELECT project_name, arg_min(color_space_tag, id) AS color_space_tag, min(id) AS fingerprint_id FROM inf GROUP BY 1")
def lut_source_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lut_source_space(Catalog(spark, sf_dir))


@query(
    "file_color_tags",
    """SELECT id, CASE WHEN format <> 'dpx' THEN 'linear' WHEN transfer IN ('printing_density', 'logarithmic') THEN 'log'
  WHEN transfer IN ('bt709', 'bt601_bg', 'bt601_m', 'smpte_274m', 'unspecified_video', 'ntsc_composite', 'pal_composite') THEN 'video' ELSE 'linear' END AS color_tag,
  CASE WHEN format = 'dpx' AND transfer IN ('printing_density', 'logarithmic') THEN 1
  WHEN format = 'dpx' AND transfer IN ('bt709', 'bt601_bg', 'bt601_m', 'smpte_274m', 'unspecified_video', 'ntsc_composite', 'pal_composite') THEN 2 ELSE 0 END AS code FROM files""",
)
def file_color_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = ops.color_tag(F.col("format"), F.col("transfer"))
    return Catalog(spark, sf_dir).files.select("id", tag.alias("color_tag")).withColumn("code", ops.color_tag_code(F.col("color_tag")))


@query(
    "validate_entries",
    """WITH b AS (SELECT e.entry_id, string_agg('tag:' || coalesce(e.t, 'null'), '; ' ORDER BY e.pos) AS bad FROM
    (SELECT entry_id, unnest(grading_style_tags) AS t, generate_subscripts(grading_style_tags, 1) AS pos FROM dataset_entries) e
    LEFT JOIN style_vocabulary v ON v.tag = e.t WHERE v.tag IS NULL GROUP BY 1),
  x AS (SELECT e.entry_id, concat_ws('; ', CASE WHEN coalesce(material_type, '') NOT IN ('dpx', 'exr', 'mov') THEN 'material_type:' || coalesce(material_type, 'null') END,
    CASE WHEN coalesce(color_space, '') NOT IN ('srgb', 'acescct', 'linear', 'rec709', 'log') THEN 'color_space:' || coalesce(color_space, 'null') END,
    CASE WHEN coalesce(len(grading_style_tags), 0) = 0 THEN 'tags:empty' END, b.bad) AS errors FROM dataset_entries e LEFT JOIN b ON b.entry_id = e.entry_id)
  SELECT entry_id, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS status, errors FROM x""",
)
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark, sf_dir)
    return ops.validate_entries(c.table("dataset_entries"), c.table("style_vocabulary"), MATERIALS, SPACES)


@query("last_search_start", with_(SESSIONS) + """SELECT "user", max(started_at) AS last_search FROM ses WHERE command = 'search' GROUP BY 1""")
def last_search_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_search_start(Catalog(spark, sf_dir).sessions)


@query(
    "search_to_export",
    with_(SESSIONS) + """SELECT session_id, latency_ms FROM (SELECT session_id, command, started_at - max(CASE WHEN command = 'search' THEN started_at END)
  OVER (PARTITION BY "user" ORDER BY started_at RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latency_ms FROM ses WHERE "user" IS NOT NULL) WHERE command = 'export' AND latency_ms > 0""",
)
def search_to_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_to_export(Catalog(spark, sf_dir).sessions)
