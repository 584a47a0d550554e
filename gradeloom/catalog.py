"""The catalog: tables as stored, and the views that other operators take as input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.vector import histogram
from gradeloom.storage import keep_latest, read_table, spread

L, S, D = T.LongType(), T.StringType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


#: Explicit schemas of the catalog, so no reader has to infer them.
SCHEMAS: dict[str, T.StructType] = {
    "projects": _schema(id=L, name=S, path=S, dpx_count=L, exr_count=L, mov_count=L, created_at=L),
    "files": _schema(id=L, project_id=L, filename=S, format=S, width=L, height=L, bit_depth=L, transfer=S, fps=D, duration=D, frame_count=L, created_at=L),
    "fingerprints": _schema(
        id=L, file_id=L, histogram_r=S, histogram_g=S, histogram_b=S, luminance_mean=D, luminance_stddev=D, color_space_tag=S,
        embedding=T.ArrayType(T.FloatType()), embedding_model=S, feature_status=S, created_at=L,
    ),
    "tags": _schema(id=L, fingerprint_id=L, tag=S, source=S, project_name=S, filename=S, created_at=L, ingested_at=T.TimestampNTZType()),
    "luts": _schema(id=L, project_id=L, fingerprint_id=L, title=S, format=S, grid_size=L, output_path=S, created_at=L),
    "search_feedback": _schema(id=L, project_name=S, file_path=S, file_format=S, action=S, search_type=S, created_at=L),
    "calibration_activities": _schema(id=L, project_name=S, fingerprint_id=L, removed_tags=S, added_tags=S, renamed_tags=S, created_at=L),
    "analytics_sessions": _schema(
        session_id=S, command=S, args_json=S, started_at=L, ended_at=L, duration_ms=L, exit_code=L, search_to_export_ms=L, user=S, created_at=L, ingested_at=T.TimestampNTZType()
    ),
    "session_messages": _schema(session_id=L, branch=S, seq=L, role=S, content=S, is_compacted=T.BooleanType()),
}


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) / 1000000).cast("long")


@dataclass(frozen=True)
class Catalog:
    """Tables of one data directory. Every property is lazy."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def projects(self) -> DataFrame:
        return self.table("projects")

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def fingerprints(self) -> DataFrame:
        """As stored; a luminance that is NaN is none, so it is null, as a database stores it."""
        measured = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("luminance_mean", "luminance_stddev")}
        return self.table("fingerprints").withColumns(measured)

    @property
    def tags(self) -> DataFrame:
        """Rows delivered twice count once; null and blank tags are no tags."""
        rows = self.table("tags").where("trim(tag) <> ''")
        return keep_latest(rows, ["id"], ["ingested_at"])

    @property
    def sessions(self) -> DataFrame:
        """One row per session_id: a later delivery replaces an earlier one."""
        return keep_latest(self.table("analytics_sessions").where("session_id IS NOT NULL"), ["session_id"], ["created_at", "ingested_at"])

    @property
    def info(self) -> DataFrame:
        """fingerprints with their file and project."""
        f = self.files.select(F.col("id").alias("file_id"), "project_id", "filename", "format", "transfer", "width", "height")
        p = self.projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), "path")
        return self.fingerprints.join(f, "file_id").join(p, "project_id")

    @property
    def histograms(self) -> DataFrame:
        """(id, file_id, hist_r, hist_g, hist_b) of fingerprints whose three texts are sound histograms.

        A generator makes the row, as a filter on the parsed columns would be pushed down and parse each text again.
        """
        names = [f"hist_{c}" for c in "rgb"]
        f = spread(self.table("fingerprints").select("id", "file_id", *[f"histogram_{c}" for c in "rgb"]))
        parsed = F.struct(*[histogram(F.col(f"histogram_{c}")).alias(n) for c, n in zip("rgb", names)])
        sound = F.filter(F.array(parsed), lambda x: x[names[0]].isNotNull() & x[names[1]].isNotNull() & x[names[2]].isNotNull())
        return f.select("id", "file_id", F.inline(sound).alias(*names))

    @property
    def feedback(self) -> DataFrame:
        """Accepted and rejected results: a search result with a score of 0.8 or more counts as accepted."""
        r = self.table("search_results").where("result_id IS NOT NULL AND project_name IS NOT NULL AND file_path IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
        r = r.dropDuplicates(["result_id"])
        action = F.when(F.col("score") >= 0.8, "accepted").otherwise("rejected")
        return r.select(
            F.col("result_id").alias("id"), "project_name", "file_path", "file_format", action.alias("action"), "search_type", epoch_seconds("logged_at").alias("created_at")
        )

    @property
    def calibrations(self) -> DataFrame:
        """One calibration per dataset entry; its style tags count as added, as a JSON array."""
        e = self.table("dataset_entries")
        added = F.to_json(F.coalesce(F.col("grading_style_tags"), F.array().cast("array<string>")))
        return e.select(
            F.col("entry_id").alias("id"), F.split_part("image_path", F.lit("/"), F.lit(4)).alias("project_name"), added.alias("added_tags"),
            F.lit("[]").alias("removed_tags"), "created_at",
        )

    @property
    def luts(self) -> DataFrame:
        """A lookup table for every fingerprint."""
        i = self.info
        kind = F.element_at(F.array(*[F.lit(x) for x in ("cube", "3dl", "look", "csp")]), (F.col("id") % 4 + 1).cast("int"))
        return i.select(
            "id", "project_id", F.col("id").alias("fingerprint_id"), F.concat(F.lit("grade "), F.col("id").cast("string")).alias("title"),
            kind.alias("format"), F.when(F.col("id") % 20 == 0, 33).otherwise(17).cast("long").alias("grid_size"),
            F.concat(F.lit("/luts/"), (F.col("id") % 50).cast("string"), F.lit("."), kind).alias("output_path"), "created_at",
        )

    @property
    def messages(self) -> DataFrame:
        """Chat logs: every line 'role: text' of an agent chat document is a message."""
        d = self.table("documents").where("source = 'agent_chat' AND text IS NOT NULL")
        lines = d.select(F.col("doc_id").alias("session_id"), "created_at", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        role = F.regexp_extract("line", r"^(user|assistant|system): ", 1)
        rows = lines.select("session_id", F.lit("main").alias("branch"), F.col("pos").cast("long").alias("seq"), role.alias("role"), F.regexp_replace("line", r"^(user|assistant|system): ", "").alias("content"))
        return rows.where("role <> ''").withColumn("is_compacted", F.lit(False))
