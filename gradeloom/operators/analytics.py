"""Usage analytics over sessions, feedback, calibrations and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEK = 604_800


def since(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) >= value)


def of_user(sessions: DataFrame, user: str | None) -> DataFrame:
    return sessions if user is None else sessions.where(F.col("user") == user)


def session_count(sessions: DataFrame, start: int | None = None) -> DataFrame:
    return since(sessions, "started_at", start).agg(F.count("*").alias("sessions"))


def average_duration(sessions: DataFrame, start: int | None = None) -> DataFrame:
    """Mean duration of successful sessions in whole milliseconds, cut off; 0 if there is none."""
    ok = since(sessions, "started_at", start).where("exit_code = 0")
    return ok.agg(F.floor(F.coalesce(F.avg("duration_ms"), F.lit(0.0))).cast("long").alias("avg_duration_ms"))


def command_breakdown(sessions: DataFrame, start: int | None = None, user: str | None = None) -> DataFrame:
    return of_user(since(sessions, "started_at", start), user).groupBy("command").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "command")


def recent_sessions(sessions: DataFrame, n: int = 20, start: int | None = None, user: str | None = None) -> DataFrame:
    """The newest n; ties by session_id."""
    cols = ["session_id", "command", "started_at", "duration_ms", "exit_code", "user"]
    return of_user(since(sessions, "started_at", start), user).select(*cols).orderBy(F.col("started_at").desc(), "session_id").limit(n)


def rate(accepted: Column, total: Column) -> Column:
    return F.when(total > 0, accepted / total).otherwise(F.lit(0.0))


def _hits() -> list[Column]:
    return [F.count_if(F.col("action") == "accepted").alias("accepted"), F.count_if(F.col("action") == "rejected").alias("rejected"), F.count("*").alias("total")]


def hit_rate(feedback: DataFrame, start: int | None = None) -> DataFrame:
    return since(feedback, "created_at", start).agg(*_hits()).withColumn("hit_rate", rate(F.col("accepted"), F.col("total")))


def hit_rate_by_type(feedback: DataFrame, start: int | None = None) -> DataFrame:
    """Grouped by the stored type, so null and a literal 'unknown' stay two rows of that name."""
    g = since(feedback, "created_at", start).groupBy("search_type").agg(*_hits())
    g = g.withColumn("hit_rate", rate(F.col("accepted"), F.col("total")))
    return g.withColumn("search_type", F.coalesce("search_type", F.lit("unknown"))).orderBy(F.col("total").desc(), "search_type")


def calibration_metrics(calibrations: DataFrame, start: int | None = None) -> DataFrame:
    """Per project: number and time of the last calibration."""
    g = since(calibrations, "created_at", start).groupBy("project_name").agg(F.count("*").alias("calibrations"), F.max("created_at").alias("last_at"))
    return g.orderBy(F.col("calibrations").desc(), "project_name")


def weekly_trend(feedback: DataFrame, start: int | None = None) -> DataFrame:
    """Seven-day buckets from the epoch on."""
    week = (F.expr(f"created_at div {WEEK}") * WEEK).alias("week_start")
    g = since(feedback, "created_at", start).groupBy(week).agg(*_hits())
    return g.withColumn("hit_rate", rate(F.col("accepted"), F.col("total"))).orderBy("week_start")


def trend_direction(trend: DataFrame) -> DataFrame:
    """up, down or flat, from the first to the last bucket; 'unknown' with less than two."""
    t = trend.agg(F.count("*").alias("weeks"), F.min_by("hit_rate", "week_start").alias("first_rate"), F.max_by("hit_rate", "week_start").alias("last_rate"))
    way = F.when(F.col("weeks") < 2, "unknown").when(F.col("last_rate") > F.col("first_rate"), "up").when(F.col("last_rate") < F.col("first_rate"), "down").otherwise("flat")
    return t.withColumn("direction", way)


def added_tags(calibrations: DataFrame) -> DataFrame:
    """One row per tag added in a calibration."""
    return calibrations.select("project_name", "created_at", F.explode(F.from_json("added_tags", "array<string>")).alias("tag")).where("tag IS NOT NULL")


def vocabulary_size(tags: DataFrame, calibrations: DataFrame, start: int | None = None) -> DataFrame:
    """Distinct manual and calibrated tags in all, and since `start`."""
    manual = tags.where("source = 'manual'").select("tag", "created_at")
    both = manual.unionByName(added_tags(calibrations).select("tag", "created_at"))
    by_tag = both.groupBy("tag").agg(F.max("created_at").alias("last"))
    recent = F.count_if(F.col("last") >= start) if start is not None else F.count("*")
    return by_tag.agg(F.count("*").alias("total_tags"), recent.alias("recent_tags"))


def top_tags(tags: DataFrame, calibrations: DataFrame, n: int = 10) -> DataFrame:
    """Manual tags and added ones by frequency; ties by tag."""
    manual = tags.where("source = 'manual'").groupBy("tag").agg(F.count("*").alias("n"))
    added = added_tags(calibrations).groupBy("tag").agg(F.count("*").alias("n"))
    return manual.unionByName(added).groupBy("tag").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "tag").limit(n)


def personalised_tags(tags: DataFrame, calibrations: DataFrame) -> DataFrame:
    """The same counts for each project."""
    manual = tags.where("source = 'manual' AND project_name IS NOT NULL").select("project_name", "tag")
    both = manual.unionByName(added_tags(calibrations).select("project_name", "tag"))
    return both.groupBy("project_name", "tag").agg(F.count("*").alias("total"))


def user_stats(sessions: DataFrame, start: int | None = None) -> DataFrame:
    """Sessions, rounded mean duration of successful ones, searches and last start of every user; users without name are left out."""
    ok = F.when(F.col("exit_code") == 0, F.col("duration_ms"))
    s = since(sessions, "started_at", start).where("user <> ''")
    return s.groupBy("user").agg(
        F.count("*").alias("sessions"), F.round(F.coalesce(F.avg(ok), F.lit(0.0))).cast("long").alias("avg_duration_ms"),
        F.sum(F.when(F.col("command") == "search", 1).otherwise(0)).alias("searches"), F.max("started_at").alias("last_started_at"),
    ).orderBy(F.col("sessions").desc(), "user")


def users(sessions: DataFrame) -> DataFrame:
    return sessions.where("user <> ''").select("user").distinct().orderBy("user")


def project_tags(tags: DataFrame) -> DataFrame:
    return tags.where("project_name IS NOT NULL").select("project_name", "tag").distinct().orderBy("project_name", "tag")


def project_tag_sources(tags: DataFrame) -> DataFrame:
    """Each tag of a project with its distinct sources, sorted and joined by ', '."""
    t = tags.where("project_name IS NOT NULL")
    return t.groupBy("project_name", "tag").agg(F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"))


def tag_sources(tags: DataFrame) -> DataFrame:
    return tags.select("fingerprint_id", "tag", "source").distinct().orderBy("fingerprint_id", "tag", "source")


def first_feedback(feedback: DataFrame) -> DataFrame:
    """The first action on each (project, file) counts; later ones are ignored. Unknown actions are refused."""
    known = feedback.where(F.col("action").isin("accepted", "rejected"))
    first = known.groupBy("project_name", "file_path").agg(F.min(F.struct("created_at", "id", "action", "search_type")).alias("f"))
    return first.select("project_name", "file_path", "f.id", "f.action", "f.search_type", "f.created_at")


def message_counts(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Number of messages of every chat, 0 included."""
    n = messages.groupBy("session_id").agg(F.count("seq").alias("messages"), F.max("seq").alias("last_seq"))
    return sessions.select("session_id").distinct().join(n, "session_id", "left").select(
        "session_id", F.coalesce("messages", F.lit(0)).alias("messages"), (F.coalesce("last_seq", F.lit(-1)) + 1).alias("next_seq")
    )


def feedback_trend_stream(feedback: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Weekly hit rates of a stream: repeated ids are dropped within the watermark, late rows beyond it are lost."""
    rows = feedback.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"])
    g = rows.groupBy(F.window(ts, "7 days").alias("w")).agg(F.count_if(F.col("action") == "accepted").alias("accepted"), F.count("*").alias("total"))
    return g.select(F.col("w.start").alias("week_start"), "accepted", "total", rate(F.col("accepted"), F.col("total")).alias("hit_rate"))


def last_messages(messages: DataFrame, keep: int = 6, compact_from: int = 20) -> tuple[DataFrame, DataFrame]:
    """(kept, compacted) messages: branches of at least `compact_from` messages keep their last `keep`.

    Sequence numbers are dense per branch, so the cut follows from one aggregate per
    branch; no window sorts a branch.
    """
    live = messages.where("NOT is_compacted")
    size = live.groupBy("session_id", "branch").agg(F.count("*").alias("n"), F.sort_array(F.slice(F.sort_array(F.collect_list("seq"), False), 1, keep)).alias("tail"))
    x = live.join(size, ["session_id", "branch"])
    old = (F.col("n") >= compact_from) & (F.col("seq") < F.array_min("tail"))
    return x.where(~old).select(*messages.columns), x.where(old).withColumn("is_compacted", F.lit(True)).select(*messages.columns)

