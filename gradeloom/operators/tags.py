"""Changes of tags and chat logs, as transforms of immutable tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.storage import materialize


@dataclass(frozen=True)
class Change:
    """The table after a change, and the rows it touched (whose count the caller may want)."""

    table: DataFrame
    touched: DataFrame


class TagError(ValueError):
    """A change that the rules refuse."""


def _sound(tag: str) -> str:
    if not tag or not tag.strip():
        raise TagError("a tag must not be blank")
    return tag


def add_tag(tags: DataFrame, fingerprint_id: int, tag: str, source: str = "manual") -> Change:
    """Adds one tag; a fingerprint that has it already is an error."""
    _sound(tag)
    if tags.where((F.col("fingerprint_id") == fingerprint_id) & (F.col("tag") == tag)).head(1):
        raise TagError(f"fingerprint {fingerprint_id} has the tag already")
    new = tags.sparkSession.range(1).select(F.lit(fingerprint_id).cast("long").alias("fingerprint_id"), F.lit(tag).alias("tag"), F.lit(source).alias("source"))
    return Change(tags.unionByName(new, allowMissingColumns=True), new)


def remove_tag(tags: DataFrame, fingerprint_id: int, tag: str) -> Change:
    gone = (F.col("fingerprint_id") == fingerprint_id) & (F.col("tag") == tag)
    hit = tags.where(gone)
    if not hit.head(1):
        raise TagError("no such tag")
    return Change(tags.where(~F.coalesce(gone, F.lit(False))), hit)


def add_to_project(tags: DataFrame, fingerprints: DataFrame, tag: str, source: str = "manual") -> Change:
    """Adds the tag to all given fingerprints (column fingerprint_id) that lack it."""
    _sound(tag)
    has = tags.where(F.col("tag") == tag).select("fingerprint_id").distinct()
    new = fingerprints.select("fingerprint_id").distinct().join(has, "fingerprint_id", "left_anti")
    new = new.select("fingerprint_id", F.lit(tag).alias("tag"), F.lit(source).alias("source"))
    return Change(tags.unionByName(new, allowMissingColumns=True), new)


def remove_from_project(tags: DataFrame, fingerprints: DataFrame, tag: str) -> Change:
    marked = tags.join(fingerprints.select("fingerprint_id").distinct().withColumn("__in", F.lit(True)), "fingerprint_id", "left")
    gone = F.coalesce((F.col("tag") == tag) & F.col("__in"), F.lit(False))
    return Change(marked.where(~gone).drop("__in"), marked.where(gone).drop("__in"))


def rename_tag(tags: DataFrame, fingerprints: DataFrame, old: str, new: str, strict: bool = True) -> Change:
    """Renames a tag on the given fingerprints, all or nothing; sources stay.

    No hit is an error, and so is any fingerprint that has the new tag already. Without `strict` neither is:
    no hit leaves the table as it is, a tag that meets its own new name stays a row of its own, as in SQL.
    """
    _sound(new)
    ids = fingerprints.select("fingerprint_id").distinct()
    hit = tags.where(F.col("tag") == old).join(ids, "fingerprint_id", "left_semi")
    if strict:
        state = hit.select("fingerprint_id").distinct().join(tags.where(F.col("tag") == new).select("fingerprint_id").distinct().withColumn("taken", F.lit(1)), "fingerprint_id", "left")
        n = state.agg(F.count("*").alias("hits"), F.count("taken").alias("conflicts")).first()
        if not n["hits"]:
            raise TagError("no such tag")
        if n["conflicts"] and new != old:
            raise TagError("the new tag exists already")
    marked = tags.join(ids.withColumn("__in", F.lit(True)), "fingerprint_id", "left")
    name = F.when(F.col("__in") & (F.col("tag") == old), F.lit(new)).otherwise(F.col("tag"))
    return Change(marked.withColumn("tag", name).drop("__in"), hit)


def calibration_row(project: str, fingerprint_id: int | None, removed: list[str], added: list[str], renamed: list[tuple[str, str]], spark, created_at: int) -> DataFrame:
    """The log row of a calibration, with JSON arrays of its tags."""
    import json

    row = (project, fingerprint_id, json.dumps(removed), json.dumps(added), json.dumps([list(r) for r in renamed]), created_at)
    return spark.createDataFrame([row], "project_name string, fingerprint_id long, removed_tags string, added_tags string, renamed_tags string, created_at long")


def needs_calibration(sources: str | None, action: str) -> bool:
    """Additions and renamings are logged always, removals only of tags that the model alone gave."""
    return action in ("add", "rename") or (action == "remove" and sources == "ai")


def branch_messages(messages: DataFrame, session_id: int, branch: str = "main") -> DataFrame:
    return messages.where((F.col("session_id") == session_id) & (F.col("branch") == branch) & ~F.col("is_compacted")).orderBy("seq")


def compact(messages: DataFrame, session_id: int, branch: str, until: int, summary: str) -> Change:
    """Marks messages up to `until` compacted and puts a system summary in their place, before the kept ones."""
    own = (F.col("session_id") == session_id) & (F.col("branch") == branch)
    old = own & (F.col("seq") <= until) & ~F.col("is_compacted")
    marked = messages.withColumn("is_compacted", F.when(old, True).otherwise(F.col("is_compacted")))
    line = messages.sparkSession.range(1).select(
        F.lit(session_id).cast("long").alias("session_id"), F.lit(branch).alias("branch"), F.lit(until).cast("long").alias("seq"), F.lit("system").alias("role"), F.lit(summary).alias("content"), F.lit(False).alias("is_compacted")
    )
    return Change(marked.unionByName(line), messages.where(old))


def new_session(spark: SparkSession, session_id: int | str, created_at: int, provider: str | None = None, model: str | None = None, title: str = "New Session") -> DataFrame:
    """The row of a chat session, to be appended."""
    kind = "long" if isinstance(session_id, int) else "string"
    return spark.createDataFrame([(session_id, title, provider, model, created_at, created_at)], f"session_id {kind}, title string, provider string, model string, created_at long, updated_at long")


def sessions_listed(sessions: DataFrame, k: int | None = None) -> DataFrame:
    """Newest first, by the last update; ties by session."""
    out = sessions.orderBy(F.col("updated_at").desc(), "session_id")
    return out if k is None else out.limit(k)


def new_branch(branches: DataFrame, session_id: int | str, branch_id: int | str, name: str, created_at: int, parent_id: int | str | None = None, at_seq: int = 0) -> Change:
    """Adds a branch; a name that the session has already, or a parent it hasn't, is an error. Without a parent it is a root, as 'main'."""
    own = branches.where(F.col("session_id") == session_id)
    found = own.agg(F.count_if(F.col("name") == name).alias("same"), F.count_if(F.col("branch_id") == F.lit(parent_id)).alias("parent")).first()
    if found["same"]:
        raise TagError(f"the session has a branch {name!r}")
    if parent_id is not None and not found["parent"]:
        raise TagError("no such parent branch")
    fields = {"session_id": session_id, "branch_id": branch_id, "parent_id": parent_id, "branch_point_seq": at_seq, "name": name, "created_at": created_at}
    kinds = dict(branches.dtypes)
    row = branches.sparkSession.range(1).select(*[F.lit(v).cast(kinds.get(k, "string" if k == "name" else "long")).alias(k) for k, v in fields.items()])
    return Change(branches.unionByName(row, allowMissingColumns=True), row)


def branches_of(branches: DataFrame, session_id: int | str) -> DataFrame:
    """A session's branches, oldest first."""
    return branches.where(F.col("session_id") == session_id).orderBy("created_at", "branch_id")


def branch_by_name(branches: DataFrame, session_id: int | str, name: str = "main") -> DataFrame:
    return branches.where((F.col("session_id") == session_id) & (F.col("name") == name)).select("branch_id")


def branch_tree(branches: DataFrame, depth: int | None = None) -> DataFrame:
    """(session_id, branch_id, root, level, path) from (session_id, branch_id, parent_id, name); `depth` leaves out deeper levels.

    Every round doubles the stretch that a branch knows of the way to its root, so a chain
    of a million branches takes twenty rounds. Branches whose parents form a loop or are missing
    belong to no root and don't come out.
    """
    b = branches.select("session_id", "branch_id", "parent_id", F.col("name").cast("string").alias("path"))
    done = b.where("parent_id IS NULL").select("session_id", "branch_id", F.col("branch_id").alias("root"), F.lit(0).alias("level"), "path")
    way = b.where("parent_id IS NOT NULL").select("session_id", "branch_id", F.col("parent_id").alias("up"), F.lit(1).alias("level"), "path")
    while True:
        top = done.select("session_id", F.col("branch_id").alias("up"), "root", F.col("level").alias("l"), F.col("path").alias("p"))
        new = way.join(top, ["session_id", "up"]).select("session_id", "branch_id", "root", (F.col("l") + F.col("level")).alias("level"), F.concat_ws("/", "p", "path").alias("path"))
        new = materialize(new, "branches")
        if not new.head(1):
            break
        next_ = way.select("session_id", F.col("branch_id").alias("up"), F.col("up").alias("u"), F.col("level").alias("l"), F.col("path").alias("p"))
        way = way.join(next_, ["session_id", "up"]).join(new.select("session_id", "branch_id"), ["session_id", "branch_id"], "left_anti")
        way = materialize(way.select("session_id", "branch_id", F.col("u").alias("up"), (F.col("level") + F.col("l")).alias("level"), F.concat_ws("/", "p", "path").alias("path")), "ways")
        done = done.unionByName(new)
    return done if depth is None else done.where(F.col("level") <= depth)


def next_sequence(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id", "branch").agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))
