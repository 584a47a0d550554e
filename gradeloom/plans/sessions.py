"""Queries on working sessions (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans.registry import query
from gradeloom.storage import read_table
from gradeloom.streaming.sessions import clean_commands, sessionize, stream_sessions

SESSIONS_SQL = """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, ingested_at DESC,
    ended_at DESC NULLS LAST) AS n FROM analytics_sessions) WHERE n = 1),
  ms AS (SELECT lower(trim("user", ' ')) AS u, CASE WHEN started_at < 100000000000 THEN started_at * 1000 ELSE started_at END AS s,
    CASE WHEN ended_at < 100000000000 THEN ended_at * 1000 ELSE ended_at END AS e FROM latest),
  c AS (SELECT u, s, greatest(s, coalesce(e, s)) AS e FROM ms WHERE u <> '' AND s IS NOT NULL),
  m AS (SELECT *, max(e) OVER (PARTITION BY u ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM c),
  g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
  """


@query("p5_found", SESSIONS_SQL + "SELECT u AS user_name, min(s) AS session_start, max(e) AS session_end FROM g GROUP BY u, k")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working sessions of every user."""
    return sessionize(clean_commands(read_table(spark, sf_dir, "analytics_sessions"))).select("user_name", "session_start", "session_end")


WHOLE = SESSIONS_SQL + "SELECT u AS user_name, min(s) AS session_start, max(e) AS session_end, max(e) - min(s) AS duration_ms, count(*) AS events FROM g GROUP BY u, k"


@query("p5_stream", WHOLE)
def p5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from keyed streaming timers, the log delivered in three parts."""
    return stream_sessions(clean_commands(read_table(spark, sf_dir, "analytics_sessions")))


@query("p5_sessions", WHOLE)
def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Working sessions with duration and number of commands."""
    return sessionize(clean_commands(read_table(spark, sf_dir, "analytics_sessions")))
