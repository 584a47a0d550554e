"""Sessions by keyed timers: batch against brute force, hostile rows, and the stream."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gradeloom.streaming.sessions import OpenSession, clean_commands, merged, sessionize, sessionize_stream, stream_sessions

LOG = "session_id string, command string, started_at long, ended_at long, user string, created_at long, ingested_at timestamp_ntz, command_extra string"


def brute(events: list[tuple[str, int, int]], gap: int) -> list[tuple]:
    out = []
    for user in sorted({e[0] for e in events}):
        own = sorted((a, b) for u, a, b in events if u == user)
        start, end, n = own[0][0], own[0][1], 0
        for a, b in own:
            if a > end + gap:
                out.append((user, start, end, n))
                start, end, n = a, b, 0
            end, n = max(end, b), n + 1
        out.append((user, start, end, n))
    return sorted(out)


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 80)), min_size=1, max_size=40))
def test_machine(events):
    m, got = OpenSession(10), []
    for a, d in sorted(events):
        if (done := m.event(a, a + d)) is not None:
            got.append(("u", *done))
    got.append(("u", *m.expire()))
    assert got == brute([("u", a, a + d) for a, d in events], 10)
    assert m.expire() is None


@pytest.mark.parametrize("slice_ms", [7, 100, 10**9])
def test_batch_against_brute_force(spark, slice_ms):
    rnd = random.Random(3)
    events = [(rnd.choice("aaab"), s, s + rnd.choice([0, 1, 5, 400])) for s in (rnd.randrange(3000) for _ in range(600))]
    df = spark.createDataFrame(events, "user_name string, start long, end long").repartition(5)
    got = sorted((r["user_name"], r["session_start"], r["session_end"], r["events"]) for r in sessionize(df, gap=9, slice_ms=slice_ms).collect())
    assert got == brute(events, 9)


def test_cleaning(spark):
    rows = [
        ("s1", "search", 1_500_000_000_000, 1_500_000_001_000, " Ann ", 10, None, "x"),
        ("s1", "search", 1_500_000_000_000, 1_500_000_009_000, "ANN", 11, None, "x"),  # the later delivery counts
        ("s2", "tag", 1_500_000_100, 1_500_000_160, "ann", 1, None, "x"),  # seconds
        ("s3", "tag", 1_500_000_200_000, 0, "ann", 1, None, "x"),  # ends before it starts
        ("s4", "tag", 1_500_000_300_000, None, "ann", 1, None, "x"),
        ("s5", "tag", 1_500_000_300_000, None, None, 1, None, "x"),
        ("s6", "tag", 1_500_000_300_000, None, "   ", 1, None, "x"),
        (None, "tag", 1_500_000_300_000, None, "ann", 1, None, "x"),
        ("s7", "tag", None, None, "ann", 1, None, "x"),
    ]
    got = sorted(tuple(r) for r in clean_commands(spark.createDataFrame(rows, LOG)).collect())
    assert got == [
        ("ann", 1_500_000_000_000, 1_500_000_009_000), ("ann", 1_500_000_100_000, 1_500_000_160_000), ("ann", 1_500_000_200_000, 1_500_000_200_000), ("ann", 1_500_000_300_000, 1_500_000_300_000),
    ]
    assert sessionize(clean_commands(spark.createDataFrame([], LOG))).count() == 0


def test_ties_and_repeats(spark):
    df = spark.createDataFrame([("a", 5, 5), ("a", 5, 5), ("a", 5, 9), (None, 1, 2), ("b", None, 2)], "user_name string, start long, end long")
    got = [tuple(r) for r in sessionize(df, gap=1).collect()]
    assert got == [("a", 5, 9, 4, 3)]


def test_stream(spark, tmp_path):
    """The streaming timers give the sessions of the batch for all keys whose timer the watermark has passed."""
    base = 1_700_000_000_000
    events = [("a", 0), ("a", 60), ("a", 5000), ("b", 100), ("a", 90), ("b", 120), ("z", 200_000)]
    src = tmp_path / "in"
    df = spark.createDataFrame([(u, base + s * 1000, base + s * 1000 + 500) for u, s in events], "user_name string, ms long, end long")
    df.selectExpr("user_name", "timestamp_millis(ms) AS ts", "end").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("user_name string, ts timestamp, end long").parquet(str(src))
    q = sessionize_stream(stream, gap=1_800_000, late="1 minute").writeStream.format("memory").queryName("stream_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = sorted(((r["user_name"], r["session_start"] - base, r["session_end"] - base, r["events"]) for r in spark.table("stream_sessions").collect()))
    finally:
        q.stop()
    assert got == [("a", 0, 90_500, 3), ("a", 5_000_000, 5_000_500, 1), ("b", 100_000, 120_500, 2)]


@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 80)), min_size=1, max_size=40), st.randoms())
def test_partial_sessions_merge_in_any_order(events, rnd):
    rows = [(a, a + d, 1) for a, d in events]
    want = [(s, e, n) for _, s, e, n in brute([("u", s, e) for s, e, _ in rows], 10)]
    rnd.shuffle(rows)
    parts: list = []
    while rows:
        k = rnd.randrange(1, 5)
        parts, rows = merged([*parts, *merged(rows[:k], 10)], 10), rows[k:]
    assert parts == want


def test_stream_of_a_table(spark):
    """Deliveries in parts give what the batch gives, with ties, repeats, overlaps and hot keys."""
    base = 1_700_000_000_000
    rnd = random.Random(8)
    events = [(rnd.choice(["hot"] * 6 + ["a", "b", "c", None]), base + s, base + s + rnd.choice([0, 1000, 90_000_000])) for s in (rnd.randrange(40) * 900_000 for _ in range(400))]
    df = spark.createDataFrame(events, "user_name string, start long, end long").repartition(3)
    got = sorted(tuple(r) for r in stream_sessions(df, batches=3, late="2 hours").collect())
    assert got == sorted(tuple(r) for r in sessionize(df).collect())
    assert stream_sessions(df.limit(0)).count() == 0
