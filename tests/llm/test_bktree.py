from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import bktree

VOCABULARY = [(1, "gilded_skyline"), (2, "plum_ceiling"), (3, "underlit"), (4, "ember_dusk"), (5, "ashen_dusk")]


def slow(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_distance(a, b):
    assert bktree.edit_distance(a, b) == slow(a, b) == bktree.edit_distance(b, a)


@settings(max_examples=60)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=30), st.text("abc", max_size=7), st.integers(0, 5))
def test_tree_finds_all_within(words, asked, radius):
    tree = bktree.BKTree()
    for i, w in enumerate(words):
        tree.add(w, i)
    want = sorted((slow(asked, w), i, w) for i, w in enumerate(words) if slow(asked, w) <= radius)
    assert tree.within(asked, radius) == want
    got = tree.nearest(asked, radius)
    assert (got is None) == (not want)
    if want:
        assert got == min((d, -len(w), i) for d, i, w in want)


@pytest.mark.parametrize(
    ("typed", "key"),
    [
        ("Gilded Skyline", 1), ("g1ld3d_skyl1n3", 1), ("skyline/gilded", 1), ("ｇｉｌｄｅｄ_ｓｋｙｌｉｎｅ", 1), ("gіldеd_skylіne", 1), ("gil​ded-sky\xa0line", 1), ("gilded_sky…", 1), ("glddskyln", 1),
        ("plúm  cèiling", 2), ("plumCeiling v2", 2), ("more underlit", 3), ("#underlit?", 3), ("mber_dsk", 4), ("ref #12", -1), ("wip", -1), ("???", -1), ("night crew queue", -1),
    ],
)
def test_spellings(spark, typed, key):
    tree = bktree.build(VOCABULARY)
    got = bktree._search(tree, typed, bktree.SHARE)
    assert (got[2] if got else -1) == key


def test_cases_and_shards(spark, monkeypatch):
    tags = spark.createDataFrame(
        [(1, "Plum Ceiling", "x"), (1, "Plum Ceiling", "x"), (2, "underlit", "x"), (3, None, "x"), (4, "   ", "x"), (5, " underlit", "x"), (6, "wip", "x"), (None, "undrlit", "x"), (7, "dusk", "x"), (8, "\t", "x")],
        "id long, tag string, value string",
    )
    entries = spark.createDataFrame([(1, ["ember dsk", None, "", "ember_dusk", "ember dsk"]), (2, None), (3, [])], "entry_id long, grading_style_tags array<string>")
    vocabulary = spark.createDataFrame([*VOCABULARY, (9, None)], "vocab_id long, tag string")
    want = [
        ("dataset_entries", 1, 0, 4), ("dataset_entries", 1, 4, 4), ("tags", 1, 0, 2), ("tags", 5, 0, 3), ("tags", 6, 0, -1), ("tags", 7, 0, -1), ("tags", 8, 0, -1),
    ]
    assert sorted(tuple(r) for r in bktree.canonical_values(tags, entries, vocabulary).collect()) == want
    monkeypatch.setattr(bktree, "BROADCAST_ENTRIES", 2)
    assert sorted(tuple(r) for r in bktree.canonical_values(tags, entries, vocabulary).collect()) == want
    assert {r[3] for r in bktree.canonical_values(tags, entries, vocabulary.limit(0)).collect()} == {-1}
    assert bktree.canonical_values(tags.limit(0), entries.limit(0), vocabulary).count() == 0


def test_very_long_value():
    tree = bktree.build(VOCABULARY)
    assert bktree._search(tree, "gilded skyline " * 20_000, bktree.SHARE) is None


def test_random_typos():
    rnd = random.Random(5)
    tree = bktree.build(VOCABULARY)
    for key, entry in VOCABULARY:
        for _ in range(30):
            i = rnd.randrange(len(entry))
            typed = entry[:i] + rnd.choice(["", "q", entry[i] * 2]) + entry[i + 1 :]
            assert bktree._search(tree, typed, bktree.SHARE)[2] == key


def test_longer_entry_passes_where_the_nearest_fails(spark, monkeypatch):
    """The share divides by the longer spelling, so a farther, longer entry may share enough; shards give the same."""
    vocabulary = spark.createDataFrame([(1, "abcxyz"), (2, "abcdefghij")], "vocab_id long, tag string")
    values = spark.createDataFrame([("abcdef",)], "value string")
    assert [tuple(r) for r in bktree.match_values(values, vocabulary, share=0.55).collect()] == [("abcdef", 2, 4)]
    monkeypatch.setattr(bktree, "BROADCAST_ENTRIES", 1)
    assert [tuple(r) for r in bktree.match_values(values, vocabulary, share=0.55).collect()] == [("abcdef", 2, 4)]


def test_half_of_the_spelling_is_enough():
    """Exactly half is a match, in the words' own order; a turned order must share more to be one."""
    tree = bktree.build([(1, "abcdwxyz"), (2, "slate_falloff"), (3, "glacial_veil"), (4, "plum_ceiling")])
    keys = [g[2] if (g := bktree._search(tree, v, bktree.SHARE)) else -1 for v in ("abcd", "fathom crate", "v3 FINAL final", "ceiling/plum")]
    assert keys == [1, -1, -1, 4]


def test_shards_and_blocks_give_what_one_tree_gives(spark, monkeypatch):
    import duckdb

    from tests.conftest import DATA

    sf = f"{DATA}/sf0.01"
    vocabulary = spark.read.parquet(f"{sf}/style_vocabulary.parquet")
    typed = [r[0] for r in duckdb.sql(f"SELECT DISTINCT tag FROM '{sf}/tags.parquet' WHERE tag IS NOT NULL").fetchall()]
    values = spark.createDataFrame([(t,) for t in typed], "value string")
    one = sorted(tuple(r) for r in bktree.match_values(values, vocabulary).collect())
    monkeypatch.setattr(bktree, "BROADCAST_ENTRIES", 20)
    monkeypatch.setattr(bktree, "BLOCK_VALUES", 50)
    assert sorted(tuple(r) for r in bktree.match_values(values, vocabulary, shards=3).collect()) == one
