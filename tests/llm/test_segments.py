from __future__ import annotations

import random

import pytest

from gradeloom.llm import bpe, segments

ENC = bpe.encoder()


def check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n in pieces:
        assert ENC.count(text[a:b]) == n <= limit
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        shared = ENC.count(text[c:b])
        assert overlap - 6 <= shared <= overlap + segments.ATOM_TOKENS + 6


def prose(topics, sentences, seed=0):
    rnd = random.Random(seed)
    words = {t: [f"{t}{rnd.randrange(1000)}word" for _ in range(25)] for t in topics}
    out, borders = "", []
    for t in topics:
        for _ in range(sentences):
            out += " ".join(rnd.choice(words[t]) for _ in range(9)).capitalize() + ". "
        borders.append(len(out) - 1)
    return out, borders


@pytest.mark.parametrize(
    "text",
    [
        prose("abc", 40)[0], "a" * 6000, "漢字かな" * 900, "é" * 3000, "\n" * 5000, " " * 6000, "🎬" * 1500, "no breaks here only spaces " * 400, "x,y," * 1500,
        "line one\nline two; three\r\n" * 300, "Ende. " * 900, "0123456789" * 500, ("word " * 700 + "z" * 3000 + ". ") * 2,
    ],
)
@pytest.mark.parametrize(("limit", "overlap"), [(256, 16), (128, 0), (1024, 64)])
def test_pieces(text, limit, overlap):
    n = ENC.count(text)
    pieces = segments.split_text(ENC, text, limit, overlap)
    if n <= limit:
        assert pieces == []
    else:
        check(text, pieces, limit, overlap)


def test_cuts_fall_on_topic_borders():
    text, borders = prose("abcdef", 12, seed=3)
    each = ENC.count(text) // 6
    pieces = segments.split_text(ENC, text, int(each * 1.5), 16)
    ends = [b for _, b, _ in pieces[:-1]]
    near = sum(min(abs(e - b) for b in borders) < 120 for e in ends)
    assert near >= 0.6 * len(ends)
    assert all(text[e - 1] == "." for e in ends)


def test_documents(spark):
    long = "The look holds. " * 500
    rows = [(1, long), (2, "short"), (3, ""), (4, None), (5, "b" * 1025), (1, long), (None, long)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, piece int, k string")
    got = segments.split_documents(df, 256, 16).collect()
    assert {r["doc_id"] for r in got} == {1, None} | ({5} if ENC.count("b" * 1025) > 256 else set())
    first = [r for r in got if r["doc_id"] is None]
    assert "".join(sorted({r["text"] for r in first}, key=len)[-1:]) in long and all(r["text"] == long[r["start"] : r["end"]] for r in first)
    assert sum(r["piece"] == 0 for r in got if r["doc_id"] == 1) == 2
    assert segments.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        segments.split_documents(df, 100, 60)


def test_exactly_at_the_limit():
    text = " word" * 100
    assert ENC.count(text) == 100
    assert segments.split_text(ENC, text, 100, 8) == []
    assert len(segments.split_text(ENC, text + " word", 100, 8)) == 2


def test_very_long_text():
    text = prose("abcdefgh", 2500, seed=1)[0]
    assert len(text) > 1_000_000
    pieces = segments.split_text(ENC, text, 1024, 64)
    check(text, pieces, 1024, 64)


@pytest.mark.parametrize("text", ["=" * 100_000, "-" * 100_000, "international" * 3000, "thelookholdsinthedarkroom" * 1200, "A run. " * 300 + "=" * 20_000 + " and words" * 900, "y" * 9000])
def test_unbroken_runs_share_and_fill(text):
    """Overlap and limit are tokens of the text, also where a run is cut into atoms."""
    pieces = segments.split_text(ENC, text, 1024, 64)
    check(text, pieces, 1024, 64)
    for (a, b, n), (c, _, _) in zip(pieces, pieces[1:]):
        assert ENC.count(text[c:b]) >= 64
        assert n >= 512
    if " " not in text:
        assert all(n >= 1000 for _, _, n in pieces[:-1])


def test_any_stretch_is_measured_as_if_encoded_alone():
    rnd = random.Random(4)
    parts = ["word", " word", "  ", "\n", "\n\n", " \n ", "'s", " 12345", "!!", " ...", "=" * 60, "漢字", "é", "\t", "🎬", " " * 90, "loooooooooooooooooooooooooooooooooooooong" * 3, "\r\n"]
    for _ in range(40):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(3, 60)))
        words = ENC.pieces(text)
        ruler = segments._Ruler(ENC, text, words, [len(x) for x in ENC.piece_ids(words)])
        for _ in range(60):
            i, j = sorted(rnd.randrange(len(ruler.atoms) + 1) for _ in range(2))
            assert ruler.tokens(i, j) == ENC.count(text[ruler.at(i) : ruler.at(j)]), (text, i, j)


def test_similarity_of_blocks_against_the_definition():
    import numpy as np

    rng = np.random.default_rng(2)
    for units in (2, 3, 7, 40):
        unit = np.sort(rng.integers(0, units, 25 * units))
        unit = np.searchsorted(np.unique(unit), unit)
        n = int(unit.max()) + 1
        ids = rng.integers(0, 50_000, len(unit)) // 5000 + unit // 4
        m = np.zeros((n, int(ids.max()) + 1))
        np.add.at(m, (unit, ids), 1)
        m *= np.log1p(n / np.maximum((m > 0).sum(0), 1))
        want = []
        for g in range(n - 1):
            a, b = m[max(0, g - 5) : g + 1].sum(0), m[g + 1 : g + 7].sum(0)
            want.append(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9))
        assert np.allclose(segments._similarities(ids, unit, n), want)


def test_depth_is_the_climb_to_the_peaks_on_both_sides(monkeypatch):
    import numpy as np

    s = np.array([0.5, 0.7, 0.7, 0.2, 0.3, 0.3, 0.1, 0.9])
    monkeypatch.setattr(segments, "_similarities", lambda *a: s)
    got = segments._valleys(np.zeros(1), np.zeros(1), 9)
    assert np.allclose(got, [0.2, 0, 0, 0.5 + 0.1, 0, 0, 0.2 + 0.8, 0, 0])


def test_unit_ends_against_the_pattern():
    import re

    rnd = random.Random(6)
    pattern = re.compile(r"\n+|[.!?…;]+[\"'”’)\]]*(?=\s)|[。！？；]+")
    for _ in range(400):
        text = "".join(rnd.choice(".!?…;\"'”’)] \n\t\u3000ab。！？；\x85\xa0🎬漢\r\u2028") for _ in range(rnd.randrange(40)))
        assert segments.unit_ends(text).tolist() == sorted({m.end() for m in pattern.finditer(text)}), repr(text)
