from __future__ import annotations

import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import bpe

ENC = bpe.encoder()
REF = tiktoken.Encoding("ref", pat_str=bpe.PIECE_PATTERN, mergeable_ranks=ENC.rank_of, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)
    assert ENC.count(text) == len(ENC.encode(text))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, "ab" * 4000 + "x", " " * 3000, "\r\n\t 　", "é" * 999, "漢字" * 800, "🎬" * 300, "0" * 2001, "don't I'LL we've"])
def test_special_and_long(text):
    assert ENC.encode(text) == REF.encode_ordinary(text)


def test_long_random_words():
    rnd = random.Random(0)
    for _ in range(60):
        text = "".join(rnd.choice("etaoinshrdlu") for _ in range(4000))
        assert ENC.encode(text) == REF.encode_ordinary(text)


def test_other_vocabulary():
    e = bpe.encoder("byte_bpe_multi_50k.tiktoken")
    r = tiktoken.Encoding("m", pat_str=bpe.PIECE_PATTERN, mergeable_ranks=e.rank_of, special_tokens={})
    for text in ("Die Szene ist zu dunkel.", "シーン5とシーン49を並べて確認", "escena nocturna, más cálida", "zzzqqq" * 50):
        assert e.encode(text) == r.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "a b"), (2, ""), (3, None), (4, " \n"), (1, "a b"), (None, "x"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, [9]) for i, t in rows], "doc_id long, text string, ids array<int>")
    got = sorted(((r["doc_id"], r["ids"]) for r in bpe.encode_documents(df).collect()), key=str)
    assert got == sorted(((i, REF.encode_ordinary(t or "")) for i, t in rows), key=str)
    counts = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.count_tokens(df).collect()), key=str)
    assert counts == sorted(((i, len(REF.encode_ordinary(t or ""))) for i, t in rows), key=str)
    assert bpe.encode_documents(df.limit(0)).count() == 0


def test_memo_may_be_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    text = "one two three four five six seven eight nine ten unbelievableness"
    for _ in range(3):
        assert ENC.encode(text) == REF.encode_ordinary(text)
