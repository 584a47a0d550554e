"""Byte-level BPE by per-prefix dynamic programming (problem 7).

The encoding of every prefix of a piece ends in exactly one token. Each prefix keeps
that token: of all tokens that are a suffix of the prefix (found by a suffix-matching
automaton), it is the one that may follow the last token of the shorter prefix. Two
tokens may be neighbours if merging by rank would leave their border alone. The ids are
then read off the back-pointers, so a piece of n bytes costs O(n) automaton steps
however long it is; no merge loop runs.

Texts are cut into pieces by the tokenizer's own pattern before. Null and empty texts
have the empty list. Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

#: The public pre-tokenisation pattern of the byte-level vocabularies.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Folder of the public vocabularies; a parameter of every operator.
TOKENIZER_DIR = os.environ.get("GRADELOOM_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"

#: Entries after which the piece memo is emptied. It changes speed only.
MEMO_ENTRIES = 400_000


class PrefixEncoder:
    """Encoder of one rank file: lines of base64 bytes and a rank."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.path = path
        with open(path, "rb") as f:
            self.rank_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        top = max(self.rank_of.values()) + 1
        self.size = [0] * top
        for raw, t in self.rank_of.items():
            self.size[t] = len(raw)
        self.left = list(range(top))
        self.right = list(range(top))
        self.merged: dict[int, int] = {}
        self._allowed: dict[int, bool] = {}
        self._halve()
        auto = ahocorasick.Automaton()
        for raw, t in self.rank_of.items():
            auto.add_word(raw.decode("latin-1"), t)
        auto.make_automaton()
        self._auto = auto
        self._split = regex.compile(PIECE_PATTERN).findall
        self._memo = _Memo(self)

    def _halve(self) -> None:
        """Finds for every token the pair whose merge makes it, in rank order."""
        for raw, t in sorted(self.rank_of.items(), key=lambda x: x[1]):
            for cut in range(1, len(raw)):
                a, b = self.rank_of.get(raw[:cut]), self.rank_of.get(raw[cut:])
                if a is not None and b is not None and a < t and b < t and self._neighbours(a, b, t):
                    self.left[t], self.right[t] = a, b
                    self.merged[a << 20 | b] = t
                    break

    def _neighbours(self, a: int, b: int, below: int) -> bool:
        """True if no merge of rank under `below` would join a suffix part of a and a prefix part of b.

        The border sees, in time, ever larger parts of both tokens. Undoing the later of
        the two last merges walks back through that history; at each moment a merge
        across the border would have happened if its rank comes before the next merge
        that changes either side.
        """
        merged, left, right = self.merged, self.left, self.right
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < below:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (a > b or whole_b):
                below, a = a, right[a]
            else:
                below, b = b + 1, left[b]

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._allowed.get(key)
        if known is None:
            if len(self._allowed) > 4 * MEMO_ENTRIES:
                self._allowed.clear()
            known = self._allowed[key] = self._neighbours(a, b, 1 << 30)
        return known

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.rank_of.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        last = [-1] * (n + 1)
        size, follows = self.size, self.follows
        for end, token in self._auto.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[token]
            if start == 0 or follows(last[start], token):
                last[end] = token
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return ids

    def pieces(self, text: str) -> list[str]:
        return self._split(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(itertools.chain.from_iterable(map(self._memo.__getitem__, self._split(text))))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(len, map(self._memo.__getitem__, self._split(text))))

    def piece_ids(self, pieces: Iterable[str]) -> list[tuple[int, ...]]:
        return list(map(self._memo.__getitem__, pieces))


class _Memo(dict):
    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self._encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self._encoder.piece(piece.encode("utf-8")))
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:  # also within one text, however long
                self.clear()
            self[piece] = ids
        return ids


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    path = os.path.join(folder or TOKENIZER_DIR, vocabulary)
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None
) -> DataFrame:
    """(id_col, ids array<int>) for every row of `df`; a map without any shuffle.

    Null, empty: the empty list. Blank texts are ordinary text. Repeated rows come out
    as often as they came in; other columns are not carried, so clashing names don't matter.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            step = 256
            for at in range(0, batch.num_rows, step):
                got = [enc.encode(x.as_py()) for x in texts[at : at + step]]
                ends = np.zeros(len(got) + 1, np.int32)
                np.cumsum([len(x) for x in got], out=ends[1:])
                flat = np.fromiter(itertools.chain.from_iterable(got), np.int32, int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys[at : at + step], lists], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None
) -> DataFrame:
    """(id_col, n_tokens int) for every row of `df`; null and empty texts have 0."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, folder)
        for batch in batches:
            n = pa.array([enc.count(x.as_py()) for x in batch.column(1)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")
