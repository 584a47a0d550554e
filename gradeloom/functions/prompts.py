"""Prompts of a text encoder as token ids of fixed length: start, pieces by merge rank, end, padding."""

from __future__ import annotations

import heapq
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the text encoder: length of a prompt, ids of its start, end and padding, and the pattern that cuts it.
LENGTH, START, END, PADDING = 77, 49406, 49407, 0
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\w+| ?\d+| ?[^\s\w\d]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """A visible character for every byte: itself where it is visible, else one from 256 on, in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Prompts:
    """Encoder of one tokenizer file (JSON with `model.vocab` and `model.merges`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters, self.cut, self.known = byte_letters(), re.compile(PATTERN), {}

    def piece(self, word: str) -> list[int]:
        """Joins the pair of lowest rank, leftmost first, until none is left; links and a heap, so long pieces take n log n."""
        if word in self.known:
            return self.known[word]
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (new := (parts[a], parts[b])) in self.rank:
                    heapq.heappush(heap, (self.rank[new], a, new))
        ids = [self.ids[p] for p in parts if p is not None and p in self.ids]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids = [START]
        for match in self.cut.findall(text.lower()):
            ids += self.piece("".join(self.letters[b] for b in match.encode("utf-8")))
            if len(ids) >= LENGTH:
                break
        ids = [*ids[: LENGTH - 1], END]
        return ids + [PADDING] * (LENGTH - len(ids))


_LOADED: dict[str, Prompts] = {}


def prompt_ids(text: Column, path: str) -> Column:
    """array<int> of LENGTH ids; a null text is null, an empty one has only start and end. Pieces that the vocabulary lacks are left out."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if path not in _LOADED:
            _LOADED[path] = Prompts(path)
        return texts.map(lambda t: None if t is None else _LOADED[path].encode(t))

    return encode(text)
