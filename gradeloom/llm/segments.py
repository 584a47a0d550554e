"""Splitting long texts at natural boundaries by lexical cohesion (problem 9).

A text over the limit is cut into units at line ends and sentence ends. For every border
of two units the vocabularies (token ids, weighted by how few units have them) of the
blocks of units before and after are compared; a valley in that similarity marks a change
of topic. Each piece ends at the deepest valley in the second half of its window. Where
the window has no such border, the last space or punctuation serves, and in a text without
any, the last character that fits. The next piece begins so that it shares at least
`overlap` tokens with the one before, and less than one atom (a word, or a few characters of
an unbroken run) more. Where a run is cut into atoms, several atoms can be one token of the
text; limit, window and overlap are then measured on the text itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.bpe import DEFAULT_VOCABULARY, PrefixEncoder, encoder
from gradeloom.storage import spread

LIMIT = 1024
OVERLAP = 64
#: Units in each of the two blocks that are compared.
BLOCK_UNITS = 6
#: Unbroken runs of more tokens than this are cut into atoms of ATOM_CHARS characters.
ATOM_TOKENS, ATOM_CHARS = 16, 4

_STOP, _CLOSER, _FULL_STOP, _BLANK, _LINE = 1, 2, 4, 8, 16
#: What each character of the first plane is to a unit's end.
_KINDS = np.zeros(65536, np.uint8)
for _kind, _chars in ((_STOP, ".!?…;"), (_CLOSER, "\"'”’)]"), (_FULL_STOP, "。！？；"), (_BLANK, [c for c in map(chr, range(65535)) if c.isspace()]), (_LINE, "\n")):
    _KINDS[[ord(c) for c in _chars]] |= _kind


def unit_ends(text: str) -> np.ndarray:
    """Characters before the end of each unit: after a run of line ends, a sentence end with its closing marks before a blank, a run of full-width stops."""
    k = _KINDS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)]
    if not len(k):
        return np.zeros(0, np.int64)
    runs = k & (_LINE | _FULL_STOP)
    out = (runs & ~np.r_[runs[1:], np.uint8(0)]) != 0
    # the last character that closes nothing decides whether closing marks end a sentence
    last = np.maximum.accumulate(np.where(k & _CLOSER, -1, np.arange(len(k), dtype=np.int32)))
    ended = (k[np.maximum(last, 0)] & _STOP != 0) & (last >= 0)
    out[:-1] |= ended[:-1] & (k[1:] & _BLANK != 0)
    return np.flatnonzero(out) + 1


def _similarities(ids: np.ndarray, unit_of_token: np.ndarray, units: int, block: int = BLOCK_UNITS) -> np.ndarray:
    """Cosine of the `block` units before and after the end of each unit but the last, over token ids.

    The sum of two blocks' products is the sum over pairs of units, so the products of
    units up to 2 * block - 1 apart are enough; they come from the occurrences of a token
    id in order, of which at most that many lie so close. Nothing is as wide as the vocabulary.
    """
    lags = 2 * block
    entries, n = np.unique(ids * units + unit_of_token, return_counts=True)  # by id, then unit
    token, unit = entries // units, entries % units
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    spread_of = np.diff(np.r_[first, len(token)])  # units that have the id
    x = n * np.repeat(np.log1p(units / spread_of), spread_of)
    near = np.zeros((lags, units))
    near[0] = np.bincount(unit, x * x, units)
    for shift in range(1, lags):
        a, b = slice(None, -shift), slice(shift, None)
        at = np.flatnonzero((token[a] == token[b]) & (unit[b] - unit[a] < lags))
        if not len(at):
            break
        np.add.at(near, (unit[at + shift] - unit[at], unit[at]), x[at] * x[at + shift])
    sums = np.zeros((lags, units + 1))
    np.cumsum(near, axis=1, out=sums[:, 1:])

    def total(lag: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Products of unit u and u + lag, for u from lo to hi."""
        hi, lo = np.minimum(hi, units - 1), np.maximum(lo, 0)
        return np.where(hi >= lo, sums[lag][np.maximum(hi, -1) + 1] - sums[lag][np.minimum(lo, units)], 0.0)

    g = np.arange(units - 1)
    cross = sum(total(lag, np.maximum(g - block + 1, g + 1 - lag), np.minimum(g, g + block - lag)) for lag in range(1, lags))
    before = total(0, g - block + 1, g) + 2 * sum(total(lag, g - block + 1, g - lag) for lag in range(1, block))
    # products that would end beyond the last unit are zero in `near`
    after = total(0, g + 1, g + block) + 2 * sum(total(lag, g + 1, g + block - lag) for lag in range(1, block))
    return cross / np.maximum(np.sqrt(np.maximum(before * after, 0)), 1e-9)


def _valleys(ids: np.ndarray, unit_of_token: np.ndarray, units: int) -> np.ndarray:
    """Depth of the cohesion valley at the end of each unit; the last has none."""
    depth = np.zeros(units)
    if units < 2:
        return depth
    s = _similarities(ids, unit_of_token, units)
    at = np.arange(len(s))
    # the peak on either side, climbing while the similarity doesn't fall: where the run that leads down to here begins and ends
    left = np.maximum.accumulate(np.where(np.r_[True, s[:-1] < s[1:]], at, 0))
    right = np.minimum.accumulate(np.where(np.r_[s[1:] < s[:-1], True], at, len(s))[::-1])[::-1]
    depth[: units - 1] = (s[left] - s) + (s[right] - s)
    return depth


class _Ruler:
    """Tokens of any stretch between two atoms of a text, as they are if the stretch is encoded alone.

    Pieces of the pre-tokeniser keep their tokens wherever a stretch begins or ends, but for
    two: a piece that is cut into atoms and only partly in the stretch, and blanks at its
    end, which may have been apart only because of the word behind them. Those are encoded again.
    """

    def __init__(self, enc: PrefixEncoder, text: str, words: list[str], counts: list[int]):
        self.enc, self.text = enc, text
        n = np.array(counts, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.where(n > ATOM_TOKENS, -(-size // ATOM_CHARS), 1)
        self.word_end, self.words_before = np.cumsum(size), np.concatenate([[0], np.cumsum(n)])
        self.word_of = np.repeat(np.arange(len(words)), parts)
        if len(self.word_of) == len(words):
            self.atoms, self.ends = words, self.word_end
        else:
            self.atoms = list(itertools.chain.from_iterable([w] if k == 1 else [w[i : i + ATOM_CHARS] for i in range(0, len(w), ATOM_CHARS)] for w, k in zip(words, parts.tolist())))
            self.ends = np.cumsum(np.fromiter(map(len, self.atoms), np.int64, len(self.atoms)))
        self.blank = np.fromiter(map(str.isspace, words), bool, len(words))

    def at(self, i: int) -> int:
        """Characters before atom i."""
        return int(self.ends[i - 1]) if i else 0

    def tokens(self, i: int, j: int) -> int:
        """Tokens of the atoms from i to j - 1."""
        if i >= j:
            return 0
        lo, hi = self.at(i), self.at(j)
        a, b = int(self.word_of[i]), int(self.word_of[j - 1])
        head = lo > (int(self.word_end[a - 1]) if a else 0)  # the stretch begins inside a word
        # whole words up to `tail`, then what is encoded again
        tail = b if int(self.word_end[b]) > hi else b + 1
        while tail > a and self.blank[tail - 1] and (tail <= b or (tail - 2 >= a and self.blank[tail - 2])):
            tail -= 1
        if head and tail <= a + (b > a and bool(self.blank[a])):
            return self.enc.count(self.text[lo:hi])
        count = 0
        if head:
            count, a = self.enc.count(self.text[lo : int(self.word_end[a])]), a + 1
        if tail <= b:
            start = int(self.word_end[tail - 1]) if tail else 0
            count += self.enc.count(self.text[start:hi])
        return count + int(self.words_before[tail] - self.words_before[a])


def split_text(enc: PrefixEncoder, text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text over the limit, in characters; none for other texts."""
    if not text:
        return []
    words = enc.pieces(text)
    coded = enc.piece_ids(words)
    counts = list(map(len, coded))
    if sum(counts) <= limit:
        return []
    ruler = _Ruler(enc, text, words, counts)
    atoms, ends = ruler.atoms, ruler.ends
    if atoms is not words:
        coded = enc.piece_ids(atoms)
    n_tokens = np.fromiter(map(len, coded), np.int64, len(coded))
    ids = np.fromiter(itertools.chain.from_iterable(coded), np.int64, int(n_tokens.sum()))
    total = np.concatenate([[0], np.cumsum(n_tokens)])  # tokens before each atom, each encoded alone
    unit_end = np.unique(np.append(np.searchsorted(ends, unit_ends(text)), len(atoms) - 1))  # last atom of each unit
    unit_end = unit_end[unit_end < len(atoms)]
    unit_of_atom = np.searchsorted(unit_end, np.arange(len(atoms)))
    depth = _valleys(ids, np.repeat(unit_of_atom, n_tokens), len(unit_end))

    pieces, start = [], 0
    while True:
        # atoms start..stop-1 fit by their own counts, or more where several atoms are one token of the text
        stop = _reach(lambda i: ruler.tokens(start, i) <= limit, max(int(np.searchsorted(total, total[start] + limit, "right")) - 1, start + 1), len(atoms))
        low = min(_reach(lambda i: ruler.tokens(start, i) < limit // 2, int(np.searchsorted(total, total[start] + limit // 2)), stop), stop)
        while True:
            end = len(atoms) if stop >= len(atoms) else _cut(text, ends, unit_end, depth, low, stop)
            n = ruler.tokens(start, end)
            if n <= limit or end <= start + 1:
                break
            stop = end - 1
        pieces.append((ruler.at(start), ruler.at(end), n))
        if end == len(atoms):
            return pieces
        back = max(start + 1, int(np.searchsorted(total, total[end] - overlap, "right")) - 1)
        short = _reach(lambda i: ruler.tokens(end - i, end) < overlap, end - back, end - start - 1)
        # the fewest atoms that share enough
        at = min(short + 1, end - start - 1) if ruler.tokens(end - short, end) < overlap else short
        start = end - at


def _reach(fits: Callable[[int], bool], at: int, top: int) -> int:
    """The last number from `at` to `top` that still fits, by doubled steps and halving; `at` itself is given back where even that doesn't."""
    if at >= top or not fits(at):
        return min(at, top)
    step = 1
    while at + step <= top and fits(at + step):
        at, step = at + step, 2 * step
    high = min(at + step, top + 1)  # doesn't fit, or lies beyond
    while high - at > 1:
        mid = (at + high) // 2
        if fits(mid):
            at = mid
        else:
            high = mid
    return at


def _cut(text: str, ends: np.ndarray, unit_end: np.ndarray, depth: np.ndarray, low: int, stop: int) -> int:
    """How many atoms come before the cut: the deepest valley between low and stop, else the last soft break, else stop."""
    a, b = np.searchsorted(unit_end, [low, stop])
    if b > a:
        window = depth[a:b]
        return int(unit_end[a + len(window) - 1 - int(np.argmax(window[::-1]))]) + 1
    for end in range(stop, max(low, 1), -1):
        here = int(ends[end - 1])
        if text[here - 1] in ",:、，) \t" or text[here : here + 1].isspace():
            return end
    return stop


def split_documents(
    df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, folder: str | None = None
) -> DataFrame:
    """(id_col, piece, start, end, n_tokens, text) of every document with more than `limit` tokens.

    Pieces cover the text without gaps; start and end count characters from 0. A piece
    has at most `limit` tokens, measured on its own text. Null, empty and short texts give
    no row (a text of at most `limit` bytes can't have more tokens and is skipped where it is
    read). Repeated rows come out as often as they came in.
    """
    if not 0 <= overlap < limit // 2 - ATOM_TOKENS:
        raise ValueError("the overlap must be less than half of the limit")
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary, folder)
        for x in frames:
            for key, text in zip(x["k"], x["t"]):
                got = split_text(enc, text, limit, overlap)
                if got:
                    yield pd.DataFrame(
                        {"k": key, "piece": np.arange(len(got), dtype=np.int32), "start": [g[0] for g in got], "end": [g[1] for g in got], "n_tokens": [g[2] for g in got], "text": [text[g[0] : g[1]] for g in got]}
                    )

    long = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where(F.octet_length("t") > limit)
    out = spread(long).mapInPandas(run, f"k {kind}, piece int, start long, end long, n_tokens int, text string")
    return out.withColumnRenamed("k", id_col)
