"""Mapping freely typed values to a canonical list with a BK-tree (problem 4).

Values and entries are reduced to their spelling first (compatibility forms, case,
accents, look-alike letters, digits for letters, everything that is no letter or digit).
The tree holds each entry once for every rotation of its words; a changed word order
costs one edit. Distance is Levenshtein's, a true metric; the triangle inequality skips
every subtree whose edge to its parent differs from the value's distance by more than
the radius, and the radius shrinks to the best distance met.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.storage import materialize, spread

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
}
#: Digits written for letters.
DIGIT_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Entries up to which the tree is broadcast; larger lists are sharded.
BROADCAST_ENTRIES = 50_000
#: Distinct values that one task sets against a shard, on average; their number decides into how many blocks they are cut.
BLOCK_VALUES = 100_000
#: Share of the spelling that a value and its entry must have in common.
SHARE = 0.5
#: Edits that another word order costs. If it cost none, every rotation were one more free try at half of the letters.
TURNED = 1


def spelling(value: str, digits: bool = True) -> str:
    """The bare letters of a value."""
    text = unicodedata.normalize("NFKC", value).casefold()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    text = "".join(LOOK_ALIKE.get(c, c) for c in text)
    if digits and any(c.isalpha() for c in text):
        text = "".join(DIGIT_LETTER.get(c, c) for c in text)
    return "".join(c for c in text if c.isalnum())


def rotations(entry: str) -> list[str]:
    """Spellings of an entry with its words in every rotated order."""
    words = [w for w in re.split(r"[\W_]+", entry) if w]
    return list(dict.fromkeys(spelling("".join(words[i:] + words[:i])) for i in range(len(words) or 1)))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by bit-parallel columns; integers are as long as `a`."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        grow = down | (~(across | up) & mask)
        shrink = up & across
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
        grow = (grow << 1 | 1) & mask
        shrink = (shrink << 1) & mask
        across_v = eq | down
        up = shrink | (~(across_v | grow) & mask)
        down = grow & across_v
    return score


class BKTree:
    """Entries by edit distance; `add` and `nearest` take spellings."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, word: str, key: int, cost: int = 0) -> None:
        """`cost` is added to the distances of this key under this spelling."""
        if self.root is None:
            self.root = [word, {key: cost}, {}]
            return
        node = self.root
        while True:
            d = edit_distance(word, node[0])
            if d == 0:
                node[1][key] = min(cost, node[1].get(key, cost))
                return
            if d not in node[2]:
                node[2][d] = [word, {key: cost}, {}]
                return
            node = node[2][d]

    def within(self, word: str, radius: int) -> list[tuple[int, int, str]]:
        """(distance, key, entry spelling) of every entry within the radius."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            text, keys, below = stack.pop()
            d = edit_distance(word, text)
            found += [(d + cost, k, text) for k, cost in keys.items() if d + cost <= radius]
            stack += [child for edge, child in below.items() if d - radius <= edge <= d + radius]
        return sorted(found)

    def nearest(self, word: str, radius: int, share: float = 0.0) -> tuple[int, int, int] | None:
        """(distance, -length, key) of the closest entry within the radius that has `share` of the longer spelling in common.

        The longer entry, then the smaller key wins ties. A closer entry that shares too little doesn't narrow the search.
        """
        best = None
        stack = [self.root] if self.root else []
        while stack:
            text, keys, below = stack.pop()
            d = edit_distance(word, text)
            if d <= radius:
                far, key = min((d + cost, k) for k, cost in keys.items())
                here = (far, -len(text), key)
                # sharing s means d <= (1 - s) * length, without rounding of a quotient
                if far <= radius and far <= (1 - share) * max(len(word), len(text)) and (best is None or here < best):
                    best, radius = here, far
            # the closest edges are taken up last, hence searched first
            for edge, child in sorted(below.items(), key=lambda x: -abs(x[0] - d)):
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return best


def _search(tree: BKTree, raw: str, share: float) -> tuple[int, int, int, int] | None:
    """(distance, -entry length, key, value length) of the best entry that shares at least `share` of the spelling."""
    word = spelling(raw)
    if not word:
        return None
    # sharing s of the longer spelling means d <= (1 - s) * max(lengths) and the entry is at most d longer
    radius = int(len(word) * (1 - share) / share) if share > 0 else 1 << 30
    got = tree.nearest(word, max(radius, 1), share)
    return (*got, len(word)) if got else None


def build(entries: list[tuple[int, str]]) -> BKTree:
    tree = BKTree()
    for key, text in sorted(entries):
        for turn, word in enumerate(rotations(text)):
            if word:
                tree.add(word, key, TURNED if turn else 0)
    return tree


def match_values(
    values: DataFrame, reference: DataFrame, value_col: str = "value", key_col: str = "vocab_id", entry_col: str = "tag", share: float = SHARE, shards: int = 16
) -> DataFrame:
    """(value, key, distance) of each distinct value: the closest entry that shares enough, or key -1 if none shares `share` of its spelling.

    Null values and entries are skipped; a value without any letter or digit is unmatched.
    Values of any length are compared whole. Repeated values are searched once. Ties go to
    the longer entry, then to the smaller key. An empty reference leaves all unmatched.

    A reference of at most BROADCAST_ENTRIES entries (counted) becomes one tree that every
    task gets; a larger one is cut into at least `shards` trees of as many entries at most, each value
    visits all of them, in blocks of about BLOCK_VALUES values, and the shard winners are
    merged. Both give the same result.
    """
    distinct = values.select(F.col(value_col).alias("value")).where("value IS NOT NULL").distinct()
    refs = reference.select(F.col(key_col).cast("long").alias("key"), F.col(entry_col).alias("entry")).where("entry IS NOT NULL AND key IS NOT NULL")
    schema = "value string, key long, distance int"
    head = refs.limit(BROADCAST_ENTRIES + 1).collect()
    if len(head) <= BROADCAST_ENTRIES:
        entries = [(r["key"], r["entry"]) for r in head]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = build(entries)
            for x in frames:
                got = [_search(tree, v, share) for v in x["value"]]
                yield pd.DataFrame({"value": x["value"], "key": [g[2] if g else -1 for g in got], "distance": [g[0] if g else -1 for g in got]})

        return distinct.mapInPandas(run, schema)

    def winners(key, ref: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        tree = build(list(zip(ref["key"], ref["entry"])))
        got = [(v, *g[:3]) for v in ask["value"] if (g := _search(tree, v, share))]
        return pd.DataFrame(got, columns=["value", "d", "l", "k"])

    distinct = materialize(distinct, "values")  # counted, sent to the shards and joined to their winners
    shards = max(shards, -(-refs.count() // BROADCAST_ENTRIES))
    blocks = max(1, values.sparkSession.sparkContext.defaultParallelism // shards, -(-distinct.count() // BLOCK_VALUES))
    pieces = F.array(*[F.lit(i) for i in range(shards)])
    block = F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")
    asked = distinct.select("value", block.alias("block"), F.explode(pieces).alias("shard"))
    cut = refs.select("key", "entry", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    won = cut.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(winners, "value string, d int, l int, k long")
    best = won.groupBy("value").agg(F.min(F.struct("d", "l", "k")).alias("b"))
    return distinct.join(best, "value", "left").select("value", F.coalesce("b.k", F.lit(-1)).alias("key"), F.coalesce("b.d", F.lit(-1)).alias("distance"))


def free_values(tags: DataFrame, entries: DataFrame) -> DataFrame:
    """(origin, row_id, pos, value): every tag and every array element; null and blank ones (outer spaces aside) are skipped."""
    a = tags.where("id IS NOT NULL").select(F.lit("tags").alias("origin"), F.col("id").cast("long").alias("row_id"), F.lit(0).alias("pos"), F.col("tag").alias("value"))
    b = entries.where("entry_id IS NOT NULL").select(
        F.lit("dataset_entries").alias("origin"), F.col("entry_id").cast("long").alias("row_id"), F.posexplode("grading_style_tags").alias("pos", "value")
    )
    return a.unionByName(b).where("trim(value) <> ''")


def canonical_values(tags: DataFrame, entries: DataFrame, vocabulary: DataFrame, share: float = SHARE) -> DataFrame:
    """(origin, row_id, pos, vocab_id) of every value that isn't an entry character by character; -1 if unmatched.

    Rows delivered twice come out once. The join back is on the value, whose skew is cut
    first: rows are reduced to distinct cases before it, and AQE splits what is left.
    """
    typed = free_values(tags, entries)
    exact = vocabulary.where("tag IS NOT NULL").select(F.col("tag").alias("value")).distinct()
    odd = typed.join(exact, "value", "left_anti").distinct()
    matched = match_values(spread(odd.select("value").distinct()), vocabulary, "value", share=share)
    return odd.join(matched, "value").select("origin", "row_id", "pos", F.col("key").alias("vocab_id"))
