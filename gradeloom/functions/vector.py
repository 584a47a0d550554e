"""Vectors, histograms and tag sets as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
CLAMP = 1e-10


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def histogram(text: Column, bins: int = 64) -> Column:
    """Comma-separated text as an array of `bins` finite doubles, else null; blank items are skipped.

    The array is cast once: a lambda over one element binds it, so the optimiser can't inline the cast where it is tested.
    """
    gaps = text.rlike("^ *,|, *,|, *$|^ *$")
    items = F.when(gaps, F.filter(F.split(text, ","), lambda x: F.btrim(x, F.lit(" ")) != "")).otherwise(F.split(text, ","))
    # Java would also take hexadecimal numbers, suffixes and other blanks
    values = F.when(~text.rlike("[^0-9eE+., -]"), items.try_cast("array<double>"))
    sound = lambda h: (F.size(h) == bins) & (F.size(F.array_compact(h)) == bins) & (F.array_max(h) < float("inf")) & (F.array_min(h) > float("-inf"))
    return F.get(F.filter(F.array(values), sound), F.lit(0))


def normalised(h: Column, sum_: Column) -> Column:
    """h / sum; a histogram of sum zero becomes uniform. `sum_` is its own column, as a sum in the lambda would be taken for every bin."""
    return F.when(sum_ > 0, F.transform(h, lambda x: x / sum_)).otherwise(F.transform(h, lambda x: F.lit(1.0) / F.size(h)))


def coefficient(p: Column, q: Column) -> Column:
    """Bhattacharyya coefficient of two normalised histograms; bins under 1e-10 count as that."""
    return total(F.zip_with(p, q, lambda a, b: F.sqrt(F.greatest(a, F.lit(CLAMP)) * F.greatest(b, F.lit(CLAMP)))))


def grading_similarity(ps: list[Column], qs: list[Column]) -> Column:
    """Mean coefficient over the channels."""
    s = coefficient(ps[0], qs[0])
    for p, q in zip(ps[1:], qs[1:]):
        s = s + coefficient(p, q)
    return s / len(ps)


def intersection(a: Column, b: Column) -> Column:
    """Sum of the smaller bins, over the common length."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.least(x, y)))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity; 0 for null, empty, unequal or zero vectors."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def clip_similarity(cos: Column) -> Column:
    return (cos + 1) / 2


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tags; 0 if either set is empty or null."""
    ok = (F.size(F.coalesce(a, F.array())) > 0) & (F.size(F.coalesce(b, F.array())) > 0)
    return F.when(ok, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def last_peak(h: Column) -> Column:
    """Bin of the greatest value, the last of equals."""
    return F.array_max(F.transform(h, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))["i"]


def first_peak(h: Column) -> Column:
    """Bin of the greatest value, the first of equals."""
    return -F.array_max(F.transform(h, lambda x, i: F.struct(x.alias("v"), (-i).alias("i"))))["i"]


def percentile(h: Column, p: float) -> Column:
    """Position in 0..1 below which the share p of the histogram lies, linear inside the bin; 0 if empty, 1 beyond the last."""
    n, target = F.size(h), F.lit(p) * total(h)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"), F.lit(0).alias("i"))

    def step(acc: Column, x: Column) -> Column:
        reached = (acc["at"] < 0) & (x > 0) & (acc["sum"] + x >= target)
        at = F.when(reached, (acc["i"] + (target - acc["sum"]) / x) / n).otherwise(acc["at"])
        return F.struct((acc["sum"] + F.greatest(x, F.lit(0.0))).alias("sum"), at.alias("at"), (acc["i"] + 1).alias("i"))

    found = F.aggregate(h, start, step, lambda acc: acc["at"])
    return F.when(total(h) <= 0, 0.0).when(found < 0, 1.0).otherwise(found)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    exps = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / total(exps))


def equal_parts(v: Column, parts: int) -> Column:
    """An array of `parts` equal slices of a vector."""
    size = F.floor(F.size(v) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(v, i * size + 1, size))
