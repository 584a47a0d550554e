"""Top N rows of every group by two-stage salted ranking (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    n: int,
    item: str,
    subgroups: int = 32,
    copies: str = "identical",
) -> DataFrame:
    """The first `n` items of every group by `order`, with column `position` (1..n).

    Stage one hashes each group into `subgroups` by the item and keeps the first n of
    each, a group limit that also runs before the shuffle, so a group with a third of
    all rows is spread and mostly dropped where it is read. Stage two ranks the at most
    n * subgroups survivors of a group. `order` must end in the item to break all ties.

    Copies of an item fall into one subgroup. With copies="identical" they agree in
    `order` and share a dense rank; with "best" they may differ, and the best-ranked copy
    is found first by a shuffle on the item. Rows with a null group or item are skipped.
    An empty table has an empty result; n larger than a group returns the whole group.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if copies not in ("identical", "best"):
        raise ValueError("copies must be 'identical' or 'best'")
    keys = [*groups, item]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in dict.fromkeys(keys)))
    if copies == "best":
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("__copy", F.row_number().over(w)).where("__copy = 1").drop("__copy")
    rows = rows.withColumn("__sub", F.pmod(F.xxhash64(F.col(item)), F.lit(subgroups)).cast("int"))
    first = Window.partitionBy(*groups, "__sub").orderBy(*order)
    kept = rows.withColumn("__rank", F.dense_rank().over(first)).where(F.col("__rank") <= n)
    kept = kept.dropDuplicates([*keys]).drop("__rank", "__sub")
    last = Window.partitionBy(*groups).orderBy(*order)
    return kept.withColumn("position", F.row_number().over(last)).where(F.col("position") <= n)


def best_results(results: DataFrame, n: int = 10) -> DataFrame:
    """The n best search results of each project by score, then file_path, then result_id.

    Null project_name, null or NaN score and null result_id are skipped; a null file_path
    sorts before all others. A result delivered several times counts once.
    """
    sound = results.select("project_name", "file_path", "result_id", "score").where(
        F.col("score").isNotNull() & ~F.isnan("score")
    )
    order = [F.col("score").desc(), F.col("file_path").asc_nulls_first(), F.col("result_id").asc()]
    return top_n(sound, ["project_name"], order, n, "result_id")
