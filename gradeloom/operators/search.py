"""Similarity search: scores as columns, ranked by score and an explicit tie key.

A search is an equi-free join of all candidates with one query row. The query side is one
row by construction (an id is looked up, ties by the smallest), so it is broadcast; the
ranking is a top-k per partition that meets on one task with k rows from each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import vector as v
from gradeloom.operators.features import tile_features

#: Weights of grading, clip and tag signals.
PRESETS = {"grading-first": (0.6, 0.3, 0.1), "balanced": (0.4, 0.4, 0.2), "pyramid": (0.6, 0.3, 0.1)}
PYRAMID_WEIGHTS = (0.25, 0.25, 0.5)


def check_weights(weights: dict[str, float], least: float = 0.0) -> tuple[float, float, float]:
    """(grading, clip, tag): known unique names, finite, at least `least`, sum 1 within 1e-6."""
    if set(weights) - {"grading", "clip", "tag"}:
        raise ValueError(f"unknown weights: {sorted(set(weights) - {'grading', 'clip', 'tag'})}")
    w = tuple(float(weights.get(k, 0.0)) for k in ("grading", "clip", "tag"))
    if any(not math.isfinite(x) or x < least for x in w):
        raise ValueError(f"weights must be finite and at least {least}")
    if abs(sum(w) - 1) > 1e-6:
        raise ValueError("weights must add up to 1")
    return w


def parse_weights(text: str) -> tuple[float, float, float]:
    """'grading=0.6,clip=0.3,tag=0.1'."""
    found: dict[str, float] = {}
    for part in text.split(","):
        name, eq, value = part.partition("=")
        if not eq or name.strip() in found:
            raise ValueError(f"bad or repeated weight: {part!r}")
        found[name.strip()] = float(value)
    return check_weights(found)


def explain_few(n: int) -> str | None:
    """What to tell a user who got few results."""
    return {0: "no match: relax the filters or import more projects", 1: "a single match: the catalog may be too small", 2: "only two matches: scores are hard to compare"}.get(n)


def ranked(df: DataFrame, k: int | None, ties: list[str], score: str = "score") -> DataFrame:
    """The k best by descending score, with their rank; all rows without one if k is None, as a rank of all rows would order them in one task."""
    if k is None:
        return df
    order = [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def with_query(candidates: DataFrame, features: DataFrame, query_id: int, columns: list[str], key: str = "id") -> DataFrame:
    """Every other candidate next to the query's columns (prefixed q_); the query side is one row."""
    q = features.where(F.col(key) == query_id).select(*[F.col(c).alias(f"q_{c}") for c in columns]).limit(1)
    return candidates.where(F.col(key) != query_id).join(F.broadcast(q))


def normalised_features(histograms: DataFrame) -> DataFrame:
    """Normalised channels n_r, n_g, n_b; the sums are columns of their own."""
    sums = histograms.withColumns({f"s_{c}": v.total(F.col(f"hist_{c}")) for c in "rgb"})
    return sums.select("id", *[v.normalised(F.col(f"hist_{c}"), F.col(f"s_{c}")).alias(f"n_{c}") for c in "rgb"])


def grading_search(features: DataFrame, query_id: int, k: int | None = 10) -> DataFrame:
    """By mean Bhattacharyya coefficient of the channels; the query itself is left out."""
    cols = ["n_r", "n_g", "n_b"]
    x = with_query(features, features, query_id, cols)
    s = v.grading_similarity([F.col(c) for c in cols], [F.col(f"q_{c}") for c in cols])
    return ranked(x.select("id", s.alias("score")), k, ["id"])


def histogram_search(features: DataFrame, query_id: int, k: int | None = 10) -> DataFrame:
    """By mean intersection of the normalised channels."""
    cols = ["n_r", "n_g", "n_b"]
    x = with_query(features, features, query_id, cols)
    s = v.intersection(F.col("n_r"), F.col("q_n_r")) + v.intersection(F.col("n_g"), F.col("q_n_g")) + v.intersection(F.col("n_b"), F.col("q_n_b"))
    return ranked(x.select("id", (s / 3).alias("score")), k, ["id"])


def listing(info: DataFrame, histograms: DataFrame, k: int = 50) -> DataFrame:
    """The search without a query: sound fingerprints by project and file, all with score 1."""
    x = info.select("id", "project_name", "filename").join(histograms.select("id"), "id", "left_semi")
    x = x.orderBy("project_name", "filename", "id").limit(k).withColumn("score", F.lit(1.0))
    return x.withColumn("rank", F.row_number().over(Window.orderBy("project_name", "filename", "id")).cast("long"))


def tag_search(tags: DataFrame, text: str, k: int | None = 20) -> DataFrame:
    """Distinct matching tags of a fingerprint over the most that any has; the most is taken before the limit."""
    wanted = list(dict.fromkeys(text.split()))
    n = tags.where(F.col("tag").isin(*wanted)).groupBy(F.col("fingerprint_id").alias("id")).agg(F.countDistinct("tag").alias("matches"))
    top = n.agg(F.max("matches").alias("most"))
    x = n.join(F.broadcast(top)).select("id", "matches", (F.col("matches") / F.col("most")).alias("score"))
    return ranked(x, k, ["id"])


def image_search(embeddings: DataFrame, query_id: int, k: int | None = 10, among: DataFrame | None = None) -> DataFrame:
    """By cosine among fingerprints of the query's model and size. `among` (column id) restricts the candidates first."""
    e = embeddings.where("embedding IS NOT NULL AND size(embedding) > 0 AND embedding_model IS NOT NULL").select("id", "embedding", "embedding_model")
    c = e if among is None else e.join(among.select("id").distinct(), "id", "left_semi")
    x = with_query(c, e, query_id, ["embedding", "embedding_model"]).where("embedding_model = q_embedding_model AND size(embedding) = size(q_embedding)")
    return ranked(x.select("id", v.cosine(F.col("embedding"), F.col("q_embedding")).alias("score")), k, ["id"])


def image_tag_search(embeddings: DataFrame, tags: DataFrame, query_id: int, text: str, k: int | None = 10) -> DataFrame:
    """image_search among fingerprints with any of the tags."""
    among = tags.where(F.col("tag").isin(*text.split())).select(F.col("fingerprint_id").alias("id"))
    return image_search(embeddings, query_id, k, among)


def tag_sets(tags: DataFrame) -> DataFrame:
    return tags.groupBy(F.col("fingerprint_id").alias("id")).agg(F.collect_set("tag").alias("tags"))


def resolved_weights(weights: tuple[float, float, float], present: list[Column]) -> list[Column]:
    """Weights of missing signals become zero and the others share the whole."""
    kept = [F.when(p, F.lit(w)).otherwise(F.lit(0.0)) for w, p in zip(weights, present)]
    whole = kept[0] + kept[1] + kept[2]
    return [F.when(whole > 0, w / whole) for w in kept]


def color_family(tag: Column) -> Column:
    t = F.lower(tag)
    return F.when(t.isin("video", "srgb", "rec709"), "video").when(t.isin("acescct", "acescg", "log"), "log").when(t == "linear", "linear").otherwise("unknown")


#: The phrases of a style description.
STYLE = {
    "high contrast": "高对比度", "low contrast": "低对比度", "warm shadows": "暗部偏暖", "cool shadows": "暗部偏冷",
    "soft highlights": "高光柔和延展", "saturated": "饱和度偏高", "muted": "饱和度低", "neutral": "风格中性",
}


def style_description(hist_l: Column, l_std: Column, a_mean: Column, b_mean: Column) -> Column:
    """Contrast, shadow temperature, highlights and saturation in words, joined by ' · '.

    Values between two thresholds say nothing; if all four do, the one closest to a
    threshold (relative to its range) speaks. Null features are neutral.
    """
    say = {k: F.lit(t) for k, t in STYLE.items()}
    p95, chroma2 = v.percentile(hist_l, 0.95), a_mean * a_mean + b_mean * b_mean
    clear = F.array(
        F.when(l_std > 0.35, say["high contrast"]).when(l_std < 0.15, say["low contrast"]), F.when(a_mean < -0.03, say["cool shadows"]).when(a_mean > 0.03, say["warm shadows"]),
        F.when(p95 > 0.85, say["soft highlights"]), F.when(chroma2 > 0.02, say["saturated"]).when(chroma2 < 0.005, say["muted"]),
    )

    def weak(distance: Column, place: int, text: Column) -> Column:
        return F.struct(F.least(distance, F.lit(1.0)).alias("d"), F.lit(place).alias("p"), text.alias("t"))

    closest = F.array_min(
        F.array(
            weak(F.abs(l_std - 0.25) / 0.1, 0, F.when(l_std >= 0.25, say["high contrast"]).otherwise(say["low contrast"])),
            weak(F.abs(a_mean) / 0.03, 1, F.when(a_mean >= 0, say["warm shadows"]).otherwise(say["cool shadows"])),
            weak((0.85 - p95) / 0.85, 2, say["soft highlights"]),
            weak(F.abs(chroma2 - 0.0125) / 0.0075, 3, F.when(chroma2 >= 0.0125, say["saturated"]).otherwise(say["muted"])),
        )
    )["t"]
    words = F.array_join(F.array_compact(clear), " · ")
    known = hist_l.isNotNull() & l_std.isNotNull() & a_mean.isNotNull() & b_mean.isNotNull()
    return F.when(~known, say["neutral"]).when(words != "", words).otherwise(F.coalesce(closest, say["neutral"]))


def finite_embedding() -> Column:
    """The embedding, or null where it is empty or has an element that isn't a finite number."""
    e = F.col("embedding")
    return F.when((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), e)


def hybrid_inputs(fingerprints: DataFrame, features: DataFrame, tags: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id, file_id, n_r, n_g, n_b, embedding, embedding_model, tags, color_space_tag, feature_status): what hybrid search reads.

    Grading features are required; a missing or unsound embedding and missing tags are
    null. `among` (column id) restricts all three inputs before anything is parsed or
    gathered, so it has to name the query's row as well.
    """
    f = fingerprints.select("id", "file_id", finite_embedding().alias("embedding"), "embedding_model", "color_space_tag", "feature_status")
    if among is not None:
        ids = among.select("id").distinct()
        f, features = f.join(ids, "id", "left_semi"), features.join(ids, "id", "left_semi")
        tags = tags.join(ids.withColumnRenamed("id", "fingerprint_id"), "fingerprint_id", "left_semi")
    return f.join(features, "id").join(tag_sets(tags), "id", "left")


def hybrid_search(inputs: DataFrame, query_id: int, weights: tuple[float, float, float] = PRESETS["grading-first"], k: int | None = 10, among: DataFrame | None = None) -> DataFrame:
    """Weighted grading, clip and tag similarity; a signal that either side lacks is left out and the other weights grow.

    Candidates are fingerprints of other files; those without any weighted signal are left
    out. `gap` tells of different color space families, `stale` of features that are older
    than the image or of unknown age. `among` restricts candidates before the ranking.
    """
    cols = ["file_id", "n_r", "n_g", "n_b", "embedding", "embedding_model", "tags", "color_space_tag"]
    c = inputs if among is None else inputs.join(among.select("id").distinct(), "id", "left_semi")
    x = with_query(c, inputs, query_id, cols).where("file_id <> q_file_id")
    has_grading = F.col("n_r").isNotNull() & F.col("q_n_r").isNotNull()
    has_clip = (F.col("embedding_model") == F.col("q_embedding_model")) & (F.size("embedding") == F.size("q_embedding")) & (F.size("embedding") > 0)
    has_tags = F.col("tags").isNotNull() & F.col("q_tags").isNotNull()
    grading = F.least(F.greatest(v.grading_similarity([F.col(f"n_{ch}") for ch in "rgb"], [F.col(f"q_n_{ch}") for ch in "rgb"]), F.lit(0.0)), F.lit(1.0))
    x = x.select(
        "id", F.col("color_space_tag"), F.col("q_color_space_tag"), "feature_status",
        F.when(has_grading, grading).alias("grading"),
        F.when(has_clip, v.clip_similarity(v.cosine(F.col("embedding"), F.col("q_embedding")))).alias("clip"),
        F.when(has_tags, v.jaccard(F.col("tags"), F.col("q_tags"))).alias("tag"),
    )
    w = resolved_weights(weights, [F.col(s).isNotNull() for s in ("grading", "clip", "tag")])
    parts = [F.coalesce(F.col(s), F.lit(0.0)) * wi for s, wi in zip(("grading", "clip", "tag"), w)]
    score = F.least(F.greatest(parts[0] + parts[1] + parts[2], F.lit(0.0)), F.lit(1.0))
    x = x.withColumn("score", score).where("score IS NOT NULL")
    gap = color_family(F.col("color_space_tag")) != color_family(F.col("q_color_space_tag"))
    x = x.withColumns({"gap": gap, "stale": F.coalesce(F.col("feature_status"), F.lit("stale")) == "stale"})
    return ranked(x.select("id", "grading", "clip", "tag", "score", "gap", "stale"), k, ["id"])


def near_and_query(near: DataFrame, query_id: int) -> DataFrame:
    """The ids of a prefilter's hits and of the query itself."""
    return near.select("id").unionByName(near.sparkSession.range(query_id, query_id + 1))


def prefiltered_hybrid(fingerprints: DataFrame, features: DataFrame, tags: DataFrame, query_id: int, weights: tuple[float, float, float], k: int, among: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Hybrid search over the best max(5k, 200) by cosine; the filter comes before the prefilter, so no match in scope is lost to it.

    `near` (column id) are the hits of an index; without it all embeddings are ranked. Only
    the hits' histograms and tags are read on. A query without embedding has no prefilter:
    give it hybrid_search.
    """
    hits = max(5 * k, 200)
    if near is None:
        near = image_search(fingerprints.withColumn("embedding", finite_embedding()), query_id, hits, among)
    ids = F.broadcast(near_and_query(near.select("id"), query_id))  # at most max(5k, 200) + 1 rows
    return hybrid_search(hybrid_inputs(fingerprints, features, tags, ids), query_id, weights, k)


def image_or_listing(embeddings: DataFrame, info: DataFrame, histograms: DataFrame, query_id: int, k: int = 10) -> DataFrame:
    """image_search, or the listing (score 1) where the query has no embedding to search by."""
    ok = embeddings.where((F.col("id") == query_id) & finite_embedding().isNotNull() & F.col("embedding_model").isNotNull()).select(F.lit(1).alias("__q")).limit(1)
    first = image_search(embeddings.withColumn("embedding", finite_embedding()), query_id, k).select("id", "score", "rank")
    return first.unionByName(listing(info, histograms, k).select("id", "score", "rank").join(F.broadcast(ok), how="left_anti"))


def image_tag_or_tag_search(embeddings: DataFrame, tags: DataFrame, query_id: int, text: str, k: int = 10) -> DataFrame:
    """image_tag_search, or tag_search where the query has no embedding to search by."""
    ok = embeddings.where((F.col("id") == query_id) & finite_embedding().isNotNull() & F.col("embedding_model").isNotNull()).select(F.lit(1).alias("__q")).limit(1)
    first = image_tag_search(embeddings.withColumn("embedding", finite_embedding()), tags, query_id, text, k).select("id", "score", "rank")
    return first.unionByName(tag_search(tags, text, k).select("id", "score", "rank").join(F.broadcast(ok), how="left_anti"))


def merged_vocabulary(custom: DataFrame, default: DataFrame) -> DataFrame:
    """(tag, place, custom): the custom tags (tag, place) in their order, then the default ones (tag, place) that aren't among them; each tag once."""
    mine = custom.where("tag IS NOT NULL").groupBy("tag").agg(F.min("place").alias("place"))
    rest = default.where("tag IS NOT NULL").groupBy("tag").agg(F.min("place").alias("place")).join(mine.select("tag"), "tag", "left_anti")
    both = mine.withColumn("custom", F.lit(True)).unionByName(rest.withColumn("custom", F.lit(False)))
    # a vocabulary is a list of labels, counted before it is used; one task orders it
    return both.select("tag", F.row_number().over(Window.orderBy(F.col("custom").desc(), "place", "tag")).cast("long").alias("place"), "custom")


def zero_shot_tags(images: DataFrame, labels: DataFrame, n: int = 5, scale: float = 100.0) -> DataFrame:
    """(id, tag, probability, position): softmax over the cosines of every image with every label vector, the n most likely.

    Labels (tag, vector) are a vocabulary of bounded, counted size that becomes one array next to each image.
    """
    most = 20_000
    if labels.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    packed = labels.agg(F.sort_array(F.collect_list(F.struct("tag", "vector"))).alias("labels"))
    x = images.select("id", F.col("embedding").alias("e")).withColumn("ne", v.norm(F.col("e"))).join(F.broadcast(packed))
    scored = x.select("id", F.transform("labels", lambda t: t["tag"]).alias("names"), F.transform("labels", lambda t: v.cosine(F.col("e"), t["vector"], F.col("ne")) * scale).alias("s"))
    p = scored.withColumn("m", F.array_max("s")).withColumn("ex", F.transform("s", lambda t: F.exp(t - F.col("m")))).withColumn("z", v.total(F.col("ex")))
    best = F.slice(F.sort_array(F.arrays_zip(F.transform("ex", lambda t: t / F.col("z")).alias("p"), F.transform("names", lambda t: t).alias("t")), False), 1, n)
    out = p.select("id", F.posexplode(best).alias("pos", "b"))
    return out.select("id", F.col("b.t").alias("tag"), F.col("b.p").alias("probability"), (F.col("pos") + 1).cast("long").alias("position"))


def feedback_by_rank(results: DataFrame, rank: int, action: str) -> DataFrame:
    """The feedback row of the result with that rank."""
    if action not in ("accepted", "rejected"):
        raise ValueError("action must be 'accepted' or 'rejected'")
    return results.where(F.col("rank") == rank).withColumn("action", F.lit(action))


# Tiles: (id, tile_row, tile_col, n_r, n_g, n_b) with normalised channels.


def tiles_of(histograms: DataFrame, side: int = 2) -> DataFrame:
    """Square tiles from slices of the channels: side * side tiles of 64 / side**2 bins each."""
    n = side * side
    cut = histograms.select("id", *[v.equal_parts(F.col(f"hist_{c}"), n).alias(c) for c in "rgb"])
    x = cut.select("id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "t"))
    x = x.select("id", F.floor(F.col("pos") / side).cast("int").alias("tile_row"), (F.col("pos") % side).cast("int").alias("tile_col"), *[F.col(f"t.{c}").alias(f"t_{c}") for c in "rgb"])
    x = x.withColumns({f"s_{c}": v.total(F.col(f"t_{c}")) for c in "rgb"})
    return x.select("id", "tile_row", "tile_col", *[v.normalised(F.col(f"t_{c}"), F.col(f"s_{c}")).alias(f"n_{c}") for c in "rgb"])


def stored_tiles(tiles: DataFrame, fingerprint_id: int) -> DataFrame:
    """The tiles of one fingerprint, row by row."""
    return tiles.where(F.col("id") == fingerprint_id).orderBy("tile_row", "tile_col")


def tile_similarity() -> Column:
    return v.grading_similarity([F.col(f"n_{c}") for c in "rgb"], [F.col(f"q_n_{c}") for c in "rgb"])


def tile_search(tiles: DataFrame, query_id: int, mode: str = "spatial", k: int | None = 10) -> DataFrame:
    """Mean coefficient of tiles in the same place ('spatial'), or of each query tile with the candidate's best tile anywhere ('any').

    The query's tiles are a grid of at most some hundred rows, so they are broadcast.
    """
    cols = ["tile_row", "tile_col", "n_r", "n_g", "n_b"]
    q = tiles.where(F.col("id") == query_id).select(*[F.col(c).alias(f"q_{c}") for c in cols])
    c = tiles.where(F.col("id") != query_id)
    if mode == "spatial":
        x = c.join(F.broadcast(q), (F.col("tile_row") == F.col("q_tile_row")) & (F.col("tile_col") == F.col("q_tile_col")))
        s = x.select("id", tile_similarity().alias("s")).groupBy("id").agg(F.avg("s").alias("score"))
    elif mode == "any":
        x = c.join(F.broadcast(q)).select("id", "q_tile_row", "q_tile_col", tile_similarity().alias("s"))
        best = x.groupBy("id", "q_tile_row", "q_tile_col").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("s"))
        s = best.groupBy("id").agg(F.avg("s").alias("score"))  # a row per query tile, so the mean divides by their number
    else:
        raise ValueError("mode must be 'spatial' or 'any'")
    return ranked(s, k, ["id"])


def pyramid(tiles: DataFrame, finest: int) -> DataFrame:
    """(id, level, row, col, n_r, n_g, n_b): tiles averaged to 1 x 1, 2 x 2 and the finest grid.

    Levels finer than the grid are left out; where a level doesn't divide the grid, edge
    tiles beyond the last full block are left out, as in the block arithmetic of the definition.
    """
    levels = list(dict.fromkeys(x for x in (1, 2, finest) if x <= finest))
    out = None
    for i, level in enumerate(levels):
        step = finest // level
        at = tiles.where((F.col("tile_row") < step * level) & (F.col("tile_col") < step * level))
        at = at.select("id", F.floor(F.col("tile_row") / step).cast("int").alias("row"), F.floor(F.col("tile_col") / step).cast("int").alias("col"), "n_r", "n_g", "n_b")
        if step > 1:
            x = at.select("id", "row", "col", F.posexplode(F.arrays_zip("n_r", "n_g", "n_b")).alias("bin", "v"))
            m = x.groupBy("id", "row", "col", "bin").agg(*[F.avg(f"v.n_{c}").alias(c) for c in "rgb"])
            m = m.groupBy("id", "row", "col").agg(F.sort_array(F.collect_list(F.struct("bin", "r", "g", "b"))).alias("v"))
            at = m.select("id", "row", "col", *[F.col(f"v.{c}").alias(f"n_{c}") for c in "rgb"])
        at = at.withColumn("level", F.lit(i))
        out = at if out is None else out.unionByName(at)
    return out


def pyramid_of_pixels(pixels: DataFrame, keys: list[str], width: str, height: str, sides: tuple[int, ...] = (1, 2, 4), bins: int = 64) -> DataFrame:
    """(keys, level, tile_row, tile_col, features): the features of tiles taken anew at every level, from the whole image down."""
    out = None
    for i, side in enumerate(sides):
        t = tile_features(pixels, keys, width, height, side, bins).withColumn("level", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out


def pyramid_search(levels: DataFrame, query_id: int, k: int | None = 10, weights: tuple[float, ...] = PYRAMID_WEIGHTS) -> DataFrame:
    """Weighted mean coefficient per level; a level that is missing counts 0."""
    cols = ["level", "row", "col", "n_r", "n_g", "n_b"]
    q = levels.where(F.col("id") == query_id).select(*[F.col(c).alias(f"q_{c}") for c in cols])
    x = levels.where(F.col("id") != query_id).join(F.broadcast(q), (F.col("level") == F.col("q_level")) & (F.col("row") == F.col("q_row")) & (F.col("col") == F.col("q_col")))
    per = x.select("id", "level", tile_similarity().alias("s")).groupBy("id", "level").agg(F.avg("s").alias("s"))
    w = F.element_at(F.array(*[F.lit(float(t)) for t in weights]), F.col("level") + 1)
    return ranked(per.groupBy("id").agg(F.sum(w * F.col("s")).alias("score")), k, ["id"])
