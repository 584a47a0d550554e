"""Search queries R1-R23 and their score functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.catalog import Catalog
from gradeloom.functions import vector as v
from gradeloom.operators import index as vectors
from gradeloom.operators import search as ops
from gradeloom.plans.registry import query
from gradeloom.plans.sqltext import HISTS, INFO, TAGS, with_
from gradeloom.storage import is_kept, scratch

QUERY_ID = 7
WORDS = "gilded_skyline plum_ceiling velvet_pulse"
QUOTED = ", ".join(f"'{w}'" for w in WORDS.split())


def norm_sql(h: str) -> str:
    return f"CASE WHEN list_sum({h}) > 0 THEN list_transform({h}, lambda x: x / list_sum({h})) ELSE list_transform({h}, lambda x: 1.0::DOUBLE / len({h})) END"


NORM = "nf AS (SELECT id, " + ", ".join(f"{norm_sql('hist_' + c)} AS n_{c}" for c in "rgb") + " FROM hi)"


def coef_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: sqrt(greatest(z[1], 1e-10::DOUBLE) * greatest(z[2], 1e-10::DOUBLE))))"


def inter_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: least(z[1], z[2])))"


GRADING = "(" + " + ".join(coef_sql(f"c.n_{x}", f"q.n_{x}") for x in "rgb") + ") / 3"
COS = "list_cosine_similarity(list_transform(c.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"
COSINE = f"CASE WHEN list_sum(list_transform(c.embedding, lambda x: abs(x::DOUBLE))) = 0 OR list_sum(list_transform(q.embedding, lambda x: abs(x::DOUBLE))) = 0 THEN 0 ELSE {COS} END"
EMB = "em AS (SELECT id, embedding, embedding_model FROM fingerprints WHERE embedding IS NOT NULL AND len(embedding) > 0 AND embedding_model IS NOT NULL)"
SETS = "st AS (SELECT fingerprint_id AS id, list(DISTINCT tag) AS tags FROM tg GROUP BY 1)"


def top_sql(body: str, k: int | None, cols: str = "id, score") -> str:
    """Ranks (id, score, ...) rows; scores are rounded after the ranking."""
    limit = f" QUALIFY rank <= {k}" if k else ""
    shown = cols.replace("score", "round(score, 6) AS score")
    return f"SELECT {shown}, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({body}){limit}"


def _register(name: str, sql: str, f, score: str = "score") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Catalog(spark, sf_dir)).withColumn(score, F.round(score, 6))

    run.__name__ = name
    query(name, sql)(run)


def _features(c: Catalog) -> DataFrame:
    return ops.normalised_features(c.histograms)


def _sound_embeddings(c: Catalog) -> DataFrame:
    """Non-finite vectors have no cosine; they are left out before the search."""
    return c.fingerprints.where(F.coalesce(F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


FINITE = "AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))"
EMB = EMB[:-1] + f" {FINITE})"

_register("r3_similar_grades", with_(HISTS, NORM) + top_sql(f"SELECT c.id, {GRADING} AS score FROM nf c, nf q WHERE q.id = {QUERY_ID} AND c.id <> q.id", 10), lambda c: ops.grading_search(_features(c), QUERY_ID, 10))
_register("grading_scores", with_(HISTS, NORM) + f"SELECT c.id, round({GRADING}, 6) AS score FROM nf c, nf q WHERE q.id = {QUERY_ID} AND c.id <> q.id", lambda c: ops.grading_search(_features(c), QUERY_ID, None))
_register(
    "histogram_search",
    with_(HISTS, NORM) + top_sql("SELECT c.id, (" + " + ".join(inter_sql(f"c.n_{x}", f"q.n_{x}") for x in "rgb") + f") / 3 AS score FROM nf c, nf q WHERE q.id = {QUERY_ID} AND c.id <> q.id", 10),
    lambda c: ops.histogram_search(_features(c), QUERY_ID, 10),
)
_register(
    "histogram_listing",
    with_(INFO, HISTS) + "SELECT id, project_name, filename, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY project_name, filename, id) AS rank FROM inf WHERE id IN (SELECT id FROM hi) QUALIFY rank <= 50",
    lambda c: ops.listing(c.info, c.histograms, 50),
)
TAGGED = f"SELECT fingerprint_id AS id, count(DISTINCT tag) AS matches, count(DISTINCT tag)::DOUBLE / max(count(DISTINCT tag)) OVER () AS score FROM tg WHERE tag IN ({QUOTED}) GROUP BY 1"
_register("tag_search", with_(TAGS) + top_sql(TAGGED, 20, "id, matches, score"), lambda c: ops.tag_search(c.tags, WORDS, 20))
_register("tag_scores", with_(TAGS) + f"SELECT id, matches, round(score, 6) AS score FROM ({TAGGED})", lambda c: ops.tag_search(c.tags, WORDS, None))
IMAGE = f"SELECT c.id, {COSINE} AS score FROM em c, em q WHERE q.id = {QUERY_ID} AND c.id <> q.id AND c.embedding_model = q.embedding_model AND len(c.embedding) = len(q.embedding)"
_register("image_search", with_(EMB) + top_sql(IMAGE, 10), lambda c: ops.image_search(_sound_embeddings(c), QUERY_ID, 10))
_register("image_scores", with_(EMB) + f"SELECT id, round(score, 6) AS score FROM ({IMAGE})", lambda c: ops.image_search(_sound_embeddings(c), QUERY_ID, None))
_register("image_tag_search", with_(EMB, TAGS) + top_sql(IMAGE + f" AND c.id IN (SELECT fingerprint_id FROM tg WHERE tag IN ({QUOTED}))", 10), lambda c: ops.image_tag_search(_sound_embeddings(c), c.tags, QUERY_ID, WORDS, 10))

SOUND = "CASE WHEN len(f.embedding) > 0 AND list_bool_and(list_transform(f.embedding, lambda x: isfinite(x))) THEN f.embedding END"
INPUTS = f"""hin AS (SELECT f.id, f.file_id, {SOUND} AS embedding, f.embedding_model, f.color_space_tag, f.feature_status, n.n_r, n.n_g, n.n_b, s.tags, i.project_name FROM fingerprints f
  JOIN nf n ON n.id = f.id LEFT JOIN st s ON s.id = f.id LEFT JOIN inf i ON i.id = f.id)"""
FAMILY = "CASE WHEN lower({0}) IN ('video', 'srgb', 'rec709') THEN 'video' WHEN lower({0}) IN ('acescct', 'acescg', 'log') THEN 'log' WHEN lower({0}) = 'linear' THEN 'linear' ELSE 'unknown' END"
SIGNALS = f"""sg AS (SELECT c.id, c.project_name, CASE WHEN c.n_r IS NOT NULL AND q.n_r IS NOT NULL THEN least(greatest({GRADING}, 0), 1) END AS grading,
  CASE WHEN c.embedding_model = q.embedding_model AND len(c.embedding) = len(q.embedding) AND len(c.embedding) > 0 THEN (({COSINE}) + 1) / 2 END AS clip,
  CASE WHEN c.tags IS NOT NULL AND q.tags IS NOT NULL THEN len(list_intersect(c.tags, q.tags))::DOUBLE / len(list_distinct(list_concat(c.tags, q.tags))) END AS tag,
  {FAMILY.format('c.color_space_tag')} <> {FAMILY.format('q.color_space_tag')} AS gap, coalesce(c.feature_status, 'stale') = 'stale' AS stale
  FROM hin c, hin q WHERE q.id = {{Q}} AND c.id <> q.id AND c.file_id <> q.file_id)"""


def hybrid_sql(w: tuple[float, float, float], where: str = "true", query_id: int | str = QUERY_ID) -> str:
    num = " + ".join(f"coalesce({s} * {x}::DOUBLE, 0)" for s, x in zip(("grading", "clip", "tag"), w))
    den = " + ".join(f"CASE WHEN {s} IS NULL THEN 0 ELSE {x}::DOUBLE END" for s, x in zip(("grading", "clip", "tag"), w))
    body = f"SELECT *, least(greatest(({num}) / nullif({den}, 0), 0), 1) AS score FROM sg WHERE {where}"
    return with_(EMB, HISTS, NORM, TAGS, SETS, INFO, INPUTS, SIGNALS.replace("{Q}", str(query_id))) + (
        "SELECT id, round(grading, 6) AS grading, round(clip, 6) AS clip, round(tag, 6) AS tag, round(score, 6) AS score, gap, stale, "
        f"row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({body}) WHERE score IS NOT NULL QUALIFY rank <= 10"
    )


def _inputs(c: Catalog) -> DataFrame:
    return ops.hybrid_inputs(c.fingerprints, _features(c), c.tags)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({s: F.round(s, 6) for s in ("grading", "clip", "tag")})


for _name, _w in {"grading_first": ops.PRESETS["grading-first"], "balanced": ops.PRESETS["balanced"], "no_clip": (0.7, 0.0, 0.3), "no_tags": (0.5, 0.5, 0.0), "grading_only": (1.0, 0.0, 0.0), "tag_only": (0.0, 0.0, 1.0)}.items():
    _register(f"hybrid_{_name}", hybrid_sql(_w), lambda c, w=_w: _rounded(ops.hybrid_search(_inputs(c), QUERY_ID, w, 10)))
_register(
    "hybrid_in_project",
    hybrid_sql(ops.PRESETS["balanced"], "project_name = 'glass_estuary'"),
    lambda c: _rounded(ops.hybrid_search(_inputs(c), QUERY_ID, ops.PRESETS["balanced"], 10, c.info.where("project_name = 'glass_estuary'").select("id"))),
)
_register(
    "hybrid_prefiltered",
    hybrid_sql(ops.PRESETS["balanced"], "id IN (SELECT c.id FROM em c, em q WHERE q.id = " + f"{QUERY_ID} AND c.id <> q.id AND c.embedding_model = q.embedding_model AND len(c.embedding) = len(q.embedding) ORDER BY {COSINE} DESC, c.id LIMIT 200)"),
    lambda c: _rounded(ops.prefiltered_hybrid(c.fingerprints, _features(c), c.tags, QUERY_ID, ops.PRESETS["balanced"], 10)),
)
BARE = "(SELECT min(f.id) FROM fingerprints f JOIN nf n ON n.id = f.id WHERE f.embedding IS NULL)"


def _without_embedding(c: Catalog) -> int:
    """The first fingerprint with grading features and no embedding."""
    return c.fingerprints.where("embedding IS NULL").select("id").join(c.histograms.select("id"), "id", "left_semi").agg(F.min("id")).first()[0]


_register("hybrid_without_embedding", hybrid_sql(ops.PRESETS["balanced"], query_id=BARE), lambda c: _rounded(ops.hybrid_search(_inputs(c), _without_embedding(c), ops.PRESETS["balanced"], 10)))
_register(
    "hybrid_missing_signals",
    with_(HISTS, NORM, TAGS, SETS, INFO, INPUTS, SIGNALS.replace("{Q}", str(QUERY_ID))) + "SELECT clip IS NULL AS no_clip, tag IS NULL AS no_tag, gap, stale, count(*) AS n, round(sum((0.4::DOUBLE * grading + coalesce(0.4::DOUBLE * clip, 0) + coalesce(0.2::DOUBLE * tag, 0)) / (0.4::DOUBLE + CASE WHEN clip IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN tag IS NULL THEN 0 ELSE 0.2::DOUBLE END)), 6) AS score FROM sg GROUP BY ALL",
    lambda c: ops.hybrid_search(_inputs(c), QUERY_ID, ops.PRESETS["balanced"], None).groupBy(F.col("clip").isNull().alias("no_clip"), F.col("tag").isNull().alias("no_tag"), "gap", "stale").agg(F.count("*").alias("n"), F.sum("score").alias("score")),
)
LISTED = with_(INFO, HISTS, NORM) + f"SELECT id, 1.0::DOUBLE AS score, row_number() OVER (ORDER BY project_name, filename, id) AS rank FROM inf WHERE id IN (SELECT id FROM hi) AND {BARE} IS NOT NULL QUALIFY rank <= 10"
_register("image_search_fallback", LISTED, lambda c: ops.image_or_listing(c.fingerprints, c.info, c.histograms, _without_embedding(c), 10))
_register(
    "image_tag_fallback",
    with_(TAGS) + top_sql(f"SELECT * FROM ({TAGGED})", 10),
    lambda c: ops.image_tag_or_tag_search(c.fingerprints, c.tags, _without_embedding(c), WORDS, 10),
)


_INDEXES: dict[tuple[str, str], tuple[str, vectors.VectorIndex]] = {}


def _index(c: Catalog) -> vectors.VectorIndex:
    """The index of the catalog's embeddings in the shared folder, built once a session for a data directory."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _INDEXES or not is_kept(_INDEXES[key][0]):
        path = scratch(c.spark, "index")
        _INDEXES[key] = path, vectors.load_or_build(c.fingerprints.select("id", "embedding", "embedding_model"), path)
    return _INDEXES[key][1]


_register("image_search_exact_index", with_(EMB, "ez AS (SELECT * FROM em WHERE list_bool_or(list_transform(embedding, lambda x: x <> 0)))") + top_sql(IMAGE.replace("em c, em q", "ez c, ez q"), 10), lambda c: vectors.search(_index(c), c.fingerprints, QUERY_ID, 10, None))


@query("image_search_indexed")
def image_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten by cosine from the nearest cells of the index; approximate, so no SQL: its recall is tested."""
    c = Catalog(spark, sf_dir)
    return vectors.search(_index(c), c.fingerprints, QUERY_ID, 10).withColumn("score", F.round("score", 6))


@query("hybrid_indexed")
def hybrid_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over the index's best 200."""
    c = Catalog(spark, sf_dir)
    near = vectors.search(_index(c), c.fingerprints, QUERY_ID, 200)
    found = ops.prefiltered_hybrid(c.fingerprints, _features(c), c.tags, QUERY_ID, ops.PRESETS["balanced"], 10, near=near)
    return _rounded(found).withColumn("score", F.round("score", 6))


@query("tag_sets", with_(TAGS) + "SELECT fingerprint_id AS id, string_agg(tag, '|' ORDER BY tag) AS tags, count(*) AS n FROM (SELECT DISTINCT fingerprint_id, tag FROM tg) GROUP BY 1")
def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.tag_sets(Catalog(spark, sf_dir).tags)
    return s.select("id", F.array_join(F.sort_array("tags"), "|").alias("tags"), F.size("tags").cast("long").alias("n"))


@query(
    "zero_shot_tags",
    f"""WITH l AS (SELECT 'm' || label AS tag, list_transform(range(1, 65), lambda i: avg_[i]) AS vector FROM (SELECT label, list(m ORDER BY pos) AS avg_ FROM
    (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)),
  e AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM fingerprints WHERE len(embedding) = 64 {FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
  s AS (SELECT e.id, l.tag, list_cosine_similarity(e.v, l.vector) * 100 AS s FROM e, l),
  p AS (SELECT id, tag, exp(s - max(s) OVER (PARTITION BY id)) AS ex FROM s),
  r AS (SELECT id, tag, ex / sum(ex) OVER (PARTITION BY id) AS p FROM p)
  SELECT id, tag, round(p, 6) AS probability, row_number() OVER (PARTITION BY id ORDER BY p DESC, tag DESC) AS position FROM r QUALIFY position <= 3""",
)
def zero_shot_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label vectors are the mean embeddings of the labelled table."""
    c = Catalog(spark, sf_dir)
    x = c.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    labels = x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda t: t["m"]).alias("vector")).select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("tag"), "vector")
    e = _sound_embeddings(c).where((F.size("embedding") == 64) & F.exists("embedding", lambda t: t != 0)).select("id", F.transform("embedding", lambda t: t.cast("double")).alias("embedding"))
    return ops.zero_shot_tags(e, labels, 3).withColumn("probability", F.round("probability", 6))


def tile_norm(h: str, i: str) -> str:
    return norm_sql(f"list_slice({h}, {i} * 16 + 1, {i} * 16 + 16)")


TILES = "tl AS (SELECT id, (t // 2)::INT AS tile_row, (t % 2)::INT AS tile_col, " + ", ".join(f"{tile_norm('hist_' + c, 't')} AS n_{c}" for c in "rgb") + " FROM hi, range(4) r(t))"
PAIR = f"SELECT c.id, q.tile_row AS qr, q.tile_col AS qc, {GRADING} AS s FROM tl c, tl q WHERE q.id = {QUERY_ID} AND c.id <> q.id"
_register("tile_search_spatial", with_(HISTS, TILES) + top_sql(f"SELECT id, avg(s) AS score FROM ({PAIR} AND c.tile_row = q.tile_row AND c.tile_col = q.tile_col) GROUP BY 1", 10), lambda c: ops.tile_search(ops.tiles_of(c.histograms), QUERY_ID, "spatial", 10))
_register("tile_search_any", with_(HISTS, TILES) + top_sql(f"SELECT id, avg(s) AS score FROM (SELECT id, qr, qc, greatest(max(s), 0) AS s FROM ({PAIR}) GROUP BY 1, 2, 3) GROUP BY 1", 10), lambda c: ops.tile_search(ops.tiles_of(c.histograms), QUERY_ID, "any", 10))
LEVELS = """pl AS (SELECT id, 1 AS level, tile_row, tile_col, n_r, n_g, n_b FROM tl UNION ALL SELECT id, 0, 0, 0, list(r ORDER BY i), list(g ORDER BY i), list(b ORDER BY i) FROM
  (SELECT id, i, avg(n_r[i]) AS r, avg(n_g[i]) AS g, avg(n_b[i]) AS b FROM tl, range(1, 17) x(i) GROUP BY 1, 2) GROUP BY 1)"""
_register(
    "pyramid_search",
    with_(HISTS, TILES, LEVELS)
    + top_sql(f"SELECT id, sum(0.25::DOUBLE * s) AS score FROM (SELECT c.id, c.level, avg({GRADING}) AS s FROM pl c, pl q WHERE q.id = {QUERY_ID} AND c.id <> q.id AND c.level = q.level AND c.tile_row = q.tile_row AND c.tile_col = q.tile_col GROUP BY 1, 2) GROUP BY 1", 10),
    lambda c: ops.pyramid_search(ops.pyramid(ops.tiles_of(c.histograms), 2), QUERY_ID, 10),
)


@query("luminance_percentiles", with_(HISTS) + """SELECT id, round(CASE WHEN t <= 0 THEN 0 ELSE (k - 1 + (0.95::DOUBLE * t - coalesce(c[k - 1], 0)) / hist_r[k]) / 64 END, 6) AS p95 FROM
  (SELECT *, list_position(list_transform(range(1, 65), lambda i: c[i] >= 0.95::DOUBLE * t AND hist_r[i] > 0), true) AS k FROM
  (SELECT id, hist_r, list_sum(hist_r) AS t, list_transform(range(1, 65), lambda i: list_sum(hist_r[1:i])) AS c FROM hi))""")
def luminance_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark, sf_dir).histograms.select("id", F.round(v.percentile(F.col("hist_r"), 0.95), 6).alias("p95"))


@query("feedback_of_rank", with_(HISTS, NORM) + f"SELECT id, 'accepted' AS action FROM ({top_sql(f'SELECT c.id, {GRADING} AS score FROM nf c, nf q WHERE q.id = {QUERY_ID} AND c.id <> q.id', 10)}) WHERE rank = 3")
def feedback_of_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.grading_search(_features(Catalog(spark, sf_dir)), QUERY_ID, 10)
    return ops.feedback_by_rank(found, 3, "accepted").select("id", "action")


@query(
    "merged_vocabulary",
    with_(TAGS) + "SELECT tag, row_number() OVER (ORDER BY custom DESC, place, tag) AS place, custom FROM (SELECT tag, -count(*) AS place, true AS custom FROM tg WHERE source = 'manual' GROUP BY 1 HAVING count(*) >= 3 UNION ALL SELECT tag, vocab_id, false FROM style_vocabulary WHERE tag NOT IN (SELECT tag FROM tg WHERE source = 'manual' GROUP BY 1 HAVING count(*) >= 3))",
)
def merged_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's own tags by how often they were given, then the vocabulary."""
    c = Catalog(spark, sf_dir)
    mine = c.tags.where("source = 'manual'").groupBy("tag").agg(F.count("*").alias("n")).where("n >= 3").select("tag", (-F.col("n")).alias("place"))
    return ops.merged_vocabulary(mine, c.table("style_vocabulary").select("tag", F.col("vocab_id").alias("place")))
