"""Queries of the llm problems, each over its whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bktree, bpe, cooccurrence, looks, packing, segments, topn, vptree
from gradeloom.storage import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SOUND = """SELECT id, embedding_model, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM fingerprints
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
  AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"""


@query(
    "p1_found",
    f"""WITH v AS ({SOUND}) SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b
  ON a.embedding_model = b.embedding_model AND a.id < b.id AND list_cosine_similarity(a.e, b.e) >= 0.97""",
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fingerprints of one model with a cosine of at least 0.97."""
    return vptree.similar_pairs(read_table(spark, sf_dir, "fingerprints"), min_cosine=0.97, k=10)


@query("p1_neighbours")
def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest fingerprints, against all rows, of every fingerprint whose id is divisible by 50."""
    rows = read_table(spark, sf_dir, "fingerprints")
    asked = rows.where(F.col("id") % 50 == 0).select("id")
    near = vptree.similar_vectors(rows, k=10, queries=asked)
    return near.select("id", "neighbour", F.round("cosine", 6).alias("cosine"), "position")


@query(
    "p6_found",
    """SELECT project_name, result_id FROM (SELECT project_name, result_id, row_number() OVER
  (PARTITION BY project_name ORDER BY score DESC, file_path ASC, result_id ASC) AS n FROM
  (SELECT DISTINCT project_name, file_path, result_id, score FROM search_results
   WHERE project_name IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))) WHERE n <= 10""",
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best search results of every project."""
    return topn.best_results(read_table(spark, sf_dir, "search_results"), 10).select("project_name", "result_id")


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


PAIRS_SQL = """WITH d AS (SELECT DISTINCT project_name AS p, filename AS f, lower(trim(tag, ' ')) AS t FROM tags
    WHERE project_name IS NOT NULL AND filename IS NOT NULL AND trim(tag, ' ') <> ''),
  c AS (SELECT t, count(*) AS n FROM d GROUP BY t), r AS (SELECT count(*) AS n FROM (SELECT DISTINCT p, f FROM d)),
  j AS (SELECT a.t AS ta, b.t AS tb, count(*) AS n FROM d a JOIN d b ON a.p = b.p AND a.f = b.f AND a.t < b.t GROUP BY 1, 2 HAVING count(*) >= 5),
  x AS (SELECT j.ta, j.tb, j.n, ca.n AS na, cb.n AS nb, r.n AS nr FROM j JOIN c ca ON j.ta = ca.t JOIN c cb ON j.tb = cb.t, r)
  """


@query("p2_found", PAIRS_SQL + "SELECT ta AS tag_a, tb AS tag_b FROM x WHERE n * nr >= 3 * na * nb")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags in at least five files together and three times as often as by chance."""
    pairs = cooccurrence.surprising_pairs(cooccurrence.tag_records(read_table(spark, sf_dir, "tags")), least=5)
    return pairs.where(F.col("n_ab") * F.col("records") >= 3 * F.col("n_a") * F.col("n_b")).select("tag_a", "tag_b")


@query(
    "p2_pairs",
    PAIRS_SQL + "SELECT ta AS tag_a, tb AS tag_b, n AS n_ab, na AS n_a, nb AS n_b, nr AS records, n * nr::DOUBLE / (na::DOUBLE * nb) AS lift FROM x",
)
def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts and lift of every pair in at least five files."""
    pairs = cooccurrence.surprising_pairs(cooccurrence.tag_records(read_table(spark, sf_dir, "tags")), least=5)
    return pairs.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", "records", "lift")


@query("p2_surprise")
def p2_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their expectation under the fitted null, tail probability and false-discovery rate."""
    return cooccurrence.surprising_pairs(cooccurrence.tag_records(read_table(spark, sf_dir, "tags")), least=5)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every freely typed value with the vocabulary entry that was meant, or -1."""
    tables = [read_table(spark, sf_dir, t) for t in ("tags", "dataset_entries", "style_vocabulary")]
    return bktree.canonical_values(*tables)


@query("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every non-empty document, measured in tokens, in a container of 2,048."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 1,024 tokens: those that the splitter cuts."""
    pieces = segments.split_documents(read_table(spark, sf_dir, "documents"))
    return pieces.where("piece = 0").select("doc_id")


@query("p9_pieces")
def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document of more than 1,024 tokens."""
    return segments.split_documents(read_table(spark, sf_dir, "documents"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fingerprints of one review sheet that belong to the same look."""
    members, _ = looks.looks_of(read_table(spark, sf_dir, "fingerprints"), degrees=False)
    return looks.sheet_pairs(members, read_table(spark, sf_dir, "review_sheets"))


@query("p3_looks")
def p3_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every look with its size and its five most typical fingerprints."""
    members, _ = looks.looks_of(read_table(spark, sf_dir, "fingerprints"))
    return looks.describe_looks(members)
