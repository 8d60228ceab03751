"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    best_fit,
    cotraining,
    hard_negatives,
    hilbert_zones,
    interpolated_lm,
    language_bitmask,
    lsh_forest,
    mixing,
    norm_buckets,
    order_minhash,
    rp_forest,
    token_orc,
    warc_chunks,
)
from corpusloom.llm.common import fold, shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


@registered
def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-ids")
    token_orc.write_token_ids(table(spark, sf_dir, "documents"), path)
    return token_orc.token_digests(spark, path)


@registered
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_neighbours(table(spark, sf_dir, "documents"))


@registered
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLES["op3_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), totals AS (
  SELECT no_source, name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY no_source, name)) - 1) % 3 + 1] AS weight,
    sum(source_size) OVER () AS total
  FROM totals
), filled AS (
  SELECT *,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, no_source, name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    sum(weight) OVER (ORDER BY 2 * source_size / weight, no_source, name
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open
  FROM weighed
), level AS (
  SELECT max(total) AS total, arg_min((1.5::DOUBLE * total - capped) / open, capped) AS level FROM filled
  WHERE 2 * source_size >= weight * ((1.5::DOUBLE * total - capped) / open)
), targets AS (
  SELECT no_source, name, source_size, least((2 * source_size)::DOUBLE, weight * level) AS target
  FROM weighed, level
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY no_source, name ORDER BY size DESC, doc_id NULLS FIRST) AS place,
    coalesce(CASE WHEN source_size > 0 THEN floor(target * 16777216 / source_size)::BIGINT END, 0) AS rate,
    ('0x' || substr(md5('0:' || no_source::VARCHAR || ':' || name), 1, 6))::BIGINT AS start
  FROM sized JOIN targets USING (no_source, name)
)
SELECT doc_id, size, source_size, target,
  ((place * rate + start) // 16777216 - ((place - 1) * rate + start) // 16777216)::BIGINT AS copies,
  ((place * rate + start) // 16777216 - ((place - 1) * rate + start) // 16777216)::BIGINT * size AS taken
FROM placed
"""


@registered
def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "class_no")


@registered
def op5_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    segments = warc_chunks.archive(table(spark, sf_dir, "pages"), path)
    read = warc_chunks.read_chunks(spark, path, segments, with_data=False).where("last")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registered
def op6_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(table(spark, sf_dir, "documents"))


@registered
def op7_rp_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@registered
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(best_fit.token_pieces(table(spark, sf_dir, "documents")))


@registered
def op9_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_bitmask.train(language_bitmask.training_rows(docs))
    found = language_bitmask.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "coverage")


@registered
def op10_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "score", "keep", "text_score", "metadata_score")


@registered
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, moved)


#: Vectors of the table whose components are whole after scaling, and inner products of two lists.
WHOLE = """
whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
)"""

ORACLES["op11_hard_negatives"] = f"""
WITH {WHOLE.format(scale=256)}, moved AS (
  SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM whole WHERE label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM moved a JOIN moved b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@registered
def op12_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_zones.cluster(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int) -> str:
    """Common table expressions: assigned<r> goes by centroids<r>, centroids<r + 1> are their means."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""gaps{r} AS (
  SELECT vec_id, c.cluster, sum((v.value - c.value) * (v.value - c.value))::BIGINT AS distance
  FROM components v JOIN centroids{r} c USING (place) GROUP BY vec_id, c.cluster
), assigned{r} AS (
  SELECT * FROM gaps{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)""")
        if r < rounds:
            parts.append(f"""means{r} AS (
  SELECT cluster, place, floor(sum(value)::DOUBLE / count(*))::BIGINT AS value
  FROM components JOIN assigned{r} USING (vec_id) GROUP BY cluster, place
), centroids{r + 1} AS (
  SELECT cluster, place, coalesce(m.value, c.value) AS value FROM centroids{r} c LEFT JOIN means{r} m USING (cluster, place)
)""")
    return ", ".join(parts)


ORACLES["op12_hilbert_zones"] = f"""
WITH {WHOLE.format(scale=64)}, kept AS (
  SELECT vec_id, x FROM whole WHERE len(x) = 64
), components AS (
  SELECT vec_id, unnest(x)::BIGINT AS value, unnest(range(64)) AS place FROM kept
), starts AS (
  SELECT vec_id, (row_number() OVER (ORDER BY sha256('1:' || vec_id)))::INTEGER - 1 AS cluster FROM kept
  QUALIFY cluster < 16
), centroids0 AS (
  SELECT cluster, place, value FROM components JOIN starts USING (vec_id)
), {_rounds(3)}, prints AS (
  SELECT cluster, sha256(string_agg(value::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM centroids3 GROUP BY cluster
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM assigned3 JOIN prints USING (cluster)
"""


@registered
def op13_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op13_norm_buckets"] = f"""
WITH {WHOLE.format(scale=256)}
SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.x, b.x)::BIGINT AS score,
  (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, b.x) DESC, b.vec_id))::INTEGER AS rank
FROM whole q JOIN whole b ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id
QUALIFY rank <= 5
"""
