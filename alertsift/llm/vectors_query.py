"""Query of the vector near-duplicates, and its SQL twin (all pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import vectors
from .catalog import query
from .common import table

SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT vec_id AS start, vec_id AS node FROM embeddings UNION SELECT r.start, l.b FROM reach r JOIN links l ON r.node = l.a),
parts AS (SELECT start AS vec_id, min(node) AS component_id FROM reach GROUP BY start)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN degree ON vec_id = a
"""


@query("op7_embedding_near_dedup", SQL)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
