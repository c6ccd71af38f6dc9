"""Query of the near-duplicate search, and its SQL twin (a join on shared shingles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import minhash
from .catalog import query
from .common import table

SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) END) AS g FROM words),
sets AS (SELECT DISTINCT doc_id, g FROM grams),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, e.b FROM reach r JOIN either e ON r.node = e.a),
parts AS (SELECT start AS doc_id, min(node) AS component_id FROM reach GROUP BY start)
SELECT p.doc_id, coalesce(n, 0) AS n_shingles, component_id, p.doc_id = component_id AS kept
FROM parts p LEFT JOIN sizes s ON p.doc_id = s.doc_id
"""


@query("op5_minhash_near_dedup", SQL)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, percent=85)
