"""Query of the source mix, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .catalog import query
from .common import table

_BITS = ", ".join(
    f"CAST('0x' || substr(sha256('{k // 8}|' || key), {8 * (k % 8) + 1}, 8) AS BIGINT)" for k in range(mixing.DRAWS)
)
_SUMS = ", ".join(f"CAST(sum(CASE WHEN bits[{k + 1}] < cut THEN size ELSE 0 END) AS BIGINT)" for k in range(mixing.DRAWS))
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS key FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS HUGEINT) AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(s) OVER () AS total, sum(w) OVER () AS weights,
    coalesce(sum(3 * s) OVER o, 0) AS full_before, coalesce(sum(w) OVER o, 0) AS weights_before
  FROM sources WINDOW o AS (ORDER BY 6 * s // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT CAST(total - full_before AS HUGEINT) AS t, CAST(weights - weights_before AS HUGEINT) AS w FROM ordered
  ORDER BY CAST(total - full_before AS DOUBLE) / CAST(weights - weights_before AS DOUBLE) DESC LIMIT 1),
targets AS (
  SELECT source, CAST(s AS BIGINT) AS source_size, 3 * s * level.w <= sources.w * t AS full_up,
    CASE WHEN full_up THEN CAST(3 * s AS DOUBLE) ELSE CAST(sources.w * t AS DOUBLE) / CAST(level.w AS DOUBLE) END AS target,
    CASE WHEN full_up THEN 3 ELSE CAST((sources.w * t) // (s * level.w) AS BIGINT) END AS base,
    CASE WHEN full_up THEN 0 ELSE
      CAST((sources.w * t) % (s * level.w) AS DOUBLE) / CAST(s * level.w AS DOUBLE) * 4294967296 END AS cut
  FROM sources, level),
drawn AS (
  SELECT d.doc_id, d.size, t.*, [{_BITS}] AS bits FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
nearest AS (
  SELECT source, list_position(offs, list_min(offs)) AS draw FROM (
    SELECT source, list_transform([{_SUMS}], lambda x: abs(any_value(target) - any_value(base) * any_value(source_size) - x)) AS offs
    FROM drawn GROUP BY source))
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (base + CASE WHEN bits[draw] < cut THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM drawn JOIN nearest ON drawn.source IS NOT DISTINCT FROM nearest.source
"""


@query("op11_source_mix", SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
