"""Query of the quality rules, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality
from .catalog import query
from .common import table

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 6),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM places),
hit AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM grams WHERE n >= 2),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(following - i, 5))) AS n_repeat_words FROM hit GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop
  FROM base),
measured AS (
  SELECT c.doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN (n_stop + 1) / n_words ELSE 0 END AS stop_ratio,
    CASE WHEN len(l) > 0 THEN (len(l) - len(list_distinct(l))) / len(l) ELSE 0 END AS line_ratio
  FROM counted c LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND word_length >= 2.0 AND word_length <= 15.0 AND symbol_ratio <= 0.1 AND stop_ratio >= 0.02
    AND line_ratio <= 0.5 AS kept
FROM measured
"""


@query("op1_quality_rules", SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
