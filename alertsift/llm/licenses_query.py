"""Queries of the licence scan, and their SQL twins (every line, or every run of words, against every template)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .catalog import query
from .common import table

_ROWS = ", ".join(f"('{t.name}', {[*t.bigrams()]!r})" for t in licenses.TEMPLATES)
SQL = f"""
WITH templates(licence, grams) AS (VALUES {_ROWS}),
units AS (
  SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS t
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
words AS (
  SELECT doc_id, line, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM units),
grams AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words
  WHERE len(w) > 1),
compared AS (
  SELECT doc_id, line, licence, len(list_intersect(g, grams.grams)) AS both_n, len(g) AS a, len(grams.grams) AS b
  FROM grams JOIN templates AS grams ON 13 * least(len(g), len(grams.grams)) >= 7 * greatest(len(g), len(grams.grams))),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY both_n / (a + b) DESC, licence) AS k FROM compared
  WHERE 20 * both_n >= 7 * (a + b))
SELECT d.doc_id, count(b.line) AS n_matches,
  coalesce(string_agg(b.line || ':' || licence || ':' || both_n || ':' || a || ':' || b.b, ',' ORDER BY b.line), '') AS matches
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND k = 1 GROUP BY d.doc_id
"""


@query("op10_license_scans", SQL)
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda m: F.concat_ws(":", *[m[c].cast("string") for c in ("line", "licence", "shared", "size", "template_size")])
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.transform(F.sort_array("matches"), line), ",").alias("matches"),
    )


_NUMBERED = ", ".join(f"({k}, '{t.name}', {[*t.bigrams()]!r})" for k, t in enumerate(licenses.TEMPLATES))
NOTICES_SQL = f"""
WITH RECURSIVE templates(t, licence, grams) AS (VALUES {_NUMBERED}),
words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM documents),
texts AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM words WHERE len(w) > 1),
places AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS k FROM texts),
hits AS (SELECT doc_id, t, k, len(grams) AS b FROM places JOIN (SELECT t, grams, unnest(grams) AS gram FROM templates) USING (gram)),
runs AS (
  SELECT x.doc_id, x.t, x.k AS i, y.k AS j FROM hits x JOIN hits y
    ON x.doc_id = y.doc_id AND x.t = y.t AND y.k >= x.k AND 7 * (y.k - x.k + 1) <= 13 * x.b AND 13 * (y.k - x.k + 1) >= 7 * x.b),
compared AS (
  SELECT doc_id, licence, i, j, len(list_intersect(g[i:j], grams)) AS s, len(list_distinct(g[i:j])) AS a, len(grams) AS b
  FROM runs JOIN texts USING (doc_id) JOIN templates USING (t)),
ranked AS (
  SELECT doc_id, list({{'i': i, 'j': j, 'l': licence, 's': s, 'a': a, 'b': b}} ORDER BY s / (a + b) DESC, s DESC, i, j, licence) AS r
  FROM compared WHERE 20 * s >= 7 * (a + b) GROUP BY doc_id),
step AS (
  SELECT doc_id, r[1] AS best, list_filter(r, lambda x: x.i > r[1].j OR x.j < r[1].i) AS r FROM ranked
  UNION ALL
  SELECT doc_id, r[1], list_filter(r, lambda x: x.i > r[1].j OR x.j < r[1].i) FROM step WHERE len(r) > 0)
SELECT d.doc_id, count(best) AS n_notices,
  coalesce(string_agg(best.i || '+' || (best.j - best.i + 2) || ':' || best.l || ':' || best.s || ':' || best.a || ':' || best.b, ',' ORDER BY best.i), '') AS notices
FROM documents d LEFT JOIN step ON d.doc_id = step.doc_id GROUP BY d.doc_id
"""


@query("op10_license_notices", NOTICES_SQL)
def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.notices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda m: F.concat_ws(":", F.concat_ws("+", m["first_word"], m["words"]), *[m[c].cast("string") for c in ("licence", "shared", "size", "template_size")])
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.transform("notices", shown), ",").alias("notices"),
    )
