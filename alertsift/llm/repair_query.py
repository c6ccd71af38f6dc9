"""Query of the conversation repair, and its SQL twin (a recursion over whole edit strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repair
from .catalog import query
from .common import table

_STATE = "STRUCT(c BIGINT, p VARCHAR, r VARCHAR)"


def _move(state: str, cost: str, letter: str, piece: str | None, when: str = "true") -> str:
    text = f"{state}.r" if piece is None else f"concat_ws(chr(10), {state}.r, {piece})"
    return (
        f"CASE WHEN {state} IS NOT NULL AND {when} THEN "
        f"CAST({{'c': {state}.c + {cost}, 'p': {state}.p || '{letter}', 'r': {text}}} AS {_STATE}) END"
    )


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _stay(state: str, to: str) -> list[str]:
    """The ways of a usable row out of ``state``."""
    name = "user" if to == "2" else "assistant"
    return [
        _move(state, "cut", "K", "role || ':' || text", f"NOT unusable AND i = '{name[0]}'"),
        _move(state, "(2 + cut)", "R", f"'{name}:' || text", f"NOT unusable AND i <> '{name[0]}'"),
    ]


def _delete(state: str) -> str:
    return _move(state, "3", "D", None)


_B = {
    "b0": _delete("s0"),
    "b1": _least(_delete("s1"), _move("s0", "cut", "K", "role || ':' || text", "NOT unusable AND i = 's'")),
    "b2": _least(_delete("s2"), *[w for s in ("s0", "s1", "s3") for w in _stay(s, "2")]),
    "b3": _least(_delete("s3"), *_stay("s2", "3")),
}
_INS = lambda s, name: _move(s, "2", "I", f"'{name}:'")
_M2 = _least("b2", _INS("b0", "user"), _INS("b1", "user"))
SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS d
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, generate_series(1, CASE WHEN d = 3 THEN 2 ELSE 1 END) WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS open_end FROM damaged),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair FROM placed),
ready AS (
  SELECT conv_id, pos, role, text, substr(role, 1, 1) AS i, blank OR again AS unusable,
    CASE WHEN open_end THEN 1 ELSE 0 END AS cut FROM judged),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, CAST({{'c': 0, 'p': '', 'r': NULL}} AS {_STATE}) AS s0, CAST(NULL AS {_STATE}) AS s1,
    CAST({{'c': 2, 'p': 'I', 'r': 'user:'}} AS {_STATE}) AS s2,
    CAST({{'c': 4, 'p': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS {_STATE}) AS s3
  FROM conversations
  UNION ALL
  SELECT conv_id, pos, b0, b1, {_least("b2", _INS("b0", "user"), _INS("b1", "user"), _INS("b3", "user"))},
    {_least("b3", _INS("m2", "assistant"))}
  FROM (SELECT *, {_M2} AS m2 FROM (
    SELECT dp.conv_id, ready.pos, {", ".join(f"{sql} AS {name}" for name, sql in _B.items())}
    FROM dp JOIN ready ON dp.conv_id IS NOT DISTINCT FROM ready.conv_id AND ready.pos = dp.pos + 1))),
ended AS (SELECT conv_id, {_least("s0", "s3")} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE open_end AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.p AS audit,
  sha256(coalesce(best.r, '')) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the planted damage; rows that it drops have ``there`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("there"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
    )


@query("op13_conversation_repair", SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair.audit(rows, present=F.col("there")).drop("rows")
