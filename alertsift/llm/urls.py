"""URL filters: rules found through their rarest literal token.

Each rule is a regular expression with the literal tokens every fitting address must hold. A
count of those tokens over all addresses picks the rarest one per rule as its index key. An
address fetches the rules under its own tokens from a constant table of slots, and only the
fetched ones' expressions are run. The best rule is the one of greatest rank. All of it is one
projection: judging moves no row.

Defined cases: a null address, or one without ``://``, has an empty host and path and no rule;
equal addresses are judged row by row; a rule without a whole literal token is fetched by
every address; with no rules every row gets the default verdict.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


class UrlRule(NamedTuple):
    name: str
    verdict: str
    pattern: str  # run on host followed by path
    tokens: tuple[str, ...]  # whole tokens, in lower case, of every address that fits
    listed: bool = True  # a listed rule goes before a pattern of the method


def _tokens(literal: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", literal.lower()) if t]


def prefix_rule(name: str, verdict: str) -> UrlRule:
    """A ``host/path`` rule: fits the host and its subdomains where the path starts alike."""
    host, _, path = name.partition("/")
    whole = path if not path or not path[-1].isalnum() else path[: len(path) - len(re.findall(r"[A-Za-z0-9]+$", path)[0])]
    return UrlRule(
        name, verdict, rf"(?s)^(?:[^/]*\.)?{_quoted(host.lower())}/{_quoted(path)}", (*_tokens(host), *_tokens(whole))
    )


def host_word(words: str, verdict: str) -> UrlRule:
    """A pattern of the method: a host label that holds the hyphenated words."""
    return UrlRule(words, verdict, rf"(?s)^[^/]*(?<![a-z0-9]){_quoted(words)}(?![a-z0-9])", tuple(_tokens(words)), False)


def _quoted(literal: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", literal)


# The rules of the query.
LISTED = (
    prefix_rule("net/", "block"),
    prefix_rule("example.net/en/", "allow"),
    prefix_rule("example.com/de/", "block"),
    prefix_rule("org/fr/", "allow"),
)
PATTERNS = tuple(host_word(w, "block") for w in ("spam-farm", "cheap-pills", "casino", "ads-track", "click-bait"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens in lower case, and an empty one that rules without a token hang on."""
    return F.array_distinct(F.array_append(F.split(F.lower(F.concat_ws("/", host, path)), "[^a-z0-9]+"), F.lit("")))


def index_rules(addresses: DataFrame, rules: Sequence[UrlRule]) -> list[dict]:
    """The rules in the order of their rank, each with its index token. ``addresses`` has ``_tokens``.

    The token counts that reach the driver are at most the tokens of the rule table.
    """
    literals = sorted({t for r in rules for t in r.tokens})
    seen = {}
    if literals:
        used = addresses.select(F.explode(F.filter("_tokens", lambda t: t.isin(literals))).alias("token"))
        seen = {r["token"]: r["n"] for r in used.groupBy("token").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(rules, key=lambda r: (r.listed, len(r.name), r.name))
    return [
        {"rank": k, "token": min(r.tokens, key=lambda t: (seen.get(t, 0), t), default=""), **r._asdict()}
        for k, r in enumerate(ordered)
    ]


def fetch(tokens: Column, index: Sequence[dict]) -> Column:
    """(token, rank, pattern) of the rules under these tokens, from a constant table of slots.

    A token's slot is its checksum; the table is as large as the rule table and part of the plan.
    """
    slots = [[] for _ in range(2 * len(index) + 1)]
    for rule in index:
        slots[zlib.crc32(rule["token"].encode()) % len(slots)].append({k: rule[k] for k in ("token", "rank", "pattern")})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<token:string,rank:int,pattern:string>>>")

    def under(token: Column) -> Column:
        slot = F.get(table, F.pmod(F.crc32(token.cast("binary")), F.lit(len(slots))).cast("int"))
        return F.filter(slot, lambda rule: rule["token"] == token)

    return F.flatten(F.transform(tokens, under))


def judge(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules: Sequence[UrlRule] = LISTED + PATTERNS,
    default: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, ``rule`` (listed), ``pattern``, ``verdict``."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path"))
    addresses = parts.withColumn("_tokens", url_tokens(F.col("_host"), F.col("_path")))
    index = index_rules(addresses, rules)
    text = F.concat("_host", "_path")
    fits = F.filter(fetch(F.col("_tokens"), index), lambda rule: F.rlike(text, rule["pattern"]))
    best = addresses.withColumn("_rank", F.array_max(F.transform(fits, lambda rule: rule["rank"])))
    facts = [{k: rule[k] for k in ("name", "verdict", "listed")} for rule in index]
    ranked = F.from_json(F.lit(json.dumps(facts)), "array<struct<name:string,verdict:string,listed:boolean>>")
    judged = best.withColumn("_rule", F.get(ranked, F.col("_rank")))
    return judged.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_rule.listed"), F.col("_rule.name")).alias("rule"),
        F.when(~F.col("_rule.listed"), F.col("_rule.name")).alias("pattern"),
        F.coalesce("_rule.verdict", F.lit(default)).alias("verdict"),
    )
