"""Packet alerts to candidate flows through the direction-free key, and leakage control.

Candidates stay a long table (key, flow). Nothing here collects the flows of one key into
one row: what a status or a decision needs from them is a mergeable aggregate per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import keys as K

KEY = "canonical_key"
NO_KEY = 4096  # groups of packets without a key


def candidates(
    flows: DataFrame,
    address: Sequence[str] = ("Src IP", "Src Port", "Dst IP", "Dst Port", "Protocol"),
    logical_id: str = "LogicalFlowID",
) -> DataFrame:
    """Long candidate table: one row per flow with a valid key."""
    cols = [F.col(f"`{a}`") for a in address]
    return flows.select(
        K.canonical_key(*cols).alias(KEY),
        F.col(logical_id).alias("lfid"),
        "label",
        "source_file",
    ).where(F.col(KEY).isNotNull())


def candidate_index(cand: DataFrame) -> DataFrame:
    """Per key: number of candidates, labels and captures, and the least candidate with its label.

    Pre-aggregated per (key, capture, label), so a key that a third of the flows share
    reaches the second step as a handful of rows.
    """
    per_capture = cand.groupBy(KEY, "source_file", "label").agg(
        F.count("*").alias("_n"), F.min("lfid").alias("_lfid")
    )
    return per_capture.groupBy(KEY).agg(
        F.sum("_n").alias("n_candidates"),
        F.count_distinct("label").alias("n_labels"),
        F.count_distinct("source_file").alias("n_captures"),
        F.min("_lfid").alias("rep_lfid"),
        F.min_by("label", "_lfid").alias("rep_label"),
    )


def with_packet_key(packets: DataFrame) -> DataFrame:
    """Add protocol, key and the reason a packet has none."""
    protocol = K.protocol_of(F.col("l4_tcp"), F.col("l4_udp"))
    address = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]
    return packets.withColumns(
        {
            "protocol": protocol,
            KEY: K.canonical_key(*address, protocol),
            "invalid_reason": K.invalid_reason(*address, protocol),
        }
    )


def mapping_status() -> Column:
    """Status from the joined index columns; an invalid key overrides everything."""
    n = F.col("n_candidates")
    return (
        F.when(F.col(KEY).isNull(), S.INVALID_KEY)
        .when(n.isNull(), S.NO_MATCH)
        .when(n == 1, S.UNIQUE_MATCH)
        .when(F.col("n_labels") > 1, S.CONFLICTING)
        .when(F.col("n_captures") > 1, S.SAME_LABEL)
        .otherwise(S.SAME_CAPTURE)
    )


def classify_packets(packets: DataFrame, index: DataFrame) -> DataFrame:
    """Left join on the key, then status, counts and the flow of a unique match.

    Packets without a key are dealt over ``NO_KEY`` names that no candidate has, for a join sends all rows
    of a null key to one task.
    """
    keyed = with_packet_key(packets)
    nowhere = F.concat(F.lit("-"), (F.monotonically_increasing_id() % NO_KEY).cast("string"))
    dealt = keyed.withColumn("_at", F.coalesce(F.concat(F.lit("+"), KEY), nowhere))
    found = index.where(F.col(KEY).isNotNull()).withColumn("_at", F.concat(F.lit("+"), KEY)).drop(KEY)
    columns = [KEY, *(c for c in keyed.columns if c != KEY), *(c for c in index.columns if c != KEY)]
    joined = dealt.join(found, "_at", "left").select(*[f"`{c}`" for c in columns]).withColumn("status", mapping_status())
    return joined.withColumns(
        {
            "n_candidates": F.coalesce("n_candidates", F.lit(0)),
            "n_captures": F.coalesce("n_captures", F.lit(0)),
            "n_labels": F.coalesce("n_labels", F.lit(0)),
            "matched_lfid": F.when(F.col("status") == S.UNIQUE_MATCH, F.col("rep_lfid")),
        }
    )


def reachable_flows(aligned: DataFrame, cand: DataFrame, part: str | None = None, split: str = "split") -> DataFrame:
    """Distinct flows that the alerts (of one part) can reach: a semi join on their keys."""
    alerts = aligned if part is None else aligned.where(F.col(split) == part)
    return cand.join(alerts.where(F.col(KEY).isNotNull()).select(KEY).distinct(), KEY, "left_semi").select("lfid")


LEAK_RULES = [("val", "train"), ("test", "train"), ("test", "val")]


def _reach(aligned: DataFrame, cand: DataFrame, split: str) -> DataFrame:
    """(lfid, _val, _test): which flows alerts of either part reach, in one pass over the candidates."""
    part = lambda name: F.bool_or(F.coalesce(F.col(split) == name, F.lit(False))).alias(f"_{name}")
    keys = aligned.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(part("val"), part("test"))
    reached = cand.join(keys.where("_val OR _test"), KEY)
    return reached.groupBy("lfid").agg(F.bool_or("_val").alias("_val"), F.bool_or("_test").alias("_test"))


def leaking_rows(sample: DataFrame, aligned: DataFrame, cand: DataFrame, split: str = "split") -> DataFrame:
    """Sample rows (lfid, split) each guard rule hits, with the rule's name."""
    rules = F.array_compact(
        F.array(
            *[
                F.when((F.col(split) == flow_part) & F.col(f"_{alert_part}"), F.lit(f"cascade_{alert_part}_x_{flow_part}"))
                for alert_part, flow_part in LEAK_RULES
            ]
        )
    )
    marked = sample.join(_reach(aligned, cand, split), "lfid")
    return marked.select(*[F.col(f"`{c}`") for c in sample.columns], F.explode(rules).alias("rule"))


def leakage_guard(sample: DataFrame, aligned: DataFrame, cand: DataFrame, split: str = "split") -> DataFrame:
    """One row per rule: number of overlapping flows and whether the rule holds."""
    rules = sample.sparkSession.createDataFrame(
        [(f"cascade_{a}_x_{b}",) for a, b in LEAK_RULES], "rule string"
    )
    counts = leaking_rows(sample, aligned, cand, split).groupBy("rule").agg(F.count("*").alias("overlap"))
    return rules.join(counts, "rule", "left").select(
        "rule",
        F.coalesce("overlap", F.lit(0)).alias("overlap"),
        (F.coalesce("overlap", F.lit(0)) == 0).cast("int").alias("clean"),
    )


def remove_leaks(
    sample: DataFrame, aligned: DataFrame, cand: DataFrame, split: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): drops train flows any alert reaches and val flows test alerts reach."""
    marked = sample.join(_reach(aligned, cand, split), "lfid", "left")
    by_test, by_val = (F.coalesce(F.col(c), F.lit(False)) for c in ("_test", "_val"))
    leaks = ((F.col(split) == "train") & (by_test | by_val)) | ((F.col(split) == "val") & by_test)
    leaks = F.coalesce(leaks, F.lit(False))  # a row without a split leaks into none and is kept
    return marked.where(~leaks).drop("_test", "_val"), marked.where(leaks).drop("_test", "_val")


def match_with_fallback(packets: DataFrame, flows: DataFrame, order: Sequence[str], flow_id: str = "lfid") -> DataFrame:
    """First flow on the 5-tuple, its reverse, the 4-tuple, its reverse - in that order.

    ``flows`` is read once. Works on distinct packet addresses: each looks up its four keys in one equi-join, the
    best hit is kept, and packets join back to it.
    """
    flow_key = [
        F.trim("src_ip").alias("a"), F.trim("dst_ip").alias("b"),
        F.coalesce(K.number(F.col("src_port")).cast("long"), F.lit(-1)).alias("pa"),
        F.coalesce(K.number(F.col("dst_port")).cast("long"), F.lit(-1)).alias("pb"),
    ]
    protocol = K.number(F.col("protocol")).cast("long")
    flow_keys = flows.select(
        *flow_key, protocol.alias("p"), F.struct(*order, F.col(flow_id).alias("id")).alias("first")
    )
    cols = ["a", "b", "pa", "pb", "p"]
    # Each flow stands under its protocol and, as -1, under none, so that the flows are built and shuffled once.
    under = F.array_compact(F.array(F.nullif("p", F.lit(-1)), F.lit(-1)).cast("array<bigint>"))
    placed = flow_keys.select(*cols[:4], F.explode(under).alias("p"), "first")
    lookup = placed.groupBy(*cols).agg(F.min("first").alias("first")).select(*cols, F.col("first.id").alias("matched"))

    addressed = packets.withColumns(
        {
            "_a": F.trim("src_ip"), "_b": F.trim("dst_ip"),
            "_pa": F.coalesce(K.number(F.col("src_port")).cast("long"), F.lit(-1)),
            "_pb": F.coalesce(K.number(F.col("dst_port")).cast("long"), F.lit(-1)),
            "_p": F.coalesce(K.protocol_of_flags(F.col("l4_tcp"), F.col("l4_udp")).cast("long"), F.lit(-2)),
        }
    )
    mine = ["_a", "_b", "_pa", "_pb", "_p"]
    tries = []
    for rank, (reverse, use_protocol) in enumerate([(False, True), (True, True), (False, False), (True, False)], 1):
        a, b, pa, pb = ("_b", "_a", "_pb", "_pa") if reverse else ("_a", "_b", "_pa", "_pb")
        p = F.col("_p") if use_protocol else F.lit(-1).cast("long")
        tries.append(
            F.struct(
                F.lit(rank).alias("rank"), F.col(a).alias("a"), F.col(b).alias("b"),
                F.col(pa).alias("pa"), F.col(pb).alias("pb"), p.alias("p"),
            )
        )
    distinct = addressed.select(*mine).where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).distinct()
    best = (
        distinct.select(*mine, F.inline(F.array(*tries)))
        .join(lookup, cols)
        .groupBy(*mine)
        .agg(F.min(F.struct("rank", "matched")).alias("hit"))
    )
    return addressed.join(best, mine, "left").withColumns(
        {"match_rank": F.col("hit.rank"), "matched_flow": F.col("hit.matched")}
    ).drop("hit", *mine)


def status_coverage(aligned: DataFrame, by: str = "split") -> DataFrame:
    """Count and percent of each status within each part."""
    counts = aligned.groupBy(by, "status").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def invalid_reasons(aligned: DataFrame, by: str = "split") -> DataFrame:
    return (
        aligned.where(F.col("status") == S.INVALID_KEY)
        .groupBy(by, "invalid_reason")
        .agg(F.count("*").alias("n"))
    )


def label_coverage(aligned: DataFrame, by: Sequence[str] = ("split", "label")) -> DataFrame:
    """Share of unique, missing, invalid and usable mappings per label."""
    share = lambda *s: F.avg(F.col("status").isin(*s).cast("double"))
    return aligned.groupBy(*by).agg(
        F.count("*").alias("n"),
        share(S.UNIQUE_MATCH).alias("unique_rate"),
        share(S.NO_MATCH).alias("no_match_rate"),
        share(S.INVALID_KEY).alias("invalid_rate"),
        share(S.UNIQUE_MATCH, S.SAME_CAPTURE).alias("usable_rate"),
    )


def packets_per_flow(classified: DataFrame) -> DataFrame:
    """Packets of unique matches per flow."""
    return (
        classified.where(F.col("status") == S.UNIQUE_MATCH)
        .groupBy("matched_lfid")
        .agg(F.count("*").alias("packets"))
    )


def candidate_histogram(classified: DataFrame, clip: int = 5) -> DataFrame:
    return (
        classified.groupBy(F.least("n_candidates", F.lit(clip)).alias("candidates"))
        .agg(F.count("*").alias("n"))
    )


def status_examples(classified: DataFrame, key: str, per_status: int = 2) -> DataFrame:
    """The first packets of each status by key; limited map-side before any shuffle."""
    w = Window.partitionBy("status").orderBy(key)
    return (
        classified.withColumn("example", F.row_number().over(w))
        .where(F.col("example") <= per_status)
        .select("status", "example", key, KEY, "n_candidates", "n_labels", "n_captures")
    )
