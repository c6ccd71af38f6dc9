"""Packet, segment and flow tables derived from the given TPC-H-like tables.

Each view exists twice: as a Spark DataFrame and as SQL text for an independent check.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import flows
from ..schema import FlowRules

FLOW_CUTOFF = 2_592_000
TIE = "tie"  # the segment's number as a decimal, since a long holds it for order keys below 2^25 only

SEGMENT_RULES = FlowRules(
    identity=["label", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"],
    first=["init_win"],
    sums=["fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration_us"],
    maxima=["len_max"],
    minima=["len_min"],
    weighted={"len_mean": "pkts"},
    pooled={"len_std": ("len_mean", "pkts")},
    squared={"len_var": "len_std"},
    rates={"bytes_per_s": "bytes", "packets_per_s": "pkts"},
    duration="duration_us",
    derived={"pkts": "fwd_pkts + bwd_pkts", "bytes": "fwd_bytes + bwd_bytes"},
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as one flow segment."""
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    wide = lambda c: c.cast("decimal(19,0)")
    capture = F.element_at(
        F.array(
            *[
                F.lit(name + ".pcap_Flow.csv")
                for name in (
                    "BenignTraffic", "BenignTraffic1", "BenignTraffic2", "DDoS-HTTP_Flood-",
                    "DoS-HTTP_Flood", "DNS_Spoofing", "XSS", "DictionaryBruteForce",
                )
            ]
        ),
        (F.col("l_orderkey") % 8 + 1).cast("int"),
    )
    port = F.element_at(F.array(*[F.lit(p) for p in (80, 443, 53, 8080, 50001, 0)]), (part % 6 + 1).cast("int"))
    day_s = F.floor(flows.epoch_micros(F.col("l_shipdate")) / 1_000_000)
    size = F.when(F.col("l_orderkey") % 13 != 0, F.col("l_extendedprice") / F.col("l_quantity"))
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax",
        (((F.col("l_orderkey") * 8 + line) * 1048576 + part) * 32768 + supp).alias("segment_no"),
        (wide(F.col("l_orderkey") * 8 + line) * F.lit(1 << 35).cast("decimal(11,0)") + wide(part * 32768 + supp)).cast("decimal(20,0)").alias(TIE),
        capture.alias("source_file"),
        F.concat(F.lit("10.0.0."), text(F.when(line <= 2, supp % 5).otherwise(supp))).alias("src_ip"),
        F.concat(F.lit("10.1.0."), text(F.when(line <= 2, part % 4).otherwise(part))).alias("dst_ip"),
        (40000 + supp % 5).alias("src_port"),
        port.cast("long").alias("dst_port"),
        F.when(part % 6 == 2, 17).when(part % 12 == 4, 1).otherwise(6).cast("long").alias("protocol"),
        (day_s + (F.col("l_orderkey") * 37) % 86400).alias("ts"),
        F.floor("l_quantity").alias("fwd_pkts"),
        (part % 30).alias("bwd_pkts"),
        F.floor("l_extendedprice").alias("fwd_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).alias("bwd_bytes"),
        F.when(F.col("l_orderkey") % 17 != 0, F.floor(F.col("l_quantity") * 1000))
        .otherwise(0)
        .alias("duration_us"),
        size.alias("len_mean"),
        (F.col("l_discount") * 100).alias("len_std"),
        (size * 2).alias("len_max"),
        (size / 2).alias("len_min"),
        F.when(part % 7 != 0, part % 65536).alias("init_win"),
    )
    return df.withColumn("label", K.label_of(F.col("source_file"))).withColumn(
        "flow_id", F.concat_ws("-", "src_ip", "dst_ip", text(F.col("src_port")), text(F.col("dst_port")), text(F.col("protocol")))
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a packet, with swapped, missing and foreign endpoints."""
    s = segments(spark, sf_dir)
    odd = F.col("l_orderkey") % 2 == 1
    pick = lambda a, b: F.when(odd, F.col(b)).otherwise(F.col(a))
    return s.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("fwd_bytes").cast("string")).alias("packet_id"),
        F.when(F.col("l_orderkey") % 29 != 0, pick("src_ip", "dst_ip")).alias("src_ip"),
        F.when(F.col("l_orderkey") % 31 == 0, "172.16.0.9").otherwise(pick("dst_ip", "src_ip")).alias("dst_ip"),
        pick("src_port", "dst_port").alias("src_port"),
        pick("dst_port", "src_port").alias("dst_port"),
        (F.col("protocol") == 6).cast("int").alias("l4_tcp"),
        (F.col("protocol") == 17).cast("int").alias("l4_udp"),
        "label",
        K.is_attack(F.col("label")).alias("y_true"),
        (F.col("l_discount") + F.col("l_tax")).alias("anomaly_score"),
        "fwd_pkts", "fwd_bytes", "len_mean", "init_win",
    )


def unified_flows(spark: SparkSession, sf_dir: str, cutoff: int = FLOW_CUTOFF) -> DataFrame:
    return flows.build_unified_flows(
        segments(spark, sf_dir), SEGMENT_RULES, ("source_file", "flow_id"), "ts", cutoff, TIE, "lfid"
    )


LABEL_SQL = """CASE WHEN source_file LIKE 'Benign%' THEN 'benign'
  WHEN contains(source_file, 'DDoS-HTTP') THEN 'DDOS-HTTP_flood'
  WHEN contains(source_file, 'DoS-HTTP') THEN 'DoS-HTTP'
  WHEN contains(source_file, 'Spoofing') THEN 'DNS_spoofing'
  WHEN contains(source_file, 'XSS') THEN 'XSS'
  WHEN contains(source_file, 'BruteForce') THEN 'brute_force' ELSE 'Unknown Attack' END"""

SEGMENTS_SQL = f"""seg0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax,
  ((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 32768 + l_suppkey AS segment_no,
  CASE l_orderkey % 8 WHEN 0 THEN 'BenignTraffic' WHEN 1 THEN 'BenignTraffic1' WHEN 2 THEN 'BenignTraffic2'
    WHEN 3 THEN 'DDoS-HTTP_Flood-' WHEN 4 THEN 'DoS-HTTP_Flood' WHEN 5 THEN 'DNS_Spoofing' WHEN 6 THEN 'XSS'
    ELSE 'DictionaryBruteForce' END || '.pcap_Flow.csv' AS source_file,
  '10.0.0.' || CASE WHEN l_linenumber <= 2 THEN l_suppkey % 5 ELSE l_suppkey END AS src_ip,
  '10.1.0.' || CASE WHEN l_linenumber <= 2 THEN l_partkey % 4 ELSE l_partkey END AS dst_ip,
  40000 + l_suppkey % 5 AS src_port,
  CASE l_partkey % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 8080 WHEN 4 THEN 50001 ELSE 0 END AS dst_port,
  CASE WHEN l_partkey % 6 = 2 THEN 17 WHEN l_partkey % 12 = 4 THEN 1 ELSE 6 END AS protocol,
  CAST(epoch(l_shipdate) AS BIGINT) + (l_orderkey * 37) % 86400 AS ts,
  CAST(floor(l_quantity) AS BIGINT) AS fwd_pkts, l_partkey % 30 AS bwd_pkts,
  CAST(floor(l_extendedprice) AS BIGINT) AS fwd_bytes,
  CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS bwd_bytes,
  CASE WHEN l_orderkey % 17 = 0 THEN 0 ELSE CAST(floor(l_quantity * 1000) AS BIGINT) END AS duration_us,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS len_mean,
  l_discount * 100 AS len_std,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity * 2 END AS len_max,
  CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_extendedprice / l_quantity / 2 END AS len_min,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 65536 END AS init_win FROM lineitem),
seg AS (SELECT *, {LABEL_SQL} AS label,
  src_ip || '-' || dst_ip || '-' || src_port || '-' || dst_port || '-' || protocol AS flow_id FROM seg0)"""

PACKETS_SQL = """pk AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || fwd_bytes AS packet_id,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 2 = 1 THEN dst_ip ELSE src_ip END AS src_ip,
  CASE WHEN l_orderkey % 31 = 0 THEN '172.16.0.9' WHEN l_orderkey % 2 = 1 THEN src_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN l_orderkey % 2 = 1 THEN dst_port ELSE src_port END AS src_port,
  CASE WHEN l_orderkey % 2 = 1 THEN src_port ELSE dst_port END AS dst_port,
  CAST(protocol = 6 AS INTEGER) AS l4_tcp, CAST(protocol = 17 AS INTEGER) AS l4_udp,
  label, CAST(label <> 'benign' AS INTEGER) AS y_true, l_discount + l_tax AS anomaly_score,
  fwd_pkts, fwd_bytes, len_mean, init_win
  FROM seg)"""


def clusters_sql(cutoff: int = FLOW_CUTOFF) -> str:
    """Segments with cluster number: the textbook lag form, independent of the Spark plan."""
    return f"""lagged AS (SELECT *, ts - lag(ts) OVER (PARTITION BY source_file, flow_id ORDER BY ts) AS gap FROM seg),
clus AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {cutoff} THEN 1 ELSE 0 END)
  OVER (PARTITION BY source_file, flow_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS cluster FROM lagged)"""


_TIE = "struct_pack(a := ts, b := segment_no)"
_POOLED = """sqrt(coalesce(greatest(CASE WHEN sum(p) > 1 THEN
  (sum(greatest(p - 1, 0) * len_std * len_std) + sum(p * coalesce(len_mean, 0) * coalesce(len_mean, 0))
   - sum(p * coalesce(len_mean, 0)) * sum(p * coalesce(len_mean, 0)) / nullif(sum(p), 0)) / (sum(p) - 1) END, 0), 0))"""

FLOWS_SQL = f"""fl AS (SELECT source_file, flow_id, source_file || '|' || flow_id || '#' || CAST(cluster AS BIGINT) AS lfid,
  min(label) AS label, min(src_ip) AS src_ip, min(src_port) AS src_port, min(dst_ip) AS dst_ip,
  min(dst_port) AS dst_port, min(protocol) AS protocol,
  arg_min(init_win, {_TIE}) FILTER (WHERE init_win IS NOT NULL) AS init_win,
  count(*) AS SegmentCount, min(ts) AS ts_first, max(ts) AS ts_last,
  CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts, CAST(sum(bwd_pkts) AS BIGINT) AS bwd_pkts,
  CAST(sum(fwd_bytes) AS BIGINT) AS fwd_bytes, CAST(sum(bwd_bytes) AS BIGINT) AS bwd_bytes,
  CAST(sum(duration_us) AS BIGINT) AS duration_us, max(len_max) AS len_max, min(len_min) AS len_min,
  coalesce(sum(CASE WHEN len_mean IS NOT NULL THEN p * len_mean END)
    / nullif(sum(CASE WHEN len_mean IS NOT NULL THEN p END), 0), 0) AS len_mean,
  {_POOLED} AS len_std, pow({_POOLED}, 2) AS len_var,
  coalesce(sum(fwd_bytes + bwd_bytes) / nullif(CAST(sum(duration_us) AS DOUBLE), 0) * 1000000, 0) AS bytes_per_s,
  coalesce(sum(p) / nullif(CAST(sum(duration_us) AS DOUBLE), 0) * 1000000, 0) AS packets_per_s
  FROM (SELECT *, fwd_pkts + bwd_pkts AS p FROM clus) GROUP BY source_file, flow_id, cluster)"""

BASE = f"WITH {SEGMENTS_SQL}"
WITH_PACKETS = f"{BASE}, {PACKETS_SQL}"
WITH_FLOWS = f"{BASE}, {clusters_sql()}, {FLOWS_SQL}"
WITH_ALL = f"{BASE}, {PACKETS_SQL}, {clusters_sql()}, {FLOWS_SQL}"
