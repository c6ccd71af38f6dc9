"""Queries on keys, packet-to-flow mapping and leakage control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import checks, mapping, quantiles
from ..session import materialise
from . import views as V
from .catalog import near, query, r

ADDRESS = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")


def candidates(spark, sf_dir):
    return mapping.candidates(V.unified_flows(spark, sf_dir), ADDRESS, "lfid")


def classified(spark, sf_dir):
    return mapping.classify_packets(V.packets(spark, sf_dir), mapping.candidate_index(candidates(spark, sf_dir)))


def with_split(df, key="packet_id"):
    """Three-way split by the first hexadecimal digit of the key's hash."""
    digit = F.substring(F.md5(F.col(key)), 1, 1)
    return df.withColumn("split", F.when(digit < "4", "val").when(digit < "8", "test").otherwise("train"))


SPLIT = """CASE WHEN substr(md5({0}), 1, 1) < '4' THEN 'val' WHEN substr(md5({0}), 1, 1) < '8' THEN 'test' ELSE 'train' END"""


def key_sql(proto: str) -> str:
    a, b = "src_ip || ':' || src_port", "dst_ip || ':' || dst_port"
    return f"""CASE WHEN src_ip IS NOT NULL AND dst_ip IS NOT NULL AND src_port > 0 AND dst_port > 0 AND {proto} IN (6, 17)
    THEN CASE WHEN {a} <= {b} THEN {a} || '||' || {b} ELSE {b} || '||' || {a} END || '||' || {proto} END"""


PROTO = "CASE WHEN l4_tcp = 1 THEN 6 WHEN l4_udp = 1 THEN 17 ELSE 0 END"
REASON = """CASE WHEN src_ip IS NULL OR dst_ip IS NULL THEN 'missing_endpoint'
  WHEN src_port <= 0 OR dst_port <= 0 THEN 'zero_port' WHEN protocol NOT IN (6, 17) THEN 'unsupported_protocol' END"""
MAPPED = f"""{V.WITH_ALL},
cand AS (SELECT {key_sql('protocol')} AS canonical_key, lfid, label, source_file FROM fl),
idx AS (SELECT canonical_key, count(*) AS n_candidates, count(DISTINCT label) AS n_labels,
  count(DISTINCT source_file) AS n_captures, min(lfid) AS rep_lfid, arg_min(label, lfid) AS rep_label
  FROM cand WHERE canonical_key IS NOT NULL GROUP BY canonical_key),
pk1 AS (SELECT *, {PROTO} AS protocol FROM pk),
pk2 AS (SELECT *, {key_sql('protocol')} AS canonical_key, {REASON} AS invalid_reason, {SPLIT.format('packet_id')} AS split FROM pk1),
al AS (SELECT p.*, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_labels, 0) AS n_labels,
  coalesce(n_captures, 0) AS n_captures, rep_lfid,
  CASE WHEN p.canonical_key IS NULL THEN 'invalid_key' WHEN n_candidates IS NULL THEN 'no_match'
    WHEN n_candidates = 1 THEN 'unique_match' WHEN n_labels > 1 THEN 'multiple_conflicting_labels'
    WHEN n_captures > 1 THEN 'multiple_same_label' ELSE 'multiple_same_capture' END AS status
  FROM pk2 p LEFT JOIN idx i ON p.canonical_key = i.canonical_key)"""


@query(
    "g1_packet_protocol",
    f"""{V.WITH_PACKETS} SELECT {PROTO} AS protocol, CASE WHEN len_mean IS NOT NULL AND init_win IS NULL THEN 1
      WHEN l4_udp > 0 THEN 17 WHEN l4_tcp > 0 THEN 6 END AS protocol_flags, count(*) AS n FROM pk GROUP BY 1, 2""",
)
def g1(spark, sf_dir):
    # packets without an init window but with a length stand for those with an icmp type
    icmp = F.when(F.col("init_win").isNull(), F.col("len_mean"))
    return (
        V.packets(spark, sf_dir)
        .groupBy(
            K.protocol_of(F.col("l4_tcp"), F.col("l4_udp")).alias("protocol"),
            K.protocol_of_flags(F.col("l4_tcp"), F.col("l4_udp"), icmp).alias("protocol_flags"),
        )
        .agg(F.count("*").alias("n"))
    )


@query("g2_canonical_key", f"{MAPPED} SELECT packet_id, fwd_bytes, canonical_key FROM pk2")
def g2(spark, sf_dir):
    return mapping.with_packet_key(V.packets(spark, sf_dir)).select("packet_id", "fwd_bytes", "canonical_key")


@query("g3_key_validity", f"{MAPPED} SELECT coalesce(invalid_reason, 'valid') AS reason, count(*) AS n FROM pk2 GROUP BY 1")
def g3(spark, sf_dir):
    keyed = mapping.with_packet_key(V.packets(spark, sf_dir))
    return keyed.groupBy(F.coalesce("invalid_reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "g4_candidate_index",
    f"{MAPPED} SELECT canonical_key, CAST(n_candidates AS BIGINT) AS n_candidates, n_labels, n_captures, rep_lfid, rep_label FROM idx",
)
def g4(spark, sf_dir):
    return mapping.candidate_index(candidates(spark, sf_dir))


@query("g4_candidate_list", f"{MAPPED} SELECT canonical_key, lfid FROM cand WHERE canonical_key IS NOT NULL")
def g4_list(spark, sf_dir):
    return candidates(spark, sf_dir).select("canonical_key", "lfid")


@query(
    "g5_packet_flow_join",
    f"{MAPPED} SELECT packet_id, fwd_bytes, canonical_key, CAST(n_candidates AS BIGINT) AS n_candidates FROM al",
)
def g5(spark, sf_dir):
    return classified(spark, sf_dir).select("packet_id", "fwd_bytes", "canonical_key", "n_candidates")


@query(
    "g6_mapping_status",
    f"""{MAPPED} SELECT packet_id, fwd_bytes, status, invalid_reason,
    CASE WHEN status = 'unique_match' THEN rep_lfid END AS matched_lfid FROM al""",
)
def g6(spark, sf_dir):
    return classified(spark, sf_dir).select("packet_id", "fwd_bytes", "status", "invalid_reason", "matched_lfid")


@query(
    "g7_fallback_match",
    f"""{MAPPED}, f5 AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol, arg_min(lfid, struct_pack(a := ts_first, b := lfid)) AS m
      FROM fl GROUP BY ALL),
    f4 AS (SELECT src_ip, dst_ip, src_port, dst_port, arg_min(lfid, struct_pack(a := ts_first, b := lfid)) AS m FROM fl GROUP BY ALL),
    pp AS (SELECT *, CASE WHEN l4_udp > 0 THEN 17 WHEN l4_tcp > 0 THEN 6 END AS p FROM pk)
    SELECT pp.packet_id, pp.fwd_bytes, CASE WHEN a.m IS NOT NULL THEN 1 WHEN b.m IS NOT NULL THEN 2 WHEN c.m IS NOT NULL THEN 3
      WHEN d.m IS NOT NULL THEN 4 END AS match_rank, coalesce(a.m, b.m, c.m, d.m) AS matched_flow FROM pp
    LEFT JOIN f5 a ON pp.src_ip = a.src_ip AND pp.dst_ip = a.dst_ip AND pp.src_port = a.src_port AND pp.dst_port = a.dst_port AND pp.p = a.protocol
    LEFT JOIN f5 b ON pp.src_ip = b.dst_ip AND pp.dst_ip = b.src_ip AND pp.src_port = b.dst_port AND pp.dst_port = b.src_port AND pp.p = b.protocol
    LEFT JOIN f4 c ON pp.src_ip = c.src_ip AND pp.dst_ip = c.dst_ip AND pp.src_port = c.src_port AND pp.dst_port = c.dst_port
    LEFT JOIN f4 d ON pp.src_ip = d.dst_ip AND pp.dst_ip = d.src_ip AND pp.src_port = d.dst_port AND pp.dst_port = d.src_port""",
)
def g7(spark, sf_dir):
    matched = mapping.match_with_fallback(
        V.packets(spark, sf_dir), V.unified_flows(spark, sf_dir), ["ts_first", "lfid"]
    )
    return matched.select("packet_id", "fwd_bytes", "match_rank", "matched_flow")


def aligned_alerts(spark, sf_dir):
    """Classified val and test packets above a fixed alert score."""
    alerts = with_split(V.packets(spark, sf_dir)).where(
        (F.col("anomaly_score") >= 0.08) & F.col("split").isin("val", "test")
    )
    cand = materialise(candidates(spark, sf_dir))  # stage table: index, guard and scores read it
    return mapping.classify_packets(alerts, mapping.candidate_index(cand)), cand


def flow_sample(cand):
    """Flows whose id hash is even, with a split: the modelling sample of the guard."""
    return with_split(
        cand.select("lfid", "label").where(F.substring(F.md5(F.concat(F.lit("s"), "lfid")), 1, 1).isin(*"02468ace")), "lfid"
    )


ALERTS = f"""{MAPPED}, alerts AS (SELECT * FROM al WHERE anomaly_score >= 0.08 AND split IN ('val', 'test')),
smp AS (SELECT lfid, label, {SPLIT.format('lfid')} AS split FROM cand WHERE canonical_key IS NOT NULL
  AND substr(md5('s' || lfid), 1, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')),
cval AS (SELECT DISTINCT lfid FROM cand WHERE canonical_key IN (SELECT canonical_key FROM alerts WHERE split = 'val')),
ctest AS (SELECT DISTINCT lfid FROM cand WHERE canonical_key IN (SELECT canonical_key FROM alerts WHERE split = 'test'))"""


@query("g8_reachable_flows", f"{ALERTS} SELECT lfid, 'val' AS part FROM cval UNION ALL SELECT lfid, 'test' FROM ctest")
def g8(spark, sf_dir):
    aligned, cand = aligned_alerts(spark, sf_dir)
    parts = [mapping.reachable_flows(aligned, cand, p).withColumn("part", F.lit(p)) for p in ("val", "test")]
    return parts[0].unionByName(parts[1])


@query(
    "g9_leakage_guard",
    f"""{ALERTS}, hits AS (
      SELECT 'cascade_val_x_train' AS rule, (SELECT count(*) FROM smp WHERE split = 'train' AND lfid IN (SELECT lfid FROM cval)) AS overlap
      UNION ALL SELECT 'cascade_test_x_train', (SELECT count(*) FROM smp WHERE split = 'train' AND lfid IN (SELECT lfid FROM ctest))
      UNION ALL SELECT 'cascade_test_x_val', (SELECT count(*) FROM smp WHERE split = 'val' AND lfid IN (SELECT lfid FROM ctest)))
    SELECT rule, overlap, CAST(overlap = 0 AS INTEGER) AS clean FROM hits""",
)
def g9(spark, sf_dir):
    aligned, cand = aligned_alerts(spark, sf_dir)
    return mapping.leakage_guard(flow_sample(cand), aligned, cand)


@query(
    "g10_remove_leaks",
    f"""{ALERTS}, m AS (SELECT lfid, split, (split = 'train' AND (lfid IN (SELECT lfid FROM cval) OR lfid IN (SELECT lfid FROM ctest)))
      OR (split = 'val' AND lfid IN (SELECT lfid FROM ctest)) AS leak FROM smp)
    SELECT lfid, split, CAST(leak AS INTEGER) AS removed FROM m""",
)
def g10(spark, sf_dir):
    aligned, cand = aligned_alerts(spark, sf_dir)
    kept, removed = mapping.remove_leaks(flow_sample(cand), aligned, cand)
    return kept.select("lfid", "split", F.lit(0).alias("removed")).unionByName(
        removed.select("lfid", "split", F.lit(1).alias("removed"))
    )


@query(
    "g11_candidate_flows",
    f"{ALERTS} SELECT lfid, fwd_bytes FROM fl WHERE lfid IN (SELECT lfid FROM cval UNION SELECT lfid FROM ctest)",
)
def g11(spark, sf_dir):
    aligned, cand = aligned_alerts(spark, sf_dir)
    flows = V.unified_flows(spark, sf_dir).select("lfid", "fwd_bytes")
    return flows.join(mapping.reachable_flows(aligned, cand), "lfid", "left_semi")


@query(
    "g12_status_coverage",
    f"""{ALERTS} SELECT split, status, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split)')} AS percent
    FROM alerts GROUP BY split, status""",
)
def g12(spark, sf_dir):
    cov = mapping.status_coverage(aligned_alerts(spark, sf_dir)[0])
    return cov.select("split", "status", "n", near(F.col("percent")).alias("percent"))


@query(
    "g12_invalid_reasons",
    f"{ALERTS} SELECT split, invalid_reason, count(*) AS n FROM alerts WHERE status = 'invalid_key' GROUP BY ALL",
)
def g12_reasons(spark, sf_dir):
    return mapping.invalid_reasons(aligned_alerts(spark, sf_dir)[0])


@query(
    "g12_label_coverage",
    f"""{ALERTS} SELECT split, label, count(*) AS n,
    {r("avg(CAST(status = 'unique_match' AS DOUBLE))")} AS unique_rate, {r("avg(CAST(status = 'no_match' AS DOUBLE))")} AS no_match_rate,
    {r("avg(CAST(status = 'invalid_key' AS DOUBLE))")} AS invalid_rate,
    {r("avg(CAST(status IN ('unique_match', 'multiple_same_capture') AS DOUBLE))")} AS usable_rate FROM alerts GROUP BY ALL""",
)
def g12_labels(spark, sf_dir):
    cov = mapping.label_coverage(aligned_alerts(spark, sf_dir)[0])
    rates = ["unique_rate", "no_match_rate", "invalid_rate", "usable_rate"]
    return cov.select("split", "label", "n", *[near(F.col(c)).alias(c) for c in rates])


@query(
    "g13_packets_per_flow",
    f"""{MAPPED}, per AS (SELECT rep_lfid, count(*) AS packets FROM al WHERE status = 'unique_match' GROUP BY 1)
    SELECT count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, min(packets) AS least, {r('quantile_cont(packets, 0.5)')} AS median,
    {r('avg(packets)')} AS mean, {r('quantile_cont(packets, 0.95)')} AS p95, max(packets) AS most FROM per""",
)
def g13(spark, sf_dir):
    per = mapping.packets_per_flow(classified(spark, sf_dir)).select("packets").persist()
    median, p95 = quantiles.exact_quantiles(per, ["packets"], [0.5, 0.95])["packets"]
    return per.agg(
        F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.min("packets").alias("least"),
        near(F.lit(median)).alias("median"), near(F.avg("packets")).alias("mean"), near(F.lit(p95)).alias("p95"),
        F.max("packets").alias("most"),
    )


@query(
    "g13_candidate_histogram",
    f"{MAPPED} SELECT CAST(least(n_candidates, 5) AS BIGINT) AS candidates, count(*) AS n FROM al GROUP BY 1",
)
def g13_histogram(spark, sf_dir):
    return mapping.candidate_histogram(classified(spark, sf_dir))


@query(
    "g13_status_examples",
    f"""{MAPPED} SELECT * FROM (SELECT status, CAST(row_number() OVER (PARTITION BY status ORDER BY packet_id) AS INTEGER) AS example,
    packet_id, canonical_key, CAST(n_candidates AS BIGINT) AS n_candidates, n_labels, n_captures FROM al) WHERE example <= 2""",
)
def g13_examples(spark, sf_dir):
    return mapping.status_examples(classified(spark, sf_dir), "packet_id")


@query(
    "g14_mapping_invariants",
    f"""{MAPPED}, k AS (SELECT canonical_key, {key_sql('protocol').replace('src_', 'x_').replace('dst_', 'src_').replace('x_', 'dst_')} AS reversed FROM pk2)
    SELECT 'direction_symmetry' AS rule, count(*) FILTER (WHERE canonical_key IS DISTINCT FROM reversed) AS violations FROM k
    UNION ALL SELECT 'protocol_in_key', (SELECT count(*) FROM pk2 WHERE canonical_key NOT LIKE '%||' || protocol)
    UNION ALL SELECT 'label_never_resolves', (SELECT count(*) FROM al WHERE status = 'unique_match' AND n_candidates <> 1)""",
)
def g14(spark, sf_dir):
    return checks.mapping_invariants(V.packets(spark, sf_dir), candidates(spark, sf_dir))


@query(
    "g15_flow_integrity",
    f"""{V.WITH_FLOWS}, gaps AS (SELECT source_file, flow_id, cluster, ts - lag(ts) OVER (PARTITION BY source_file, flow_id, cluster ORDER BY ts) AS g FROM clus)
    SELECT 'segment_count' AS rule, CAST(abs((SELECT sum(SegmentCount) FROM fl) - (SELECT count(*) FROM seg)) AS BIGINT) AS violations
    UNION ALL SELECT 'unique_id', (SELECT count(*) - count(DISTINCT lfid) FROM fl)
    UNION ALL SELECT 'single_key', (SELECT count(*) FROM (SELECT lfid FROM fl GROUP BY lfid HAVING count(DISTINCT source_file || flow_id) > 1))
    UNION ALL SELECT 'gap_within_cutoff', (SELECT count(*) FROM gaps WHERE g > {V.FLOW_CUTOFF})
    UNION ALL SELECT 'single_segment_identity', (SELECT count(*) FROM fl JOIN clus c ON fl.lfid = c.source_file || '|' || c.flow_id || '#' || CAST(c.cluster AS BIGINT)
       WHERE SegmentCount = 1 AND (abs(fl.fwd_bytes - c.fwd_bytes) > 1e-6 OR abs(coalesce(fl.len_mean, 0) - CASE WHEN fl.fwd_pkts + fl.bwd_pkts = 0 THEN 0 ELSE coalesce(c.len_mean, 0) END) > 1e-6))
    UNION ALL SELECT 'duration_total', CAST(abs((SELECT sum(duration_us) FROM fl) - (SELECT sum(duration_us) FROM seg)) AS BIGINT)
    UNION ALL SELECT 'pooled_std_valid', (SELECT count(*) FROM fl WHERE NOT (len_std >= 0))""",
)
def g15(spark, sf_dir):
    return checks.flow_integrity(
        V.segments(spark, sf_dir), V.SEGMENT_RULES, ("source_file", "flow_id"), V.FLOW_CUTOFF, V.TIE,
        "fwd_bytes", "len_mean", "duration_us", "len_std",
    )
