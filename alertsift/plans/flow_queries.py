"""Queries on flow clustering and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows
from ..schema import FlowRules
from . import views as V
from .catalog import as_long, near, query, r, rounded

_KEYS = ("source_file", "flow_id")
_BY = [*_KEYS, "cluster"]


def _assigned(spark, sf_dir):
    return flows.assign_logical_flow(V.segments(spark, sf_dir), _KEYS, "ts", V.FLOW_CUTOFF, V.TIE)


def _lfid():
    return flows.logical_flow_id(F.col("source_file"), F.col("flow_id"), F.col("cluster")).alias("lfid")


def _rule_query(spark, sf_dir, rules: FlowRules, *columns):
    df = flows.aggregate_flows(_assigned(spark, sf_dir), _BY, rules, "ts", V.TIE)
    return df.select(_lfid(), *columns)


@query(
    "f1_assign_logical_flow",
    f"""{V.BASE}, {V.clusters_sql()} SELECT source_file || '|' || flow_id || '#' || CAST(cluster AS BIGINT) AS lfid,
    ts, fwd_bytes FROM clus""",
)
def f1(spark, sf_dir):
    return _assigned(spark, sf_dir).select(_lfid(), "ts", "fwd_bytes")


@query(
    "f1_event_sessions",
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, value,
      epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
    c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 3600000000 THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY t) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(t) AS t_first, max(t) AS t_last,
      {r('sum(value)', 2)} AS total FROM c GROUP BY user_id, session""",
)
def f1_events(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select("user_id", "value", flows.epoch_micros(F.col("ts")).alias("t"))
    sessions = flows.assign_logical_flow(ev, ["user_id"], "t", 3_600_000_000, cluster="session")
    return sessions.groupBy("user_id", "session").agg(
        F.count("*").alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"),
        near(F.sum("value"), 2).alias("total"),
    )


@query(
    "f2_sum_all_missing",
    f"""{V.BASE}, {V.clusters_sql()} SELECT source_file || '|' || flow_id || '#' || CAST(cluster AS BIGINT) AS lfid,
    CAST(sum(init_win) AS BIGINT) AS init_win, CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts
    FROM clus GROUP BY source_file, flow_id, cluster""",
)
def f2(spark, sf_dir):
    return _rule_query(spark, sf_dir, FlowRules(sums=["init_win", "fwd_pkts"]), *as_long("init_win", "fwd_pkts"))


@query("f3_extrema", f"{V.WITH_FLOWS} SELECT lfid, {r('len_max', 4)} AS len_max, {r('len_min', 4)} AS len_min FROM fl")
def f3(spark, sf_dir):
    rules = FlowRules(maxima=["len_max"], minima=["len_min"])
    return _rule_query(spark, sf_dir, rules, rounded("len_max"), rounded("len_min"))


@query("f4_first_non_null", f"{V.WITH_FLOWS} SELECT lfid, src_ip, dst_port, init_win FROM fl")
def f4(spark, sf_dir):
    rules = FlowRules(identity=["src_ip", "dst_port"], first=["init_win"])
    return _rule_query(spark, sf_dir, rules, "src_ip", "dst_port", "init_win")


@query("f5_weighted_mean", f"{V.WITH_FLOWS} SELECT lfid, {r('len_mean', 4)} AS len_mean FROM fl")
def f5(spark, sf_dir):
    rules = FlowRules(weighted={"len_mean": "pkts"}, derived=V.SEGMENT_RULES.derived)
    return _rule_query(spark, sf_dir, rules, rounded("len_mean"))


@query("f6_pooled_std", f"{V.WITH_FLOWS} SELECT lfid, {r('len_std', 4)} AS len_std, {r('len_var', 2)} AS len_var FROM fl")
def f6(spark, sf_dir):
    rules = FlowRules(
        pooled=V.SEGMENT_RULES.pooled, squared=V.SEGMENT_RULES.squared, derived=V.SEGMENT_RULES.derived
    )
    return _rule_query(spark, sf_dir, rules, rounded("len_std"), rounded("len_var", 2))


@query(
    "f7_recomputed_rate",
    f"{V.WITH_FLOWS} SELECT lfid, {r('bytes_per_s', 2)} AS bytes_per_s, {r('packets_per_s', 4)} AS packets_per_s FROM fl",
)
def f7(spark, sf_dir):
    rules = FlowRules(rates=V.SEGMENT_RULES.rates, duration="duration_us", derived=V.SEGMENT_RULES.derived)
    return _rule_query(spark, sf_dir, rules, rounded("bytes_per_s", 2), rounded("packets_per_s"))


@query("f8_segment_span", f"{V.WITH_FLOWS} SELECT lfid, SegmentCount, ts_first, ts_last FROM fl")
def f8(spark, sf_dir):
    return _rule_query(spark, sf_dir, FlowRules(), "SegmentCount", "ts_first", "ts_last")


_FLOW_SQL = f"""{V.WITH_FLOWS} SELECT lfid, label, src_ip, src_port, dst_ip, dst_port, protocol, init_win, SegmentCount,
  ts_first, ts_last, fwd_pkts, bwd_pkts, fwd_bytes, bwd_bytes, duration_us, {r('len_max', 4)} AS len_max,
  {r('len_min', 4)} AS len_min, {r('len_mean', 4)} AS len_mean, {r('len_std', 4)} AS len_std,
  {r('len_var', 2)} AS len_var, {r('bytes_per_s', 2)} AS bytes_per_s, {r('packets_per_s', 4)} AS packets_per_s FROM fl"""


def _all_columns(df):
    return df.select(
        "lfid", "label", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "init_win", "SegmentCount",
        "ts_first", "ts_last", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration_us",
        rounded("len_max"), rounded("len_min"), rounded("len_mean"), rounded("len_std"), rounded("len_var", 2),
        rounded("bytes_per_s", 2), rounded("packets_per_s"),
    )


@query("f9_aggregate_flows", _FLOW_SQL)
def f9(spark, sf_dir):
    df = flows.aggregate_flows(_assigned(spark, sf_dir), _BY, V.SEGMENT_RULES, "ts", V.TIE)
    return _all_columns(df.withColumn("lfid", _lfid()))


@query("f10_build_unified_flows", _FLOW_SQL)
def f10(spark, sf_dir):
    return _all_columns(V.unified_flows(spark, sf_dir))


@query(
    "f10_flows_by_label",
    f"""{V.WITH_FLOWS} SELECT label, count(*) AS flows, CAST(sum(SegmentCount) AS BIGINT) AS segments,
    CAST(sum(fwd_bytes) AS BIGINT) AS fwd_bytes, CAST(max(SegmentCount) AS BIGINT) AS largest FROM fl GROUP BY label""",
)
def flows_by_label(spark, sf_dir):
    return (
        V.unified_flows(spark, sf_dir)
        .groupBy("label")
        .agg(
            F.count("*").alias("flows"), F.sum("SegmentCount").alias("segments"),
            F.sum("fwd_bytes").alias("fwd_bytes"), F.max("SegmentCount").alias("largest"),
        )
    )


@query(
    "f11_aggregate_by_name",
    f"""{V.BASE} SELECT flow_id, min(src_ip) AS src_ip,
    arg_min(label, struct_pack(a := ts, b := segment_no)) AS label,
    {r('avg(init_win)', 4)} AS "init win", {r('max(len_max)', 4)} AS "len max", {r('min(len_min)', 4)} AS "len min",
    {r('avg(len_mean)', 4)} AS "len mean", {r('avg(len_std)', 4)} AS "len std", CAST(sum(fwd_pkts) AS BIGINT) AS "fwd pkts",
    {r('avg(duration_us)', 4)} AS duration FROM seg GROUP BY flow_id""",
)
def f11(spark, sf_dir):
    s = V.segments(spark, sf_dir).select(
        "flow_id", "src_ip", "label", "ts", V.TIE, F.col("init_win").alias("init win"),
        F.col("len_max").alias("len max"), F.col("len_min").alias("len min"), F.col("len_mean").alias("len mean"),
        F.col("len_std").alias("len std"), F.col("fwd_pkts").alias("fwd pkts"), F.col("duration_us").alias("duration"),
    )
    out = flows.aggregate_by_name(s, "flow_id", ["src_ip"], ["ts", V.TIE])
    return out.select(
        "flow_id", "src_ip", "label", rounded("init win"), rounded("len max"), rounded("len min"),
        rounded("len mean"), rounded("len std"), "fwd pkts", rounded("duration"),
    )
