"""Queries on sources, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import label_of
from ..operators import checks, sampling, splits
from ..session import materialise, stage_path
from ..sources import captures as A
from . import views as V
from .catalog import near, query, r
from .mapping_queries import ALERTS, SPLIT, aligned_alerts, flow_sample, with_split
from ..operators import mapping


def _csv_captures(spark, sf_dir):
    """Segments written as one folder of CSV parts per capture, and read back."""
    path = stage_path(spark, "captures")
    s = V.segments(spark, sf_dir).select("source_file", "flow_id", "ts", "fwd_pkts", "len_mean", "init_win")
    s.write.partitionBy("source_file").option("header", True).csv(path)
    schema = "flow_id string, ts long, fwd_pkts long, len_mean double, init_win long"
    return A.scan_captures(spark, path, spark.createDataFrame([], schema).schema)


@query(
    "a1_scan_captures",
    f"""{V.BASE} SELECT source_file, label, count(*) AS n, CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts, {r('sum(len_mean)', 1)} AS len_mean,
    count(init_win) AS init_win FROM seg GROUP BY ALL""",
)
def a1(spark, sf_dir):
    return _csv_captures(spark, sf_dir).groupBy("source_file", "label").agg(
        F.count("*").alias("n"), F.sum("fwd_pkts").alias("fwd_pkts"), near(F.sum("len_mean"), 1).alias("len_mean"),
        F.count("init_win").alias("init_win"),
    )


@query(
    "a1_captures_by_name",
    f"""{V.BASE} SELECT source_file, label, count(*) AS n, CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts, {r('sum(len_mean)', 1)} AS len_mean,
    count(CASE WHEN length(source_file) % 3 <> 2 THEN init_win END) AS init_win FROM seg GROUP BY ALL""",
)
def a1_by_name(spark, sf_dir):
    """Captures of three headers: two orders of the columns, and one that lacks a column."""
    names = ["flow_id", "ts", "fwd_pkts", "len_mean", "init_win"]
    folder = stage_path(spark, "captures")
    s = materialise(V.segments(spark, sf_dir).select("source_file", *names))
    for k, header in enumerate((names, names[::-1], names[:-1])):
        part = s.where(F.length("source_file") % 3 == k).select("source_file", *header)
        part.write.partitionBy("source_file").option("header", True).csv(f"{folder}/{k}")
    schema = "flow_id string, ts long, fwd_pkts long, len_mean double, init_win long"
    return A.scan_captures(spark, folder, spark.createDataFrame([], schema).schema).groupBy("source_file", "label").agg(
        F.count("*").alias("n"), F.sum("fwd_pkts").alias("fwd_pkts"), near(F.sum("len_mean"), 1).alias("len_mean"),
        F.count("init_win").alias("init_win"),
    )


@query("a2_label_from_source", f"{V.BASE} SELECT source_file, label, count(*) AS n FROM seg GROUP BY ALL")
def a2(spark, sf_dir):
    s = V.segments(spark, sf_dir)
    return s.groupBy("source_file", label_of(F.col("source_file")).alias("label")).agg(F.count("*").alias("n"))


FILE_MAP = {
    "Benign": ["BenignTraffic.pcap_Flow.csv", "BenignTraffic1.pcap_Flow.csv", "BenignTraffic9.pcap_Flow.csv"],
    "Flood": ["DDoS-HTTP_Flood-.pcap_Flow.csv", "DoS-HTTP_Flood.pcap_Flow.csv"],
}


@query(
    "a3_label_from_file_map",
    f"""{V.BASE}, m(source_file, category) AS (VALUES {', '.join(f"('{f}', '{c}')" for c, fs in FILE_MAP.items() for f in fs)})
    SELECT category, count(*) AS n, 'pooled' AS kind FROM seg JOIN m USING (source_file) GROUP BY category
    UNION ALL SELECT category, count(*), 'missing file' FROM m WHERE source_file NOT IN (SELECT source_file FROM seg) GROUP BY category""",
)
def a3(spark, sf_dir):
    s = V.segments(spark, sf_dir)
    pooled = A.label_from_file_map(s, FILE_MAP).groupBy("category").agg(F.count("*").alias("n"), F.lit("pooled").alias("kind"))
    absent = A.missing_files(s, FILE_MAP).groupBy("category").agg(F.count("*").alias("n"), F.lit("missing file").alias("kind"))
    return pooled.unionByName(absent)


@query("a4_pruned_scan", f"{V.BASE} SELECT DISTINCT src_port, dst_port FROM seg")
def a4(spark, sf_dir):
    return V.segments(spark, sf_dir).select("src_port", "dst_port").distinct()


@query(
    "a5_pair_captures",
    f"""{V.BASE} SELECT DISTINCT replace(source_file, '.pcap_Flow.csv', '') AS stem, replace(source_file, '.pcap_Flow.csv', '.csv') AS packet_file,
    source_file AS flow_file FROM seg WHERE l_orderkey % 5 < 4""",
)
def a5(spark, sf_dir):
    s = V.segments(spark, sf_dir)
    packet_files = s.select(F.replace("source_file", F.lit(".pcap_Flow.csv"), F.lit(".csv")).alias("source_file"))
    return A.pair_captures(packet_files, s)


@query("a6_stage_table", f"{V.WITH_FLOWS} SELECT label, count(*) AS flows, CAST(sum(fwd_bytes) AS BIGINT) AS fwd_bytes FROM fl GROUP BY label")
def a6(spark, sf_dir):
    path = stage_path(spark, "unified_flows")
    build = lambda: V.unified_flows(spark, sf_dir)
    A.stage_table(spark, path, build)
    again = A.stage_table(spark, path, lambda: 1 / 0)  # reads, never builds
    return again.groupBy("label").agg(F.count("*").alias("flows"), F.sum("fwd_bytes").alias("fwd_bytes"))


@query("a7_metric_tables", f"{V.BASE} SELECT label, count(*) AS n, 'json' AS form FROM seg GROUP BY label UNION ALL SELECT label, count(*), 'csv' FROM seg GROUP BY label")
def a7(spark, sf_dir):
    table = V.segments(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    parts = []
    for form in ("json", "csv"):
        path = stage_path(spark, f"metrics-{form}")
        A.write_metrics(table, path, form)
        reader = spark.read.schema(table.schema)
        read = reader.json(path) if form == "json" else reader.option("header", True).csv(path)
        parts.append(read.withColumn("form", F.lit(form)))
    return parts[0].unionByName(parts[1])


def orders(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("host"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("o_orderdate")).alias("ts_first"),
    )


HASH = "md5('23|' || id)"
ORDERS = f"""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS label, o_custkey AS host, CAST(epoch(o_orderdate) AS BIGINT) AS ts_first FROM orders),
h AS (SELECT *, row_number() OVER (ORDER BY {HASH}) AS g_rank, row_number() OVER (PARTITION BY label ORDER BY {HASH}) AS c_rank,
  count(*) OVER (PARTITION BY label) AS c_n, count(*) OVER () AS g_n FROM o)"""


@query("d1_sample_exact", f"{ORDERS} SELECT id, label FROM h WHERE g_rank <= 1000")
def d1(spark, sf_dir):
    return sampling.sample_exact(orders(spark, sf_dir), 1000, "id").select("id", "label")


@query("d2_sample_upto", f"{ORDERS} SELECT id, label FROM h WHERE c_rank <= 3000")
def d2(spark, sf_dir):
    return sampling.sample_upto(orders(spark, sf_dir), 3000, ["label"], "id").select("id", "label")


@query("d2_shortfall", f"{ORDERS} SELECT label, count(*) AS available, 3000 - count(*) AS missing FROM h GROUP BY label HAVING count(*) < 3000")
def d2_short(spark, sf_dir):
    return sampling.shortfall(orders(spark, sf_dir), 3000, ["label"])


@query("d3_sample_balanced", f"{ORDERS} SELECT id, label FROM h WHERE c_rank <= 1000")
def d3(spark, sf_dir):
    return sampling.sample_balanced(orders(spark, sf_dir), "id", total=5003).select("id", "label")


@query(
    "d4_split_budget",
    f"""{ORDERS}, q AS (SELECT label, 1003 // 5 + CAST(row_number() OVER (ORDER BY label) <= 1003 % 5 AS INTEGER) AS quota FROM (SELECT DISTINCT label FROM o))
    SELECT id, label FROM h JOIN q USING (label) WHERE c_rank <= quota""",
)
def d4(spark, sf_dir):
    return sampling.sample_budget(orders(spark, sf_dir), 1003, "id").select("id", "label")


@query(
    "d5_packet_cohort",
    f"""{V.WITH_PACKETS}, k AS (SELECT packet_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('23|' || packet_id)) AS rk FROM pk)
    SELECT packet_id, label FROM k WHERE rk <= CASE WHEN label = 'benign' THEN 2000 ELSE 300 END""",
)
def d5(spark, sf_dir):
    p = V.packets(spark, sf_dir)
    benign = sampling.sample_upto(p.where("label = 'benign'"), 2000, [], "packet_id")
    attacks = sampling.sample_upto(p.where("label <> 'benign'"), 300, ["label"], "packet_id")
    return benign.unionByName(attacks).select("packet_id", "label")


@query("d6_shuffle", f"{ORDERS} SELECT id, g_rank AS position FROM h")
def d6(spark, sf_dir):
    return sampling.shuffle_rows(orders(spark, sf_dir), "id").select("id", "position")


@query(
    "d7_resample_replacements",
    f"""{ALERTS}, gone AS (SELECT lfid, label, split FROM smp WHERE (split = 'train' AND (lfid IN (SELECT lfid FROM cval) OR lfid IN (SELECT lfid FROM ctest)))
      OR (split = 'val' AND lfid IN (SELECT lfid FROM ctest))),
    q AS (SELECT label, count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'val') AS b, count(*) FILTER (WHERE split = 'test') AS c FROM gone GROUP BY label),
    pool AS (SELECT lfid, label FROM cand WHERE canonical_key IS NOT NULL AND lfid NOT IN (SELECT lfid FROM smp)
      AND lfid NOT IN (SELECT lfid FROM cval) AND lfid NOT IN (SELECT lfid FROM ctest)),
    rk AS (SELECT lfid, label, row_number() OVER (PARTITION BY label ORDER BY md5('23|' || lfid)) AS rn FROM pool)
    SELECT lfid, label, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'val' ELSE 'test' END AS split FROM rk JOIN q USING (label) WHERE rn <= a + b + c""",
)
def d7(spark, sf_dir):
    aligned, cand = aligned_alerts(spark, sf_dir)
    sample = flow_sample(cand)
    reach = mapping.reachable_flows(aligned, cand)
    _, removed = mapping.remove_leaks(sample, aligned, cand)
    used = materialise(sample.select("lfid").unionByName(reach))
    out = sampling.resample_replacements(materialise(removed), cand.select("lfid", "label"), used, "lfid")
    return out.select("lfid", "label", "split")


def _rounded_cut(share: float) -> str:
    return f"floor(c_n * {share}::DOUBLE + 0.5)"


@query("e1_stratified_split", f"{ORDERS} SELECT id, CASE WHEN c_rank <= {_rounded_cut(0.25)} THEN 'test' ELSE 'train' END AS split FROM h")
def e1(spark, sf_dir):
    return splits.stratified_split(orders(spark, sf_dir), ["label"], "id", {"test": 0.25}).select("id", "split")


def _three_way(spark, sf_dir):
    return splits.stratified_split(orders(spark, sf_dir), ["label"], "id", {"test": S.TEST_SHARE, "val": S.VAL_SHARE})


@query(
    "e2_three_way_split",
    f"{ORDERS} SELECT id, CASE WHEN c_rank <= {_rounded_cut(0.15)} THEN 'test' WHEN c_rank <= {_rounded_cut(0.3)} THEN 'val' ELSE 'train' END AS split FROM h",
)
def e2(spark, sf_dir):
    return _three_way(spark, sf_dir).select("id", "split")


@query(
    "e3_group_split",
    f"""{ORDERS}, g AS (SELECT host, row_number() OVER (ORDER BY md5('23|' || host)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT host FROM o))
    SELECT id, CASE WHEN rk <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM o JOIN g USING (host)""",
)
def e3(spark, sf_dir):
    return splits.group_split(orders(spark, sf_dir), "host").select("id", "split")


@query(
    "e3_group_overlap",
    f"""{ORDERS}, g AS (SELECT host, row_number() OVER (ORDER BY md5('23|' || host)) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT host FROM o)),
    s AS (SELECT o.host, CASE WHEN rk <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM o LEFT JOIN g ON o.host = g.host)
    SELECT 'host' AS side, count(*) AS overlap FROM (SELECT host FROM s GROUP BY host HAVING count(DISTINCT split) > 1)""",
)
def e3_overlap(spark, sf_dir):
    shared = splits.group_overlap(splits.group_split(orders(spark, sf_dir), "host"), "host")
    return shared.agg(F.lit("host").alias("side"), F.count("*").alias("overlap"))


FOLDS = f"""{ORDERS}, f AS (SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY ts_first, id) - 1) * 4 // count(*) OVER (PARTITION BY label) AS INTEGER) AS temporal_fold,
  row_number() OVER (PARTITION BY label ORDER BY ts_first, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM o)"""


def _folds(spark, sf_dir):
    return splits.temporal_folds(orders(spark, sf_dir), "label", ["ts_first", "id"])


@query("e4_temporal_folds", f"{FOLDS} SELECT id, temporal_fold FROM f")
def e4(spark, sf_dir):
    return _folds(spark, sf_dir).select("id", "temporal_fold")


@query(
    "e5_expanding_plan",
    f"""{FOLDS} SELECT CAST(k AS INTEGER) AS round, CASE WHEN temporal_fold < k THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM f, range(1, 4) t(k)
    WHERE temporal_fold <= k GROUP BY ALL""",
)
def e5(spark, sf_dir):
    return splits.expanding_plan(_folds(spark, sf_dir)).groupBy("round", "role").agg(F.count("*").alias("n"))


@query("e6_early_stop_tail", f"{FOLDS} SELECT id, CAST(rn > greatest(floor(n * 0.9::DOUBLE), 1) AS INTEGER) AS early_stop FROM f")
def e6(spark, sf_dir):
    return splits.early_stop_tail(orders(spark, sf_dir), "label", ["ts_first", "id"]).select("id", "early_stop")


@query(
    "e7_fit_validation_split",
    f"""{V.WITH_PACKETS}, b AS (SELECT packet_id, row_number() OVER (ORDER BY md5('23|' || packet_id)) AS rn, count(*) OVER () AS n FROM pk WHERE label = 'benign')
    SELECT packet_id, CAST(rn <= least(n - 1, greatest(1, floor(n * 0.1::DOUBLE))) AS INTEGER) AS is_validation FROM b""",
)
def e7(spark, sf_dir):
    benign = V.packets(spark, sf_dir).where("label = 'benign'")
    return splits.fit_validation_split(benign, "packet_id").select("packet_id", "is_validation")


@query("e8_apply_split_map", f"WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS label FROM orders) SELECT id, label, {SPLIT.format('CAST(id AS VARCHAR)')} AS split FROM o")
def e8(spark, sf_dir):
    o = orders(spark, sf_dir)
    assigned = with_split(o.select("id", F.col("id").cast("string").alias("key")), "key")
    return splits.apply_split_map(o, assigned, "id").select("id", "label", "split")


@query(
    "g16_split_checks",
    f"""{FOLDS} SELECT * FROM (VALUES ('unique_key', 0::BIGINT), ('one_split_per_key', 0), ('share_spread', 0), ('class_in_every_split', 0),
    ('fold_assigned', 0), ('class_in_every_fold', 0)) t(rule, violations)
    UNION ALL SELECT 'thin_fold_cells', (SELECT count(*) FROM (SELECT label, temporal_fold FROM f GROUP BY 1, 2 HAVING count(*) < 30))""",
)
def g16(spark, sf_dir):
    df = _three_way(spark, sf_dir)
    folded = materialise(splits.temporal_folds(df, "label", ["ts_first", "id"]))
    return checks.split_checks(folded, "id", "label", "split", "temporal_fold")
