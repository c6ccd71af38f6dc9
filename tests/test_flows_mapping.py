"""Edge rules of clustering, aggregation, keys and mapping on hand-written frames."""

import math

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from alertsift import schema as S
from alertsift.functions import keys as K
from alertsift.operators import features as X
from alertsift.operators import flows as FL
from alertsift.operators import mapping as M
from alertsift.plans import views as V
from alertsift.schema import FlowRules
from alertsift.sources import captures as A


def clusters(spark, times, cutoff=300):
    rows = [("f", "a", i, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "source_file string, flow string, i long, ts long").repartition(4)
    out = FL.assign_logical_flow(df, ("source_file", "flow"), "ts", cutoff, tie="i")
    return [r.cluster for r in out.orderBy("i").collect()]


@pytest.mark.parametrize(
    "times, want",
    [
        ([0, 300], [1, 1]),
        ([0, 301], [1, 2]),
        ([0, 299, 600, 900, 1201], [1, 1, 2, 2, 3]),
        ([1000, 0, 250], [2, 1, 1]),
        ([5, 5, 5], [1, 1, 1]),
        ([0, 1000, None, 100, None], [1, 2, 3, 1, 4]),
        ([None, None], [1, 2]),
        ([-400, -90, 211], [1, 2, 3]),
    ],
)
def test_gap_clusters(spark, times, want):
    assert clusters(spark, times) == want


def test_clusters_match_the_sorted_scan(spark):
    import random

    rng = random.Random(3)
    times = [rng.randint(0, 60_000) for _ in range(400)]
    got = clusters(spark, times)
    order, number, last, want = sorted(range(400), key=lambda i: times[i]), 0, None, {}
    for i in order:
        if last is None or times[i] - last > 300:
            number += 1
        last, want[i] = times[i], number
    assert got == [want[i] for i in range(400)]


RULES = FlowRules(
    identity=["ip"], first=["win"], sums=["n", "gap"], maxima=["hi"], minima=["lo"], weighted={"mean": "n"},
    pooled={"std": ("mean", "n")}, squared={"var": "std"}, rates={"rate": "n"}, duration="dur",
)
COLUMNS = "source_file string, flow string, ts long, tie long, ip string, win long, n long, gap long, hi double, lo double, mean double, std double, dur long"


def unify(spark, rows, cutoff=300):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    out = FL.build_unified_flows(df, RULES, ("source_file", "flow"), "ts", cutoff, "tie")
    return {r["LogicalFlowID"]: r for r in out.collect()}


def test_rules_on_two_segments(spark):
    flow = unify(
        spark,
        [
            ("f", "a", 10, 2, None, None, 4, None, 5.0, 1.0, 10.0, 2.0, 500_000),
            ("f", "a", 200, 1, "x", 7, 2, None, 9.0, 0.5, 40.0, 1.0, 500_000),
            ("f", "a", 250, 1, "y", 8, 0, None, None, None, None, None, None),
        ],
    )["f|a#1"]
    assert (flow.SegmentCount, flow.ts_first, flow.ts_last) == (3, 10, 250)
    assert (flow.ip, flow.win) == ("x", 7)  # first non-null in time order
    assert flow.n == 6 and flow.gap is None  # all-missing stays missing
    assert (flow.hi, flow.lo) == (9.0, 0.5)
    assert flow["mean"] == pytest.approx((4 * 10 + 2 * 40) / 6)
    total, mean = 6, 120 / 6
    within = 3 * 4.0 + 1 * 1.0
    between = 4 * (10 - mean) ** 2 + 2 * (40 - mean) ** 2
    assert flow["std"] == pytest.approx(math.sqrt((within + between) / (total - 1)))
    assert flow["var"] == pytest.approx((within + between) / (total - 1))
    assert flow.rate == pytest.approx(6.0)


def test_single_packet_zero_weight_and_zero_duration(spark):
    flows = unify(
        spark,
        [
            ("f", "one", 0, 1, "x", None, 1, 3, 1.0, 1.0, 5.0, 9.0, 0),
            ("f", "none", 0, 1, "x", None, 0, 3, 1.0, 1.0, 5.0, 9.0, None),
            ("f", "late", None, 1, "x", 1, 1, 3, 1.0, 1.0, 5.0, 9.0, 10),
            ("f", "late", None, 2, "x", 2, 1, 3, 1.0, 1.0, 5.0, 9.0, 10),
            ("f", "late", 50, 3, "x", 3, 1, 3, 1.0, 1.0, 5.0, 9.0, 10),
        ],
    )
    assert flows["f|one#1"]["std"] == 0 and flows["f|one#1"].rate == 0 and flows["f|one#1"].win is None
    assert flows["f|none#1"]["mean"] == 0 and flows["f|none#1"]["std"] == 0 and flows["f|none#1"].rate == 0
    assert [flows[f"f|late#{i}"].win for i in (1, 2, 3)] == [3, 1, 2]  # untimed ones come last


def test_varying_identity_does_not_split_a_flow(spark):
    flows = unify(
        spark,
        [
            ("f", "a", 20, 1, "second", 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1),
            ("f", "a", 10, 1, "first", 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1),
            ("f", "a", 290, 1, "second", 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1),
            ("f", "a", 400, 1, "first", 1, 1, 1, 1.0, 1.0, 1.0, 1.0, 1),
        ],
    )
    assert list(flows) == ["f|a#1"] and flows["f|a#1"].ip == "first" and flows["f|a#1"].SegmentCount == 4


def test_two_ways_agree_on_a_hot_flow(spark):
    """A third of the rows in one Flow ID: fused and step-wise aggregation are equal."""
    df = spark.range(6000).select(
        F.lit("f").alias("source_file"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("flow"),
        ((F.col("id") * 7919) % 900_000).alias("ts"), F.col("id").alias("tie"), F.lit("x").alias("ip"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("win"), (F.col("id") % 9).alias("n"), F.lit(1).cast("long").alias("gap"),
        (F.col("id") % 13).cast("double").alias("hi"), (F.col("id") % 11).cast("double").alias("lo"),
        (F.col("id") % 17).cast("double").alias("mean"), (F.col("id") % 4).cast("double").alias("std"), (F.col("id") % 6).alias("dur"),
    )
    keys = ("source_file", "flow")
    fused = FL.build_unified_flows(df, RULES, keys, "ts", 300, "tie")
    steps = FL.aggregate_flows(FL.assign_logical_flow(df, keys, "ts", 300, "tie"), [*keys, "cluster"], RULES, "ts", "tie")
    cols = ["flow", "SegmentCount", "ts_first", "ts_last", "win", "n", "hi", "lo", F.round("mean", 6), F.round("std", 6), F.round("rate", 6)]
    a, b = (sorted(map(tuple, d.select(*cols).collect())) for d in (fused, steps))
    assert a == b and len(a) > 2000


def test_null_flow_ids_are_set_aside(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "`Flow ID` string, x long")
    usable, rejected = FL.split_null_flow_ids(df)
    assert (usable.count(), rejected.count()) == (1, 1)


@pytest.mark.parametrize(
    "name, rule",
    [("FWD Init Win Bytes", "mean"), ("Fwd IAT Max", "max"), ("Idle Min", "min"), ("Packet Length Std", "mean"),
     ("Down/Up Ratio", "mean"), ("Flow Bytes/s", "mean"), ("Total Fwd Packet", "sum"), ("Packet Length Variance", "mean")],
)
def test_name_rules(name, rule):
    assert FL.name_rule(name) == rule


def test_timestamp_text(spark):
    df = spark.createDataFrame([("01/02/2022 01:05:09 PM",), ("31/31/2022 01:00:00 AM",), (None,)], "t string")
    got = [r[0] for r in df.select(FL.parse_timestamp(F.col("t"))).collect()]
    assert str(got[0]) == "2022-02-01 13:05:09" and got[1:] == [None, None]


@pytest.mark.parametrize(
    "name, label",
    [("BenignTraffic1.pcap_Flow.csv", "benign"), ("DDoS-HTTP_Flood-.csv", "DDOS-HTTP_flood"), ("DoS-HTTP_Flood.csv", "DoS-HTTP"),
     ("DNS_Spoofing.csv", "DNS_spoofing"), ("x-XSS.csv", "XSS"), ("DictionaryBruteForce.csv", "brute_force"), ("Mirai.csv", "Unknown Attack")],
)
def test_labels(spark, name, label):
    assert spark.range(1).select(K.label_of(F.lit(name))).first()[0] == label


def packet(spark, *rows):
    return spark.createDataFrame(rows, "src_ip string, src_port long, dst_ip string, dst_port long, l4_tcp int, l4_udp int")


def test_key_ignores_direction_and_holds_protocol(spark):
    rows = M.with_packet_key(
        packet(spark, ("a", 9, "b", 80, 1, 0), ("b", 80, "a", 9, 1, 0), ("a", 9, "b", 80, 0, 1), ("a", 10, "a", 9, 1, 0))
    ).select("canonical_key").collect()
    assert [r[0] for r in rows] == ["a:9||b:80||6", "a:9||b:80||6", "a:9||b:80||17", "a:10||a:9||6"]


def test_invalid_reasons_in_order(spark):
    rows = M.with_packet_key(
        packet(spark, (None, 0, "b", 80, 0, 0), ("", 1, "b", 80, 1, 0), ("a", 0, "b", 80, 0, 0), ("a", None, "b", 80, 1, 0),
               ("a", 1, "b", 80, 0, 0), ("a", 1, "b", 80, 1, 0))
    ).select("invalid_reason", "canonical_key").collect()
    assert [r[0] for r in rows] == ["missing_endpoint", "missing_endpoint", "zero_port", "zero_port", "unsupported_protocol", None]
    assert [r[1] is None for r in rows] == [True] * 5 + [False]


def candidates(spark):
    flows = [
        ("f1", "benign", "c1", "a", 1, "b", 80, 6),
        ("f2", "XSS", "c2", "a", 2, "b", 80, 6), ("f3", "XSS", "c2", "b", 80, "a", 2, 6),
        ("f4", "benign", "c1", "a", 3, "b", 80, 6), ("f5", "XSS", "c2", "a", 3, "b", 80, 6),
        ("f6", "benign", "c1", "a", 4, "b", 80, 6), ("f7", "benign", "c3", "a", 4, "b", 80, 6),
        ("f8", "benign", "c1", "a", 0, "b", 80, 6),
    ]
    df = spark.createDataFrame(flows, "lfid string, label string, source_file string, s string, sp long, d string, dp long, p int")
    return M.candidates(df, ("s", "sp", "d", "dp", "p"), "lfid")


def test_statuses(spark):
    index = M.candidate_index(candidates(spark))
    packets = packet(spark, *[("a", port, "b", 80, 1, 0) for port in (1, 2, 3, 4, 5)], ("a", 0, "b", 80, 1, 0))
    rows = M.classify_packets(packets, index).orderBy("src_port").collect()
    assert [r.status for r in rows] == [S.INVALID_KEY, S.UNIQUE_MATCH, S.SAME_CAPTURE, S.CONFLICTING, S.SAME_LABEL, S.NO_MATCH]
    assert [r.n_candidates for r in rows] == [0, 1, 2, 2, 2, 0]
    assert [r.matched_lfid for r in rows] == [None, "f1", None, None, None, None]


def test_packets_without_a_key_are_spread(spark):
    """A join sends all null keys to one task, where a third of the packets may have none."""
    index = M.candidate_index(candidates(spark))
    packets = spark.range(4000, numPartitions=2).selectExpr(
        "CAST(null AS string) AS src_ip", "id AS src_port", "'2' AS dst_ip", "2L AS dst_port", "1 AS l4_tcp", "0 AS l4_udp"
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = M.classify_packets(packets, index)
        tasks = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert out.columns[0] == M.KEY and "_at" not in out.columns
        assert {r.status for r in out.select("status").distinct().collect()} == {S.INVALID_KEY}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 4000 and len(tasks) == 8
    assert max(r["count"] for r in tasks) < 1000


def test_fallback_priority(spark):
    flows = spark.createDataFrame(
        [("five", "a", "b", 1, 80, 6, 5), ("four", "a", "b", 1, 80, 17, 1), ("rev", "b", "a", 80, 2, 6, 0), ("any", "c", "d", 1, 2, None, 0)],
        "lfid string, src_ip string, dst_ip string, src_port long, dst_port long, protocol int, t long",
    )
    packets = packet(spark, ("a", 1, "b", 80, 1, 0), ("a", 2, "b", 80, 1, 0), ("c", 1, "d", 2, 1, 0), ("d", 2, "c", 1, 0, 0), ("z", 1, "b", 80, 1, 0), (None, 1, "b", 80, 1, 0))
    rows = M.match_with_fallback(packets, flows, ["t"]).orderBy(F.col("src_ip").asc_nulls_last(), "src_port").collect()
    assert [(r.match_rank, r.matched_flow) for r in rows] == [(1, "five"), (2, "rev"), (3, "any"), (4, "any"), (None, None), (None, None)]


def test_leaks_are_removed_by_rule(spark):
    cand = candidates(spark)
    alerts = packet(spark, ("a", 1, "b", 80, 1, 0), ("a", 2, "b", 80, 1, 0)).withColumn("split", F.when(F.col("src_port") == 1, "val").otherwise("test"))
    aligned = M.classify_packets(alerts, M.candidate_index(cand))
    sample = spark.createDataFrame([("f1", "train"), ("f2", "val"), ("f3", "train"), ("f4", "train"), ("f1x", "val")], "lfid string, split string")
    kept, removed = M.remove_leaks(sample, aligned, cand)
    assert sorted(r.lfid for r in removed.collect()) == ["f1", "f2", "f3"]
    assert sorted(r.lfid for r in kept.collect()) == ["f1x", "f4"]
    guard = {r.rule: r.overlap for r in M.leakage_guard(sample, aligned, cand).collect()}
    assert guard == {"cascade_val_x_train": 1, "cascade_test_x_train": 1, "cascade_test_x_val": 1}


def test_attempts_count_earlier_or_self(spark):
    times = [0, 10, 10, 70, 71, 100_000, 86_395, 86_405]
    rows = [("a", "b", t, i) for i, t in enumerate(times)] + [("a", "c", 10, 99)]
    df = spark.createDataFrame(rows, "src string, dst string, ts long, i long")
    out = X.attempts_same_target(df, {"n60": 60}, ["src", "dst"], "ts", "i").orderBy("i").collect()
    assert [r.n60 for r in out] == [1, 2, 3, 3, 2, 1, 1, 2, 1]


def test_attempts_by_running_totals(spark, monkeypatch):
    """Frames that slide are summed anew for every row, so a busy pair would cost the square of its rows."""
    times = [(i * i * 7919) % 500 - 120 for i in range(300)]
    rows = [("a", "b" if i % 3 else "c", t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "src string, dst string, ts long, i long")
    seen = []
    monkeypatch.setattr(X, "materialise", lambda d: seen.append(d) or d.localCheckpoint())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")  # windows reach over batches
        out = X.attempts_same_target(df, {"near": 9, "far": 100}, ["src", "dst"], "ts", "i", chunk=100).collect()
    finally:
        spark.conf.set(key, old)
    assert len(out) == len(rows)
    for r in out:
        mine = [(t, i) for _, d, t, i in rows if d == r.dst and (t, i) <= (r.ts, r.i)]
        assert [r.near, r.far] == [sum(t >= r.ts - w for t, _ in mine) for w in (9, 100)]
    assert "RangeFrame" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_equal_rows_get_distinct_keys(spark):
    df = spark.createDataFrame([("x", 1.0)] * 5 + [("y", None)], "a string, b double")
    keys = [r[0] for r in A.with_row_key(df).select("packet_key").collect()]
    assert len(set(keys)) == 6


def test_capture_name(spark):
    paths = ["file:/d/BenignTraffic.csv", "file:/d/XSS.pcap_Flow.csv/part-0-x.csv", "file:/d/source_file=A%20B.csv/part-0.csv"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(A.capture_name(F.col("p"))).collect()
    assert [r[0] for r in got] == ["BenignTraffic.csv", "XSS.pcap_Flow.csv", "A B.csv"]


def test_captures_unite_by_name(spark, tmp_path):
    (tmp_path / "Benign[1].csv").write_text("a,b\n1,2\n")
    (tmp_path / "XSS.csv").write_text("b,a\n2,1\n")
    (tmp_path / "DNS_Spoofing.csv").write_text("a\nx\n")
    (tmp_path / "Empty.csv").write_text("")
    got = {r.source_file: r for r in A.scan_captures(spark, str(tmp_path)).collect()}
    assert {f: (r.a, r.b) for f, r in got.items()} == {"Benign[1].csv": ("1", "2"), "XSS.csv": ("1", "2"), "DNS_Spoofing.csv": ("x", None)}
    schema = spark.createDataFrame([], "b long, a long").schema
    got = {r.source_file: (r.a, r.b) for r in A.scan_captures(spark, str(tmp_path), schema).collect()}
    assert got == {"Benign[1].csv": (1, 2), "XSS.csv": (1, 2), "DNS_Spoofing.csv": (None, None)}
    with pytest.raises(ValueError, match="'c'"):
        A.scan_captures(spark, str(tmp_path), spark.createDataFrame([], "a long, c long").schema)


def test_parts_of_one_capture_must_agree(spark, tmp_path):
    folder = tmp_path / "XSS.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n1,2\n")
    (folder / "part-1.csv").write_text("b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        A.scan_captures(spark, str(tmp_path)).collect()


def _marked(df):
    """``df`` behind a step that shows in every plan that builds it."""
    return df.mapInPandas(lambda batches: batches, df.schema)


def test_fallback_reads_the_flows_once(spark):
    flows = spark.createDataFrame(
        [("f1", 5, "a", "b", 1, 2, 6), ("f2", 3, "a", "b", 1, 2, 17), ("f3", 1, "a", "b", 1, 2, None), ("f4", 2, "c", "d", 1, 2, None)],
        "lfid string, t long, src_ip string, dst_ip string, src_port long, dst_port long, protocol long",
    )
    packets = spark.createDataFrame(
        [("a", "b", 1, 2, 1, 0), ("a", "b", 1, 2, 0, 1), ("b", "a", 2, 1, 0, 0), ("d", "c", 2, 1, 1, 0), ("x", "y", 1, 2, 1, 0)],
        "src_ip string, dst_ip string, src_port long, dst_port long, l4_tcp int, l4_udp int",
    )
    out = M.match_with_fallback(packets, _marked(flows), ["t"])
    got = {(r.src_ip, r.l4_tcp, r.l4_udp): (r.match_rank, r.matched_flow) for r in out.collect()}
    assert got == {("a", 1, 0): (1, "f1"), ("a", 0, 1): (1, "f2"), ("b", 0, 0): (4, "f3"), ("d", 1, 0): (4, "f4"), ("x", 1, 0): (None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_flow_integrity_builds_the_flows_once(spark):
    from alertsift.operators import checks

    rows = [("s", f"k{i % 3}", 10.0 * i, i, 2, 8, 100 + i, 5, 1.5, 0.5) for i in range(30)]
    segments = spark.createDataFrame(rows, "f string, id string, ts double, no long, p long, q long, bytes long, dur long, mean double, dev double")
    rules = FlowRules(sums=["bytes", "dur"], weighted={"mean": "p"}, pooled={"dev": ("mean", "p")})
    out = checks.flow_integrity(_marked(segments), rules, ("f", "id"), 20.0, "no", "bytes", "mean", "dur", "dev")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.rule: r.violations for r in out.collect()} == dict.fromkeys(
        ["segment_count", "unique_id", "single_key", "gap_within_cutoff", "single_segment_identity", "duration_total", "pooled_std_valid"], 0
    )
    # The raw totals; the segments with their clusters (two reads each) for gaps and for single segments.
    assert plan.count("MapInPandas") == 5


def test_flows_are_shuffled_once_by_key(spark, monkeypatch):
    """Rows go to their key in one exchange; a crowded key takes the combined way, with the same flows."""
    df = spark.range(3000).select(
        F.concat(F.lit("f"), (F.col("id") % 4 % 2).cast("string")).alias("source_file"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))).alias("flow"),
        F.when(F.col("id") % 40 > 0, (F.col("id") * 7919) % 900_000).alias("ts"), F.col("id").alias("tie"), F.lit("x").alias("ip"),
        F.when(F.col("id") % 5 > 0, F.col("id")).alias("win"), (F.col("id") % 9).alias("n"), F.lit(1).cast("long").alias("gap"),
        F.lit(1.0).alias("hi"), F.lit(2.0).alias("lo"), (F.col("id") % 17).cast("double").alias("mean"), F.lit(3.0).alias("std"), (F.col("id") % 6).alias("dur"),
    )
    keys = ("source_file", "flow")
    timed = FL.build_unified_flows(df.where("ts IS NOT NULL"), RULES, keys, "ts", 300, "tie")
    assert timed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert FL._crowded_cells(df, keys, "ts") == ([], 75)
    plain = sorted(map(repr, FL.build_unified_flows(df, RULES, keys, "ts", 300, "tie").collect()))
    monkeypatch.setattr(FL, "CROWD", 400)
    monkeypatch.setattr(FL, "_CELLS", 4096)
    assert len(FL._crowded_cells(df, keys, "ts")[0]) == 2
    assert sorted(map(repr, FL.build_unified_flows(df, RULES, keys, "ts", 300, "tie").collect())) == plain
    assert len(plain) > 1000


def test_large_order_keys_keep_the_order_of_ties(spark, tmp_path):
    """Order keys above 2^25: the number of a segment no longer fits a long."""
    first = 54_000_000
    rows = [
        (first + 8 * (n // 2), part, 360_005, 1 + n % 2, 10.0, 1000.0 + n, 0.05, 0.02, "1995-03-01")
        for n, part in enumerate((7_200_013, 7_200_001, 7_200_001, 7_200_013))
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, day string"
    table = spark.createDataFrame(rows, names).withColumn("l_shipdate", F.to_timestamp_ntz("day")).drop("day")
    table.write.parquet(str(tmp_path / "lineitem.parquet"))
    found = queries()["f10_build_unified_flows"](spark, str(tmp_path)).collect()
    assert [(r.SegmentCount, r.init_win, r.src_ip) for r in found] == [(4, 7_200_013 % 65536, "10.0.0.0")]
    assert [tuple(r) for r in queries()["f9_aggregate_flows"](spark, str(tmp_path)).collect()] == [tuple(r) for r in found]
    ties = [int(r[0]) for r in V.segments(spark, str(tmp_path)).select(V.TIE).collect()]
    assert sorted(ties) == sorted(((k * 8 + line) * 1048576 + part) * 32768 + supp for k, part, supp, line, *_ in rows)


def test_clusters_need_one_exchange_and_a_crowded_key_changes_none(spark, monkeypatch):
    df = spark.range(3000).select(
        (F.col("id") % 2).cast("string").alias("source_file"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))).alias("flow"),
        F.when(F.col("id") % 40 > 0, F.floor(F.col("id") * 7919 / 3) % 900_000).alias("ts"), F.col("id").alias("tie"),
    )
    keys = ("source_file", "flow")
    rules = FlowRules(sums=["tie"])
    timed = FL.aggregate_flows(FL.assign_logical_flow(df.where("ts IS NOT NULL"), keys, "ts", 300, "tie"), [*keys, "cluster"], rules, "ts", "tie")
    assert timed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    ways = [FL.assign_logical_flow(df, keys, "ts", 300, "tie", by_bucket=way) for way in (False, True)]
    monkeypatch.setattr(FL, "CROWD", 400)
    monkeypatch.setattr(FL, "_CELLS", 4096)
    assert len(FL._crowded_cells(df, keys, "ts")[0]) == 2
    ways.append(FL.assign_logical_flow(df, keys, "ts", 300, "tie"))
    plain, *others = (sorted(map(repr, way.collect())) for way in ways)
    assert len(plain) == 3000 and others == [plain, plain]
