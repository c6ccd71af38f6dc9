"""Ranking metrics, suppression rules and policies on ties, gaps and empty cases."""

import math

import pytest
from pyspark.sql import functions as F

from alertsift import schema as S
from alertsift.operators import cascade as C
from alertsift.operators import cleaning as L
from alertsift.operators import metrics as M


def ranking(spark, pairs):
    df = spark.createDataFrame([(float(s), y) for s, y in pairs], "s double, y int")
    return M.ranking_metrics(M.score_table(df, "s", "y")).first()


def test_auc_and_ap_with_ties(spark):
    row = ranking(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)])
    assert row.roc_auc == pytest.approx(3.5 / 4)
    assert row.average_precision == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_all_scores_equal(spark):
    row = ranking(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])
    assert (row.roc_auc, row.average_precision) == (0.5, pytest.approx(1 / 3))


def test_step_wise_not_interpolated(spark):
    row = ranking(spark, [(4, 1), (3, 0), (2, 1), (1, 0)])
    assert row.average_precision == pytest.approx(0.8333333, abs=1e-6)


def test_absent_class_has_no_auc(spark):
    assert ranking(spark, [(0.5, 1), (0.4, 1)]).roc_auc is None


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    row = M.detection_metrics(df, "y", "p").first()
    assert (row.precision, row.recall, row.f1, row.fpr, row.fnr) == (0, 0, 0, 0, 1)


def test_threshold_takes_the_first_best(spark):
    rows = [(i / 100, int(i >= 50)) for i in range(101)]
    df = spark.createDataFrame(rows, "s double, y int")
    sweep = M.threshold_sweep(df, "s", "y").collect()
    tau = [0.01 + i * (0.98 / 199) for i in range(200)]
    for r in sweep:
        assert r.tp == sum(y for s, y in rows if s >= r.threshold) and r.fp == sum(1 - y for s, y in rows if s >= r.threshold)
        assert r.threshold == pytest.approx(tau[r.slot])
    best = M.choose_threshold(df, "s", "y").first()
    assert best.f1 == 1.0 and best.threshold == min(r.threshold for r in sweep if r.f1 == 1.0)


def test_constant_scores_sweep(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0)], "s double, y int")
    assert M.choose_threshold(df, "s", "y").first().threshold == 1.0


def test_rank_normalise_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (9.0,)], "s double")
    ref = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "r double")
    got = {r.s: r.rank_score for r in M.rank_normalise(df, "s", ref, "r").collect()}
    assert got == {0.0: 0.0, 1.0: 0.25, 2.5: 0.5, 9.0: 1.0}


def test_class_weights_have_mean_one(spark):
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2, "label string")
    for scheme in ("none", "balanced", "dampened"):
        rows = M.class_weights(df, "label", scheme).collect()
        assert sum(r.n * r.weight for r in rows) / 10 == pytest.approx(1.0)


CAND = [("k1", "f1"), ("k2", "f2"), ("k2", "f3"), ("k3", "f4"), ("k3", "f5"), ("k4", "f6"), ("k4", "f7")]


def decide(spark, scores, heads=("h",)):
    cand = spark.createDataFrame(CAND, "canonical_key string, lfid string")
    table = spark.createDataFrame(scores, "lfid string, h double")
    aligned = spark.createDataFrame(
        [(1, "k1", S.UNIQUE_MATCH), (2, "k2", S.SAME_CAPTURE), (3, "k3", S.CONFLICTING), (4, "k4", S.SAME_CAPTURE), (5, None, S.INVALID_KEY), (6, "zz", S.NO_MATCH)],
        "id long, canonical_key string, status string",
    )
    out = C.alert_scores(aligned, C.key_scores(cand, table, heads), heads)
    return {(r.id, r.policy): (r.score, r.decision_flow, r.usable) for r in out.collect()}


def test_policies_and_missing_scores(spark):
    got = decide(spark, [("f1", 0.3), ("f2", 0.9), ("f3", 0.9), ("f4", 0.1), ("f5", 0.2), ("f6", 0.5)])
    assert got[1, "A"] == got[1, "B"] == (0.3, "f1", True)
    assert got[2, "A"] == (None, None, False)
    assert got[2, "B"] == (0.9, "f3", True)  # equal scores: the greater id
    assert got[4, "B"] == (None, None, False)  # one candidate without a score
    assert all(got[i, p] == (None, None, False) for i in (3, 5, 6) for p in "AB")


def test_non_finite_candidate_means_no_score(spark):
    got = decide(spark, [("f1", float("nan")), ("f2", 0.1), ("f3", float("inf"))])
    assert got[1, "A"][2] is False and got[2, "B"][2] is False


def test_keep_rule(spark):
    df = spark.createDataFrame([(0.4,), (0.5,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(C.keep(F.col("s"), F.lit(0.5))).collect()] == [False, True, True, True]


def brute_threshold(rows, floor):
    best = None
    for tau in sorted({s for s, _ in rows if s is not None}):
        kept = [(s, y) for s, y in rows if not (s is not None and s < tau)]
        tp, fp = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        retention, reduction = sum(y for _, y in kept) / max(tp, 1), 1 - sum(1 - y for _, y in kept) / max(fp, 1)
        if retention >= floor and (best is None or (reduction, retention) > best[1:]):
            best = (tau, reduction, retention)
    return best


@pytest.mark.parametrize("floor", [0.5, 0.9, 1.0])
def test_select_threshold_is_the_brute_force_choice(spark, floor):
    import random

    rng = random.Random(11)
    rows = [(None if rng.random() < 0.1 else round(rng.random() + 0.3 * y, 2), y) for y in (rng.randint(0, 1) for _ in range(300))]
    df = spark.createDataFrame([("h", "A", s, y, s is not None) for s, y in rows], "head string, policy string, score double, y_true int, usable boolean")
    got = C.select_threshold(df, floor=floor).first()
    tau, reduction, retention = brute_threshold(rows, floor)
    assert (got.tau, got.feasible) == (tau, True)
    assert (got.fp_reduction, got.tp_retention) == (pytest.approx(reduction), pytest.approx(retention))


def test_nothing_feasible_keeps_everything(spark):
    df = spark.createDataFrame([("h", "A", None, 1, False), ("h", "A", None, 0, False)], "head string, policy string, score double, y_true int, usable boolean")
    row = C.bake_off(C.select_threshold(df)).first()
    assert row.tau is None and not row.feasible
    assert C.apply_frozen(df, row).where("NOT keep").count() == 0


def test_mcnemar(spark):
    rows = [(1, False)] * 3 + [(0, False)] * 20 + [(1, True)] * 5
    got = C.mcnemar(spark.createDataFrame(rows, "y_true int, keep boolean")).first()
    chi2 = (abs(3 - 20) - 1) ** 2 / 23
    assert (got.b, got.c, got.chi2) == (3, 20, pytest.approx(chi2))
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))
    empty = C.mcnemar(spark.createDataFrame([(1, True)], "y_true int, keep boolean")).first()
    assert empty.chi2 is None and empty.p_value is None


def test_bootstrap_covers_the_point_and_repeats(spark):
    rows = [(0, False)] * 600 + [(0, True)] * 400 + [(1, True)] * 95 + [(1, False)] * 5
    df = spark.createDataFrame(rows, "y_true int, keep boolean")
    a, b = (C.bootstrap_intervals(df, 400).first() for _ in range(2))
    assert a == b and a.repeats == 400
    assert a.fp_reduction_low < 0.6 < a.fp_reduction_high and a.tp_retention_low < 0.95 < a.tp_retention_high
    # Binomial spread: about 1.96 * sqrt(p * q / n) to each side.
    assert a.fp_reduction_high - a.fp_reduction_low == pytest.approx(2 * 1.96 * math.sqrt(0.24 / 1000), rel=0.2)


def raw_packets(spark):
    rows = [("1.1.1.1", "2.2.2.2", 1, 2, 1, 0, float(i % 7), None if i % 4 == 0 else float(i), "GET" if i % 2 else "-1", "benign") for i in range(40)]
    return spark.createDataFrame(
        rows, "src_ip string, dst_ip string, src_port long, dst_port long, l4_tcp int, l4_udp int, size double, jitter double, http_request_method string, label string"
    )


def test_prepare_packets_keeps_identifiers_aside(spark):
    frame, names = L.prepare_packets(raw_packets(spark), S.PACKET_ID_COLUMNS)
    assert frame.count() == 40 and {"id_src_ip", "id_dst_port"} <= set(frame.columns)
    assert {"size", "jitter", "jitter_is_missing", "http_request_method_GET", "http_request_method_unknown"} <= set(names)
    assert not set(names) & {"src_ip", "src_port"}


def test_prepare_packets_fails_loudly(spark):
    df = raw_packets(spark)
    with pytest.raises(ValueError, match="missing"):
        L.prepare_packets(df.drop("src_ip"), S.PACKET_ID_COLUMNS)
    with pytest.raises(ValueError, match="null features"):
        L.prepare_packets(df.withColumn("size", F.lit(-5.0)), S.PACKET_ID_COLUMNS)
    with pytest.raises(ValueError, match="null features"):
        L.prepare_packets(df.withColumn("size", F.when(F.col("size") > 3, float("-inf")).otherwise(F.col("size"))), S.PACKET_ID_COLUMNS)
    only_ids = df.select("src_ip", "dst_ip", "src_port", "dst_port", "label")
    with pytest.raises(ValueError, match="no numeric"):
        L.prepare_packets(only_ids, ["src_ip"])


def test_infinity_rules(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (float("inf"),), (float("-inf"),), (None,)], "x double")
    rows = L.cap_infinity(df).collect()
    assert [r.x_is_infinite for r in rows] == [0, 0, 1, 1, 0]
    assert [r.x for r in rows] == [1.0, 5.0, 5.0, float("-inf"), None]


def test_preprocessor_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None, None, "a"), (3.0, None, 2.0, "b"), (None, None, 4.0, "b")], "x double, void double, z double, c string")
    test = spark.createDataFrame([(None, 9.0, None, "new"), (-1.0, 1.0, 6.0, None)], train.schema)
    pre = L.fit_preprocessor(train, ["x", "void", "z"], ["c"])
    assert pre.features == ["x", "z", "x_is_missing", "z_is_missing", "c_a", "c_b"]
    rows = pre.apply(test).select(*pre.features).collect()
    assert [tuple(r) for r in rows] == [(2.0, 3.0, 1.0, 1.0, 0, 0), (2.0, 6.0, 1.0, 0.0, 0, 1)]


def test_forbidden_columns():
    L.forbid_columns(S.behaviour_numeric())
    assert len(S.behaviour_numeric()) == 80
    with pytest.raises(ValueError, match="Src Port"):
        L.forbid_columns(["Flow Duration", "Src Port"])


def test_identifier_words():
    names = ["src_ip", "Dst Port", "http-host", "stripe", "l4_tcp", "support", "flow_id", "server"]
    assert L.identifier_columns(names) == ["src_ip", "Dst Port", "http-host", "server"]


def test_one_configuration_is_its_part_of_all(spark):
    """A row per head and policy is made where it is read; the stage table holds each alert once."""
    heads = ["g", "h"]
    cand = spark.createDataFrame(CAND, "canonical_key string, lfid string")
    table = spark.createDataFrame([(f"f{i}", i / 10, 1 - i / 10) for i in range(1, 7)], "lfid string, g double, h double")
    aligned = spark.createDataFrame(
        [(1, "k1", S.UNIQUE_MATCH), (2, "k2", S.SAME_CAPTURE), (3, "k3", S.CONFLICTING), (4, "k4", S.SAME_CAPTURE), (5, None, S.INVALID_KEY), (1, "k1", S.UNIQUE_MATCH)],
        "id long, canonical_key string, status string",
    )
    per_key = C.key_scores(cand, table, heads)
    stage = C.scored_alerts(aligned, per_key, heads)
    assert stage.count() == 6
    every = C.alert_scores(aligned, per_key, heads)
    assert every.count() == 6 * 2 * 2
    for head in heads:
        for policy in C.POLICIES:
            one = C.one_configuration(stage, heads, head, policy)
            assert one.columns == every.columns
            rows = lambda df: sorted(map(str, df.collect()))
            assert rows(one) == rows(every.where((F.col("head") == head) & (F.col("policy") == policy)))


def test_the_stage_of_decisions_holds_each_alert_once(spark, monkeypatch):
    from alertsift.plans import cascade_queries as CQ

    wide = spark.createDataFrame(
        [(f"p{i}", "benign", i % 2, "val" if i < 3 else "test", 1, 2, status, *[(0.5, "f")] * 4) for i, status in enumerate([S.UNIQUE_MATCH, S.CONFLICTING, S.SAME_CAPTURE, S.UNIQUE_MATCH])],
        "packet_id string, label string, y_true int, split string, src_port long, dst_port long, status string, "
        + ", ".join(f"_s_{h} struct<score: double, lfid: string>" for h in CQ.HEADS),
    )
    monkeypatch.setattr(CQ, "scored_alerts", lambda *_: wide)
    stage = CQ.stage_decisions(spark, "nowhere")
    assert stage.count() == 4 and stage.where(F.col(f"_s_{CQ.HEADS[0]}").isNull()).count() == 1
    test, winner = CQ.frozen(spark, "nowhere")
    assert [r.packet_id for r in test.collect()] == ["p3"] and winner["feasible"]
