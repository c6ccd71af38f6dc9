"""Queries on metrics, score calibration and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..operators import metrics as M
from . import views as V
from .catalog import near, query, r


def unit_hash(*parts):
    """A number in [0, 1) from the md5 of the joined parts: a stand-in for a model score."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def unit_hash_sql(text: str) -> str:
    digits = " + ".join(
        f"(strpos('0123456789abcdef', substr(md5({text}), {i + 1}, 1)) - 1) * {16 ** (3 - i)}" for i in range(4)
    )
    return f"(({digits}) / 65536.0::DOUBLE)"


def scored(spark, sf_dir):
    """Packets with score, binary prediction, a predicted label and one score per class."""
    p = V.packets(spark, sf_dir)
    odd = F.substring(F.md5("packet_id"), 2, 1)
    return p.select(
        "packet_id", "label", "y_true", "anomaly_score",
        (F.col("anomaly_score") >= 0.1).cast("int").alias("pred"),
        F.when(odd < "8", F.col("label")).when(odd < "b", "XSS").otherwise("benign").alias("pred_label"),
        *[unit_hash(F.col("packet_id"), F.lit(c)).alias(f"p_{i}") for i, c in enumerate(S.LABELS)],
    )


SCORED = f"""{V.WITH_PACKETS}, sc AS (SELECT packet_id, label, y_true, anomaly_score, CAST(anomaly_score >= 0.1 AS INTEGER) AS pred,
  CASE WHEN substr(md5(packet_id), 2, 1) < '8' THEN label WHEN substr(md5(packet_id), 2, 1) < 'b' THEN 'XSS' ELSE 'benign' END AS pred_label
  FROM pk),
cls AS (SELECT unnest(['benign', 'DDOS-HTTP_flood', 'DoS-HTTP', 'DNS_spoofing', 'XSS', 'brute_force']) AS class),
cum AS (SELECT score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
  FROM (SELECT anomaly_score AS score, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sc GROUP BY 1)
  WINDOW w AS (ORDER BY score DESC))"""
COUNTS = """count(*) FILTER (WHERE y_true = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y_true = 0 AND pred = 0) AS tn"""


@query(
    "k1_confusion_binary",
    f"""{SCORED} SELECT a.v AS y_true, b.v AS pred, (SELECT count(*) FROM sc WHERE y_true = a.v AND pred = b.v) AS n
    FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)""",
)
def k1(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), "y_true", "pred", [0, 1])


@query(
    "k1_confusion_multiclass",
    f"""{SCORED} SELECT a.class AS label, b.class AS pred_label, count(sc.packet_id) AS n FROM cls a CROSS JOIN cls b
    LEFT JOIN sc ON sc.label = a.class AND sc.pred_label = b.class GROUP BY 1, 2""",
)
def k1_multi(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), "label", "pred_label", S.LABELS)


@query(
    "k2_detection_metrics",
    f"""{SCORED}, c AS (SELECT {COUNTS} FROM sc) SELECT tp, fp, fn, tn, {r('tp / (tp + fp)', 6)} AS precision, {r('tp / (tp + fn)', 6)} AS recall,
    {r('2.0 * tp / (2 * tp + fp + fn)', 6)} AS f1, {r('(tp + tn) / (tp + fp + fn + tn)', 6)} AS accuracy,
    {r('fp / (fp + tn)', 6)} AS fpr, {r('fn / (fn + tp)', 6)} AS fnr FROM c""",
)
def k2(spark, sf_dir):
    m = M.detection_metrics(scored(spark, sf_dir), "y_true", "pred")
    rates = ["precision", "recall", "f1", "accuracy", "fpr", "fnr"]
    return m.select("tp", "fp", "fn", "tn", *[near(F.col(c), 6).alias(c) for c in rates])


@query(
    "k3_roc_auc",
    f"""{SCORED}, rk AS (SELECT y_true, rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0 AS rk FROM sc)
    SELECT {r("(sum(rk) FILTER (WHERE y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0) / (sum(y_true) * sum(1 - y_true))", 6)} AS roc_auc FROM rk""",
)
def k3(spark, sf_dir):
    table = M.score_table(scored(spark, sf_dir), "anomaly_score", "y_true")
    return M.ranking_metrics(table).select(near(F.col("roc_auc"), 6).alias("roc_auc"))


@query(
    "k3_roc_points",
    f"{SCORED} SELECT {r('score', 6)} AS score, {r('cn / tn', 6)} AS fpr, {r('cp / tp', 6)} AS tpr FROM cum",
)
def k3_points(spark, sf_dir):
    points = M.roc_points(M.score_table(scored(spark, sf_dir), "anomaly_score", "y_true"))
    return points.select(*[near(F.col(c), 6).alias(c) for c in points.columns])


@query("k4_average_precision", f"{SCORED} SELECT {r('sum(pos * cp / (cp + cn)) / max(tp)', 6)} AS average_precision FROM cum")
def k4(spark, sf_dir):
    table = M.score_table(scored(spark, sf_dir), "anomaly_score", "y_true")
    return M.ranking_metrics(table).select(near(F.col("average_precision"), 6).alias("average_precision"))


PER_CLASS = f"""{SCORED}, pc AS (SELECT class, (SELECT count(*) FROM sc WHERE label = class) AS support,
  (SELECT count(*) FROM sc WHERE pred_label = class) AS predicted, (SELECT count(*) FROM sc WHERE label = class AND pred_label = class) AS tp FROM cls),
pm AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
  coalesce(2.0 * tp / nullif(predicted + support, 0), 0) AS f1 FROM pc)"""


@query(
    "k5_per_class",
    f"{PER_CLASS} SELECT class, support, predicted, tp, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1 FROM pm",
)
def k5(spark, sf_dir):
    t = M.per_class(scored(spark, sf_dir), "label", "pred_label", S.LABELS)
    return t.select("class", "support", "predicted", "tp", *[near(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "k5_multiclass_summary",
    f"""{PER_CLASS} SELECT {r('sum(tp) / sum(support)', 6)} AS accuracy, {r('avg(recall)', 6)} AS balanced_accuracy,
    {r('avg(precision)', 6)} AS macro_precision, {r('avg(recall)', 6)} AS macro_recall, {r('avg(f1)', 6)} AS macro_f1,
    {r('sum(f1 * support) / sum(support)', 6)} AS weighted_f1 FROM pm""",
)
def k5_summary(spark, sf_dir):
    t = M.multiclass_summary(M.per_class(scored(spark, sf_dir), "label", "pred_label", S.LABELS))
    return t.select(*[near(F.col(c), 6).alias(c) for c in t.columns])


@query(
    "k6_one_vs_rest",
    f"""{SCORED}, long AS (SELECT class, {unit_hash_sql("packet_id || '|' || class")} AS s, CAST(label = class AS INTEGER) AS hit FROM sc CROSS JOIN cls),
    rk AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY s) + (count(*) OVER (PARTITION BY class, s) - 1) / 2.0 AS rk FROM long),
    auc AS (SELECT class, (sum(rk) FILTER (WHERE hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * sum(1 - hit)) AS auc FROM rk GROUP BY class),
    cc AS (SELECT class, pos, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY class) AS tp
      FROM (SELECT class, s, sum(hit) AS pos, sum(1 - hit) AS neg FROM long GROUP BY 1, 2) WINDOW w AS (PARTITION BY class ORDER BY s DESC)),
    ap AS (SELECT class, sum(pos * cp / (cp + cn)) / max(tp) AS ap FROM cc GROUP BY class)
    SELECT {r('(SELECT avg(auc) FROM auc)', 6)} AS roc_auc_ovr_macro, {r('(SELECT avg(ap) FROM ap)', 6)} AS pr_auc_ovr_macro""",
)
def k6(spark, sf_dir):
    t = M.one_vs_rest(scored(spark, sf_dir), "label", {c: f"p_{i}" for i, c in enumerate(S.LABELS)})
    return t.select(*[near(F.col(c), 6).alias(c) for c in t.columns])


@query(
    "k7_binary_collapse",
    f"""{SCORED}, b AS (SELECT CAST(label <> 'benign' AS INTEGER) AS y_true, CAST(pred_label <> 'benign' AS INTEGER) AS pred FROM sc),
    c AS (SELECT {COUNTS} FROM b) SELECT {r('tp / (tp + fp)', 6)} AS attack_precision, {r('tp / (tp + fn)', 6)} AS attack_recall,
    {r('2.0 * tp / (2 * tp + fp + fn)', 6)} AS attack_f1 FROM c""",
)
def k7(spark, sf_dir):
    collapsed = M.binary_collapse(scored(spark, sf_dir), "label", "pred_label")
    m = M.detection_metrics(collapsed, "y_any", "pred_any")
    return m.select(*[near(F.col(c), 6).alias(f"attack_{c}") for c in ("precision", "recall", "f1")])


@query(
    "k8_detection_rates",
    f"{SCORED} SELECT label, count(*) AS n, {r('avg(pred)', 6)} AS rate FROM sc WHERE label <> 'benign' GROUP BY label",
)
def k8(spark, sf_dir):
    t = M.detection_rates(scored(spark, sf_dir), "label", "pred")
    return t.select("label", "n", near(F.col("rate"), 6).alias("rate"))


@query(
    "k9_best_operating_point",
    f"""{SCORED}, pr AS (SELECT cp / (cp + cn) AS p, cp / tp AS rec FROM cum)
    SELECT {r('max(2 * p * rec / (p + rec + 1e-12))', 6)} AS best_f1, {r('max(p) FILTER (WHERE rec >= 0.9)', 6)} AS precision_at_recall FROM pr""",
)
def k9(spark, sf_dir):
    t = M.best_operating_point(M.score_table(scored(spark, sf_dir), "anomaly_score", "y_true"))
    return t.select(*[near(F.col(c), 6).alias(c) for c in t.columns])


@query(
    "k10_log_loss",
    f"""{SCORED}, p AS (SELECT {unit_hash_sql("packet_id || '|' || label")} AS p FROM sc)
    SELECT {r('-avg(ln(least(greatest(p, 1e-15), 1 - 1e-15)))', 6)} AS log_loss FROM p""",
)
def k10(spark, sf_dir):
    df = scored(spark, sf_dir)
    p_true = F.coalesce(*[F.when(F.col("label") == c, F.col(f"p_{i}")) for i, c in enumerate(S.LABELS)])
    return M.log_loss(df, p_true).select(near(F.col("log_loss"), 6).alias("log_loss"))


@query(
    "h10_single_feature_auc",
    f"""{V.BASE}, long AS (SELECT CAST(label <> 'benign' AS INTEGER) AS y, f.n AS feature, f.v AS v FROM seg,
      LATERAL (SELECT unnest([struct_pack(n := 'fwd_pkts', v := CAST(fwd_pkts AS DOUBLE)), struct_pack(n := 'bwd_pkts', v := bwd_pkts),
        struct_pack(n := 'len_std', v := len_std), struct_pack(n := 'duration_us', v := duration_us)]) AS f)),
    rk AS (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM long),
    a AS (SELECT feature, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM rk GROUP BY feature)
    SELECT feature, {r('greatest(auc, 1 - auc)', 6)} AS auc FROM a""",
)
def h10(spark, sf_dir):
    s = V.segments(spark, sf_dir).withColumns({"y": (F.col("label") != "benign").cast("int"), "constant": F.lit(1)})
    t = M.feature_auc(s, ["fwd_pkts", "bwd_pkts", "len_std", "duration_us", "constant"], "y")
    return t.select("feature", near(F.col("auc"), 6).alias("auc"))


REFERENCE = "substr(md5(packet_id), 3, 1) < '8'"


def _ranked(spark, sf_dir):
    df = scored(spark, sf_dir).select("packet_id", "anomaly_score", F.col("p_0").alias("other"))
    reference = df.where(F.substring(F.md5("packet_id"), 3, 1) < "8")
    first = M.rank_normalise(df, "anomaly_score", reference, "anomaly_score", "rank_a")
    return M.rank_normalise(first, "other", reference, "other", "rank_b")


RANKED = f"""{SCORED}, s2 AS (SELECT packet_id, anomaly_score AS a, {unit_hash_sql("packet_id || '|benign'")} AS b, {REFERENCE} AS ref FROM sc),
rk AS (SELECT packet_id, (count(*) FILTER (WHERE ref) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING)) / (count(*) FILTER (WHERE ref) OVER ()) AS rank_a,
  (count(*) FILTER (WHERE ref) OVER (ORDER BY b RANGE UNBOUNDED PRECEDING)) / (count(*) FILTER (WHERE ref) OVER ()) AS rank_b FROM s2)"""


@query("i6_rank_normalise", f"{RANKED} SELECT packet_id, {r('rank_a', 6)} AS rank_a, {r('rank_b', 6)} AS rank_b FROM rk")
def i6(spark, sf_dir):
    return _ranked(spark, sf_dir).select("packet_id", near(F.col("rank_a"), 6).alias("rank_a"), near(F.col("rank_b"), 6).alias("rank_b"))


@query(
    "i7_fuse_scores",
    f"""{RANKED} SELECT packet_id, {r('0.5 * rank_a + 0.5 * rank_b', 5)} AS mean_score, {r('greatest(rank_a, rank_b)', 5)} AS max_score,
    {r('0.6 * rank_b + 0.4 * rank_a', 5)} AS weighted_score FROM rk""",
)
def i7(spark, sf_dir):
    a, b = F.col("rank_a"), F.col("rank_b")
    return _ranked(spark, sf_dir).select(
        "packet_id", *[near(M.fuse(a, b, m), 5).alias(f"{m}_score") for m in ("mean", "max", "weighted")]
    )


SWEEP = f"""{SCORED}, q AS (SELECT quantile_cont(anomaly_score, 0.01) AS lo, quantile_cont(anomaly_score, 0.99) AS hi FROM sc),
t AS (SELECT i AS slot, lo + i * ((hi - lo) / 199) AS threshold FROM q, range(200) x(i)),
sw AS (SELECT slot, threshold, count(*) FILTER (WHERE y_true = 1 AND anomaly_score >= threshold) AS tp,
  count(*) FILTER (WHERE y_true = 0 AND anomaly_score >= threshold) AS fp, sum(y_true) AS positives FROM t CROSS JOIN sc GROUP BY 1, 2),
f AS (SELECT *, coalesce(2.0 * tp / nullif(tp + fp + positives, 0), 0) AS f1 FROM sw)"""


@query(
    "i8_threshold_sweep",
    f"{SWEEP} SELECT CAST(slot AS INTEGER) AS slot, {r('threshold', 5)} AS threshold, tp, fp, {r('f1', 6)} AS f1 FROM f",
)
def i8_sweep(spark, sf_dir):
    t = M.threshold_sweep(scored(spark, sf_dir), "anomaly_score", "y_true")
    return t.select("slot", near(F.col("threshold"), 5).alias("threshold"), "tp", "fp", near(F.col("f1"), 6).alias("f1"))


@query(
    "i8_choose_threshold",
    f"{SWEEP} SELECT {r('threshold', 5)} AS threshold, {r('f1', 6)} AS f1 FROM f ORDER BY f.f1 DESC, slot LIMIT 1",
)
def i8(spark, sf_dir):
    t = M.choose_threshold(scored(spark, sf_dir), "anomaly_score", "y_true")
    return t.select(near(F.col("threshold"), 5).alias("threshold"), near(F.col("f1"), 6).alias("f1"))


@query(
    "i14_class_weights",
    f"""{SCORED}, c AS (SELECT label, count(*) AS n FROM sc GROUP BY label),
    w AS (SELECT label, n, sum(n) OVER () / (count(*) OVER () * n) AS balanced FROM c),
    m AS (SELECT *, sqrt(balanced) AS dampened FROM w)
    SELECT label, n, {r('balanced / (sum(balanced * n) OVER () / sum(n) OVER ())', 6)} AS balanced,
    {r('dampened / (sum(dampened * n) OVER () / sum(n) OVER ())', 6)} AS dampened, {r('1.0', 6)} AS none FROM m""",
)
def i14(spark, sf_dir):
    df = scored(spark, sf_dir).select("label")
    parts = {s: M.class_weights(df, "label", s).withColumnRenamed("weight", s) for s in ("balanced", "dampened", "none")}
    t = parts["balanced"].join(parts["dampened"].drop("n"), "label").join(parts["none"].drop("n"), "label")
    return t.select("label", "n", *[near(F.col(c), 6).alias(c) for c in parts])


@query(
    "i26_run_summary",
    f"""{V.WITH_PACKETS}, runs AS (SELECT label, substr(md5(packet_id), 1, 1) AS run, avg(fwd_pkts) AS value FROM pk GROUP BY 1, 2)
    SELECT label, count(*) AS runs, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std FROM runs GROUP BY label""",
)
def i26_summary(spark, sf_dir):
    runs = V.packets(spark, sf_dir).groupBy("label", F.substring(F.md5("packet_id"), 1, 1).alias("run")).agg(
        F.avg("fwd_pkts").alias("value")
    )
    t = M.run_summary(runs, ["label"])
    return t.select("label", "runs", near(F.col("mean")).alias("mean"), near(F.col("std")).alias("std"))
