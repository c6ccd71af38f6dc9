"""Detectors and heads: ranges, reproducibility, brute force where it is small, and beating baselines."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from alertsift import schema as S
from alertsift.functions.keys import hash_order
from alertsift.operators import classifiers as C
from alertsift.operators import detectors as D
from alertsift.operators import explain as E
from alertsift.operators import metrics as M
from alertsift.operators import networks as N
from alertsift.operators import profiling as P


@pytest.fixture(scope="module")
def clouds(spark):
    """A benign cloud near a line in 6 dimensions, and attacks off it."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 6)) + 0.05 * rng.normal(size=(600, 6))
    odd = rng.normal(size=(60, 6)) * 2.5 + 2
    rows = [(i, 0, x.tolist()) for i, x in enumerate(base)] + [(1000 + i, 1, x.tolist()) for i, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>")
    return df.withColumn("features", array_to_vector("x")).repartition(4).cache()


def auc(df, score="anomaly_score", y="y"):
    return M.ranking_metrics(M.score_table(df, score, y)).first().roc_auc


def test_isolation_forest(clouds):
    model = D.fit_isolation_forest(clouds.where("y = 0"), "id", trees=40, sample=64)
    scored = model.score(clouds).cache()
    assert auc(scored) > 0.8
    low, high = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -0.5 <= low < high <= 0.5
    again = D.fit_isolation_forest(clouds.where("y = 0").repartition(3), "id", trees=40, sample=64)
    assert again.trees == model.trees  # the draw does not depend on the partitioning


def test_forest_with_fewer_rows_than_asked(clouds):
    model = D.fit_isolation_forest(clouds.where("id < 10"), "id", trees=7, sample=256)
    assert model.sample_size == 10 and len(model.trees) == 7
    assert model.score(clouds).where("anomaly_score IS NULL").count() == 0


def test_isolation_depth_by_hand(spark):
    tree = {"feature": [0, -1, -1], "cut": [1.0, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "depth": [0.0, 1.0, 1.0 + D._path_norm(3)]}
    df = spark.createDataFrame([([0.0],), ([2.0],)], "x array<double>").withColumn("features", array_to_vector("x"))
    got = [r.anomaly_score for r in D.IsolationForestModel([tree], 4).score(df).collect()]
    want = [2 ** (-d / D._path_norm(4)) - 0.5 for d in (1.0, 1.0 + D._path_norm(3))]
    assert got == pytest.approx(want)


def test_subspace_error_is_the_projection_residual(clouds):
    model = D.fit_subspace(clouds.where("y = 0"), 2)
    rows = model.score(clouds).select("x", "y", "anomaly_score").collect()
    x = np.array([r.x for r in rows])
    benign = x[[r.y == 0 for r in rows]]
    mean = benign.mean(axis=0)
    _, _, vt = np.linalg.svd(benign - mean, full_matrices=False)
    residual = (x - mean) - (x - mean) @ vt[:2].T @ vt[:2]
    np.testing.assert_allclose([r.anomaly_score for r in rows], (residual**2).mean(axis=1), atol=1e-8)
    assert auc(model.score(clouds)) > 0.95


def test_rank_search_prefers_lower_error(clouds):
    benign = clouds.where("y = 0")
    model, table = D.search_rank(benign.where("id % 5 > 0"), benign.where("id % 5 = 0"), [1, 2, 4])
    rows = {r.rank: r for r in table.collect()}
    assert rows[1].validation_mse > rows[2].validation_mse > rows[4].validation_mse
    assert rows[4].selected == 1 and model.components.shape[1] == 4


def test_latent_vector_ends_with_the_error(clouds):
    model = D.fit_subspace(clouds.where("y = 0"), 3)
    row = D.latent_features(model.score(clouds), model).select(vector_to_array("latent_features").alias("v"), "anomaly_score").first()
    assert len(row.v) == 4 and row.v[3] == pytest.approx(row.anomaly_score)


def test_autoencoder_learns_and_repeats(clouds):
    benign = clouds.where("y = 0")
    early = D.fit_autoencoder(benign, 6, (5, 2), epochs=1)
    late = D.fit_autoencoder(benign, 6, (5, 2), epochs=40)
    loss = lambda m: m.score(benign).agg(F.avg("anomaly_score")).first()[0]
    assert loss(late) < 0.6 * loss(early)
    assert auc(late.score(clouds)) > 0.8
    assert len(late.embed(clouds).first().latent) == 2


def test_autoencoder_gradient_against_finite_differences():
    rng = np.random.default_rng(0)
    w, b, x = [rng.normal(size=(3, 2)), rng.normal(size=(2, 3))], [rng.normal(size=2), rng.normal(size=3)], rng.normal(size=(5, 3))
    gradient, loss = N.gradients(x, w, b)
    for at in (0, 4):
        moved = [v.copy() for v in w]
        moved[0].flat[at] += 1e-6
        assert (N.gradients(x, moved, b)[1] - loss) / 1e-6 == pytest.approx(gradient[at], rel=1e-3, abs=1e-4)


def test_cluster_purity(clouds):
    model = D.fit_cluster_purity(clouds, "y", k=8, components=3)
    scored = model.score(clouds)
    assert auc(scored) > 0.8 and scored.where("anomaly_score < 0 OR anomaly_score > 1").isEmpty()


def test_pca_projection_is_centred(clouds):
    out, shares = P.pca_projection(clouds, "features")
    mean = out.agg(F.avg("pc1"), F.avg("pc2")).first()
    assert abs(mean[0]) < 1e-9 and abs(mean[1]) < 1e-9 and shares[0] >= shares[1] > 0


FITS = {
    "logistic": lambda d: C.fit_logistic(C.with_class_weight(d, "y"), "y", [0, 1], "weight", maxIter=20),
    "forest": lambda d: C.fit_forest(d, "y", [0, 1], trees=10, maxDepth=5),
    "tree": lambda d: C.fit_tree(d, "y", [0, 1], depth=4, leaf=5),
    "boosted": lambda d: C.fit_boosted(d, "y", [0, 1], rounds=5),
    "adaboost": lambda d: C.fit_adaboost(d, "y", [0, 1], rounds=8),
    "perceptron": lambda d: C.fit_perceptron(d, "y", [0, 1], (8,), maxIter=60),
}


@pytest.mark.parametrize("name", list(FITS))
def test_heads_beat_the_dummy(clouds, name):
    train, test = clouds.where("id % 4 > 0"), clouds.where("id % 4 = 0")
    scored = FITS[name](train).score(test)
    bad = scored.where((F.abs(F.aggregate("probability", F.lit(0.0), lambda s, v: s + v) - 1) > 1e-6) | (F.array_min("probability") < 0))
    assert bad.isEmpty()
    head, dummy = (C.evaluate(h, "y", [0, 1]).first() for h in (scored, C.fit_dummy(train, "y", [0, 1]).score(test)))
    assert head.macro_f1 > dummy.macro_f1 + 0.1 and head.binary_pr_auc > dummy.binary_pr_auc + 0.1


def test_adaboost_weights_by_hand(spark):
    """One stump on one feature; the second round sees the missed row grown by exp(alpha)."""
    rows = [(float(i), int(i >= 5) if i != 0 else 1) for i in range(10)]
    df = spark.createDataFrame(rows, "v double, y int").withColumn("features", array_to_vector(F.array("v")))
    stumps = C.fit_adaboost(df, "y", [0, 1], rounds=2).model
    assert stumps[0][1] == pytest.approx(np.log(0.9 / 0.1))  # one of ten rows missed
    # Row 0 now weighs 9 against 1 for each other row: it is half of everything.
    assert len(stumps) == 2 and stumps[1][1] > 0


def test_multiclass_boosting_gives_probabilities(clouds):
    three = clouds.withColumn("k", F.when(F.col("y") == 1, "a").when(F.col("x")[0] > 0, "b").otherwise("benign"))
    scored = C.fit_boosted(three, "k", ["benign", "a", "b"], rounds=3).score(three)
    result = C.evaluate(scored, "k", ["benign", "a", "b"]).first()
    assert result.macro_f1 > 0.8 and 0 < result.log_loss < 1


def test_multiclass_boosting_stops_early_per_class(clouds):
    frame = clouds.withColumn("kind", F.col("id") % 3).withColumn("stop", F.col("id") % 4 == 0)
    head = C.fit_boosted(frame, "kind", [0, 1, 2], rounds=12, validation="stop")
    assert len(head.model) == 3 and min(m.getNumTrees for m in head.model) < 12  # the class is noise: no round helps
    scored = head.score(frame)
    assert scored.columns == [*frame.columns, "probability", "prediction"]
    assert scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).isEmpty()


def test_stratified_dummy_follows_the_prior(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    head = C.fit_dummy(df, "y", [0, 1], "stratified", "id")
    share = head.score(df).agg(F.avg("prediction")).first()[0]
    assert share == pytest.approx(0.1, abs=0.02)


def test_permutation_finds_the_used_feature(spark):
    df = spark.range(800).select("id", (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("noise"))
    df = df.withColumn("features", array_to_vector(F.array(F.col("y") + 0.3 * F.col("noise"), F.rand(2)))).cache()
    head = C.fit_logistic(df, "y", [0, 1], maxIter=20)
    rows = {r.feature: r.mean_drop for r in E.permutation_importance(head, df, "y", "id", {"signal": 0, "noise": 1}, repeats=2).collect()}
    assert rows["signal"] > 0.2 and abs(rows["noise"]) < 0.05
    contrib = E.class_contributions(E.contributions(head, df, "id", "y", {"signal": 0, "noise": 1}, {"signal": 0.5, "noise": 0.5}), "y", 1)
    assert {r.feature for r in contrib.collect()} == {"signal"}


def test_permutation_drops_equal_one_feature_at_a_time(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("y"))
    df = df.withColumn("features", array_to_vector(F.array(*[F.col("y") * w + F.rand(k) for k, w in enumerate((0.0, 0.2, 0.6))]))).cache()
    head = C.fit_logistic(df, "y", [0, 1], maxIter=20)
    entries = {"a": 0, "b": 1, "c": 2}
    rows = {r.feature: r for r in E.permutation_importance(head, df, "y", "id", entries).collect()}
    assert rows.keys() == entries.keys()
    vectors = {r.id: (r.y, list(r.features)) for r in df.collect()}
    scores = lambda frame: [(r.y, r.probability[1]) for r in head.score(frame).collect()]

    def precision(pairs):
        """Average precision; equal scores count as one step."""
        out = 0.0
        for score in {p for _, p in pairs}:
            above = [y for y, p in pairs if p >= score]
            out += sum(y for y, p in pairs if p == score) * sum(above) / len(above)
        return out / sum(y for y, _ in pairs)

    order = lambda seed: [r.id for r in df.orderBy(hash_order(F.col("id"), seed), "id").select("id").collect()]
    base = precision(scores(df))
    for name, at in entries.items():
        drops = []
        for r in range(3):
            swapped = []
            for mine, other in zip(order(S.SEED + 2 * r), order(S.SEED + 2 * r + 1)):
                y, v = vectors[mine]
                swapped.append((y, Vectors.dense([*v[:at], vectors[other][1][at], *v[at + 1 :]])))
            drops.append(base - precision(scores(spark.createDataFrame(swapped, ["y", "features"]))))
        assert rows[name].baseline == pytest.approx(base) and rows[name].mean_drop == pytest.approx(sum(drops) / 3, abs=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data not present")
def test_permutation_query_has_every_feature(spark):
    from alertsift.plans import model_queries

    rows = model_queries.i22(spark, "/root/testdata/sf0.001").collect()
    assert {r.feature for r in rows} == {f"e{i}" for i in range(64)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data not present")
def test_flow_heads_have_the_whole_budget_and_stop_early(spark, monkeypatch):
    from alertsift.plans import model_queries

    asked = []
    monkeypatch.setattr(C, "fit_boosted", lambda df, label, classes, **options: asked.append((label, df, options)))
    model_queries.flow_heads(spark, "/root/testdata/sf0.001")
    assert [label for label, _, _ in asked] == ["label", "y_binary"] * 2
    for _, df, options in asked:
        assert options == {"rounds": 100, "depth": 6, "validation": "stop"}
        assert {r.stop for r in df.select("stop").distinct().collect()} == {False, True}


def test_saved_model_scores_alike(spark, clouds, tmp_path):
    from pyspark.ml.classification import GBTClassificationModel

    head = C.fit_boosted(clouds, "y", [0, 1], rounds=3)
    head.model.write().save(str(tmp_path / "head"))
    back = C.Head(None, [0, 1], C._native(GBTClassificationModel.load(str(tmp_path / "head"))))
    a, b = (h.score(clouds).orderBy("id").select("probability").collect() for h in (head, back))
    assert a == b
