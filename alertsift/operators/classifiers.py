"""Supervised flow heads on MLlib, one interface: ``score`` adds class probabilities."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import hash_order
from ..session import bounded, join_groups, materialise
from . import metrics as M
from . import trees
from .networks import softmax, train_network


@dataclass(frozen=True)
class Head:
    """A fitted classifier over classes 0..k-1 with a Spark expression for their probabilities."""

    model: object
    classes: list
    probabilities: Callable[[DataFrame], DataFrame]

    def score(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """Add ``probability`` (array in class order) and the most likely class."""
        out = self.probabilities(df)
        best = F.array_position("probability", F.array_max("probability"))
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn(prediction, F.element_at(names, best.cast("int")))


def attack_score(classes: Sequence, benign=S.BENIGN) -> Column:
    """1 - P(benign); for classes 0/1 the probability of 1."""
    if benign in classes:
        return 1 - F.element_at("probability", list(classes).index(benign) + 1)
    return F.element_at("probability", list(classes).index(1) + 1)


def index_labels(df: DataFrame, label: str, classes: Sequence) -> DataFrame:
    """``_y``: place of the label in the class list."""
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn("_y", (F.array_position(names, F.col(label)) - 1).cast("double"))


def _native(model):
    return lambda df: model.transform(df).withColumn("probability", vector_to_array("probability")).drop("rawPrediction", "prediction")


def _fit(estimator, df, label, classes, weight=None) -> Head:
    if weight:
        estimator = estimator.setWeightCol(weight)
    model = estimator.setLabelCol("_y").setFeaturesCol("features").fit(index_labels(df, label, classes))
    return Head(model, list(classes), _native(model))


def fit_logistic(df, label, classes, weight=None, **options) -> Head:
    return _fit(LogisticRegression(family="multinomial", **options), df, label, classes, weight)


def fit_forest(df, label, classes, weight=None, trees: int = 300, seed: int = S.SEED, **options) -> Head:
    forest = RandomForestClassifier(
        numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=seed, **{"maxDepth": 15, **options}
    )
    return _fit(forest, df, label, classes, weight)


def fit_tree(df, label, classes, weight=None, depth: int = 8, leaf: int = 50, seed: int = S.SEED) -> Head:
    return _fit(DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, seed=seed), df, label, classes, weight)


def fit_perceptron(df, label, classes, hidden: Sequence[int] = (64, 32), seed: int = S.SEED, **options) -> Head:
    width = len(df.select("features").first()["features"])
    return _fit(MultilayerPerceptronClassifier(layers=[width, *hidden, len(classes)], seed=seed, **options), df, label, classes)


def fit_network(
    df, label, classes, key=None, held=None, hidden: Sequence[int] = (64, 32), l2: float = 1e-3, epochs: int = 200,
    batch: int = 200, patience: int = 10, seed: int = S.SEED, **options,
) -> Head:
    """Cross-entropy network on standardised features with L2 on its weights.

    Means and deviations are those of the rows it learns from; the fitted network takes raw vectors.

    Rows with true ``held`` stop the epochs by their accuracy and the best epoch is kept; without
    ``held`` all ``epochs`` are run. Rows of a label that is not in ``classes`` take no part.
    """
    indexed = index_labels(df, label, classes).where("features IS NOT NULL")
    learnt = indexed.where(~F.coalesce(F.col(held), F.lit(False))) if held else indexed
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="_scaled").fit(learnt)
    mean, spread = scaler.mean.toArray(), scaler.std.toArray()
    network = train_network(
        scaler.transform(indexed), [len(mean), *hidden, len(classes)], key, "_scaled", "_y", held, epochs, batch, l2=l2,
        patience=patience if held else None, seed=seed, **options,
    ).on_raw(mean, spread)

    def probabilities(frame: DataFrame) -> DataFrame:
        shares = network.column(frame, "features", lambda x, layers: softmax(layers[-1]), "array<double>")
        return frame.withColumn("probability", shares)

    return Head(network, list(classes), probabilities)


def fit_boosted(
    df, label, classes, weight=None, rounds: int = 100, depth: int = 3, rate: float = 0.1, subsample: float = 1.0,
    columns: str = "all", leaf: int = 1, validation: str | None = None, seed: int = S.SEED,
) -> Head:
    """Gradient boosted trees; several classes as one-vs-rest with a softmax of the margins.

    ``validation`` names a boolean column whose rows stop the rounds early, for each class.
    """
    booster = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns,
        minInstancesPerNode=leaf, seed=seed,
    )
    if len(classes) == 2:
        if validation:
            booster = booster.setValidationIndicatorCol(validation)
        return _fit(booster, df, label, classes, weight)
    if validation:
        return _boosted_with_stop(booster, index_labels(df, label, classes), classes, weight, validation)
    many = OneVsRest(classifier=booster, labelCol="_y", featuresCol="features", parallelism=4)
    if weight:
        many = many.setWeightCol(weight)
    model = many.fit(index_labels(df, label, classes))

    def probabilities(frame: DataFrame) -> DataFrame:
        shares = trees.softmax(vector_to_array("rawPrediction"))
        return model.transform(frame).withColumn("probability", shares).drop("rawPrediction", "prediction")

    return Head(model, list(classes), probabilities)


def _boosted_with_stop(booster: GBTClassifier, indexed: DataFrame, classes, weight, validation) -> Head:
    """One booster per class, each with its own early stop, and a softmax of their margins."""
    models = []
    for i in range(len(classes)):
        own = booster.copy().setLabelCol("_own").setFeaturesCol("features").setValidationIndicatorCol(validation)
        own = own.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_share{i}").setPredictionCol(f"_class{i}")
        if weight:
            own = own.setWeightCol(weight)
        models.append(own.fit(indexed.withColumn("_own", (F.col("_y") == i).cast("double"))))

    def probabilities(frame: DataFrame) -> DataFrame:
        for model in models:
            frame = model.transform(frame)
        margins = F.array(*[vector_to_array(f"_raw{i}")[1] for i in range(len(models))])
        used = [f"_{part}{i}" for i in range(len(models)) for part in ("raw", "share", "class")]
        return frame.withColumn("probability", trees.softmax(margins)).drop(*used)

    return Head(models, list(classes), probabilities)


def forest_of(head: Head) -> trees.Forest:
    """All trees of a boosted head as flat arrays: one group for two classes, else one per class."""
    models = head.model if isinstance(head.model, list) else [head.model]
    return trees.joined([trees.from_description(m.toDebugString, m.treeWeights) for m in models])


def boosted_shares(margins: Column, classes: Sequence) -> Column:
    """Probabilities of a boosted head (``fit_boosted``) from its margins, in class order."""
    if len(classes) == 2:
        one = 1 / (1 + F.exp(-2 * margins[0]))
        return F.array(1 - one, one)
    return trees.softmax(margins)


def fit_adaboost(df, label, classes, rounds: int = 100, seed: int = S.SEED) -> Head:
    """Boosted depth-1 trees: weights of misclassified rows grow by exp(alpha) each round.

    Row weights live in a column of a stage table; lineage is cut by a reliable checkpoint
    every ten rounds.
    """
    k = len(classes)
    current = materialise(index_labels(df, label, classes).select("_y", "features").withColumn("_w", F.lit(1.0)))
    stumps = []
    for round_ in range(rounds):
        stump = DecisionTreeClassifier(maxDepth=1, labelCol="_y", featuresCol="features", weightCol="_w", seed=seed + round_).fit(current)
        voted = stump.transform(current).withColumn("_miss", (F.col("prediction") != F.col("_y")).cast("double"))
        wrong, total = voted.agg(F.sum(F.col("_w") * F.col("_miss")), F.sum("_w")).first()
        error = wrong / total
        if error >= 1 - 1 / k:
            break
        alpha = math.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(k - 1)
        stumps.append((stump, alpha))
        if error <= 1e-10:
            break
        # Scaling by the new total keeps the weights at mean 1 without another pass.
        grown = total + wrong * (math.exp(alpha) - 1)
        factor = F.exp(F.lit(alpha) * F.col("_miss")) * F.lit(total / grown)
        current = voted.select("_y", "features", (F.col("_w") * factor).alias("_w"))
        if round_ % 10 == 9:
            current = materialise(current)
    if not stumps:
        raise ValueError("the first stump is no better than chance")

    def probabilities(frame: DataFrame) -> DataFrame:
        votes = [F.lit(0.0)] * k
        for i, (stump, alpha) in enumerate(stumps):
            frame = stump.transform(frame).withColumnRenamed("prediction", f"_p{i}").drop("rawPrediction", "probability")
            votes = [v + F.when(F.col(f"_p{i}") == c, alpha).otherwise(0.0) for c, v in enumerate(votes)]
        whole = sum(a for _, a in stumps)
        shares = F.array(*[v / F.lit(whole) for v in votes])
        return frame.withColumn("probability", shares).drop(*[f"_p{i}" for i in range(len(stumps))])

    return Head(stumps, list(classes), probabilities)


def fit_dummy(df, label, classes, strategy: str = "most_frequent", key: str | None = None, seed: int = S.SEED) -> Head:
    """Baselines: always the most frequent class, or a draw from the class shares by row hash."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    shares = [counts.get(c, 0) / sum(counts.values()) for c in classes]
    if strategy == "most_frequent":
        top = shares.index(max(shares))
        fixed = F.array(*[F.lit(1.0 if i == top else 0.0) for i in range(len(classes))])
        return Head(None, list(classes), lambda frame: frame.withColumn("probability", fixed))
    unit = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / 2.0**32
    low, parts = 0.0, []
    for share in shares:
        parts.append(((unit >= low) & (unit < low + share)).cast("double"))
        low += share
    return Head(None, list(classes), lambda frame: frame.withColumn("probability", F.array(*parts)))


def with_class_weight(df: DataFrame, label: str, scheme: str = "balanced", out: str = "weight") -> DataFrame:
    table = M.class_weights(df, label, scheme).select(label, F.col("weight").alias(out))
    return join_groups(df, bounded(table), [label])


def evaluate(scored: DataFrame, label: str, classes: Sequence, prediction: str = "prediction") -> DataFrame:
    """One row: multiclass averages, log-loss, and PR/ROC of attack against benign."""
    names = F.array(*[F.lit(c) for c in classes])
    p_true = F.element_at("probability", F.array_position(names, F.col(label)).cast("int"))
    frame = scored.select(
        F.col(label).alias("label"), F.col(prediction).alias("prediction"), p_true.alias("_p"),
        attack_score(classes).alias("_s"), (F.col(label) != (S.BENIGN if S.BENIGN in classes else 0)).cast("int").alias("_y"),
    ).persist()
    averages = M.multiclass_summary(M.per_class(frame, "label", "prediction", classes))
    loss = M.log_loss(frame, F.col("_p"))
    table = M.score_table(frame, "_s", "_y")
    ranking = M.ranking_metrics(table).toDF("binary_roc_auc", "binary_pr_auc")
    point = M.best_operating_point(table)
    values = {}
    for part in (averages, loss, ranking, point):
        values |= part.first().asDict()
    frame.unpersist()
    return scored.sparkSession.createDataFrame(
        [tuple(None if v is None else float(v) for v in values.values())], ", ".join(f"{k} double" for k in values)
    )


# Axes of the random parameter search. The published search has two penalty axes
# more (L2 1, 5, 10 and L1 0, 0.1, 1), which MLlib's boosting lacks.
SEARCH_GRID = {
    "depth": [3, 5, 7],
    "rate": [0.03, 0.05, 0.1],
    "leaf": [1, 5, 10],
    "subsample": [0.7, 0.9, 1.0],
    "columns": ["0.7", "0.9", "all"],
}


def random_search(train, validation, label, classes, draws: int, rounds: int, grid: Mapping[str, Sequence] = SEARCH_GRID, seed: int = S.SEED, weight=None):
    """Try seeded parameter draws; refit the best by (macro F1, lower log-loss). Returns (head, parameters, table).

    The refit uses ``validation`` for its early stop, as the published search does.
    """
    rng = random.Random(seed)
    best, rows = None, []
    for i in range(draws):
        params = {axis: rng.choice(list(values)) for axis, values in grid.items()}
        head = fit_boosted(train, label, classes, weight, rounds=rounds, seed=seed, **params)
        m = evaluate(head.score(validation), label, classes).first()
        rank = (m["macro_f1"], -m["log_loss"])
        rows.append((i, str(sorted(params.items())), m["macro_f1"], m["log_loss"], m["binary_pr_auc"]))
        if best is None or rank > best[0]:
            best = (rank, params)
    table = train.sparkSession.createDataFrame(rows, "draw int, parameters string, macro_f1 double, log_loss double, binary_pr_auc double")
    both = train.withColumn("_stop", F.lit(False)).unionByName(validation.select(*train.columns).withColumn("_stop", F.lit(True)))
    final = fit_boosted(both, label, classes, weight, rounds=rounds, seed=seed, validation="_stop", **best[1])
    return final, best[1], table


def compare_weighting(train, validation, label, classes, fit: Callable, schemes=("none", "balanced", "dampened")) -> DataFrame:
    """The same head under each class weighting, best first by (PR-AUC, best F1)."""
    rows = []
    for scheme in schemes:
        head = fit(with_class_weight(train, label, scheme), label, classes, "weight")
        m = evaluate(head.score(validation), label, classes).first()
        rows.append((scheme, m["macro_f1"], m["binary_pr_auc"], m["best_f1"], m["precision_at_recall"]))
    table = train.sparkSession.createDataFrame(
        rows, "scheme string, macro_f1 double, binary_pr_auc double, best_f1 double, precision_at_recall double"
    )
    order = Window.orderBy(F.col("binary_pr_auc").desc(), F.col("best_f1").desc(), "scheme")  # one row per scheme
    return table.withColumn("place", F.row_number().over(order))


def importances(head: Head, features: Sequence[str], spark, k: int = 15) -> DataFrame:
    """Top tree importances, or mean absolute coefficients over classes."""
    model = head.model
    if hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = model.featureImportances.toArray()
    ranked = sorted(zip(features, map(float, values)), key=lambda p: (-p[1], p[0]))[:k]
    return spark.createDataFrame(ranked, "feature string, importance double")


def temporal_robustness(df: DataFrame, label: str, classes, fit: Callable, fold: str = "temporal_fold", folds: int = S.TEMPORAL_FOLDS) -> DataFrame:
    """Train on folds before k, test on k; metrics per fold and pooled."""
    scored, rows = None, []
    for k in range(1, folds):
        head = fit(df.where(F.col(fold) < k), label, classes)
        part = head.score(df.where(F.col(fold) == k)).select(label, "prediction", "probability")
        scored = part if scored is None else scored.unionByName(part)
        rows.append((str(k), evaluate(part, label, classes).first()))
    rows.append(("pooled", evaluate(scored, label, classes).first()))
    names = rows[0][1].asDict().keys()
    return df.sparkSession.createDataFrame(
        [(name, *[m[n] for n in names]) for name, m in rows], "fold string, " + ", ".join(f"{n} double" for n in names)
    )


def repeated_runs(run: Callable[[int], DataFrame], seeds: Sequence[int], model: str) -> DataFrame:
    """One (model, seed, metric, value) row per metric of each seeded run."""
    parts = None
    for seed in seeds:
        row = run(seed)
        long = row.unpivot([], row.columns, "metric", "value").select(F.lit(model).alias("model"), F.lit(seed).alias("seed"), "metric", "value")
        parts = long if parts is None else parts.unionByName(long)
    return parts
