"""Unsupervised packet detectors, fitted on benign rows; a higher score is more anomalous."""

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import hash_order
from ..session import bounded
from .networks import Network, row_losses, train_network
from .sampling import sample_upto

_EULER = 0.5772156649015329


def _path_norm(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class IsolationForestModel:
    """Trees as flat arrays: feature (-1 in a leaf), cut, children, and depth incl. leaf size."""

    trees: list[dict]
    sample_size: int

    def score(self, df: DataFrame, vector: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Add 2^(-mean depth / norm) - 0.5, evaluated per Arrow batch with broadcast trees."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = _path_norm(self.sample_size) or 1.0

        def depths(batch: pd.Series) -> pd.Series:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            total = np.zeros(len(x))
            for tree in shared.value:
                feature, cut = np.asarray(tree["feature"]), np.asarray(tree["cut"])
                left, right, depth = (np.asarray(tree[k]) for k in ("left", "right", "depth"))
                node = np.zeros(len(x), dtype=int)
                open_rows = np.flatnonzero(feature[node] >= 0)
                while len(open_rows):
                    at = node[open_rows]
                    goes_left = x[open_rows, feature[at]] < cut[at]
                    node[open_rows] = np.where(goes_left, left[at], right[at])
                    open_rows = open_rows[feature[node[open_rows]] >= 0]
                total += depth[node]
            return pd.Series(2.0 ** (-(total / len(shared.value)) / norm) - 0.5)

        return df.withColumn(out, F.pandas_udf(depths, "double")(vector_to_array(F.col(vector))))


def fit_isolation_forest(
    benign: DataFrame, key: str, vector: str = "features", trees: int = 200, sample: int = 256, seed: int = S.SEED
) -> IsolationForestModel:
    """Grow each tree in its own group on ``sample`` rows.

    Only a hash-drawn pool of at most ``trees * sample`` rows is grouped; with fewer benign
    rows the trees take overlapping stretches of the pool.
    """
    limit = trees * sample
    pool = sample_upto(benign.select(key, vector), limit, [], key, seed)
    ranked = pool.withColumn("_place", F.row_number().over(Window.orderBy(hash_order(F.col(key), seed))) - 1)
    size = ranked.count()  # at most trees * sample
    per_tree = min(sample, size)
    # The pool is dealt out in order, over and over, until every tree has its rows.
    turns = F.sequence(F.col("_place"), F.lit(trees * per_tree - 1), F.lit(size))
    dealt = (
        ranked.where(F.col("_place") < trees * per_tree)
        .select(F.explode(turns).alias("_turn"), vector_to_array(F.col(vector)).alias("x"))
        .withColumn("tree", F.floor(F.col("_turn") / per_tree).cast("int"))
    )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(_grow_tree(np.stack(group["x"]), seed + tree))]})

    grown = dealt.groupBy("tree").applyInPandas(grow, "tree int, nodes string").orderBy("tree").collect()
    return IsolationForestModel([json.loads(r["nodes"]) for r in grown], per_tree)


def _grow_tree(x: np.ndarray, seed: int) -> dict:
    """Random cuts until rows are alone, equal, or the depth limit is reached."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes = {"feature": [], "cut": [], "left": [], "right": [], "depth": []}
    waiting = [(np.arange(len(x)), 0, None, None)]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        here = len(nodes["feature"])
        if parent is not None:
            nodes[side][parent] = here
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        choices = np.flatnonzero(high > low)
        leaf = depth >= limit or len(rows) <= 1 or not len(choices)
        feature = -1 if leaf else int(rng.choice(choices))
        cut = 0.0 if leaf else float(rng.uniform(low[feature], high[feature]))
        for name, value in zip(nodes, (feature, cut, -1, -1, depth + _path_norm(len(rows)) if leaf else 0.0)):
            nodes[name].append(value)
        if not leaf:
            mask = x[rows, feature] < cut
            waiting += [(rows[mask], depth + 1, here, "left"), (rows[~mask], depth + 1, here, "right")]
    return nodes


@dataclass(frozen=True)
class SubspaceModel:
    """Principal subspace of benign rows: reconstruction from k components around the mean."""

    mean: np.ndarray
    components: np.ndarray  # (features, k)

    def _centred(self, vector: str):
        return F.zip_with(vector_to_array(F.col(vector)), F.array(*[F.lit(float(m)) for m in self.mean]), lambda a, b: a - b)

    def embed(self, df: DataFrame, vector: str = "features", out: str = "latent") -> DataFrame:
        """Coordinates in the subspace, as an array."""
        dot = lambda c: F.aggregate(
            F.zip_with("_x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
        )
        return df.withColumn("_x", self._centred(vector)).withColumn(out, F.array(*[dot(c) for c in self.components.T])).drop("_x")

    def score(self, df: DataFrame, vector: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Mean squared reconstruction error: squared length not explained, per feature."""
        squares = lambda name: F.aggregate(name, F.lit(0.0), lambda s, v: s + v * v)
        placed = self.embed(df, vector, "_z").withColumn("_x", self._centred(vector))
        error = F.greatest(squares("_x") - squares("_z"), F.lit(0.0)) / F.lit(float(len(self.mean)))
        return placed.withColumn(out, error).drop("_x", "_z")


def fit_subspace(benign: DataFrame, rank: int, vector: str = "features") -> SubspaceModel:
    mean = benign.select(Summarizer.mean(F.col(vector)).alias("m")).first()["m"].toArray()
    model: PCAModel = PCA(k=rank, inputCol=vector, outputCol="_pc").fit(benign)
    return SubspaceModel(mean, model.pc.toArray())


def search_rank(fit: DataFrame, validation: DataFrame, ranks: Sequence[int], vector: str = "features") -> tuple[SubspaceModel, DataFrame]:
    """The rank with the lowest benign validation error (first wins), and the error of each.

    Components are nested, so one decomposition at the highest rank serves every rank.
    """
    widest = fit_subspace(fit, max(ranks), vector)
    models = {k: SubspaceModel(widest.mean, widest.components[:, :k]) for k in ranks}
    scored = validation
    for k, m in models.items():
        scored = m.score(scored, vector, f"_e{k}")
    errors = scored.agg(*[F.avg(f"_e{k}").alias(str(k)) for k in ranks]).first()
    best = min(ranks, key=lambda k: (errors[str(k)], list(ranks).index(k)))
    table = validation.sparkSession.createDataFrame(
        [(k, errors[str(k)], int(k == best)) for k in ranks], "rank int, validation_mse double, selected int"
    )
    return models[best], table


def latent_features(df: DataFrame, model: SubspaceModel, vector: str = "features", out: str = "latent_features") -> DataFrame:
    """Subspace coordinates followed by the reconstruction error, as one vector."""
    placed = model.score(model.embed(df, vector, "_latent"), vector, "_error")
    return placed.withColumn(out, array_to_vector(F.concat("_latent", F.array("_error")))).drop("_latent", "_error")


@dataclass(frozen=True)
class ClusterPurityModel:
    pca: PCAModel | None
    kmeans: object
    purity: DataFrame

    def score(self, df: DataFrame, vector: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Attack share of the row's cluster; 0 for a cluster without training rows."""
        source = df if self.pca is None else self.pca.transform(df)
        placed = self.kmeans.transform(source)
        joined = placed.join(bounded(self.purity), "_cluster", "left")
        return joined.withColumn(out, F.coalesce("_purity", F.lit(0.0))).drop("_cluster", "_purity", "_reduced")


def fit_cluster_purity(train: DataFrame, y: str, vector: str = "features", k: int = 300, components: int = 30, seed: int = S.SEED) -> ClusterPurityModel:
    """PCA, k-means without labels, then the attack share of every cluster."""
    pca, column, source = None, vector, train
    if components:
        pca = PCA(k=components, inputCol=vector, outputCol="_reduced").fit(train)
        source, column = pca.transform(train), "_reduced"
    model = KMeans(k=k, seed=seed, featuresCol=column, predictionCol="_cluster").fit(source)
    purity = model.transform(source).groupBy("_cluster").agg(F.avg(F.col(y).cast("double")).alias("_purity"))
    return ClusterPurityModel(pca, model, purity)


@dataclass(frozen=True)
class AutoencoderModel:
    """Network that rebuilds its input through a narrow layer."""

    network: Network
    bottleneck: int

    def score(self, df: DataFrame, vector: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Mean squared reconstruction error per row."""
        error = self.network.column(df, vector, lambda x, layers: row_losses(x, layers[-1]), "double")
        return df.withColumn(out, error)

    def embed(self, df: DataFrame, vector: str = "features", out: str = "latent") -> DataFrame:
        at = self.bottleneck
        return df.withColumn(out, self.network.column(df, vector, lambda x, layers: layers[at], "array<double>"))


def fit_autoencoder(
    fit: DataFrame,
    width: int,
    hidden: Sequence[int] = (64, 32, 16),
    vector: str = "features",
    epochs: int = 20,
    batch: int = 256,
    passes: int = 3,
    rate: float = 2e-3,
    decay: float = 1e-5,
    seed: int = S.SEED,
    key: str | None = None,
    held: str | None = None,
    patience: int | None = None,
    lanes: int = 8,
) -> AutoencoderModel:
    """Autoencoder over benign rows; equal for every partitioning (see ``train_network``).

    ``held`` names a boolean column whose rows only judge the epochs; with ``patience`` they
    stop them and the best epoch is kept. An empty input raises an error.
    """
    sizes = [width, *hidden, *list(reversed(hidden[:-1])), width]
    network = train_network(
        fit, sizes, key, vector, held=held, epochs=epochs, batch=batch, passes=passes, rate=rate, decay=decay,
        patience=patience, lanes=lanes, seed=seed,
    )
    return AutoencoderModel(network, len(hidden))


def search_autoencoder(fit: DataFrame, validation: DataFrame, width: int, grid: Sequence[Sequence[int]], vector: str = "features", **options) -> tuple[AutoencoderModel, DataFrame]:
    """The architecture with the lowest benign validation error, and the error of each."""
    rows, best, best_error = [], None, float("inf")
    for hidden in grid:
        model = fit_autoencoder(fit, width, hidden, vector, **options)
        error = model.score(validation, vector, "_e").agg(F.avg("_e")).first()[0]
        if error < best_error:
            best, best_error = model, error
        rows.append(("-".join(map(str, hidden)), float(error)))
    table = fit.sparkSession.createDataFrame(rows, "architecture string, validation_mse double")
    return best, table.withColumn("selected", (F.col("validation_mse") == best_error).cast("int"))
