"""Data profiling: each report is one wide aggregate turned into rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .cleaning import numeric_columns
from .quantiles import exact_quantiles


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _per_column(df: DataFrame, columns: Sequence[str], stats: Mapping[str, callable]) -> DataFrame:
    """Rows (column, stat...) from one aggregate over all columns."""
    wide = df.agg(
        *[fn(c).alias(f"{s}{i}") for i, c in enumerate(columns) for s, fn in stats.items()], F.count("*").alias("_rows")
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in stats])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select("_rows", F.inline(entries))


def infinity_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite values per column, most first."""
    names = columns or numeric_columns(df)
    counts = _per_column(df, names, {"n": lambda c: F.count_if(F.abs(_q(c)) == float("inf"))})
    return counts.where("n > 0").select("column", "n").orderBy(F.col("n").desc(), "column")


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by more than ``multiplier`` interquartile ranges."""
    names = list(columns or numeric_columns(df))
    q = exact_quantiles(df, names, [0.25, 0.75])

    def outside(c):
        if q[c][0] is None:
            return F.lit(0).cast("long")
        low, high = q[c]
        reach = multiplier * (high - low)
        return F.count_if((_q(c) < F.lit(low - reach)) | (_q(c) > F.lit(high + reach)))

    counts = _per_column(df, names, {"outliers": outside}).where("outliers > 0")
    return counts.select("column", "outliers", (100.0 * F.col("outliers") / F.col("_rows")).alias("percent")).orderBy(
        F.col("percent").desc(), "column"
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or df.columns)
    counts = _per_column(df, names, {"n": lambda c: F.count_if(_q(c).isNull())}).where("n > 0")
    return counts.select("column", (100.0 * F.col("n") / F.col("_rows")).alias("percent")).orderBy(
        F.col("percent").desc(), "column"
    )


def class_counts(df: DataFrame, label: str = "label", benign: str = S.BENIGN) -> DataFrame:
    """Rows and percent per class, and per benign/attack group."""
    kinds = F.array(
        F.struct(F.lit("class").alias("level"), _q(label).alias("value")),
        F.struct(F.lit("group").alias("level"), F.when(_q(label) == benign, "benign").otherwise("attack").alias("value")),
    )
    counts = df.groupBy(_q(label)).agg(F.count("*").alias("n")).select("n", F.inline(kinds))
    counts = counts.groupBy("level", "value").agg(F.sum("n").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("level")))


def pca_projection(df: DataFrame, vector: str, k: int = 2) -> tuple[DataFrame, list[float]]:
    """Centred principal components ``pc1..pck`` and the variance share of each."""
    mean = df.select(Summarizer.mean(F.col(vector)).alias("m")).first()["m"]
    model = PCA(k=k, inputCol=vector, outputCol="_pc").fit(df)
    shift = [float(v) for v in model.pc.toArray().T @ mean.toArray()]
    parts = vector_to_array(F.col("_pc"))
    out = model.transform(df).withColumns({f"pc{i + 1}": parts[i] - F.lit(shift[i]) for i in range(k)})
    return out.drop("_pc"), [float(v) for v in model.explainedVariance]


def centroid_distance(df: DataFrame, columns: Sequence[str], benign: Column, out: str = "distance") -> DataFrame:
    """Euclidean distance of every row to the mean of the benign rows."""
    centre = df.where(benign).agg(*[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    total = F.lit(0.0)
    for i, c in enumerate(columns):
        total = total + F.pow(_q(c) - F.lit(centre[i]), F.lit(2.0))
    return df.withColumn(out, F.sqrt(total))


def centroid_summary(df: DataFrame, benign: Column, distance: str = "distance") -> DataFrame:
    """Benign median and 95th percentile, attack median and 5th percentile of the distance."""
    split = {"benign": F.when(benign, F.col(distance)), "attack": F.when(~benign, F.col(distance))}
    q = exact_quantiles(df, split, [0.05, 0.5, 0.95])
    return df.sparkSession.createDataFrame(
        [(q["benign"][1], q["benign"][2], q["attack"][1], q["attack"][0])],
        "benign_median double, benign_p95 double, attack_median double, attack_p5 double",
    )


def top_variance(df: DataFrame, columns: Sequence[str], k: int = 25) -> list[str]:
    row = df.agg(*[F.var_samp(_q(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    ranked = sorted(range(len(columns)), key=lambda i: (-(row[i] if row[i] is not None else -1.0), i))
    return [columns[i] for i in ranked[:k]]


def correlations(df: DataFrame, columns: Sequence[str], k: int = 25) -> DataFrame:
    """Pairwise correlation of the ``k`` columns of highest variance, in one aggregate."""
    top = top_variance(df, columns, k)
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    wide = df.agg(*[F.corr(_q(a), _q(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    )
    return wide.select(F.inline(entries))


def mean_differences(df: DataFrame, columns: Sequence[str], benign: Column, k: int = 15) -> DataFrame:
    """The ``k`` columns with the largest |mean of attacks - mean of benign|."""
    difference = lambda c: F.abs(F.avg(F.when(~benign, _q(c))) - F.avg(F.when(benign, _q(c))))
    table = _per_column(df, list(columns), {"difference": difference})
    return table.select("column", "difference").orderBy(F.col("difference").desc(), "column").limit(k)


def crosstab(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Counts of ``col`` values per ``row`` value, and each as share of its row."""
    counts = df.groupBy(_q(row)).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0, [str(v) for v in values])
    total = sum((_q(str(v)) for v in values[1:]), _q(str(values[0])))
    return counts.withColumns({f"{v}_share": _q(str(v)) / F.nullif(total, F.lit(0)) for v in values})


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 80) -> DataFrame:
    """Equal-width bins over the whole range with count and density per group."""
    low, high = (v or 0.0 for v in df.agg(F.min(value), F.max(value)).first())  # without values there are no bins
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((_q(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(_q(value).isNotNull()).groupBy(*by, slot.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumns({"bin_start": F.lit(low) + F.col("bin") * F.lit(width), "density": F.col("n") / (total * width)})


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 60) -> DataFrame:
    """Counts per cell of an equal-width grid."""
    r = [v or 0.0 for v in df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()]
    cell = lambda c, low, high: F.least(
        F.floor((_q(c) - F.lit(low)) / F.lit((high - low) / bins or 1.0)), F.lit(bins - 1)
    ).cast("int")
    return df.groupBy(cell(x, r[0], r[1]).alias("bin_x"), cell(y, r[2], r[3]).alias("bin_y")).agg(F.count("*").alias("n"))
