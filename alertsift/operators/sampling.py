"""Reproducible samples drawn by hash order, without sorting a class in one task.

``hash_cuts`` finds, per class, the hash value below which exactly the wanted number of
rows lies: a histogram of hash prefixes (map-side combined) picks one prefix, and only the
rows under that prefix are ranked. Every sampler and splitter then is a comparison with a
small table of cut values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.keys import hash_order
from ..session import bounded, join_groups

_HASH = "_hash"
_ALL = "_all"  # the single stratum of an unstratified draw


def hash_cuts(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    ranks: Mapping[str, Column],
    seed: int = S.SEED,
    prefix: int = 4,
    quotas: DataFrame | None = None,
) -> DataFrame:
    """One row per stratum with its size ``n`` and one cut value per entry of ``ranks``.

    A rank expression may use ``n`` and the columns of ``quotas`` (one row per stratum).
    Rows with hash <= cut are the first ``rank`` ones; a rank <= 0 gives an empty cut.
    Rows of equal ``key`` fall on one side of every cut; ``excess`` is the number of rows a
    cut takes beyond its rank for that reason (0 when the key identifies a row).
    """
    keep = list(strata)
    strata = keep or [_ALL]
    hashed = df.withColumn(_ALL, F.lit(0)).select(*strata, hash_order(F.col(key), seed).alias(_HASH))
    whole, upto = Window.partitionBy(*strata), Window.partitionBy(*strata).orderBy("_prefix")
    histogram = (
        hashed.groupBy(*strata, F.substring(_HASH, 1, prefix).alias("_prefix"))
        .agg(F.count("*").alias("_count"))
        .withColumn("_upto", F.sum("_count").over(upto))
        .withColumn("n", F.sum("_count").over(whole))
    )
    if quotas is not None:
        histogram = join_groups(histogram, bounded(quotas), strata)
    wanted = F.array(
        *[F.struct(F.lit(name).alias("cut"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]
    )
    edges = (
        histogram.select("*", F.explode(wanted).alias("_w"))
        .select(*strata, "n", "_prefix", "_upto", "_count", "_w.*")
        .withColumn("rank", F.least("rank", "n"))
        .where((F.col("_upto") - F.col("_count") < F.col("rank")) & (F.col("rank") <= F.col("_upto")))
        .withColumn("_need", F.col("rank") - (F.col("_upto") - F.col("_count")))
        .select(*strata, "_prefix", "cut", "_need")
    )
    # Copies of one key share a hash: count per hash first, so they reach the window as one row.
    groups = (
        join_groups(hashed.withColumn("_prefix", F.substring(_HASH, 1, prefix)), bounded(edges), [*strata, "_prefix"])
        .groupBy(*strata, "cut", "_need", _HASH)
        .agg(F.count("*").alias("_rows"))
    )
    within = F.sum("_rows").over(Window.partitionBy(*strata, "cut").orderBy(_HASH))
    ranked = groups.withColumn("_within", within).where(
        (F.col("_within") - F.col("_rows") < F.col("_need")) & (F.col("_need") <= F.col("_within"))
    )
    found = ranked.groupBy(*strata).agg(
        *[F.max(F.when(F.col("cut") == name, F.col(_HASH))).alias(name) for name in ranks],
        F.max(F.col("_within") - F.col("_need")).alias("excess"),
    )
    sizes = histogram.groupBy(*strata).agg(F.max("n").alias("n"))
    return join_groups(sizes, found, strata, "left").select(
        *keep, "n", F.coalesce("excess", F.lit(0)).alias("excess"), *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in ranks]
    )


def with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str], key: str, seed: int = S.SEED) -> DataFrame:
    """Attach the row hash (``_hash``) and the cut values of the row's stratum."""
    hashed = df.withColumn(_HASH, hash_order(F.col(key), seed))
    cuts = cuts.drop("n", "excess")
    if strata:
        return join_groups(hashed, bounded(cuts), list(strata))
    values = cuts.first()  # one row when there are no strata
    return hashed.withColumns({c: F.lit(values[c] if values else "") for c in cuts.columns})


def _first_by_hash(df, strata, key, rank, seed, quotas=None):
    cuts = bounded(hash_cuts(df, strata, key, {"_cut": rank}, seed, quotas=quotas))
    if not cuts.where("excess > 0").isEmpty():
        raise ValueError(f"{key} does not identify a row, so no exact number can be drawn")
    return with_cuts(df, cuts, strata, key, seed).where(F.col(_HASH) <= F.col("_cut")).drop(_HASH, "_cut")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = S.SEED) -> DataFrame:
    """Exactly ``n`` rows, or an error when fewer exist."""
    available = df.count()
    if available < n:
        raise ValueError(f"need {n} rows, found {available}")
    return _first_by_hash(df, [], key, F.lit(n), seed)


def sample_upto(df: DataFrame, n: int, strata: Sequence[str], key: str, seed: int = S.SEED) -> DataFrame:
    """Up to ``n`` rows per stratum; all of a stratum that has fewer."""
    return _first_by_hash(df, strata, key, F.lit(n), seed)


def shortfall(df: DataFrame, n: int, strata: Sequence[str]) -> DataFrame:
    """Strata with fewer than ``n`` rows: the report that goes with ``sample_upto``."""
    return (
        df.groupBy(*strata)
        .agg(F.count("*").alias("available"))
        .where(F.col("available") < n)
        .withColumn("missing", F.lit(n) - F.col("available"))
    )


def balanced_quota(label: str = "label", total: int | None = None, seed: int = S.SEED, classes: int = 5) -> int:
    """Rows per class: a total drawn in the fixed range, divided by the class count."""
    if total is None:
        span = S.ATTACK_SAMPLE_MAX - S.ATTACK_SAMPLE_MIN + 1
        total = S.ATTACK_SAMPLE_MIN + (seed * 2_654_435_761) % span
    return total // classes


def sample_balanced(
    df: DataFrame,
    key: str,
    label: str = "label",
    total: int | None = None,
    seed: int = S.SEED,
    classes: int = 5,
    strict: bool = False,
) -> DataFrame:
    """The same quota from each class; needs exactly ``classes`` classes and no null label.

    ``strict`` also fails when a class has fewer rows than its quota.
    """
    sizes = df.groupBy(label).count().limit(classes + 2).collect()
    if any(r[label] is None for r in sizes):
        raise ValueError("null labels")
    if len(sizes) != classes:
        raise ValueError(f"expected {classes} classes, found {len(sizes)}")
    quota = balanced_quota(label, total, seed, classes)
    if strict and min(r["count"] for r in sizes) < quota:
        raise ValueError(f"a class has fewer than {quota} rows")
    return sample_upto(df, quota, [label], key, seed)


def split_budget(df: DataFrame, total: int, label: str = "label") -> DataFrame:
    """Quota per class: an even share of ``total``, the remainder to the first classes."""
    classes = df.select(label).distinct()
    place = F.row_number().over(Window.orderBy(label))  # one row per class
    k = F.count("*").over(Window.partitionBy())
    return classes.select(
        label,
        (F.floor(F.lit(total) / k) + (place <= F.lit(total) % k).cast("int")).cast("long").alias("quota"),
    )


def sample_budget(df: DataFrame, total: int, key: str, label: str = "label", seed: int = S.SEED) -> DataFrame:
    return _first_by_hash(df, [label], key, F.col("quota"), seed, split_budget(df, total, label))


def shuffle_rows(df: DataFrame, key: str, seed: int = S.SEED) -> DataFrame:
    """Add ``position``, the place of each row in hash order."""
    from .ordering import number_rows

    return number_rows(
        df.withColumn(_HASH, hash_order(F.col(key), seed)), [], [_HASH], "position"
    ).drop(_HASH)


def resample_replacements(
    removed: DataFrame,
    pool: DataFrame,
    used: DataFrame,
    key: str,
    label: str = "label",
    split: str = "split",
    seed: int = S.SEED,
    splits: Sequence[str] = ("train", "val", "test"),
) -> DataFrame:
    """Refill removed rows per (label, split) from ``pool`` rows whose key is not in ``used``.

    The splits take consecutive stretches of one hash order, so a pool row serves one split
    only; a class whose pool runs out stays short.
    """
    quota = removed.groupBy(label).agg(
        *[F.count_if(F.col(split) == s).alias(f"_q_{s}") for s in splits]
    )
    free = pool.join(used.select(key).distinct(), key, "left_anti").join(bounded(quota), label, "left_semi")
    ranks, upto = {}, F.lit(0)
    for s in splits:
        upto = upto + F.col(f"_q_{s}")
        ranks[f"_cut_{s}"] = upto
    cuts = hash_cuts(free, [label], key, ranks, seed, quotas=quota)
    choice = F.when(F.lit(False), "")
    for s in splits:
        choice = choice.when(F.col(_HASH) <= F.col(f"_cut_{s}"), s)
    return (
        with_cuts(free, cuts, [label], key, seed)
        .withColumn(split, choice)
        .where(F.col(split).isNotNull())
        .drop(_HASH, *ranks)
    )
