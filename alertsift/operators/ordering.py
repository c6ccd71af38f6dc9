"""Exact ordered numbering and running totals without a single-task window.

A window over one hot group (or over no group at all) sorts everything in one task. Here
rows are range-partitioned by (group, order), numbered or summed inside each range, and
shifted by the totals of the ranges before it. A hot group simply spans more ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, join_groups, materialise

_RANGE = "_range"


def _range_offsets(local: DataFrame, group: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive prefix and overall total per group of each ``sums`` column, per range.

    The input has one row per (group, range): at most groups + ranges rows.
    """
    parts = local.groupBy(*group, _RANGE).agg(*[F.sum(c).alias(f"_part_{s}") for s, c in sums.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return bounded(
        parts.select(
            *group,
            _RANGE,
            *[F.coalesce(F.sum(f"_part_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sums],
            *[F.sum(f"_part_{s}").over(whole).alias(f"_total_{s}") for s in sums],
        )
    )


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """One row per distinct (group, value) with inclusive running sums in value order.

    Output: group, value, each sum, ``cum_<sum>`` and ``total_<sum>``. Equal values are
    merged first (with map-side combine), so ties never straddle two ranges.
    """
    group = list(group)
    table = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*[F.sum(s).alias(s) for s in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranged = table.repartitionByRange(*group, order).withColumn(_RANGE, F.spark_partition_id())
    inside = Window.partitionBy(_RANGE, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = materialise(ranged.select("*", *[F.sum(s).over(inside).alias(f"cum_{s}") for s in sums]))
    offsets = _range_offsets(local, group, {s: s for s in sums})
    return join_groups(local, offsets, [*group, _RANGE]).select(
        *group,
        value,
        *sums,
        *[(F.col(f"cum_{s}") + F.col(f"_before_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"_total_{s}").alias(f"total_{s}") for s in sums],
    )


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    number: str = "row_number",
    size: str | None = None,
) -> DataFrame:
    """Add the 1-based position of every row in its group, and optionally the group size.

    ``order`` must identify a row within its group, or equal rows are numbered arbitrarily.
    """
    group = list(group)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    groups = [F.col(f"`{g}`") for g in group]
    ranged = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    # The id counts the rows of a partition in their sorted order: no second shuffle is needed.
    marked = ranged.withColumn("_id", F.monotonically_increasing_id())
    local = materialise(
        marked.withColumns({_RANGE: F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
    )
    parts = local.groupBy(*groups, _RANGE).agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups)
    before = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded(
        parts.select(
            *groups,
            _RANGE,
            (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start") + 1).alias("_shift"),
            F.sum("_rows").over(whole).alias("_total"),
        )
    )
    out = join_groups(local, offsets, [*group, _RANGE]).withColumn(number, F.col("_at") + F.col("_shift"))
    if size:
        out = out.withColumn(size, F.col("_total"))
    return out.drop(_RANGE, "_at", "_shift", "_total")
