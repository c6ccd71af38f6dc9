"""Flow segments to logical flows: gap clustering and rule-driven aggregation.

Clustering without sorting a whole Flow ID in one task: time is cut into buckets as wide as
the gap cut-off, so two segments of one bucket can never be further apart than it. All rules
merge, so segments are first aggregated per (capture, Flow ID, bucket) with map-side
combine, and only those summaries are ordered to find the gaps. A Flow ID that holds a third
of the capture costs one task no more than its number of buckets.

That order shuffles wide summaries twice, which only crowded Flow IDs are worth. Flow building and
clustering count rows per hash cell of the key first: rows of cells without a crowd are shuffled once, by
key, and go through the same steps (or are ordered row by row) without another exchange.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..schema import FlowRules
from ..session import join_groups
from .ordering import number_rows

_BUCKET, _LOW, _HIGH = "_bucket", "_low", "_high"
_CELLS = 65_536  # hash cells of keys whose rows are counted
CROWD = 262_144  # rows of a cell that one task may hold; a cell 16 times the mean may always be split


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less or zoned timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def parse_timestamp(text: Column) -> Column:
    """Capture timestamp text to a timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(text, F.lit(S.TIMESTAMP_FORMAT)).cast("timestamp_ntz")


def split_null_flow_ids(df: DataFrame, flow_id: str = "Flow ID") -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows without a Flow ID)."""
    return df.where(_q(flow_id).isNotNull()), df.where(_q(flow_id).isNull())


def _gap_clusters(buckets: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """Number the clusters of each key over its bucket summaries (first one is 1)."""
    w = Window.partitionBy(*[_q(k) for k in keys]).orderBy(_BUCKET, _LOW)
    ended = F.max(_HIGH).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (ended.isNull() | (F.col(_LOW) - ended > cutoff)).cast("long")
    running = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return buckets.withColumn("_starts", starts).withColumn("_cluster", running).drop("_starts")


def _bucket_of(ts: str, cutoff: float) -> Column:
    return F.floor(_q(ts) / F.lit(cutoff if cutoff > 0 else 1e-6))  # no two rows of a bucket lie further apart than the cut-off


def _cell(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*[_q(k) for k in keys], F.lit("cell")), F.lit(_CELLS))


def _crowded_cells(df: DataFrame, keys: Sequence[str], ts: str) -> tuple[list[int], int]:
    """(hash cells of keys with too many timed rows for one task, rows without a time), in one pass."""
    timed, limit = F.count_if(_q(ts).isNotNull()), F.greatest(F.lit(CROWD), F.sum("_n").over(Window.partitionBy()) * 16 / _CELLS)
    cells = df.groupBy(_cell(keys).alias("_cell")).agg(timed.alias("_n"), F.count_if(_q(ts).isNull()).alias("_untimed"))
    # At most one row per cell, so one task may hold them all.
    found = cells.withColumn("_over", F.col("_n") > limit).agg(
        F.collect_list(F.when(F.col("_over"), F.col("_cell"))).alias("crowded"), F.sum("_untimed").alias("untimed")
    )
    row = found.first()
    return sorted(row["crowded"]), row["untimed"] or 0


def assign_logical_flow(
    df: DataFrame,
    keys: Sequence[str] = ("source_file", "Flow ID"),
    ts: str = "ts",
    cutoff: float = S.GAP_SECONDS,
    tie: str | None = None,
    cluster: str = "cluster",
    by_bucket: bool = False,
) -> DataFrame:
    """Add the cluster number of every segment: a new one on the first segment of a key and
    after any gap above ``cutoff``. ``ts`` is numeric, in the unit of ``cutoff``.

    A segment without a time forms its own cluster, numbered after the timed ones (in the
    order of ``tie``). A null key is a key of its own. ``by_bucket`` takes the way of crowded keys for all.
    """
    keys = list(keys)
    crowded, untimed_rows = _crowded_cells(df, keys, ts)
    timed = df.where(_q(ts).isNotNull())
    if by_bucket:
        out = _clusters_by_bucket(timed, keys, ts, cutoff)
    elif crowded:
        apart = _cell(keys).isin(crowded)
        out = _clusters_by_row(timed.where(~apart), keys, ts, cutoff).unionByName(_clusters_by_bucket(timed.where(apart), keys, ts, cutoff))
    else:
        out = _clusters_by_row(timed, keys, ts, cutoff)
    if untimed_rows:
        out = out.unionByName(_untimed_clusters(df.where(_q(ts).isNull()), out, keys, tie))
    return out.withColumnRenamed("_cluster", cluster)


def _clusters_by_row(timed: DataFrame, keys: list[str], ts: str, cutoff: float) -> DataFrame:
    """Rows with their cluster, the rows of a key ordered in one task: one exchange by key, which later steps by key reuse."""
    w = Window.partitionBy(*[_q(k) for k in keys]).orderBy(_q(ts))
    before = F.lag(_q(ts)).over(w)
    starts = timed.withColumn("_starts", (before.isNull() | (_q(ts) - before > cutoff)).cast("long"))
    running = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return starts.withColumn("_cluster", running).drop("_starts")


def _clusters_by_bucket(timed: DataFrame, keys: list[str], ts: str, cutoff: float) -> DataFrame:
    """The same from summaries per time bucket, so that the rows of a key need not be ordered."""
    timed = timed.withColumn(_BUCKET, _bucket_of(ts, cutoff))
    spans = timed.groupBy(*[_q(k) for k in keys], _BUCKET).agg(F.min(_q(ts)).alias(_LOW), F.max(_q(ts)).alias(_HIGH))
    clusters = _gap_clusters(spans, keys, cutoff)
    return join_groups(timed, clusters.drop(_LOW, _HIGH), [*keys, _BUCKET]).drop(_BUCKET)


def _untimed_clusters(untimed, clusters, keys, tie):
    last = clusters.groupBy(*[_q(k) for k in keys]).agg(F.max("_cluster").alias("_last"))
    order = [_q(tie) if tie else F.xxhash64(*[_q(c) for c in untimed.columns])]
    numbered = number_rows(untimed, keys, order, "_n")
    return join_groups(numbered, last, keys, "left").withColumn(
        "_cluster", F.col("_n") + F.coalesce("_last", F.lit(0))
    ).drop("_n", "_last")


def logical_flow_id(source_file: Column, flow_id: Column, cluster: Column) -> Column:
    return F.concat(source_file, F.lit("|"), flow_id, F.lit("#"), cluster.cast("string"))


class RuleAggregates:
    """The aggregate expressions of a rule set: partial states, their merge, final columns.

    States are numbers, so the first step runs as a hash aggregate. The order of a row in
    time is one decimal, ``microseconds * 10^20 + tie``; ``ts`` is in seconds, ``tie`` a non-negative whole
    number below 10^20 (a long, or a decimal where a long may overflow).
    """

    def __init__(self, rules: FlowRules, ts: str = "ts", tie: str | None = None):
        self.rules, self.ts, self.tie = rules, ts, tie

    def _value(self, name: str) -> Column:
        return F.expr(self.rules.derived[name]) if name in self.rules.derived else _q(name)

    def _order(self) -> Column:
        micros = (F.coalesce(_q(self.ts), F.lit(0)).cast("decimal(18,6)") * F.lit(1_000_000)).cast("decimal(18,0)")
        ts = micros * F.lit("100000000000000000000").cast("decimal(21,0)")
        tie = (_q(self.tie) if self.tie else F.lit(0)).cast("decimal(20,0)")
        return (ts.cast("decimal(38,0)") + tie).cast("decimal(38,0)")

    def _firsts(self, identity: bool) -> dict[str, tuple[Column, Column]]:
        """Column -> (value, order of the rows where it is not null)."""
        cols = [*self.rules.first, *(self.rules.identity if identity else ())]
        return {c: (_q(c), F.when(_q(c).isNotNull(), self._order())) for c in cols}

    def _states(self) -> dict[str, tuple[Column, str]]:
        """Partial state name -> (row expression, merge function)."""
        r, num = self.rules, lambda n: self._value(n).cast("double")
        states: dict[str, tuple[Column, str]] = {
            "_segments": (F.lit(1).cast("long"), "sum"),
            "_ts_first": (_q(self.ts), "min"),
            "_ts_last": (_q(self.ts), "max"),
        }
        for c in r.sums:
            states[f"_sum_{c}"] = (self._value(c), "sum")
        for c in r.maxima:
            states[f"_max_{c}"] = (_q(c), "max")
        for c in r.minima:
            states[f"_min_{c}"] = (_q(c), "min")
        for c, w in r.weighted.items():
            weight = F.when(_q(c).isNotNull(), F.coalesce(num(w), F.lit(0.0))).otherwise(0.0)
            states[f"_wx_{c}"] = (F.coalesce(num(c), F.lit(0.0)) * weight, "sum")
            states[f"_w_{c}"] = (weight, "sum")
        for c, (mean, count) in r.pooled.items():
            n = F.greatest(F.coalesce(num(count), F.lit(0.0)), F.lit(0.0))
            s, m = F.coalesce(num(c), F.lit(0.0)), F.coalesce(num(mean), F.lit(0.0))
            states[f"_pa_{c}"] = (F.greatest(n - 1, F.lit(0.0)) * s * s, "sum")
            states[f"_pb_{c}"] = (n * m * m, "sum")
            states[f"_pc_{c}"] = (n * m, "sum")
            states[f"_pn_{c}"] = (n, "sum")
        for c in {r.duration, *r.rates.values()} if r.rates else ():
            states[f"_total_{c}"] = (num(c), "sum")
        return states

    def partial(self, identity: bool = True) -> list[Column]:
        """First step; without ``identity`` those columns are grouping keys of the step."""
        out = [getattr(F, how)(e).alias(name) for name, (e, how) in self._states().items()]
        for c, (value, order) in self._firsts(identity).items():
            out += [F.min(order).alias(f"_order_{c}"), F.min_by(value, order).alias(f"_first_{c}")]
        if not identity and self.rules.identity:
            out.append(F.min(self._order()).alias("_order"))
        return out

    def merge(self) -> list[Column]:
        """Second step, over rows of ``partial(identity=False)``."""
        out = [getattr(F, how)(_q(name)).alias(name) for name, (_, how) in self._states().items()]
        out += [F.min_by(_q(f"_first_{c}"), _q(f"_order_{c}")).alias(f"_first_{c}") for c in self.rules.first]
        out += [
            F.min_by(_q(c), F.when(_q(c).isNotNull(), F.col("_order"))).alias(f"_first_{c}")
            for c in self.rules.identity
        ]
        return out

    def finish(self) -> list[Column]:
        r = self.rules
        out = [_q(f"_first_{c}").alias(c) for c in (*r.identity, *r.first)]
        out += [_q("_segments").alias("SegmentCount"), _q("_ts_first").alias("ts_first"), _q("_ts_last").alias("ts_last")]
        for kind, cols in (("sum", r.sums), ("max", r.maxima), ("min", r.minima)):
            out += [_q(f"_{kind}_{c}").alias(c) for c in cols]
        zero = F.lit(0.0)
        out += [
            F.coalesce(_q(f"_wx_{c}") / F.nullif(_q(f"_w_{c}"), zero), zero).alias(c) for c in r.weighted
        ]
        out += [self._pooled(c).alias(c) for c in r.pooled]
        out += [F.pow(self._pooled(std), F.lit(2.0)).alias(c) for c, std in r.squared.items()]
        out += [
            F.coalesce(
                _q(f"_total_{c}") / F.nullif(_q(f"_total_{r.duration}"), zero) * S.MICROSECONDS, zero
            ).alias(rate)
            for rate, c in r.rates.items()
        ]
        return out

    @staticmethod
    def _pooled(c: str) -> Column:
        """Square root of (within + between sum of squares) / (N - 1); 0 up to one packet."""
        a, b, m, n = (_q(f"_p{x}_{c}") for x in "abcn")
        variance = (a + b - m * m / F.nullif(n, F.lit(0.0))) / F.when(n > 1, n - 1)
        return F.sqrt(F.coalesce(F.greatest(variance, F.lit(0.0)), F.lit(0.0)))


def aggregate_flows(
    df: DataFrame, by: Sequence[str], rules: FlowRules, ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """One row per logical flow from segments that already carry their cluster."""
    a = RuleAggregates(rules, ts, tie)
    return df.groupBy(*[_q(b) for b in by]).agg(*a.partial()).select(*[_q(b) for b in by], *a.finish())


def build_unified_flows(
    df: DataFrame,
    rules: FlowRules,
    keys: Sequence[str] = ("source_file", "Flow ID"),
    ts: str = "ts",
    cutoff: float = S.GAP_SECONDS,
    tie: str | None = None,
    logical_id: str = "LogicalFlowID",
) -> DataFrame:
    """Segments of all captures to logical flows: cluster and aggregate in one go.

    One shuffle of rows by key; keys of crowded cells take two of combined summaries in its place, by
    (key, bucket) and by key.
    """
    keys, a = list(keys), RuleAggregates(rules, ts, tie)
    constant = [_q(c) for c in rules.identity if c not in keys]
    crowded, untimed_rows = _crowded_cells(df, keys, ts)
    timed = df.where(_q(ts).isNotNull()).withColumn(_BUCKET, _bucket_of(ts, cutoff))

    def clustered(rows: DataFrame) -> DataFrame:
        summaries = rows.groupBy(*[_q(k) for k in keys], *constant, _BUCKET).agg(*a.partial(identity=False))
        return _gap_clusters(summaries.withColumn(_LOW, _q("_ts_first")).withColumn(_HIGH, _q("_ts_last")), keys, cutoff)

    by_key = [_q(k) for k in keys]
    if crowded:
        apart = _cell(keys).isin(crowded)
        parts = [clustered(timed.where(~apart).repartition(*by_key)), clustered(timed.where(apart))]
    else:
        parts = [clustered(timed.repartition(*by_key))]
    merged = [part.groupBy(*by_key, "_cluster").agg(*a.merge()) for part in parts]
    merged = reduce(DataFrame.unionByName, merged)
    if untimed_rows:
        untimed = df.where(_q(ts).isNull())
        spans = reduce(DataFrame.unionByName, [part.select(*by_key, "_cluster") for part in parts])
        own = _untimed_clusters(untimed, spans, keys, tie)
        single = own.groupBy(*[_q(k) for k in keys], *constant, "_cluster").agg(*a.partial(identity=False))
        merged = merged.unionByName(single.groupBy(*[_q(k) for k in keys], "_cluster").agg(*a.merge()))
    return merged.select(
        *[_q(k) for k in keys],
        *a.finish(),
        logical_flow_id(_q(keys[0]), _q(keys[1]), F.col("_cluster")).alias(logical_id),
    )


def name_rule(column: str) -> str:
    """Aggregate of a statistic judged by its name alone: first match decides."""
    name = column.lower()
    if "init win" in name:
        return "mean"
    for ending in ("max", "min"):
        if name.endswith(ending):
            return ending
    averaged = ("mean", "std", "var", "avg", "ratio", "/s")
    return "mean" if any(word in name for word in averaged) else "sum"


def aggregate_by_name(
    df: DataFrame, flow_id: str, identifiers: Sequence[str], order: Sequence[str], label: str = "label"
) -> DataFrame:
    """One row per raw Flow ID (reuse merged); identifiers and label keep their first value."""
    firsts = [c for c in df.columns if c in (*identifiers, label) and c != flow_id]
    others = [c for c in df.columns if c not in (*identifiers, label, flow_id, *order)]
    rank = [_q(o).alias(f"o{i}") for i, o in enumerate(order)]
    first = [
        F.min(F.when(_q(c).isNotNull(), F.struct(*rank, _q(c).alias("v"))))["v"].alias(c) for c in firsts
    ]
    return df.groupBy(_q(flow_id)).agg(
        *first, *[getattr(F, name_rule(c))(_q(c)).alias(c) for c in others]
    )
