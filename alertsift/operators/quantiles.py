"""Exact linear-interpolation quantiles of many columns at once.

Spark's ``percentile`` keeps every distinct value in the buffer of one final task. That is
fine for a checked number of rows; beyond it, sketches bracket each wanted order statistic,
exact counts confirm the bracket, and the bracket shrinks until few values remain.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT_CELLS = 8_000_000  # values that one task may hold
_ACCURACY = 10_000
_BATCH = 40  # sketches per aggregate


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probs: Sequence[float],
    direct_cells: int = DIRECT_CELLS,
) -> dict[str, list[float | None]]:
    """``{column: [quantile for each prob]}``, nulls ignored, None for an all-null column."""
    exprs = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    probs = [float(p) for p in probs]
    names = list(exprs)
    narrow = df.select(*[exprs[n].cast("double").alias(f"q{i}") for i, n in enumerate(names)])
    counts = narrow.agg(*[F.count(c).alias(c) for c in narrow.columns]).first()
    if sum(counts) <= direct_cells:
        wanted = F.array(*[F.lit(p) for p in probs])
        row = narrow.agg(*[F.percentile(c, wanted).alias(c) for c in narrow.columns]).first()
        return {n: list(row[i]) if row[i] is not None else [None] * len(probs) for i, n in enumerate(names)}

    ranks = {}
    for i in range(len(names)):
        if counts[i]:
            for p in probs:
                position = p * (counts[i] - 1)
                ranks.setdefault((i, math.floor(position)), None)
                ranks.setdefault((i, math.ceil(position)), None)
    values = _order_statistics(narrow, list(ranks), counts, max(1, direct_cells // 4))
    out = {}
    for i, name in enumerate(names):
        out[name] = []
        for p in probs:
            if not counts[i]:
                out[name].append(None)
                continue
            position = p * (counts[i] - 1)
            low, high = values[i, math.floor(position)], values[i, math.ceil(position)]
            share = position - math.floor(position)
            out[name].append(low if share == 0 else (1 - share) * low + share * high)
    return out


def _order_statistics(narrow, slots, counts, direct_rows):
    """The value at each 0-based (column, rank), by shrinking brackets.

    Per slot the open bracket (low, high) holds the wanted value or one of its ends is it.
    Values strictly inside a refined bracket are at most a fixed share of those inside the
    bracket before, whatever the ties, so the loop ends.
    """
    found: dict[tuple[int, int], float] = {}
    brackets = {s: (None, None, counts[s[0]], 0) for s in slots}  # low, high, inside, at or below low
    while brackets:
        wide = {s: b for s, b in brackets.items() if b[2] > direct_rows}
        if not wide:
            break
        order = list(wide)
        sketches = _sketch(narrow, wide)
        exact = {}
        for start in range(0, len(order), _BATCH):
            part = order[start : start + _BATCH]
            checks = []
            for j, s in enumerate(part):
                col, (low, high) = F.col(f"q{s[0]}"), sketches[s]
                checks += [F.count_if(col < low), F.count_if(col <= low), F.count_if(col < high), F.count_if(col <= high)]
            row = narrow.agg(*[c.alias(f"c{k}") for k, c in enumerate(checks)]).first()
            exact |= {s: row[4 * j : 4 * j + 4] for j, s in enumerate(part)}
        for s in order:
            rank, (low, high) = s[1], sketches[s]
            below, upto_low, under_high, upto_high = exact[s]
            if below <= rank < upto_low:
                found[s] = low
                del brackets[s]
            elif under_high <= rank < upto_high:
                found[s] = high
                del brackets[s]
            elif upto_low <= rank < under_high:
                brackets[s] = (low, high, under_high - upto_low, upto_low)
            elif rank < below:  # the sketch missed on the high side; keep the part below it
                old = brackets[s]
                brackets[s] = (old[0], low, below - old[3], old[3])
            else:
                old = brackets[s]
                brackets[s] = (high, old[1], old[3] + old[2] - upto_high, upto_high)
    if brackets:
        order = list(brackets)
        entries = F.array(
            *[
                F.when(
                    _inside(s, brackets[s]),
                    F.struct(F.lit(j).alias("slot"), F.col(f"q{s[0]}").alias("value")),
                )
                for j, s in enumerate(order)
            ]
        )
        inside = (
            narrow.select(F.explode(F.array_compact(entries)).alias("e"))
            .groupBy("e.slot", "e.value")
            .agg(F.count("*").alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value"))
        want = F.create_map(*[F.lit(v) for j, s in enumerate(order) for v in (j, s[1] - brackets[s][3])])
        hits = (
            inside.withColumn("upto", upto)
            .withColumn("want", want[F.col("slot")])
            .where((F.col("upto") - F.col("n") <= F.col("want")) & (F.col("want") < F.col("upto")))
        )
        for row in hits.collect():
            found[order[row["slot"]]] = row["value"]
    return found


def _sketch(narrow, wide):
    """Approximate values a little below and above each wanted rank; one sketch per bracket."""
    shared: dict[tuple, list] = {}
    for s, b in wide.items():
        shared.setdefault((s[0], b[0], b[1]), []).append(s)
    out, groups = {}, list(shared.items())
    for start in range(0, len(groups), _BATCH):
        part, sketches = groups[start : start + _BATCH], []
        for j, (key, slots) in enumerate(part):
            probs = []
            for s in slots:
                share = _share(s, wide[s])
                probs += [max(0.0, share - 3 / _ACCURACY), min(1.0, share + 3 / _ACCURACY)]
            value = F.when(_inside(slots[0], wide[slots[0]]), F.col(f"q{key[0]}"))
            sketches.append(F.percentile_approx(value, probs, _ACCURACY).alias(f"s{j}"))
        row = narrow.agg(*sketches).first()
        for j, (_, slots) in enumerate(part):
            out |= {s: (row[j][2 * k], row[j][2 * k + 1]) for k, s in enumerate(slots)}
    return out


def _inside(slot, bracket) -> Column:
    col, (low, high, _, _) = F.col(f"q{slot[0]}"), bracket
    cond = col.isNotNull()
    if low is not None:
        cond = cond & (col > low)
    if high is not None:
        cond = cond & (col < high)
    return cond


def _share(slot, bracket) -> float:
    return (slot[1] - bracket[3]) / max(bracket[2] - 1, 1)
