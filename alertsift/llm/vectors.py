"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. A fixed rotation spreads the
energy, and the coordinates are cut into blocks; each block gets a share of the squared
distance in proportion to its width. A linked pair keeps to the budget in at least one block,
so each block is range-joined on its own: a vector is at home in one slab of the block's first
coordinate and a guest in every slab within the radius. Inside a slab the home rows are halved along
the widest of the block's coordinates until few are left, and meet the guests within the radius of
their box; the block distance picks candidates, and every candidate is verified by its cosine in double precision. A pair found in several blocks counts in the first
block whose budget it keeps, so no pair table is built or made distinct: a task sends on one
count and one spanning edge per vector.

Equal vectors are merged first. The homes and the guests of a crowded slab are cut into pieces of
bounded size, and every pair of pieces is a task of its own.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links
with nothing; vectors of different lengths do not link; rows with equal vectors are linked; a
row without an id has no component, is kept, and counts as a link of its partners; an empty table gives
an empty table; other columns are ignored, also if they are named like an output. A pair links if the
quotient of its inner product and its norms, computed in double precision, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstaged
from .graph import components

BLOCKS = 8
PIECE = 32_768  # vectors on either side of one task
_ROWS, _PAIRS = 32, 1 << 18  # home rows of a cell, and pairs compared at a time inside a task
_SLACK = 1e-9


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(size, size)))[0]


def block_edges(size: int) -> np.ndarray:
    blocks = min(BLOCKS, size)
    return np.arange(blocks + 1) * size // blocks


def budgets(size: int, cosine: float) -> np.ndarray:
    return (2 - 2 * cosine) * np.diff(block_edges(size)) / size * (1 + _SLACK) + _SLACK


def _placements(classes: DataFrame, cosine: float) -> DataFrame:
    """(rep, size, block, slab, home): the slabs of every block that a vector belongs to."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, same in batch.groupby(batch["vector"].map(len)):
                turned = _units(same["vector"]) @ rotation(size)
                rep = same["rep"].to_numpy()
                for block, (start, budget) in enumerate(zip(block_edges(size)[:-1], budgets(size, cosine), strict=True)):
                    x, reach = turned[:, start], np.sqrt(budget) + _SLACK
                    slab = np.floor(x / (2 * reach)).astype(np.int64)
                    for shift in (-1, 0, 1):
                        near = np.floor((x + shift * reach) / (2 * reach)).astype(np.int64)
                        keep = (near != slab) | (shift == 0)
                        yield pd.DataFrame(
                            {"rep": rep[keep], "size": size, "block": block, "slab": near[keep], "home": shift == 0}
                        )

    return classes.select("rep", "vector").mapInPandas(place, "rep long, size int, block int, slab long, home boolean")


def _units(vectors: pd.Series) -> np.ndarray:
    raw = np.vstack(vectors.to_list()).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of every node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(part: np.ndarray, home: np.ndarray, guest: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The range join of a block inside a task: small sets of home rows with the guests within ``reach`` of their box.

    Home rows are halved along the coordinate that spreads most; guests beyond a half's border by more than
    the reach cannot be within it.
    """
    open_ = [(home, guest)]
    while open_:
        rows, others = open_.pop()
        if not len(rows) or not len(others):
            continue
        low, high = part[rows].min(axis=0) - reach, part[rows].max(axis=0) + reach
        others = others[((part[others] >= low) & (part[others] <= high)).all(axis=1)]
        axis = int((high - low).argmax())
        if len(rows) <= _ROWS or not len(others) or high[axis] - low[axis] <= 2 * reach:
            yield rows, others
            continue
        order = rows[np.argpartition(part[rows, axis], len(rows) // 2)]
        open_ += [(order[: len(rows) // 2], others), (order[len(rows) // 2 :], others)]


def _links(vectors: pd.Series, home: np.ndarray, guest: np.ndarray, rep: np.ndarray, block: int, cosine: float):
    """Index pairs (home row, guest row) of all links that this block is the first to keep."""
    raw = np.vstack(vectors.to_list()).astype(np.float64)
    norm = np.linalg.norm(raw, axis=1)
    size = raw.shape[1]
    turned = (raw / norm[:, None]) @ rotation(size)
    edges, budget = block_edges(size), budgets(size, cosine)
    part = turned[:, edges[block] : edges[block + 1]]
    square, reach, found = (part**2).sum(axis=1), np.sqrt(budget[block]) + _SLACK, []
    for rows, others in _cells(part, home, guest, reach):
        step = max(1, _PAIRS // len(others))
        for at in range(0, len(rows), step):
            few = rows[at : at + step]
            far = square[few][:, None] + square[others][None, :] - 2 * (part[few] @ part[others].T)
            i, j = np.nonzero(far <= budget[block] + 1e-6)
            i, j = few[i], others[j]
            for k in range(0, len(i), _PAIRS):
                x, y = i[k : k + _PAIRS], j[k : k + _PAIRS]
                good = (np.einsum("ij,ij->i", raw[x], raw[y]) / (norm[x] * norm[y]) >= cosine) & (rep[x] != rep[y])
                x, y = x[good], y[good]
                kept = np.add.reduceat((turned[x] - turned[y]) ** 2, edges[:-1], axis=1) <= budget
                first = kept.argmax(axis=1) == block
                found.append((x[first], y[first]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _task(cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        home, guest = np.flatnonzero(rows["home"]), np.flatnonzero(rows["guest"])
        if not len(home) or not len(guest):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype(np.int64)
        x, y = _links(rows["vector"], home, guest, rep, int(rows["block"].iat[0]), cosine)
        # A row may stand here twice (home and guest): its id decides.
        ids, node = np.unique(rep, return_inverse=True)
        counts = np.zeros(len(ids), np.int64)
        np.add.at(counts, node[x], copies[y])
        label = _forest(node[x], node[y], len(ids))
        met = np.unique(np.concatenate([node[x], node[y]]))
        return pd.DataFrame({"a": ids[met], "b": ids[label[met]], "n": counts[met]})

    return compare


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``."""
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = (F.size("vector") > 0) & F.forall("vector", number) & F.exists("vector", lambda x: x != 0)
    marked = raw.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = staged(
        marked.where("usable").groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    with_id = classes.where(F.col("rep").isNotNull())
    places = staged(_placements(with_id, cosine), "places")
    slab = ["size", "block", "slab"]
    # Either side of a slab is cut by its own count: every piece of homes meets every piece of guests.
    parts_of = lambda n: F.ceil(n / PIECE).cast("int")
    crowd = (
        places.groupBy(*slab)
        .agg(parts_of(F.count_if(F.col("home"))).alias("homes"), parts_of(F.count("*")).alias("guests"))
        .where("homes > 0")
    )
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    pieces = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = F.transform(pieces("guests"), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    as_guest = F.transform(pieces("homes"), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    tasks = F.array_distinct(F.concat(F.when(F.col("home"), at_home).otherwise(F.slice(at_home, 1, 0)), as_guest))
    dealt = (
        places.join(crowd, slab)
        .withColumns({"i": own("homes"), "j": own("guests")})
        .withColumn("task", F.explode(tasks))
        .withColumns({"home": F.col("home") & (F.col("task.i") == F.col("i")), "guest": F.col("task.j") == F.col("j")})
        .where("home or guest")
        .join(with_id, "rep")
        .select("rep", "copies", "vector", *slab, "task", "home", "guest")
    )
    found = staged(dealt.groupBy(*slab, "task").applyInPandas(_task(cosine), "a long, b long, n long"), "found")
    unstaged(places)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.select("a", "b")).withColumnRenamed("node", "rep")
    facts = with_id.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "vector",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    joined = marked.withColumn("_key", F.when(F.col("usable"), F.col("vector"))).join(
        facts.withColumnRenamed("vector", "_key"), "_key", "left"
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
