"""Hard-negative mining by a secondary-sort shuffle.

A row's score for an anchor is the integer inner product of their quantised vectors. Anchors
are a stated query set, compared with all rows in blocks: rows and anchors are dealt into blocks
of bounded size by a hash of the whole row, and every pair of blocks is a task of its own.

1. Positives: a task sends on the best rows of the anchor's own label in its block. The scores
   are packed into keys (anchor, descending score, id), the keys are shuffled by anchor and
   sorted inside the partitions, and a streaming reader keeps the first ones.
2. Negatives: with the positives known, a task sends on the best rows of other labels for the
   window of each positive. Keys are packed and sorted in the same way, together with those of the
   positives; the reader opens a window at each positive that it meets and emits the negatives
   that pass, until the windows are full. It holds the open windows of one anchor, never its rows.

What a block does not send on cannot be among the first rows of any window, so the result is that
of sorting all scores, while a block sends at most ``positives * (1 + negatives)`` rows per anchor.

Scores are computed in double precision where that is exact, otherwise in whole numbers of any
size, and kept within the range of a long.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; rows that are equal in id, label and vector count once, rows that share
only their id are rows of their own; vectors are compared with vectors of the same length only,
empty ones score 0; equal scores go by smaller id, then label, then a hash of the vector; an anchor without
another row of its label, or a positive without a row in its window, gives no row; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby, islice
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BLOCK = 1 << 21  # components on either side of one task: 32,768 vectors of 64
SCALE = 256
_ROWS = 64  # anchors compared at a time inside a task
_EXACT = float(1 << 53)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_KEY = struct.Struct(">QQQQ?QQQ")
_ANCHOR = 24  # bytes of a key that name its anchor

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_POSITIVE = "id long, label long, hash long, score long, key binary"
_NAME = ("id", "label", "hash")


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number)


def pack(anchor: np.ndarray, score: np.ndarray, negative: bool, rows: np.ndarray) -> pa.Array:
    """Keys whose byte order is: anchor, higher scores first, positives before negatives, then the row.

    ``anchor`` and each of ``rows`` are (id, label, hash). A positive goes before the negatives of an
    equal score, since its window may begin at its own score (if both are 0).
    """
    sign = np.uint64(1 << 63)
    up = lambda x: np.asarray(x, np.int64).view(np.uint64) ^ sign
    kind = np.dtype([("anchor", ">u8", 3), ("score", ">u8"), ("negative", "u1"), ("row", ">u8", 3)])
    keys = np.empty(len(score), kind)
    keys["anchor"], keys["score"], keys["negative"], keys["row"] = up(anchor), ~up(score), negative, up(rows)
    fixed = pa.Array.from_buffers(pa.binary(kind.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())])
    return fixed.cast(pa.binary())


def unpack(key: bytes) -> tuple[tuple[int, int, int], int, bool, int]:
    """(anchor, score, negative, id of the row)"""
    a, label, mark, score, negative, row, _, _ = _KEY.unpack(key)
    return (a + _LOW, label + _LOW, mark + _LOW), _HIGH - score, bool(negative), row + _LOW


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), size)


def _whole(vector: np.ndarray) -> list[int]:
    return [floor(x * SCALE) if abs(x) < 1e15 else int(x) * SCALE for x in vector.tolist()]


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of the quantised vectors, exact, kept within the range of a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, r = np.floor(anchors * SCALE), np.floor(rows * SCALE)
        top = lambda m: np.abs(m).max(axis=1, initial=0)
        large = top(a)[:, None] * top(r)[None, :] * max(a.shape[1], 1) >= _EXACT
        product = a @ r.T
        product[large] = 0
        out = product.astype(np.int64)
    exact = {}
    for i, j in zip(*np.nonzero(large), strict=True):
        for key, m in (((0, i), anchors[i]), ((1, j), rows[j])):
            if key not in exact:
                exact[key] = _whole(m)
        value = sum(x * y for x, y in zip(exact[0, i], exact[1, j], strict=True))
        out[i, j] = min(max(value, _LOW), _HIGH)
    return out


def first(score: np.ndarray, among: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` best of the places ``among`` (ascending): higher scores, then earlier places."""
    if len(among) > count:
        least = np.partition(score[among], len(among) - count)[len(among) - count]
        among = among[score[among] >= least]
    return among[np.argsort(~score[among], kind="stable")][:count]  # ~x falls as x rises and cannot overflow


def _cell(choose) -> object:
    """A task over one block of rows and one of anchors; ``choose`` yields (negative, places) per anchor."""

    def compare(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        keys = []
        lengths = lambda t: t["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        sizes, asked = lengths(rows), lengths(anchors)
        for size in np.intersect1d(sizes, asked):
            mine, own = rows.filter(pa.array(sizes == size)), anchors.filter(pa.array(asked == size))
            names = np.column_stack([mine[c].to_numpy() for c in _NAME])
            order = np.lexsort(names.T[::-1])
            names, vectors = names[order], _matrix(mine["vector"], size)[order]
            asking, wanted = np.column_stack([own[c].to_numpy() for c in _NAME]), _matrix(own["vector"], size)
            windows = own["scores"].to_pylist() if "scores" in own.column_names else [None] * len(own)
            for at in range(0, len(own), _ROWS):
                for k, score in enumerate(scores(wanted[at : at + _ROWS], vectors), start=at):
                    for negative, places in choose(asking[k], names, score, windows[k]):
                        keys.append(pack(asking[k], score[places], negative, names[places]))
        found = pa.chunked_array(keys, pa.binary())
        return pa.table({"key": found})

    return compare


def _positives(count: int):
    def choose(anchor: np.ndarray, names: np.ndarray, score: np.ndarray, _) -> Iterator[tuple[bool, np.ndarray]]:
        other = (names[:, 1] == anchor[1]) & ((names[:, 0] != anchor[0]) | (names[:, 2] != anchor[2]))
        yield False, first(score, np.flatnonzero(other), count)

    return choose


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest score that ``low`` and ``high`` hundredths of ``score`` allow; none below 0."""
    if score < 0:
        return 1, 0
    return -(-low * score // 100), high * score // 100


def _negatives(count: int, low: int, high: int):
    def choose(anchor: np.ndarray, names: np.ndarray, score: np.ndarray, positives: list[int]) -> Iterator[tuple[bool, np.ndarray]]:
        bounds = {(a, b) for a, b in (window(p, low, high) for p in positives) if a <= b}
        if not bounds:
            return
        least, most = min(a for a, _ in bounds), max(b for _, b in bounds)
        among = np.flatnonzero((names[:, 1] != anchor[1]) & (score >= least) & (score <= min(most, _HIGH)))
        met = [first(score, among[(score[among] >= a) & (score[among] <= min(b, _HIGH))], count) for a, b in bounds]
        yield True, np.unique(np.concatenate(met))

    return choose


def _sorted_keys(keys: DataFrame) -> DataFrame:
    """The secondary sort: all keys of an anchor in one partition, in key order."""
    return keys.repartition(F.substring("key", 1, _ANCHOR)).sortWithinPartitions("key")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    return groupby((k for batch in batches for k in batch.column(0).to_pylist()), key=lambda k: k[:_ANCHOR])


def _arrow_schema(fields: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def _batches(records: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size from a stream of records."""
    while held := list(islice(records, size)):
        columns = zip(*held, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _keep_first(count: int):
    schema = _arrow_schema(_POSITIVE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (key for _, keys in _stream(batches) for key in islice(keys, count))
        yield from _batches(((*anchor, score, key) for key in kept for anchor, score, *_ in (unpack(key),)), schema)

    return read


def _mine(count: int, low: int, high: int):
    schema = _arrow_schema(_RESULT)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, keys in _stream(batches):
            open_: list[list] = []
            for key in keys:
                anchor, score, negative, row = unpack(key)
                if not negative:
                    open_.append([row, score, 0, *window(score, low, high)])
                    continue
                for place in open_:
                    if place[2] < count and place[3] <= score <= place[4]:
                        place[2] += 1
                        yield anchor[0], place[0], place[2], row, place[1], score

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(emit(batches), schema)

    return read


def _deal(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, choose) -> DataFrame:
    """Every block of rows with every block of anchors, one task each: the keys that ``choose`` sends on."""
    tasks = min(2 * row_blocks * anchor_blocks, 20_000)
    mark = lambda n: F.pmod(F.xxhash64(*_NAME), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("i", mark(row_blocks)).withColumn("j", every(anchor_blocks)).repartition(tasks, "i", "j")
    right = anchors.withColumn("j", mark(anchor_blocks)).withColumn("i", every(row_blocks)).repartition(tasks, "i", "j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_cell(choose), "key binary")


def mine(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Per anchor, positive and rank: the negatives scoring within ``low`` to ``high`` hundredths of the positive.

    ``anchors`` is a condition on the columns of ``vectors``. A window lies at or below its positive, so
    ``low <= high <= 100``; a positive that scores below 0 has no window.
    """
    if not low <= high <= 100:
        raise ValueError("low <= high <= 100 is needed: negatives are read after their positive")
    vector = F.col(f"`{vector_col}`")
    named = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & usable(vector)).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        vector.alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    distinct = named.groupBy("id", "label", "vector").agg(F.max("anchor").alias("anchor"))
    rows = staged(distinct.withColumn("hash", F.xxhash64("vector")), "mine_rows")
    amount = rows.agg(F.sum(F.size("vector") + 1).alias("all"), F.sum(F.when(F.col("anchor"), F.size("vector") + 1)).alias("asked")).first()
    parallel = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(parallel, -(-(amount["all"] or 0) // BLOCK))
    anchor_blocks = max(1, -(-(amount["asked"] or 0) // BLOCK))
    every, asked = rows.select(*_NAME, "vector"), staged(rows.where("anchor").select(*_NAME, "vector"), "mine_anchors")
    near = _deal(every, asked, row_blocks, anchor_blocks, _positives(positives))
    kept = staged(_sorted_keys(near).mapInArrow(_keep_first(positives), _POSITIVE), "mine_positives")
    # The scores of an anchor's positives, at most ``positives`` of them, go back to the anchor.
    known = kept.groupBy(*_NAME).agg(F.sort_array(F.collect_list("score")).alias("scores"))
    far = _deal(every, asked.join(known, list(_NAME)), row_blocks, anchor_blocks, _negatives(negatives, low, high))
    return _sorted_keys(far.unionByName(kept.select("key"))).mapInArrow(_mine(negatives, low, high), _RESULT)
