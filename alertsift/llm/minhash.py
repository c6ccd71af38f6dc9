"""Near-duplicate documents by HyperMinHash.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of the set and a
   sketch of 256 registers (leading zeros and mantissa in 16 bits). Texts with equal sets form
   one class; only the class's least id goes on.
2. Registers are cut into bands. Classes that agree on a band share a bucket. Each bucket has
   a leader, picked by a hash, and every member is paired with it: a bucket of n members gives
   n - 1 pairs, not n squared.
3. Pairs whose collision-corrected Jaccard estimate and sizes allow a link are verified on the
   full sets, which are built again from the texts of the documents concerned.
4. Verified links give components. In the buckets where several components still meet, all
   pairs across components are estimated, block by block inside tasks. Only members with a
   possible pair come back with their full sets, and the same tasks then verify those pairs in
   place and send on the links that join components. So no link is lost to the choice of leaders,
   and the pairs themselves never become rows.

The chance that a pair at the threshold shares no band is below 1e-5 (see ``rows_for``); a pair
passes the estimate unless it errs by five standard deviations. Small sets have no such risk:
they differ in fewer registers than they have bands.

Tables that grow with the corpus are joined by merging (a hint), never by broadcasting.

Defined cases: a null or blank text has an empty set and links with nothing; a text shorter
than a shingle is one shingle; rows with equal texts are copies; rows of one id with different texts are
rows of their own, each in its own group; a row without an id has no component and is kept; an empty
table gives an empty table; other columns are ignored, also if they are named like an output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import small_batches, staged, unstaged
from .graph import components

BLOCK = 2048  # members of one bucket that one task compares with as many others
SET_BLOCK = 1024  # the same where their full sets are at hand
PAIRS = 1 << 15  # pairs of registers compared at a time
FEW = 64  # registers of a first look at a pair
SIGMAS = 5


def rows_for(percent: int) -> int:
    """Registers per band: the most for which a pair at the threshold is missed below 1e-5."""
    for rows in (6, 5, 4, 3, 2):
        if (1 - (percent / 100) ** rows) ** (sketch.BUCKETS // rows) < 1e-5:
            return rows
    return 1


def least_estimate(percent: int) -> float:
    share = percent / 100
    return share - SIGMAS * math.sqrt(share * (1 - share) / sketch.BUCKETS)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, mark, size of the shingle set, digest of the set and its sketch; the last two null if empty.

    ``mark`` is a hash of the text: with the id it names a row also where ids repeat.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                shingles = sketch.shingle_set(text, width)
                if len(shingles):
                    rows.append((len(shingles), sketch.digest(shingles), sketch.registers(shingles).tobytes()))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "registers"])
            out.insert(0, "id", batch["id"].to_numpy())
            out.insert(1, "mark", batch["mark"].to_numpy())
            yield out

    text = F.col(f"`{text_col}`")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return named.mapInPandas(sign, "id long, mark long, n_shingles long, digest binary, registers binary")


def _matrix(binary: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(binary), np.uint16).reshape(len(binary), sketch.BUCKETS)


def _buckets(classes: DataFrame, rows: int) -> DataFrame:
    """One row per class and band that holds a shingle, with the class's size and sketch."""

    @F.pandas_udf("array<long>")
    def keys(registers: pd.Series) -> pd.Series:
        key, filled = sketch.band_keys(_matrix(registers), rows)
        return pd.Series([k[f] for k, f in zip(key, filled, strict=True)])

    return classes.select("rep", F.explode(keys("registers")).alias("bucket"))


def _size_allows(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _star_pairs(buckets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's leader and its other members whose estimate allows a link."""
    floor = least_estimate(percent)

    @F.pandas_udf("double")
    def estimated(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(sketch.estimate(_matrix(left), _matrix(right)))

    # Each bucket has its own order: members of one group meet as many leaders as they share bands.
    order = F.xxhash64("rep", "bucket")
    leaders = (
        buckets.groupBy("bucket")
        .agg(F.min(F.struct(order.alias("order"), F.col("rep").alias("rep"))).alias("first"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("bucket", F.col("first.rep").alias("leader"))
    )
    pairs = (
        buckets.join(leaders.hint("merge"), "bucket")
        .where(F.col("rep") != F.col("leader"))
        .select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))
        .distinct()
    )
    return (
        _with_both(pairs, classes.select("rep", "n_shingles", "registers"))
        .where(_size_allows(F.col("n_shingles_a"), F.col("n_shingles_b"), percent))
        .where(estimated("registers_a", "registers_b") >= floor)
        .select("a", "b")
    )


def _with_both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``facts`` (keyed by rep) for either side."""
    for side in ("a", "b"):
        named = facts.select(*[F.col(c).alias(side if c == "rep" else f"{c}_{side}") for c in facts.columns])
        pairs = pairs.join(named.hint("merge"), side)
    return pairs


def _full_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(rep, set): the whole shingle sets of the classes in ``wanted``, built from their texts (id, text).

    If an id has several texts, the one whose set has the class's digest counts.
    """

    @F.pandas_udf("binary")
    def full_set(text: pd.Series) -> pd.Series:
        return text.map(lambda t: sketch.shingle_set(t, width).tobytes())

    @F.pandas_udf("boolean")
    def fits(full: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([sketch.digest(np.frombuffer(s, np.uint64)) == d for s, d in zip(full, digest, strict=True)], dtype=bool)

    whole = full_set(F.coalesce("text", F.lit(""))).alias("set")
    if not repeated:
        sets = texts.withColumnRenamed("id", "rep").join(wanted.hint("merge"), "rep").select("rep", whole)
        return sets.dropDuplicates(["rep"])  # equal rows
    named = wanted.join(classes.select("rep", "first", "digest").hint("merge"), "rep").withColumnRenamed("first", "id")
    sets = texts.join(named.hint("merge"), "id").select("rep", "digest", whole)
    return sets.where(fits("set", "digest")).dropDuplicates(["rep"]).select("rep", "set")


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold on their full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_linked(a, b, percent) for a, b in zip(left, right, strict=True)], dtype=bool)

    return _with_both(pairs, sets).where(linked("set_a", "set_b")).select("a", "b")


def _near_pairs(group: pd.DataFrame, rows: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a group (one block against another of a bucket) in different components
    whose estimate allows a link and that share no band before this bucket's."""
    bucket, low, high = (group[c].iat[0] for c in ("bucket", "low", "high"))
    rep, part, size = (group[c].to_numpy() for c in ("rep", "component", "n_shingles"))
    if part.min() == part.max():
        return
    side = group["block"].to_numpy()
    left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
    regs = _matrix(group["registers"])
    some = np.ascontiguousarray(regs[:, :: sketch.BUCKETS // FEW])
    step, floor = max(1, PAIRS // max(1, len(right))), least_estimate(percent)
    for at in range(0, len(left), step):
        rows_at = left[at : at + step]
        x, y = np.repeat(rows_at, len(right)), np.tile(right, len(rows_at))
        good = part[x] != part[y]
        good &= 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
        if low == high:
            good &= rep[x] < rep[y]
        x, y = x[good], y[good]
        hopeful = sketch.may_reach(some[x], some[y], percent / 100, SIGMAS)
        x, y = x[hopeful], y[hopeful]
        near = sketch.estimate(regs[x], regs[y]) >= floor
        x, y = x[near], y[near]
        if len(x):
            key_x, filled_x = sketch.band_keys(regs[x], rows)
            key_y, filled_y = sketch.band_keys(regs[y], rows)
            first = ((key_x == key_y) & filled_x & filled_y).argmax(axis=1)
            mine = key_x[np.arange(len(x)), first] == bucket
            yield x[mine], y[mine]


def _across(members: DataFrame, facts: DataFrame, block_size: int, visit, schema: str) -> DataFrame:
    """``visit`` every pair of blocks of each bucket's ``members`` (bucket, rep, component).

    Buckets of one component are left out. A block has about ``block_size`` members, so a task
    holds two blocks at a time however large the bucket is.
    """
    mixed = (
        members.groupBy("bucket")
        .agg(F.count("*").alias("n"), F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where(F.col("_low") < F.col("_high"))
        .select("bucket", F.ceil(F.col("n") / block_size).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = (
        members.join(mixed, "bucket")
        .withColumn("block", block)
        .withColumn("_o", other)
        .select("bucket", "rep", "component", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "block")
    )
    full = meeting.join(facts.hint("merge"), "rep")
    order = ["bucket", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _sorted_groups(batches, order):
            yield from visit(group)

    return full.repartition(*order).sortWithinPartitions(*order).mapInPandas(run, schema)


def _crossing_members(buckets: DataFrame, classes: DataFrame, parts: DataFrame, rows: int, percent: int) -> DataFrame:
    """(bucket, rep, component) of all members with a possible link to another component there."""
    named = buckets.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )

    def visit(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        met = [np.concatenate(pair) for pair in _near_pairs(group, rows, percent)]
        if met:
            yield group.iloc[np.unique(np.concatenate(met))][["bucket", "rep", "component"]]

    facts = classes.select("rep", "n_shingles", "registers")
    return _across(named, facts, BLOCK, visit, "bucket long, rep long, component long").distinct()


def _crossing_links(members: DataFrame, classes: DataFrame, sets: DataFrame, rows: int, percent: int) -> DataFrame:
    """(a, b): verified links that join different components, as few as a task needs for that.

    All possible pairs are checked on their full sets, unless their components have met before
    in the same task. The pairs stay inside the tasks.
    """

    def visit(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        rep, part, full = (group[c].to_numpy() for c in ("rep", "component", "set"))
        found = []
        for x, y in _near_pairs(group, rows, percent):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = find(int(part[i])), find(int(part[j]))
                if a != b and _linked(full[i], full[j], percent):
                    root[max(a, b)] = min(a, b)
                    found.append((int(rep[i]), int(rep[j])))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    facts = classes.select("rep", "n_shingles", "registers").join(sets.hint("merge"), "rep")
    return _across(members, facts, SET_BLOCK, visit, "a long, b long")


def _sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by ``keys``; only the open group is held across batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1
        if held and any(held[-1][k].iat[-1] != v[0] for k, v in zip(keys, values, strict=True)):
            yield pd.concat(held, ignore_index=True)
            held = []
        edges = [0, *cut.tolist(), len(batch)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            part = batch.iloc[start:stop]
            if stop == len(batch):
                held.append(part)
            elif held:
                yield pd.concat([*held, part], ignore_index=True)
                held = []
            else:
                yield part
    if held:
        yield pd.concat(held, ignore_index=True)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` and ``kept``.

    Documents link when 100 * intersection >= percent * union of their shingle sets.
    """
    found = _grouped(docs, id_col, text_col, width, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _classes(signed: DataFrame) -> tuple[DataFrame, bool]:
    """One row per digest: ``first``, its least id, and ``rep``, which names it as a node.

    The least id is the name, unless several classes have it: those are named by a hash of their digest.
    The flag tells whether there are any.
    """
    classes = staged(
        signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .withColumn("rep", F.col("first")),
        "classes",
    )
    shared = classes.groupBy("first").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    if shared.isEmpty():
        return classes, False
    named = classes.join(shared.hint("merge"), "first", "left")
    return staged(named.withColumn("rep", F.when(F.col("_n") > 1, F.xxhash64("digest")).otherwise(F.col("first"))).drop("_n"), "classes"), True


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: id, mark, n_shingles, node (of its group; null if the row links with nothing), component_id and kept."""
    small_batches(docs.sparkSession)
    rows = rows_for(percent)
    signed = staged(signatures(docs, id_col, text_col, width), "signatures")
    classes, repeated = _classes(signed)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    buckets = staged(_buckets(classes, rows), "buckets")
    stars = staged(_star_pairs(buckets, classes, percent), "pairs")
    wanted = stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct()
    links = staged(_verified(stars, _full_sets(wanted, classes, texts, width, repeated), percent), "links")
    parts = staged(components(links), "parts")
    unstaged(stars, links)
    crossing = staged(_crossing_members(buckets, classes, parts, rows, percent), "members")
    sets = _full_sets(crossing.select("rep").distinct(), classes, texts, width, repeated)
    more = staged(_crossing_links(crossing, classes, sets, rows, percent), "links")
    whole = components(
        more.select("a", "b").unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
    )
    unstaged(buckets, crossing, more, parts)
    of_class = (
        classes.select("digest", "rep", "first")
        .join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("digest", "first", F.coalesce("component", "rep").alias("node"))
    )
    if repeated:  # a node's name need not be an id: the least id of a group is looked up
        least = of_class.groupBy("node").agg(F.min("first").alias("component"))
        of_class = of_class.join(least.hint("merge"), "node")
    else:
        of_class = of_class.withColumn("component", F.col("node"))
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return signed.join(of_class.drop("first"), "digest", "left").select(
        "id", "mark", "n_shingles", "node", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept")
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates, one of the least id.

    Of several rows of a group with that id the least by its other columns stays. Rows of one id whose texts
    differ are told apart. Rows without an id or without words stay.
    """
    found = staged(_grouped(docs, id_col, text_col, width, percent), "grouped")
    key = ["_id", "_mark"]
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(f"`{text_col}`").alias("_mark"), F.struct("*").alias("_doc"))
    of = lambda table, *more: table.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), *more)
    left = named.join(of(found.where(~F.col("kept"))).distinct(), key, "left_anti")
    several = (
        found.where("kept and id is not null and node is not null").groupBy("node").count().where("count > 1").select("node")
    )
    again = of(found.where("kept").join(several, "node"), "node").distinct()
    least = left.join(again, key).groupBy("node").agg(F.min("_doc").alias("_doc"))
    return left.join(again, key, "left_anti").select("_doc").unionByName(least.select("_doc")).select("_doc.*")
