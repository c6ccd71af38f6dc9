"""Mixing of sources to target weights by hash-seeded repetition.

Tokens are summed per source. The targets share all tokens by weight, but stop at ``most``
times their source; the excess goes to the other sources by weight. This level of water is
found by rounds over the table of sources: each takes the sources that are full at the present
level out of the division, until none is added. A source's rate is its target over its size.
Every document is emitted floor(rate) times, plus one copy with probability equal to the
fraction. That draw compares the fraction with bits of a hash of the document's id and text.

A hash gives ``DRAWS`` independent draws. Each source uses the one whose sum of drawn tokens
comes nearest to its target, so that a few long documents do not carry a source off its target.
All sums and levels are whole numbers; nothing depends on the order or place of rows.

No step groups by anything but the source, with partial sums before the shuffle. Places of
sources come from a range-partitioned sort of the table of sources. The rates are broadcast if
they are few and short (both checked); otherwise they are joined on source and salt, so that a
hot source spreads over many tasks.

Defined cases: a null source is a source of its own, placed last; a null, empty or blank text has size
0 and is never emitted; rows that are equal in id and text share their draw; a source without tokens, or of
weight 0, has target 0; an empty table gives an empty table; an input column named like an
output column gives way to it, other columns of the input pass through ``mix``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, staged, unstaged

MOST = 3
DRAWS = 16
SMALL_SOURCES, SMALL_CHARS = 100_000, 16_000_000  # bounds of a broadcast table of rates
SALTS = 64
_WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """The number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, key): what the mix knows of a document; ``key`` seeds its draws."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(
        ident.alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        _key(ident, text).alias("key"),
    )


def _key(ident: Column, text: Column) -> Column:
    return F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))


def _draws(key: Column) -> list[Column]:
    """``DRAWS`` columns of 32 random bits each; a SHA-256 holds eight of them."""
    hashes = [F.sha2(F.concat(F.lit(f"{i}|"), key), 256) for i in range(-(-DRAWS // 8))]
    return [F.conv(F.substring(hashes[k // 8], 8 * (k % 8) + 1, 8), 16, 10).cast("long") for k in range(DRAWS)]


def _by_source(rows: DataFrame, rates: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the columns of ``rates``, a null source being equal to a null source."""
    right = rates.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if small:
        return rows.join(F.broadcast(right), same).drop("_source")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_mine", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return left.join(right, same & (F.col("_mine") == F.col("_salt"))).drop("_source", "_salt", "_mine")


def place_sources(sizes: DataFrame) -> DataFrame:
    """Add ``place``, counted from 0 in code point order with null last.

    Only one number per range is brought together in one task, not the sources.
    """
    order = F.col("source").asc_nulls_last()
    ranged = sizes.repartitionByRange(order).sortWithinPartitions(order)
    fixed = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), "mix_places")
    split = fixed.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = split.groupBy("_range").agg(F.struct("_range", F.count("*").alias("n")).alias("r"))
    earlier = ranges.agg(F.sort_array(F.collect_list("r")).alias("all")).select(
        F.explode(
            F.transform(
                "all",
                lambda r: F.struct(
                    r["_range"].alias("_range"),
                    F.aggregate(
                        F.filter("all", lambda s: s["_range"] < r["_range"]), F.lit(0).cast("long"), lambda a, s: a + s["n"]
                    ).alias("_before"),
                ),
            )
        ).alias("e")
    ).select("e.*")
    return split.join(F.broadcast(earlier), "_range").select(*sizes.columns, (F.col("_before") + F.col("_at")).alias("place"))


def level(sizes: DataFrame, most: int = MOST) -> tuple[int, int]:
    """(tokens, weights) left to divide once all sources are out that reach ``most`` times their size."""
    wide = lambda x: F.lit(Decimal(x)).cast(_WIDE)
    full = lambda t, w: F.col("source_size").cast(_WIDE) * most * wide(w) <= F.col("weight").cast(_WIDE) * wide(t)
    whole = sizes.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    total, tokens, weights = whole["t"] or 0, whole["t"] or 0, whole["w"] or 0
    while weights:
        now = sizes.agg(
            F.sum(F.when(full(tokens, weights), F.col("source_size") * most).otherwise(0)).alias("t"),
            F.sum(F.when(full(tokens, weights), 0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        if (total - now["t"], now["w"]) == (tokens, weights):
            break
        tokens, weights = total - now["t"], now["w"]
    return tokens, weights


def rates(measured: DataFrame, weights: DataFrame | None = None, most: int = MOST) -> tuple[DataFrame, bool]:
    """One row per source: source_size, target, whole copies, cut (of 32 bits) and the draw to use.

    ``weights`` has (source, weight) with whole numbers from 0, a missing source counting 0; without it the
    sources in code point order weigh 1, 2, 3, repeating. The flag tells whether the table is small.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        placed = place_sources(sizes)
        weighed = placed.select("source", "source_size", (F.col("place") % 3 + 1).alias("weight"))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("long").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "source_size", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")
        )
    weighed = staged(weighed, "mix_sources")
    bound = weighed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("source")), F.lit(0)).alias("c")).first()
    small = bound["n"] <= SMALL_SOURCES and bound["c"] <= SMALL_CHARS
    tokens, whole = level(weighed, most)
    size, wide = F.col("source_size"), lambda x: F.lit(Decimal(x)).cast(_WIDE)
    share = F.col("weight").cast(_WIDE) * wide(tokens)
    # With nothing left to divide, all sources that weigh anything are full.
    level_met = size.cast(_WIDE) * most * wide(whole) <= share if whole else F.col("weight") > 0
    full = (size == 0) | level_met
    piece = size.cast(_WIDE) * wide(max(whole, 1))
    rest = (share % piece).cast("double") / piece.cast("double")
    fixed = weighed.select(
        "source",
        "source_size",
        F.when(full, (size * most).cast("double")).otherwise(share.cast("double") / float(max(whole, 1))).alias("target"),
        F.when(full, F.lit(most)).otherwise(F.floor((share - share % piece) / piece)).cast("long").alias("base"),
        F.when(full, F.lit(0.0)).otherwise(rest * float(1 << 32)).alias("cut"),
    )
    # The sums of all draws per source; then the draw that comes nearest.
    drawn = _by_source(measured.select("source", "size", "key"), fixed.select("source", "cut"), small)
    sums = drawn.groupBy("source").agg(
        *[F.sum(F.when(u < F.col("cut"), F.col("size")).otherwise(0)).alias(f"_d{k}") for k, u in enumerate(_draws(F.col("key")))]
    )
    off = [
        F.struct(F.abs(F.col("target") - F.col("base") * size - F.col(f"_d{k}")).alias("off"), F.lit(k).alias("draw"))
        for k in range(DRAWS)
    ]
    # The sums have one row per source: no source is hot here, so no salt is needed.
    totals = sums.withColumnRenamed("source", "_source")
    best = fixed.join(totals, F.col("source").eqNullSafe(F.col("_source")))
    chosen = best.select("source", "source_size", "target", "base", "cut", F.least(*off)["draw"].alias("draw"))
    found = staged(chosen, "mix_rates")
    unstaged(weighed)
    return found, small


def _copies(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``rows`` (with source and key) and the columns of their source; ``copies`` tells how often a row is emitted."""
    joined = _by_source(rows, table, small)
    drawn = F.element_at(F.array(*_draws(F.col("key"))), F.col("draw") + 1) < F.col("cut")
    return joined.withColumn("copies", F.when(F.col("size") > 0, F.col("base") + drawn.cast("long")).otherwise(F.lit(0).cast("long")))


def plan(
    docs: DataFrame,
    weights: DataFrame | None = None,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: id, size, source, source_size, target, copies and taken (copies times size)."""
    measured = staged(measure(docs, id_col, text_col, source_col), "mix_sizes")
    table, small = rates(measured, weights, most)
    return _copies(measured, table, small).select(
        F.col("id").alias(id_col),
        "size",
        "source",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, numbered by ``mix_copy`` from 1."""
    measured = staged(measure(docs, id_col, text_col, source_col), "mix_sizes")
    table, small = rates(measured, weights, most)
    unstaged(measured)
    row = docs.drop("mix_copy").select(F.struct("*").alias("_doc"))
    ident, text = F.col(f"_doc.`{id_col}`"), F.col(f"_doc.`{text_col}`")
    known = row.select(
        "_doc",
        F.col(f"_doc.`{source_col}`").cast("string").alias("source"),
        word_count(text).alias("size"),
        _key(ident, text).alias("key"),
    )
    counted = _copies(known, table, small).where("copies > 0")
    numbered = counted.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy"))
    return numbered.select("_doc.*", "mix_copy")
