"""Packing documents into full training sequences with a held mixture of sources.

Every source is a queue of documents. Queues are served by deficit round robin: in each round a
queue earns its share of a window of tokens, sends documents while its credit covers them, and
carries the rest (its deficit) on. So after k rounds a queue has sent all documents that end
within k times its quantum - a closed form in the document's end position in its queue, which a
distributed running sum gives. Deficits thus carry across rounds and partitions without a
sequential scheduler. The rounds in order form one stream, which is cut every ``length`` tokens:
no token is lost, and only the last sequence may be short.

Running sums are taken over ranges (hot sources span many), and only ids stay wide: they are
encoded once, written to the shared folder, and joined back to their places once.

Defined cases: a null text is one end token; a null source is a queue of its own; repeated rows
are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import small_batches, staged

LENGTH, WINDOW = 4096, 64 * 4096
TOGETHER = 200  # words that go to the library as one text
STRETCH = 4 << 20  # characters looked up at a time


class Known:
    """Texts met before, up to a bound, and their ids in arrays: text ``k`` has ``sizes[k]`` of them."""

    def __init__(self, limit: int):
        self.limit = limit
        self.places, self.sizes, self.ids = {"": 0}, np.zeros(1, np.int64), np.empty(0, "<u4")

    def find(self, asked: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of every asked text, sizes and ids of all places); ``learn`` gives sizes and ids of new texts."""
        if len(self.places) > self.limit:  # those met first stay: common texts are met early
            half = max(1, self.limit // 2)
            self.places, self.sizes = dict(islice(self.places.items(), half)), self.sizes[:half].copy()
            self.ids = self.ids[: int(self.sizes.sum())].copy()
        met = asked.dictionary_encode()
        texts = met.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.places.get, texts, repeat(-1)), np.int64, len(texts))
        sizes, ids = self.sizes, self.ids
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            short = np.fromiter(map(len, texts[unknown]), np.int64, len(unknown)) <= bpe.LONGEST_CACHED
            unknown = np.concatenate([unknown[short], unknown[~short]])
            new, kept = texts[unknown].tolist(), int(short.sum())
            places[unknown] = len(sizes) + np.arange(len(new))
            own, learnt = learn(new)
            sizes, ids = np.concatenate([sizes, own]), np.concatenate([ids, learnt])
            # Long texts are forgotten at once.
            self.places.update(zip(new[:kept], range(len(self.sizes), len(self.sizes) + kept)))
            self.sizes, self.ids = sizes[: len(self.sizes) + kept], ids[: len(self.ids) + int(own[:kept].sum())]
        return places[met.indices.to_numpy()], sizes, ids


def _spelt(places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids) of the texts at ``places``, one after the other."""
    own = sizes[places]
    ends = np.cumsum(own)
    shift = (np.cumsum(sizes) - sizes)[places] - (ends - own)
    return own, ids[np.repeat(shift, own) + np.arange(ends[-1] if len(ends) else 0)]


class LibraryEncoder(bpe.Encoder):
    """Encodes new words by the tokenizers library instead of the pair checks.

    The words of a batch go to the library as one text. The vocabulary marks the end of every
    word in its last token, which tells the words' ids apart again. Chunks are split and looked up
    in arrays; only those that are new and no plain words are taken apart one by one.
    """

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(file)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        mark = model["model"]["end_of_word_suffix"]
        self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(mark) or t in special]] = True
        self._start(special)

    def _start(self, special: dict[str, int]) -> None:
        super()._start(special)
        self.stretch = STRETCH
        self.words, self.chunks = Known(bpe.CACHED_WORDS), Known(bpe.CACHED_CHUNKS)

    def _encode_known(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()), "\n", " "), " ")
        sizes, ids = _spelt(*self.chunks.find(split.flatten(), self._learn))
        ends = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new chunks; their new words are encoded together."""
        chunks = pa.array(new, pa.string())
        low = pc.ascii_lower(chunks)
        body, last = pc.utf8_slice_codeunits(low, 0, -1), pc.utf8_slice_codeunits(low, -1)
        alone = pc.ascii_is_alpha(low)
        ended = pc.and_(pc.ascii_is_alpha(body), pc.is_in(last, value_set=pa.array(list(".,;:!?"))))
        rest = pc.invert(pc.or_(alone, ended))
        parts = [self._words_of(c) for c in chunks.filter(rest).to_pylist()]
        single, double, odd = (np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (alone, ended, rest))
        count = np.ones(len(chunks), np.int64)
        count[double], count[odd] = 2, [len(p) for p in parts]
        first = np.cumsum(count) - count
        words = [low.filter(alone), body.filter(ended), last.filter(ended), pa.array(list(chain.from_iterable(parts)), pa.string())]
        inner = np.repeat(first[odd] - np.cumsum(count[odd]) + count[odd], count[odd]) + np.arange(len(words[3]))
        places, sizes, ids = self.words.find(pa.concat_arrays(words), self._code)
        ordered = np.empty_like(places)
        ordered[np.concatenate([first[single], first[double], first[double] + 1, inner])] = places
        sizes, ids = _spelt(ordered, sizes, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ends[first + count] - ends[first], ids

    def _code(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [w[1:] if w[0] == "\0" and w[1:] in self.special_ids else w for w in new]
        texts = [" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        return np.diff(ends, prepend=0), ids


_MADE: dict[str, LibraryEncoder] = {}


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(_row, id, source, n, ids): the ids of each row with the end id, as 16-bit integers if they fit."""
    small_batches(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((path, f.read()))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = shared.value
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = LibraryEncoder(file)
        encoder, end = _MADE[name], np.array([end_id], "<u4").tobytes()
        waiting: deque[pd.DataFrame] = deque()

        def texts() -> Iterator[str | None]:
            for batch in batches:
                if len(batch):
                    waiting.append(batch)
                    yield from batch["text"]

        coded = encoder.encode_many(texts())  # a stretch spans batches
        while first := list(islice(coded, 1)):
            batch = waiting.popleft()
            ids = [np.frombuffer(b + end, "<u4") for b in chain(first, islice(coded, len(batch) - 1))]
            yield pd.DataFrame(
                {
                    "_row": batch["_row"],
                    "id": batch["id"],
                    "source": batch["source"],
                    "n": np.fromiter(map(len, ids), np.int64, len(ids)),
                    "ids": [_narrow(x) for x in ids],
                }
            )

    return docs.mapInPandas(encode, "_row long, id long, source string, n long, ids binary")


def _narrow(ids: np.ndarray) -> bytes:
    """A leading byte with the width, then the ids."""
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\4" + ids.tobytes()


@F.pandas_udf(T.BinaryType())
def _wide(ids: pd.Series, width: pd.Series) -> pd.Series:
    """Little-endian unsigned 32-bit ids."""
    return pd.Series([np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for x, w in zip(ids, width, strict=True)], dtype=object)


def _running(df: DataFrame, order: list[str], group: str | None) -> DataFrame:
    """``df`` ordered over ranges, with ``before``: the tokens ahead of the row (in its group).

    Adds ``total`` (of the group) and ``all``. The offsets have one row per range and group.
    """
    names = [f.name for f in df.schema.fields]

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: dict = {}
        for batch in batches:
            key = batch[group].fillna("\0") if group else pd.Series("", index=batch.index)
            local = batch["n"].groupby(key).cumsum() - batch["n"] + key.map(lambda g: carried.get(g, 0))
            for g, n in batch["n"].groupby(key).sum().items():
                carried[g] = carried.get(g, 0) + int(n)
            yield batch.assign(_local=local.astype(np.int64))

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _range int, _local long"
    summed = staged(ranged.mapInPandas(sum_up, schema), "running")
    groups = [group] if group else []
    parts = summed.groupBy("_range", *groups).agg(F.sum("n").alias("_sum"))
    own = Window.partitionBy(*[F.col(g) for g in groups])
    offsets = parts.select(
        F.col("_range").alias("_r"),
        *[F.col(g).alias("_g") for g in groups],
        F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(own).alias("total"),
    )
    same = F.col("_range") == F.col("_r")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_g"))
    return summed.join(offsets, same).select(*names, (F.col("_local") + F.col("_offset")).alias("before"), "total")


def rounds(queued: DataFrame, targets: Mapping[str | None, float] | None, window: int) -> DataFrame:
    """Add ``round``: the round in which deficit round robin sends the document.

    ``queued`` has source, n, before and total (of the source). Without ``targets`` a source's share is
    its share of all tokens, so all queues end together; with targets a queue that runs dry leaves
    its share to the others. A source without a target gets the least one given.
    """
    if targets:
        least = min(targets.values())
        weight = F.lit(float(least))
        for source, share in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), float(share)).otherwise(weight)
        quantum = weight / F.lit(float(sum(targets.values()))) * F.lit(float(window))
    else:
        whole = queued.agg(F.sum("n")).first()[0] or 1
        quantum = F.col("total") / F.lit(float(whole)) * F.lit(float(window))
    return queued.withColumn("round", (F.ceil((F.col("before") + F.col("n")) / quantum) - 1).cast("long"))


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    end_id: int = 2,
    length: int = LENGTH,
    window: int = WINDOW,
    targets: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, 32-bit), doc_tokens, round, sequence_id, offset.

    ``offset`` is the piece's place in its sequence, without gaps from 0; ``start`` its place in
    the document. ``path`` names a tokenizer file that the driver can read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.col(source_col).cast("string").alias("source"),
    )
    coded = staged(_encoded(rows, path, end_id), "ids")
    queued = _running(coded.select("source", "id", "_row", "n"), ["source", "id", "_row"], "source")
    sent = rounds(queued, targets, window).select("round", "source", "before", "_row", "n")
    placed = _running(sent.withColumnRenamed("before", "_queue"), ["round", "source", "_queue", "_row"], None)
    first = F.floor(F.col("at") / length)
    width = F.conv(F.hex(F.substring("ids", 1, 1)), 16, 10).cast("int")

    def piece(k):
        low = F.greatest(F.col("at"), k * length)
        size = F.least(F.col("at") + F.col("n"), (k + 1) * length) - low
        start = low - F.col("at")
        return F.struct(
            k.alias("sequence_id"),
            (low - k * length).alias("offset"),
            start.alias("start"),
            size.alias("length"),
            F.substr("ids", (start * F.col("width") + 2).cast("int"), (size * F.col("width")).cast("int")).alias("ids"),
        )

    at = placed.select("_row", "round", F.col("before").alias("at"))
    cut = (
        coded.join(at.hint("merge"), "_row")  # grows with the corpus, so it is not for broadcasting
        .withColumn("width", width)
        .select("id", "n", "width", "round", F.explode(F.transform(F.sequence(first, F.floor((F.col("at") + F.col("n") - 1) / length)), piece)).alias("p"))
    )
    return cut.select(
        F.col("id").alias(id_col),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        _wide("p.ids", "width").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "round",
        F.col("p.sequence_id").alias("sequence_id"),
        F.col("p.offset").alias("offset"),
    )
