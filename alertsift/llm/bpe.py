"""BPE encoding and decoding for vocabularies with word ends, by speculation and verification.

A text splits at blanks into chunks, and a chunk into words. For a word never seen before, the
greedy longest match proposes tokens. The proposal is the true encoding if every adjacent pair
of tokens is *compatible*: undoing the merges of both tokens from the last to the first, no
merge across their border would have come earlier. All pairs of a batch are tested at once in
arrays; only words with an incompatible pair are merged step by step, with a heap. Encodings
are kept per worker in a table of bounded size, since words repeat.

The vocabulary file is read on the driver; its tables (a few MB, of the size of the
vocabulary) are broadcast, so executors need no file.

Defined cases: a null text has no ids (``encode``) and decodes to an empty text; texts of any
length are encoded in stretches of bounded size; repeated rows are encoded each on its own;
an ``ids`` or ``decoded`` column of the input is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, filterfalse, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

STRETCH = 1 << 20  # characters encoded at a time
CACHED_WORDS, CACHED_CHUNKS = 400_000, 700_000
LONGEST_CACHED = 32
SHORT = 48  # symbols up to which merges are found by scanning
_NEVER = np.iinfo(np.int64).max

# The white space and the word pattern of the vocabulary's format.
SPACE = "\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, their merges as arrays, and which tokens a longest match may propose."""

    def __init__(self, text: str):
        model = json.loads(text)
        ids: dict[str, int] = model["model"]["vocab"]
        self.end = model["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max(*ids.values(), *self.special.values())
        self.tokens = [""] * size
        for token, k in (ids | self.special).items():
            self.tokens[k] = token
        self.size = size
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.pair_rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            whole = ids[a + b]
            if self.rank[whole] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.rank[whole], self.left[whole], self.right[whole] = r, ids[a], ids[b]
            self.pair_rank[ids[a], ids[b]] = (r, whole)
        self.rank_of = {a * size + b: r for (a, b), (r, _) in self.pair_rank.items()}
        self.whole = [whole for _, whole in self.pair_rank.values()]  # by rank, as merges are listed
        keys = np.array([a * size + b for a, b in self.pair_rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.pair_rank.values()], np.int64)[order]
        # A token is proposed only if its own text is encoded as that one token.
        made = np.flatnonzero(self.rank >= 0)
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        sound = self.rank < 0
        for k, ok in sorted(zip(made.tolist(), whole.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            sound[k] = ok and sound[self.left[k]] and sound[self.right[k]]
        self.ids = {t: k for t, k in ids.items() if sound[k]}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self.base = ids
        self.reach: dict[str, int] = {}  # the length of the longest token without an end, by its first two letters
        for t in self.ids:
            if not t.endswith(self.end):
                self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair: does no merge across its border come before ``limit`` and their own merges?"""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER) if limit is None else limit.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossing = np.where(self.keys[at] == key, self.key_ranks[at], _NEVER)
            broken = crossing < limit[open_]
            good[open_[broken]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            first = rank_x > rank_y  # the later merge is undone first; of equal ones the right
            a[open_] = np.where(first, self.right[x], x)
            b[open_] = np.where(first, y, self.left[y])
            limit[open_] = np.where(first, rank_x, rank_y + 1)
            open_ = open_[~broken & (np.maximum(rank_x, rank_y) >= 0)]
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` is in byte letters, without its end mark."""
        get, n, at, out = self.ids.get, len(word), 0, []
        while at < n:
            stop = n
            token = get(word[at:] + self.end) if n - at <= self.longest else None
            if token is None:
                stop = min(n - 1, at + self.reach.get(word[at : at + 2], 1))
                while stop > at and (token := get(word[at:stop])) is None:
                    stop -= 1
            out.append(token)
            at = stop
        return out

    def merge(self, word: str) -> list[int]:
        """The exact encoding: always the earliest merge, of equal ones the leftmost."""
        part = [self.base[c] for c in word[:-1]] + [self.base[word[-1] + self.end]]
        if len(part) <= SHORT:
            return self._merge_short(part)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(*self.pair_rank[p], k) for k, p in enumerate(zip(part, part[1:])) if p in self.pair_rank]
        heap = [(r, k, whole) for r, whole, k in heap]
        heapq.heapify(heap)
        while heap:
            r, k, whole = heapq.heappop(heap)
            nxt = after[k]
            if part[k] < 0 or nxt >= len(part) or self.pair_rank.get((part[k], part[nxt])) != (r, whole):
                continue
            part[k], part[nxt] = whole, -1
            after[k] = after[nxt]
            if after[k] < len(part):
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < len(part) and (found := self.pair_rank.get((part[left], part[right]))):
                    heapq.heappush(heap, (found[0], left, found[1]))
        return [p for p in part if p >= 0]

    def _merge_short(self, part: list[int]) -> list[int]:
        """The same for a few symbols, where scanning all ranks beats a heap."""
        size, rank_of = self.size, self.rank_of
        ranks = [rank_of.get(a * size + b, _NEVER) for a, b in zip(part, part[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            k = ranks.index(least)
            part[k] = self.whole[least]
            del part[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of.get(part[k - 1] * size + part[k], _NEVER)
            if k < len(ranks):
                ranks[k] = rank_of.get(part[k] * size + part[k + 1], _NEVER)
        return part


class Encoder:
    """Encodes texts with one vocabulary; keeps what it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self._start(vocabulary.special)

    def _start(self, special: dict[str, int]) -> None:
        self.special_ids, self.stretch = special, STRETCH
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        names = sorted(special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _words_of(self, chunk: str) -> list[str]:
        """The words of a chunk; a special token stays whole, marked by a leading NUL."""
        if self.special is not None and "<" in chunk and self.special.search(chunk):
            out = []
            for piece in self.special.split(chunk):
                out += ["\0" + piece] if piece in self.special_ids else self._words_of(piece) if piece else []
            return out
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        low = chunk.lower() if "Σ" not in chunk else "".join(c.lower() for c in chunk)
        if low.isalpha():
            return [low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return WORD.findall(low)

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Encodings of new chunks; their new words are encoded together."""
        split = {c: self._words_of(c) for c in chunks}
        if len(self.words) > CACHED_WORDS:
            self.words = _older_half(self.words, CACHED_WORDS)
        known = self.words
        new = list({w for words in split.values() for w in words if w not in known})
        packed, ends = self._code(new)
        known.update((w, packed[a:b]) for w, a, b in zip(new, [0, *ends], ends))
        learnt = {c: known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words)) for c, words in split.items()}
        for w in new:
            if len(w) > LONGEST_CACHED:
                del known[w]
        return learnt

    def _code(self, new: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all words in a row, and where each word ends in bytes.

        Words are proposed, verified together, and merged if need be.
        """
        letter, special = self.letters.__getitem__, self.v.special
        # Printable ASCII stands for itself.
        spelt = [w if w.isascii() and w.isprintable() else "".join(map(letter, w.encode("utf-8", "replace"))) for w in new]
        proposals = [
            [special[w[1:]]] if w[0] == "\0" and w[1:] in special else self.v.propose(s) for w, s in zip(new, spelt, strict=True)
        ]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(proposals)), sizes)
        inner = np.flatnonzero(word_of[:-1] == word_of[1:]) if len(flat) else np.empty(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.v.size + flat[inner + 1], return_inverse=True)
        good = self.v.compatible(pairs // self.v.size, pairs % self.v.size)[back]
        for k in np.unique(word_of[inner[~good]]):
            proposals[k] = self.v.merge(spelt[k])
        packed = np.fromiter(chain.from_iterable(proposals), "<u4").tobytes()
        return packed, np.cumsum([4 * len(p) for p in proposals]).tolist()

    def _stretches(self, text: str) -> Iterator[str]:
        """Cuts at a blank or line feed, so no chunk is cut."""
        at = 0
        while at < len(text):
            stop = at + self.stretch
            if stop < len(text):
                ends = [p for p in (text.find(" ", stop), text.find("\n", stop)) if p >= 0]
                stop = min(ends, default=len(text))
            yield text[at:stop]
            at = stop

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(self._encode_known([s])[0] for s in self._stretches(text or ""))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The same for many texts; new chunks are learnt for several texts at once."""
        window: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if window and size + len(text) > self.stretch:
                yield from self._encode_known(window)
                window, size = [], 0
            if len(text) > self.stretch:
                yield self.encode(text)
            else:
                window.append(text)
                size += len(text)
        yield from self._encode_known(window)

    def _ready(self, texts: list[str]) -> tuple[list[list[str]], set[str]]:
        """The chunks of the texts, all of them known now, and those that are new."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._make_room()
        missing = set(filterfalse(self.chunks.__contains__, chain.from_iterable(split)))
        if missing:
            self._store(self._learn(missing))
        return split, missing

    def _make_room(self) -> None:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks = _older_half(self.chunks, CACHED_CHUNKS)

    def _store(self, learnt: dict[str, bytes]) -> None:
        self.chunks.update(learnt)

    def _forget(self, chunks: set[str]) -> None:
        for c in chunks:
            if len(c) > LONGEST_CACHED:
                del self.chunks[c]

    def _encode_known(self, texts: list[str]) -> list[bytes]:
        split, missing = self._ready(texts)
        get = self.chunks.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        self._forget(missing)
        return out


def _older_half(table: dict, limit: int) -> dict:
    """The entries met first: common words are met early, so they outlast a full table."""
    return dict(islice(table.items(), max(1, limit // 2)))


class RoundTrip(Encoder):
    """Encodes and decodes at once: per chunk the table holds its ids and its tokens as texts."""

    def _start(self, special: dict[str, int]) -> None:
        super()._start(special)
        self.chunks, self.shown = {"": ""}, {"": ""}

    def _make_room(self) -> None:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks, self.shown = _older_half(self.chunks, CACHED_CHUNKS), _older_half(self.shown, CACHED_CHUNKS)

    def _store(self, learnt: dict[str, bytes]) -> None:
        tokens = self.v.tokens
        for chunk, packed in learnt.items():
            ids = np.frombuffer(packed, "<u4").tolist() if len(packed) != 4 else [int.from_bytes(packed, "little")]
            self.chunks[chunk] = "".join([f"{k} " for k in ids])
            self.shown[chunk] = "".join([tokens[k] + " " for k in ids])

    def _forget(self, chunks: set[str]) -> None:
        for c in chunks:
            if len(c) > LONGEST_CACHED:
                del self.chunks[c], self.shown[c]

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Per text: the number of its ids, and the SHA-256 of its ids and of its decoded text."""
        window: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if window and size + len(text) > STRETCH:
                yield from self._digests_of(window)
                window, size = [], 0
            if len(text) > STRETCH:
                yield self._long(text)
            else:
                window.append(text)
                size += len(text)
        yield from self._digests_of(window)

    def _digests_of(self, texts: list[str]) -> list[tuple[int, str, str]]:
        split, missing = self._ready(texts)
        out = []
        for chunks in split:
            ids, shown = ("".join(map(t.__getitem__, chunks)) for t in (self.chunks, self.shown))
            out.append((ids.count(" "), *(sha256(s[:-1].encode()).hexdigest() for s in (ids, shown))))
        self._forget(missing)
        return out

    def _long(self, text: str) -> tuple[int, str, str]:
        """The same by stretches, each ended by the blank before the next."""
        n, sums = 0, (sha256(), sha256())
        for stretch in self._stretches(text):
            (chunks,), missing = self._ready([stretch])
            for own, known in zip(sums, (self.chunks, self.shown), strict=True):
                said = "".join(map(known.__getitem__, chunks))
                if said:
                    own.update(((" " if n else "") + said[:-1]).encode())
            n += sum(self.chunks[c].count(" ") for c in chunks)
            self._forget(missing)
        return n, *(s.hexdigest() for s in sums)


_MADE: dict[tuple, Encoder] = {}


def encoder_of(shared, kind: type[Encoder] = Encoder) -> Encoder:
    """This worker's encoder for a broadcast (name, vocabulary); one is held at a time."""
    name, vocabulary = shared.value
    if (name, kind) not in _MADE:
        _MADE.clear()
        _MADE[name, kind] = kind(vocabulary)
    return _MADE[name, kind]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read())


def share(spark: SparkSession, path: str):
    """Broadcast the vocabulary of a file that the driver can read."""
    return spark.sparkContext.broadcast((path, load_vocabulary(path)))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every text as an array of integers."""
    shared = share(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        encoder = encoder_of(shared)
        return pd.Series([np.frombuffer(b, "<i4") for b in encoder.encode_many(texts)], dtype=object)

    return docs.withColumn(out, ids_of(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of every array of ids: its tokens, joined by blanks."""
    shared = share(docs.sparkSession, path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def text_of(rows: pd.Series) -> pd.Series:
        tokens = encoder_of(shared).v.tokens
        return pd.Series([" ".join(map(tokens.__getitem__, r.tolist())) if r is not None else "" for r in rows], dtype=object)

    return docs.withColumn(out, text_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (see ``RoundTrip.digests``) of every text.

    Encodes, decodes and digests in one step, so no ids leave the worker.
    """
    shared = share(docs.sparkSession, path)
    small_batches(docs.sparkSession)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(encoder_of(shared, RoundTrip).digests(texts)), columns=list(names))

    marked = docs.withColumn("_coded", digests(F.col(text)))
    return marked.withColumns({n: F.col(f"_coded.{n}") for n in names}).drop("_coded")
