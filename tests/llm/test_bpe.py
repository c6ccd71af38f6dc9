"""The BPE encoder against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from alertsift.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
PIECES = (
    "a b 's 'll \x0b \x1c É é Σ σ ς İ ß ǅ 1 ² ½ ! ... <|endoftext|> <| |> 😀 한 中 the ing A Th ﬁ".split(" ")
    + [" ", "\n", "\t", "\x85", "\xa0", " ", "　", "​", "é", "\0", "한"]
)


def want(text):
    return REF.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library_on_odd_texts():
    encoder, rng = bpe.Encoder(bpe.load_vocabulary(PATH)), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want(text), repr(text)
    for _ in range(1000):
        word = "".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(1, 80)))
        assert np.frombuffer(encoder.encode(word), "<u4").tolist() == want(word), word


def test_long_word_and_stretches():
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for text in ("a" * 30_000 + "b", "the cat, " * 200_000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want(text)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 7)
    encoder = bpe.Encoder(bpe.load_vocabulary(PATH))
    for text in ("some words, some more words and again some words", "Hello hello HELLO", "one two three four five six seven eight nine"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want(text)


def test_verified_pairs_are_exactly_the_stable_ones():
    v, rng = bpe.load_vocabulary(PATH), random.Random(5)
    names = [t for t in v.ids if not t.endswith(v.end)]
    ends = [t for t in v.ids if t.endswith(v.end)]
    a = np.array([v.ids[rng.choice(names)] for _ in range(3000)])
    b = np.array([v.ids[rng.choice(ends)] for _ in range(3000)])
    good = v.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        word = v.tokens[x] + v.tokens[y].removesuffix(v.end)
        assert (v.merge(word) == [x, y]) == ok


def test_columns(spark):
    texts = [None, "", "Été, the cat's 12 mats<|endoftext|>x", "the the the"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)] * 2, "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(rows) == 8
    for r in rows:
        ids = want(texts[r.doc_id])
        assert list(r.ids) == ids and r.decoded == REF.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def digests(text):
    ids = want(text)
    sums = (" ".join(map(str, ids)), REF.decode(ids, skip_special_tokens=False))
    return len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in sums)


def test_round_trip_digests(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(800)] + [None, "", " ", "x" * 50 + " y"]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(df, PATH).collect()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sorted(rows, key=lambda r: r.doc_id)] == [digests(t) for t in texts]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
    monkeypatch.setattr(bpe, "STRETCH", 30)
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 9)
    long = ["the cat, " * 20, "   " * 30, "a" * 100 + "  b\n" * 40, "short"] + texts[:50]
    coder = bpe.RoundTrip(bpe.load_vocabulary(PATH))
    assert list(coder.digests(long)) == [digests(t) for t in long]
