"""Packing: every id once, no gap, and the mixture held."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from alertsift.llm import packing, packing_query

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)


def docs(spark, n=300):
    rows = [(k, " ".join(f"w{k} text number {j}" for j in range(k % 41)), "hot" if k % 3 == 0 else f"s{k % 5}", "x") for k in range(n)]
    rows += [(n, None, None, "x"), (n + 1, "", "s1", "x"), (7, "again", "s2", "x"), (None, "no id", "s2", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, ids string").repartition(5)


def check(rows, pieces, length):
    want = defaultdict(list)
    for key, text, *_ in rows:
        want[key].append(REF.encode(text or "", add_special_tokens=False).ids + [2])
    got = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length > 0 and p.offset + p.length <= length
        got[p.doc_id].append((p.doc_tokens, p.start, ids.tolist()))
    for key, texts in want.items():
        if len(texts) == 1:
            parts = sorted(got[key])
            assert sum((p[2] for p in parts), []) == texts[0]
            assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:k]) for k in range(len(parts))]
    assert sum(map(len, sum(want.values(), []))) == sum(p.length for p in pieces)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))]
        assert k == max(sequences) or sum(n for _, n in parts) == length


def test_every_id_once_and_full_sequences(spark):
    rows, df = docs(spark)
    pieces = packing.pack(df, PATH, length=256, window=1024).collect()
    check(rows, pieces, 256)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_deficits_hold_the_mixture(spark):
    rows, df = docs(spark)
    sizes, source = {}, {k: s for k, _, s, _ in rows}
    rounds = defaultdict(lambda: defaultdict(int))
    for p in packing.pack(df, PATH, length=256, window=4096).collect():
        sizes[p.doc_id] = p.doc_tokens
        rounds[p.round][source[p.doc_id]] += p.length
    total = defaultdict(int)
    for k in rounds:
        for s, n in rounds[k].items():
            total[s] += n
    whole, sent, longest = sum(total.values()), defaultdict(int), max(sizes.values())
    for k in sorted(rounds):
        for s in total:
            sent[s] += rounds[k][s]
            assert -1 <= min(total[s], (k + 1) * 4096 * total[s] / whole) - sent[s] <= longest + 1  # the deficit


def test_targets(spark):
    rows, df = docs(spark)
    pieces = packing.pack(df, PATH, length=256, window=2048, targets={"hot": 0.8, "s1": 0.05}).collect()
    check(rows, pieces, 256)
    source = {k: s for k, _, s, _ in rows}
    first = [p for p in pieces if p.round <= 1]
    share = sum(p.length for p in first if source[p.doc_id] == "hot") / sum(p.length for p in first)
    assert share > 0.6


def test_query_checksums(spark):
    _, df = docs(spark, 20)
    pieces = packing.pack(df, PATH).collect()
    sums = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing_query.digest(packing.pack(df, PATH)).collect()}
    assert len(sums) == len(pieces)
    assert all(sums[p.sequence_id, p.offset] == zlib.crc32(bytes(p.ids)) for p in pieces)


def test_library_encoder_equals_the_library():
    import random

    from test_bpe import PIECES

    with open(PATH, encoding="utf-8") as f:
        encoder = packing.LibraryEncoder(f.read())
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, got in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == REF.encode(text, add_special_tokens=False).ids, repr(text)


def library_encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.LibraryEncoder(f.read())


def test_plain_words_are_looked_up_together(monkeypatch):
    """Only new chunks that are no plain words are taken apart one by one, and repeats of a stretch count once."""
    taken = []
    encoder = library_encoder()
    monkeypatch.setattr(encoder, "_words_of", lambda chunk, own=encoder._words_of: taken.append(chunk) or own(chunk))
    texts = ["Plain words, said twice. x-1 café\nPlain end", "words, x-1 <|im_end|> more!"] * 5
    for text, got in zip(texts, encoder.encode_many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == REF.encode(text, add_special_tokens=False).ids
    assert sorted(set(taken)) == sorted(["x-1", "café", "<|im_end|>"]) and taken.count("x-1") == 1


def test_full_tables_and_short_stretches(monkeypatch):
    """Tables that overflow, long chunks that are forgotten and texts beyond a stretch change no id."""
    from test_bpe import PIECES

    monkeypatch.setattr("alertsift.llm.bpe.CACHED_WORDS", 5)
    monkeypatch.setattr("alertsift.llm.bpe.CACHED_CHUNKS", 7)
    monkeypatch.setattr(packing, "STRETCH", 40)
    encoder = library_encoder()
    texts = ["", None, "a" * 90 + " b", *[f"{p} w{k} {'long' * 12} {p}{k}, x\n\ny" for k, p in enumerate(PIECES * 3)], " ".join(PIECES * 4)]
    for _ in range(2):
        for text, got in zip(texts, encoder.encode_many(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == REF.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_stretches_span_batches(spark):
    """Rows keep their own ids where one stretch takes many batches, and empty partitions give none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows, df = docs(spark, 50)
        check(rows, packing.pack(df, PATH, length=256, window=1024).collect(), 256)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
