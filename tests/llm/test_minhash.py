"""Near-duplicates against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from alertsift.llm import minhash, sketch


def shingles(text, width):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= percent * either:
                a, b = sorted((part[i], part[j]))
                part = [a if p == b else p for p in part]
    return [(len(s), part[part[k]]) for k, s in enumerate(sets)]


def corpus(rng):
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randint(0, 40))
    texts = [None, "", " \n", "one", "ONE", "two words", "Two  Words", "É é", "a b c", "a b c d"]
    for size in (3, 7, 8, 30, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 16))):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy).title())
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    texts = corpus(random.Random(width))
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, kept long").repartition(4)
    rows = {r.doc_id: r for r in minhash.near_duplicates(df, width=width, percent=percent).collect()}
    want = brute(texts, width, percent)
    got = [(rows[k].n_shingles, rows[k].component_id) for k in range(len(texts))]
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_chain_that_no_leader_covers(spark, monkeypatch):
    """A sliding window of words: neighbours link, others do not, so one component is one long chain."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "SET_BLOCK", 2)
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 48, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.near_duplicates(df, width=3, percent=85).collect()
    assert sorted((r.n_shingles, r.component_id) for r in rows) == sorted(brute(texts, 3, 85))


def test_repeated_and_null_ids_and_empty(spark):
    data = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A b c d"), (9, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    rows = minhash.near_duplicates(df, width=3, percent=85).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows if r.doc_id is not None) == [
        ("5", 5, True), ("5", 5, True), ("7", 5, False), ("9", 9, True)
    ]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_unbiased_and_registers_hold_the_minimum():
    rng, errors = np.random.default_rng(1), []
    for _ in range(200):
        common, own = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, 200).astype(np.uint64)
        a = np.unique(sketch._mixed(np.concatenate([common, own[:100]])))
        b = np.unique(sketch._mixed(np.concatenate([common, own[100:]])))
        errors.append(sketch.estimate(sketch.registers(a)[None], sketch.registers(b)[None])[0] - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_repeated_ids_with_different_texts(spark):
    """Rows of one id are rows of their own: no link of any of them is lost, and none is gained."""
    rng = random.Random(8)
    texts = [t for t in corpus(rng) if shingles(t, 5)]
    ids = [rng.choice([1, 2, 3, 500 + k]) for k in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, node string").repartition(4)
    part = [p for _, p in brute(texts, 5, 80)]
    least = {p: min(ids[k] for k in range(len(texts)) if part[k] == p) for p in set(part)}
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted((i, len(shingles(t, 5)), least[p], i == least[p]) for i, t, p in zip(ids, texts, part, strict=True))
    stay = minhash.one_of_each(df)
    assert stay.columns == df.columns
    kept = [(r.doc_id, r.text) for r in stay.collect()]
    rows = list(zip(ids, texts, part, strict=True))
    want = [min((i, t) for i, t, q in rows if q == p) for p in set(part)]
    assert sorted(kept) == sorted(want)


def test_unique_text_under_a_repeated_id_stays(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (2, a), (2, b), (1, a), (None, b + " x"), (None, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(minhash.one_of_each(df).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, a), (2, b), (None, b + " x"), (None, None), (3, ""), (3, "")], key=lambda r: f"Row(doc_id={r[0]!r}, text={r[1]!r})")
    linked = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(spark.createDataFrame([(1, a), (1, b), (2, b + " x")], "doc_id long, text string")).collect()}
    assert linked[2, 57].component_id == 1 and not linked[2, 57].kept
