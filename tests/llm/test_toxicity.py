"""Segments against their definition; the learnt score on held-out rows."""

import random

import pytest
from pyspark.sql import functions as F

from alertsift.llm import toxicity
from alertsift.llm.toxicity_query import held_out

SF_DIR = "/root/testdata/sf0.1"


def brute_segments(scores):
    """The best segment, then the same on what lies left and right of it."""
    def best(low, high):
        top = max(((sum(scores[a:b]), -(b - a), -a) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0))
        if top[0] <= 1e-12:
            return []
        a, n = -top[2], -top[1]
        return best(low, a) + [(a, a + n - 1, top[0])] + best(a + n, high)

    return best(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randint(0, 24)
        # Steps of 2^-k with distinct sums, so that no two segments tie.
        hits = [(k, 0.3 + rng.random() * rng.choice([1, 4])) for k in range(n) if rng.random() < 0.4]
        gain = dict(hits)
        want = brute_segments([gain.get(k, -toxicity.DRIFT) for k in range(n)])
        got = toxicity.segments(hits)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_lambda_makes_the_mean_one():
    import math

    import numpy as np

    rate = toxicity._lambda(np.array([2.0, 5.0]), np.array([30.0, 4.0]), 1000)
    mean = (30 * math.exp(2 * rate) + 4 * math.exp(5 * rate) + 966 * math.exp(-toxicity.DRIFT * rate)) / 1000
    assert abs(mean - 1) < 1e-6 and toxicity._lambda(np.array([]), np.array([]), 10) == 1.0


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~held_out(F.col("doc_id")))
    return toxicity.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"), labels)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model).join(spark.read.parquet(f"{SF_DIR}/labels.parquet"), "doc_id")
    rows = scored.select("score", "predicted", "toxic").toPandas()
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.predicted == 1).sum() > 0.9 and hit / (rows.toxic == 1).sum() > 0.85
    ranks = rows["score"].rank()
    bad, good = (rows.toxic == 1).sum(), (rows.toxic == 0).sum()
    assert (ranks[rows.toxic == 1].sum() - bad * (bad + 1) / 2) / bad / good > 0.93


def test_odd_texts_and_passages(spark, model):
    word = next(t[:-1] for t in sorted(model.terms) if t.endswith("$") and model.terms[t] > 5)
    texts = [None, "", "1 2 3", f"the {word} and", "of the and " * 40_000 + word]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)] * 2, "doc_id long, text string, score int")
    rows = sorted(toxicity.score(df, model).collect(), key=lambda r: r.doc_id)
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert rows[0].score == rows[2].score == rows[4].score and rows[0].passages == []
    assert [(p.first, p.last) for p in rows[6].passages] == [(1, 1)] and rows[6].score > rows[0].score
    assert toxicity.score(df.limit(0), model).count() == 0


def test_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None), (None, 1)], [(1, 0)]):
        model = toxicity.learn(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]
