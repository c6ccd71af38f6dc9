import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertsift.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score long"


def quantised(vector):
    return [math.floor(Fraction(x) * 256) for x in vector]


def brute(rows, positives=5, count=10, low=30, high=90, step=100):
    good = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good[(vec_id, label, tuple(vector))] = quantised(vector)
    out = []
    for me, mine in good.items():
        if me[0] % step:
            continue
        scored = [
            (-min(max(sum(a * b for a, b in zip(mine, q)), -(2**63)), 2**63 - 1), k[0], k[1])
            for k, q in good.items()
            if k != me and len(k[2]) == len(me[2])
        ]
        scored.sort()
        for score, pos, _ in [s for s in scored if s[2] == me[1]][:positives]:
            fit = [s for s in scored if s[2] != me[1] and score <= 0 and low * -score <= 100 * -s[0] <= high * -score][:count]
            out += [(me[0], pos, r, s[1], -score, -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def planted(seed, size, n=400):
    """Few distinct values, so that scores tie often; a hot label holds half of the rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-2, 3, size=(n, size)) / 8
    return [(k, v.tolist(), 0 if k % 2 else int(rng.integers(0, 4))) for k, v in enumerate(vectors)]


ODD = [
    (1000, None, 1), (1100, [1.0, None], 1), (1200, [float("nan"), 1.0], 1), (1300, [float("inf"), 0.0], 1),
    (None, [1.0, 1.0], 1), (1400, [1.0, 1.0], None), (1500, [], 1), (1501, [], 2), (1502, [], 1), (1600, [0.5, 0.5], 1),
    (1601, [0.5, 0.5], 1), (1602, [0.25, 0.25], 2), (1603, [0.25, 0.25], 2), (1603, [0.25, 0.25], 2),
    (1700, [0.0, 0.0], 3), (1701, [0.0, 0.0], 3), (5, [0.0, 0.0], 4), (1800, [-0.0, 1e-9], 5),
    (2000, [1e300, 1.0], 6), (2001, [1e300, 2.0], 6), (2002, [1e299, 3.0], 7), (2100, [3e8, 1.0], 6), (2101, [2e8, 1.0], 7),
]


@pytest.mark.parametrize("size", [2, 7])
def test_equal_to_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK", 400)
    rows = planted(size, size, 250) + ODD
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows) == want


def test_other_counts_and_windows(spark):
    rows = planted(3, 5)
    assert run(spark, rows, positives=2, negatives=3, low=100, high=100) == brute(rows, 2, 3, 100, 100)
    assert run(spark, rows, positives=7, negatives=40, low=-50, high=99) == brute(rows, 7, 40, -50, 99)


def test_equal_rows_count_once_even_if_many(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)] + [(2, [0.5, 0.0], 2)] * 3000 + [(3, [0.5, 0.0], 2)]
    assert run(spark, rows) == [(100, 1, 1, 2, 65536, 32768), (100, 1, 2, 3, 65536, 32768)]


def test_empty_table_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []


def test_windows_above_the_positive_are_refused(spark):
    with pytest.raises(ValueError):
        run(spark, [(100, [1.0], 1)], high=101)


def test_scores_are_exact():
    a, b = np.array([[1e15, -3.5], [0.1, 2**40]]), np.array([[1e15 + 1, 7.0], [-(2.0**62), 1.0]])
    want = [[min(max(sum(x * y for x, y in zip(quantised(u), quantised(v))), -(2**63)), 2**63 - 1) for v in b] for u in a]
    assert negatives.scores(a, b).tolist() == want


def test_key_order_is_the_sort_order():
    rng = np.random.default_rng(1)
    made = []
    for _ in range(300):
        anchor, row = rng.integers(-3, 3, 3), rng.integers(-3, 3, (1, 3))
        score, negative = rng.choice([-(2**63), -5, 0, 7, 2**63 - 1]), bool(rng.integers(2))
        key = negatives.pack(anchor, np.array([score]), negative, row)[0].as_py()
        assert negatives.unpack(key) == (tuple(anchor), score, negative, row[0, 0])
        made.append((key, (tuple(anchor), -int(score), negative, tuple(row[0]))))
    assert [k for k, _ in sorted(made)] == [k for k, _ in sorted(made, key=lambda m: m[1])]
