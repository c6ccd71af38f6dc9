"""Vector near-duplicates against all pairs in double precision."""

import numpy as np
import pytest

from alertsift.llm import vectors


def brute(data, cosine):
    ids = [k for k, _ in data]
    good = {}
    for row, (_, v) in enumerate(data):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[row] = x / np.linalg.norm(x)
    part, degree = list(ids), [0] * len(data)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                degree[a] += 1
                degree[b] += 1
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    return [(ids[k], degree[k], part[k]) for k in range(len(data))]


def near(rng, base, cosine):
    """A vector at about the given cosine from ``base``."""
    other = rng.normal(size=len(base))
    other -= other @ base * base / (base @ base)
    return base / np.linalg.norm(base) * cosine + other / np.linalg.norm(other) * np.sqrt(1 - cosine**2)


@pytest.mark.parametrize("size", [1, 3, 16, 64])
def test_equal_to_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "PIECE", 40)
    monkeypatch.setattr(vectors, "_ROWS", 7)
    rng, data = np.random.default_rng(size), []
    for group in range(8):
        base = rng.normal(size=size)
        data.append(base * rng.uniform(0.1, 9))
        for k in range(12):
            data.append(near(rng, base, 0.9275 + 0.005 * k) if size > 1 else base * rng.choice([-1.0, 2.0]))
    rows = [(k, [float(x) for x in np.atleast_1d(v)]) for k, v in enumerate(data)]
    rows += [(900, None), (901, []), (902, [0.0] * size), (903, [float("nan")] * size), (904, [None] * size), (905, [float("inf")] + [1.0] * (size - 1))]
    rows += [(906, rows[3][1]), (907, rows[3][1]), (908, [1.0] * (size + 1))]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rep int").repartition(3)
    got = vectors.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows, 0.95))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_hot_group_is_complete(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 64)
    rng = np.random.default_rng(0)
    base = rng.normal(size=32)
    rows = [(k, [float(x) for x in base + rng.normal(size=32) * 0.05]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vectors.near_duplicates(df).collect()
    assert {r.component_id for r in got} == {0} and {r.n_links for r in got} == {299}


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_thin_slab_beside_a_crowded_one(spark, monkeypatch):
    """A few homes whose neighbours crowd the next slab: either side is cut by its own count."""
    monkeypatch.setattr(vectors, "PIECE", 25)
    monkeypatch.setattr(vectors, "_ROWS", 4)
    rng, size = np.random.default_rng(5), 16
    turn = vectors.rotation(size)
    width = 2 * (np.sqrt(vectors.budgets(size, 0.95)[0]) + 1e-9)
    data = []
    for k in range(240):
        point = rng.normal(size=size) * 0.05
        point[0] = -0.01 if k < 3 else width * rng.uniform(0, 0.4)
        point[5] = 1.0
        data.append(turn @ point)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = vectors.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows, 0.95))


def test_cells_lose_no_pair_within_reach():
    rng = np.random.default_rng(6)
    part = np.concatenate([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(3, 3)), 60, axis=0)])
    home, guest = np.flatnonzero(rng.random(480) < 0.7), np.flatnonzero(rng.random(480) < 0.8)
    met = {(i, j) for rows, others in vectors._cells(part, home, guest, 0.4) for i in rows for j in others}
    near = {(i, j) for i in home for j in guest if np.linalg.norm(part[i] - part[j]) <= 0.4}
    assert near <= met and len(met) < 0.6 * len(home) * len(guest)
    assert sum(len(rows) for rows, _ in vectors._cells(part, home, guest, 9.0)) == len(home)


def test_the_quotient_decides_at_the_border(spark):
    """Pairs at the threshold to the last bit: what the stated formula gives counts."""
    rng, rows = np.random.default_rng(7), []
    for k in range(40):
        a, b = rng.normal(size=8), rng.normal(size=8)
        b -= a * (a @ b) / (a @ a)
        b = 0.95 * a / np.linalg.norm(a) + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, b.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    for k in range(40):
        a, b = (np.array(rows[2 * k + i][1]) for i in (0, 1))
        quotient = np.einsum("i,i->", a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
        if abs(quotient - 0.95) > 3e-16:
            assert (got[2 * k] > 0) == (quotient >= 0.95)
