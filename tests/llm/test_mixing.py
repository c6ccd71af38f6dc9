import hashlib
import re

import pytest

from alertsift.llm import mixing

SCHEMA = "doc_id long, text string, source string, n_chars long, taken string, size int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, weights, most):
    """Targets by resharing the excess, in floats."""
    total, target, open_ = sum(sizes.values()), {}, dict(sizes)
    left = total
    while open_:
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if whole == 0 or left * weights[s] / whole >= most * sizes[s]]
        if not full:
            return target | {s: left * weights[s] / whole for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del open_[s]
    return target


def brute(rows, most=3):
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: k % 3 + 1 for k, s in enumerate(sources)}
    sizes = {s: sum(words(r[1]) for r in rows if r[2] == s) for s in sources}
    target, out = water(sizes, weights, most), []
    for s in sources:
        mine = [r for r in rows if r[2] == s]
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        base, cut = int(rate + 1e-12), (rate - int(rate + 1e-12)) * 2**32

        def draw(r, k):
            key = ("" if r[0] is None else str(r[0])) + "|" + hashlib.md5((r[1] or "").encode()).hexdigest()
            return int(hashlib.sha256(f"{k // 8}|{key}".encode()).hexdigest()[8 * (k % 8) :][:8], 16)

        taken = [[words(r[1]) * (base + (draw(r, k) < cut)) for r in mine] for k in range(mixing.DRAWS)]
        best = min(range(mixing.DRAWS), key=lambda k: (abs(target[s] - sum(taken[k])), k))
        out += [(r[0], words(r[1]), sizes[s], round(target[s], 6), t) for r, t in zip(mine, taken[best])]
    return sorted(out, key=str)


def rows_of(n, sources):
    made = []
    for k in range(n):
        source = sources[0] if k % 3 == 0 else sources[k % len(sources)]
        made.append((k, "w " * (k * 7919 % 83), source, k, "clash", 1))
    return made


CASES = {
    "mixed": rows_of(300, ["b", "é", None, "a", "", "Z", "c"])
    + [(None, "x y z", "a", None, None, None), (None, None, None, None, None, None), (5, "one two", "b", 1, "", 1), (5, "one two", "b", 1, "", 1)]
    + [(900, "long " * 30000, "b", 1, "", 1), (901, "\t\n ", "empty", 1, "", 1)],
    "capped": [(k, "t " * (400 if k < 5 else 2), "big" if k < 5 else f"s{k}", 0, "", 0) for k in range(12)],
    "no words": [(1, None, "a", 0, "", 0), (2, " ", None, 0, "", 0)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_equal_to_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.plan(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted([(r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got], key=str) == brute(rows)


def test_targets_are_met_and_no_document_is_overused(spark):
    rows = CASES["mixed"]
    got = mixing.plan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r.size for r in got))
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max((r.size for r in mine), default=0) + 1e-6


def test_large_table_of_rates_gives_the_same(spark, monkeypatch):
    rows = CASES["mixed"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small = sorted(map(str, mixing.plan(df).collect()))
    monkeypatch.setattr(mixing, "SMALL_SOURCES", 0)
    large = mixing.plan(df.repartition(2))
    assert sorted(map(str, large.collect())) == small


def test_mixed_rows_and_given_weights(spark):
    rows = CASES["mixed"]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("a", 5), (None, 1), ("b", 0), ("absent", 9)], "source string, weight long")
    planned = mixing.plan(df, weights)
    assert {r.source: r.target for r in planned.collect() if r.source in ("b", "c")} == {"b": 0.0, "c": 0.0}
    mixed = mixing.mix(df, weights)
    assert mixed.columns == [*df.columns, "mix_copy"]
    want = {}
    for r in planned.collect():
        if r.copies:
            want[(r.doc_id, r["size"], r.source)] = want.get((r.doc_id, r["size"], r.source), 0) + r.copies
    have = {}
    for r in mixed.collect():
        key = (r.doc_id, words(r.text), r.source)
        have[key] = have.get(key, 0) + 1
    assert have == want
    assert all(r.taken == "clash" or r.doc_id is None for r in mixed.collect() if r.doc_id not in (5, 900))
