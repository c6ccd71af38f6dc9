"""Base spans against Python's matcher; the weak labels on planted cases."""

import random
import re
import time

from pyspark.sql import functions as F

from alertsift.llm import pii


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def n_digits(text):
    return re.sub("[^0-9]", "", text)


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n_digits(m)) <= 19 and luhn(n_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n_digits(m)) <= 15),
)


def brute(text):
    found = []
    for k, (kind, pattern, good) in enumerate(PLAIN):
        found += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if good(m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


NONE = pii.Model({}, -50.0, {})


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@x.y", ".", "-", "+", "%", " ", "1", "25", "256", "007", "4111 1111 1111 1111", "(2)", "é", "😀", "\n", "1.2.3.4", "+1 (202) 555-0199"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + [None, "", "a@b.c%d@e.f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(df, NONE).select("doc_id", pii.listed(F.col("base")).alias("b"), pii.listed(F.col("spans")).alias("s")).collect():
        assert r.b == r.s == brute(texts[r.doc_id]), repr(texts[r.doc_id])


def test_long_runs_neither_overflow_nor_stall(spark):
    texts = ["a" * 120_000, "a." * 60_000 + "@", "x@" + "a." * 60_000 + "b", "1" * 120_000, "1 " * 60_000, "1." * 60_000, "+1" + "(" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = pii.find(df, pii.fit(df)).select("doc_id", F.size("base").alias("n")).collect()
    assert {r.doc_id: r.n for r in rows}[2] == 1


def test_many_spans_in_one_text(spark):
    mails = " ".join(f"a{k}@b.c" for k in range(20_000))
    tokens = " ".join(f"token {random.Random(k).randbytes(20).hex()} x{k}@y.org" for k in range(5_000))
    df = spark.createDataFrame([(1, mails), (2, tokens)] + [(k, "key = " + random.Random(k).randbytes(24).hex()) for k in range(10, 30)], "doc_id long, text string")
    start = time.time()
    found = pii.find(df, pii.fit(df)).withColumn("clean", pii.redact(F.col("text"), F.col("spans")))
    rows = {r.doc_id: r for r in found.collect()}
    assert time.time() - start < 60
    assert ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in rows[1].base) == brute(mails)
    assert rows[1].clean == " ".join(["[EMAIL]"] * 20_000)
    assert rows[2].clean.count("[EMAIL]") == 5_000 and rows[2].clean.count("[SECRET]") > 4_900


def overlapping_ones(base, added):
    return [a for a in added if not any(b[0] < a[2] and a[0] < b[2] for b in base)]


def test_apart_and_redact_equal_plain_loops(spark):
    rng, rows = random.Random(9), []
    for k in range(300):
        def some(place, kind, n):
            out = []
            for _ in range(n):
                start = rng.randrange(600)
                out.append((start, place, start + rng.randrange(1, 9), kind))
            return sorted(out)
        rows.append((k, "".join(rng.choice("ab é😀") for _ in range(700)), some(0, "email", k), some(4, "secret", rng.randrange(300))))
    span = "array<struct<start:int,place:int,stop:int,kind:string>>"
    df = spark.createDataFrame(rows, f"k long, text string, base {span}, added {span}")
    got = df.select("k", pii._apart(F.col("base"), F.col("added")).alias("free"), pii.redact(F.col("text"), F.col("base")).alias("clean"))
    for r in got.collect():
        _, text, base, added = rows[r.k]
        assert sorted(tuple(s) for s in r.free) == sorted(overlapping_ones(base, added))
        out, at = "", 0
        for start, _, stop, kind in base:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, stop)
        assert r.clean == out + text[at:]


def test_method_adds_spans_and_keeps_base(spark):
    plain = ["mail me at a.b@c.org or +1 (202) 555-0199 now", "nothing to see", "commit 0123456789abcdef0123456789abcdef01234567"]
    secret = [f'token = "{random.Random(k).randbytes(20).hex()}" end' for k in range(12)]
    texts = plain + secret
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = pii.find(df, pii.fit(df)).withColumn("clean", pii.redact(F.col("text"), F.col("spans"))).collect()
    for r in rows:
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
        assert ",".join(f"{s.kind}:{s.start}:{s.stop}" for s in r.base) == brute(r.text)
        if r.doc_id >= len(plain):
            assert [s.kind for s in r.spans] == ["secret"] and r.clean == 'token = "[SECRET]" end'
    assert rows[0].clean == "mail me at [EMAIL] or [PHONE] now" and rows[1].clean == texts[1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df, pii.fit(df)).count() == 0
