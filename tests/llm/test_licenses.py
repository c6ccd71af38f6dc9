"""Licence scans against every line compared with every template."""

import random
import re
import textwrap

from alertsift.llm import licenses


def grams(text):
    w = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text))
    return set(zip(w, w[1:]))


def brute(text):
    units = list(enumerate(text.split("\n"), 1)) + ([(0, text)] if "\n" in text else [])
    out = []
    for line, unit in units:
        a, best = grams(unit), None
        for t in licenses.TEMPLATES:
            b = grams(t.text)
            if a and 20 * len(a & b) >= 7 * (len(a) + len(b)):
                rank = (-len(a & b) / (len(a) + len(b)), t.name)
                best = min(best, rank) if best else rank
        if best:
            out.append((line, best[1]))
    return sorted(out)


def test_equal_to_brute_force(spark):
    rng, texts = random.Random(6), ["", "\n", "license", "ALL RIGHTS RESERVED", "élicensed under the MIT licenseé"]
    for t in licenses.TEMPLATES:
        words = t.text.split(" ")
        for _ in range(12):
            w = [x for x in words if rng.random() > 0.15]
            for _ in range(rng.randint(0, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["foo", "the", "under", "version"]))
            texts.append(rng.choice(["", "head\n"]) + " ".join(w) + rng.choice(["", "\ntail line", "\n" + t.text]))
    texts += ["Released under the MIT License. " * 500, "\n".join(t.text for t in licenses.TEMPLATES[:4])]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, matches int").repartition(8)
    rows = licenses.scan(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert sorted((m.line, m.licence) for m in r.matches) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.licences == sorted({m.licence for m in r.matches})


def test_null_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, "All rights reserved."), (2, "All rights reserved.")], "doc_id long, text string")
    assert [r.licences for r in licenses.scan(df).orderBy("doc_id").collect()] == [[], ["Proprietary"], ["Proprietary"]]
    assert licenses.scan(df.limit(0)).count() == 0


def brute_notices(text):
    """All runs of words of all lengths that the size bound allows; of overlapping ones the closest."""
    w, runs = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)), []
    g = list(zip(w, w[1:]))
    for t in licenses.TEMPLATES:
        b = grams(t.text)
        for i in range(len(g)):
            for n in range(-(-7 * len(b) // 13), 13 * len(b) // 7 + 1):
                a = set(g[i : i + n])
                if i + n <= len(g) and 20 * len(a & b) >= 7 * (len(a) + len(b)):
                    runs.append((-len(a & b) / (len(a) + len(b)), -len(a & b), i, i + n - 1, t.name))
    kept = []
    for _, _, i, j, name in sorted(runs):
        if all(i > y or j < x for x, y, _ in kept):
            kept.append((i, j, name))
    return [(i + 1, j - i + 2, name) for i, j, name in sorted(kept)]


def test_wrapped_and_embedded_notices(spark):
    by_name = {}
    for t in licenses.TEMPLATES:
        by_name[t.name] = t.text  # the last of each name
    prose = "the tool reads packet captures and writes tables "
    wrapped = textwrap.fill(
        by_name["MIT"].rstrip(".") + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        80,
    )
    embedded = prose + "and so on. Released under the MIT License. Bugs go to the list, questions too, " + prose
    texts = [wrapped, embedded, prose * 3]
    texts += [prose + "\n" + textwrap.fill(t.text, 40, subsequent_indent=" * ") + "\n" + prose for t in licenses.TEMPLATES]
    texts.append(prose + by_name["GPL-3.0"] + " " + by_name["BSD"] + " All rights reserved. " + prose)
    rng = random.Random(7)
    for t in licenses.TEMPLATES:
        w = [x for x in t.text.split() if rng.random() > 0.12]
        w.insert(rng.randint(0, len(w)), rng.choice(["foo", "the", "under", "license"]))
        texts.append(prose + " ".join(w) + rng.choice([" ", "\n"]) + " ".join(w) + " " + prose)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = {r.doc_id: [(m.first_word, m.words, m.licence) for m in r.notices] for r in licenses.notices(df).collect()}
    assert rows == {k: brute_notices(t) for k, t in enumerate(texts)}
    licence = lambda k: [x[2] for x in rows[k]]
    assert (licence(0), licence(1), licence(2)) == (["MIT"], ["MIT"], [])
    for k, t in enumerate(licenses.TEMPLATES, 3):
        assert licence(k) == [t.name]
    assert licence(3 + len(licenses.TEMPLATES)) == ["GPL-3.0", "BSD", "Proprietary"]
    # Lines and whole texts alone miss both.
    assert not any(r.licences for r in licenses.scan(df.where("doc_id < 2")).collect())


def test_notices_null_blank_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "All rights reserved."), (3, "All rights reserved.")], "doc_id long, text string")
    rows = licenses.notices(df).orderBy("doc_id").collect()
    assert [[m.licence for m in r.notices] for r in rows] == [[], [], ["Proprietary"], ["Proprietary"]]
    assert licenses.notices(df.limit(0)).count() == 0
