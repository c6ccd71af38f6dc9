import hashlib
import random
import re
import time
from itertools import product

import pytest
from pyspark.sql import functions as F

from alertsift.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, blank int"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        blank, again = not words, (role, text) in seen
        out.append((role, text, blank, again, not blank and words[-1] not in ".!?"))
        seen.add((role, text))
    return out


def step(options, rows):
    """All (cost, audit, turns) after one more row, with up to two insertions behind it, from plain strings."""
    for cost, audit, turns in options:
        for role, text, blank, again, cut in rows:
            yield cost + 3, audit + "D", turns
            if not (blank or again):
                if role:  # an empty role has no initial and cannot be kept
                    yield cost + cut, audit + "K", turns + ((role, text),)
                for name in ("user", "assistant"):
                    yield cost + 2 + cut, audit + "R", turns + ((name, text),)


def inserted(options, most=2):
    for cost, audit, turns in options:
        for k in range(most + 1):
            for names in product(("user", "assistant"), repeat=k):
                yield cost + 2 * k, audit + "I" * k, turns + tuple((n, "") for n in names)


def exhaustive(rows):
    """Every list of edits of a short conversation; illegal beginnings are left out as soon as they show."""
    legal = lambda o: [x for x in o if re.fullmatch(r"(s?(ua)*u?)?", "".join(r[:1] for r, _ in x[2]))]
    options = legal(inserted([(0, "", ())]))
    for row in faults(rows):
        options = legal(inserted(legal(step(options, [row]))))
    ended = [x for x in options if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in x[2]))]
    return min(ended)


def plain(rows):
    """The same by the least (cost, audit) string per last turn, for longer conversations."""
    kind = lambda turns: turns[-1][0][:1] if turns else ""
    keep = lambda o: {k: min(x for x in o if kind(x[2]) == k) for k in {kind(x[2]) for x in o}}.values()
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    legal = lambda o: [
        x for x in o if len(x[2]) < 2 and "".join(r[:1] for r, _ in x[2]) in ("", "s", "u") or len(x[2]) > 1 
        and x[2][-1][0][:1] in follows[x[2][-2][0][:1]]
    ]
    options = keep(legal(inserted([(0, "", ())])))
    for row in faults(rows):
        options = keep(legal(inserted(keep(legal(step(options, [row]))))))
    return min(x for x in options if kind(x[2]) in ("", "a"))


def run(rows):
    audit = repair.Audit()
    for role, text, blank, again, cut in faults(rows):
        audit.row(role, text, blank or again, cut)
    return audit.result()


def digest(turns):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def conversation(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "agent", " "]
    return [(rng.choice(roles), rng.choice(["", " ", "a.", "b", "c!", "d", "e?", f"{rng.random()}."])) for _ in range(n)]


def test_equal_to_all_lists_of_edits():
    rng = random.Random(1)
    for k in range(60):
        rows = conversation(rng, k % 4)
        cost, audit, turns = exhaustive(rows)
        assert run(rows) == (cost, audit, digest(turns)), rows
        assert plain(rows)[:2] == (cost, audit), rows


@pytest.mark.parametrize("modulus", [repair.MODULUS, 3, 1])
def test_equal_to_whole_strings_also_if_hashes_collide(monkeypatch, modulus):
    monkeypatch.setattr(repair, "MODULUS", modulus)
    monkeypatch.setattr(repair, "_SETTLE", 5)
    rng = random.Random(modulus)
    for k in range(150):
        rows = conversation(rng, k % 40)
        cost, audit, turns = plain(rows)
        assert run(rows) == (cost, audit, digest(turns)), rows


def test_long_conversations_stay_small():
    rows = [("user" if k % 3 else "assistant", f"{k}{'.' * (k % 2)}") for k in range(30_000)]
    audit, start = repair.Audit(), time.time()
    for role, text in rows:
        audit.row(role, text, False, not text.endswith("."))
        assert audit.front[repair.ASSISTANT][1].length - audit.root.length < 3000
    assert len(audit.result()[1]) >= len(rows)
    run_of_one_role = repair.Audit()  # the states disagree to its end
    for k in range(30_000):
        run_of_one_role.row("tool", f"{k}.", False, False)
    assert run_of_one_role.result()[1] == "R" * 30_000
    assert time.time() - start < 60


def test_least_common_beginnings():
    root = repair.Node("", 0, 0, ())
    
    def of(word):
        node = root
        for c in word:
            node = repair.extend(node, c)
        return node

    rng = random.Random(2)
    words = ["".join(rng.choice("DK") for _ in range(rng.randrange(12))) for _ in range(60)]
    assert all(repair.less(of(a), of(b)) == (a < b) for a in words for b in words)
    shared = of("DKDKDKD")
    x, y = repair.extend(repair.extend(shared, "D"), "K"), repair.extend(shared, "K")
    assert repair.meeting(x, y) is shared and repair.less(x, y) and not repair.less(y, x)
    assert repair.letters(x, shared) == "DK" and repair.ancestor(x, 7) is shared


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv and r[4]], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] if r[3] is not None else " "))
        pairs = [(r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in mine]
        marks, turns = faults(pairs), [r[1] for r in mine if r[1] is not None]
        cost, audit, said = plain(pairs)
        first = [("b" if f[2] else "d" if f[3] else "t" if f[4] else "") for f in marks]
        joined = [a[0][:1] + b[0][:1] for a, b in zip(pairs, pairs[1:])]
        out.append(
            (conv, len(pairs), max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, first.count("b"), first.count("d"),
             first.count("t"), sum(j not in ("su", "ua", "au") for j in joined), cost, audit, digest(said))
        )
    return sorted(out, key=str)


def table_rows():
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for turn, (role, text) in enumerate(conversation(rng, rng.randrange(9))):
            rows.append((conv, None if rng.random() < 0.1 else turn * (1 + conv % 3), role, text, rng.random() < 0.9))
    rows += [(None, 1, "user", "x.", True), (None, None, None, None, True), (None, 1, "user", "x.", True), (None, 4, None, "y", True)]
    rows += [(100, 1, "user", "gone", False), (101, None, "assistant", None, True), (102, 5, "", "no role.", True)]
    rows += [(103, k, "user" if k % 2 == 0 else "assistant", "word " * 20_000 + f"{k}.", True) for k in range(4)]
    rows += [(104, 0, "user", "same.", True)] * 200
    return rows


def test_table_equal_to_brute_force(spark):
    rows = table_rows()
    df = spark.createDataFrame([(*r[:4], "clash", int(r[4])) for r in rows], SCHEMA).repartition(5)
    got = repair.audit(df, present=F.col("blank") == 1)
    assert got.columns == ["conv_id", *(f.split()[0] for f in repair._REPORT.split(", ")[1:])]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_repaired_turns_give_the_digests(spark):
    rows = table_rows()
    df = spark.createDataFrame([(*r[:4], "clash", int(r[4])) for r in rows], SCHEMA)
    turns = {}
    for r in repair.repaired(df, present=F.col("blank") == 1).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
        assert len(turns[r.conv_id]) == r.place
    reports = {r[0]: r for r in brute(rows)}
    assert all(digest(turns.get(conv, [])) == report[-1] for conv, report in reports.items())
    assert set(turns) <= set(reports)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit(empty).collect() == [] and repair.repaired(empty).collect() == []
