"""Repair of damaged conversations with a minimal, auditable list of edits.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Its rows may be kept (K), given
another role (R), deleted (D), and empty turns inserted (I); ``audit`` holds the letters of the
cheapest edits in order, the ASCII-least of them if several cost the same.

The audits are found by a dynamic program over the rows with four states (nothing yet, after
system, after user, after assistant). Each state holds the last node of its best edit prefix; the
prefixes are linked nodes that share their beginnings, so a step adds a few nodes and copies no
string. A node carries its length, a rolling hash of its prefix and its ancestors at distances 1, 2, 4, ...
Equally cheap prefixes are compared at the end of their longest common prefix, which is found by
descending over ancestors with unequal hashes; that the parts taken as equal are so is verified
on the nodes themselves, so a collision changes nothing. Each state also carries the running
digest of its repaired text, so texts are read once and never held.

Rows are shuffled by conversation, sorted inside the partitions and streamed: a conversation of any length
holds one byte per edit, and nodes only for the stretch in which the states still disagree
(what they agree on is written off). States that can no longer win are dropped, so that the stretch
ends. Duplicates are marked by a window over the same partitioning, which spills. One conversation is
one stream: its digest is a sequential function of all its text.

Defined cases: a null role or text counts as one space; rows go by turn (nulls first), then role, then
text; equal rows are duplicates of each other; a null conversation id is a conversation of its own; an
empty role or one of another initial cannot be kept; a conversation without rows has zeros, an empty
audit and the digest of the empty text; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS

# Cost of an edit, of a truncated row that stays, and the legal neighbours.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
ENDS = (".", "!", "?")
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last kept turn is

BASE, MODULUS = 1_000_003, (1 << 61) - 1
_SETTLE = 512  # nodes after which the common beginning is written off
_MOST = (1 << 63) - 1
_BLANK = " \t\n\x0b\x0c\r"


class Node:
    """The last letter of an edit prefix; ``up[k]`` is the ancestor 2**k letters before it."""

    __slots__ = ("letter", "length", "mark", "up")

    def __init__(self, letter: str, length: int, mark: int, up: tuple[Node, ...]):
        self.letter, self.length, self.mark, self.up = letter, length, mark, up


def extend(node: Node, letter: str) -> Node:
    up, at = [node], node
    while len(at.up) >= len(up):
        at = at.up[len(up) - 1]
        up.append(at)
    return Node(letter, node.length + 1, (node.mark * BASE + ord(letter)) % MODULUS, tuple(up))


def ancestor(node: Node, length: int) -> Node:
    while node.length > length:
        node = node.up[(node.length - length).bit_length() - 1]
    return node


def letters(node: Node, after: Node) -> str:
    """The letters behind ``after`` up to ``node``."""
    found = []
    while node is not after:
        found.append(node.letter)
        node = node.up[0]
    return "".join(reversed(found))


def _first_difference(a: Node, b: Node) -> tuple[Node, Node] | None:
    """The first unequal letters of two prefixes of one length, by walking to where they are one node."""
    found = None
    while a is not b:
        if a.letter != b.letter:
            found = a, b
        a, b = a.up[0], b.up[0]
    return found


def less(x: Node, y: Node) -> bool:
    """Whether the prefix of ``x`` is ASCII-less than that of ``y``."""
    shorter = min(x.length, y.length)
    a, b = ancestor(x, shorter), ancestor(y, shorter)
    if a.mark == b.mark:
        split = _first_difference(a, b)
    else:
        for k in reversed(range(len(a.up))):
            if k < len(a.up) and a.up[k].mark != b.up[k].mark:
                a, b = a.up[k], b.up[k]
        split = _first_difference(a.up[0], b.up[0]) or (a, b)
    if split is None:
        return x.length < y.length
    return split[0].letter < split[1].letter


def meeting(x: Node, y: Node) -> Node:
    """The last node that two prefixes share."""
    shorter = min(x.length, y.length)
    x, y = ancestor(x, shorter), ancestor(y, shorter)
    if x is y:
        return x
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k] is not y.up[k]:
            x, y = x.up[k], y.up[k]
    return x.up[0]


class Audit:
    """The program over the rows of one conversation, fed one row at a time."""

    def __init__(self):
        self.root = Node("", 0, 0, ())
        self.settled: list[str] = []
        self.window = 0
        self.front = self._inserted({EMPTY: (0, self.root, (hashlib.sha256(), False))})

    @staticmethod
    def _say(digest: tuple, role: str, text: str) -> tuple:
        said = digest[0].copy()
        said.update((("\n" if digest[1] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        return said, True

    def _inserted(self, found: dict) -> dict:
        """``found`` with all insertions, states in order of cost: an inserted turn leaves a cheaper state."""
        open_, done = dict(found), {}
        while open_:
            state = min(open_, key=lambda s: open_[s][0])
            cost, node, digest = done[state] = open_.pop(state)
            to = ASSISTANT if state == USER else USER
            if to in done or (to in open_ and open_[to][0] < cost + INSERT):
                continue
            longer = extend(node, "I")
            if to not in open_ or open_[to][0] > cost + INSERT or less(longer, open_[to][1]):
                open_[to] = cost + INSERT, longer, self._say(digest, "user" if to == USER else "assistant", "")
        # After assistant any continuation of "after system" is open too, and of "nothing yet" by one deletion more.
        if SYSTEM in done and done[ASSISTANT][0] < done[SYSTEM][0]:
            del done[SYSTEM]
        if EMPTY in done and done[ASSISTANT][0] + DELETE < done[EMPTY][0]:
            del done[EMPTY]
        return done

    def row(self, role: str, text: str, unusable: bool, truncated: bool) -> None:
        offers: dict[int, list] = {}

        def offer(to: int, cost: int, node: Node, letter: str, digest: tuple, said: str | None) -> None:
            held = offers.get(to)
            if held is None or cost < held[0][0]:
                offers[to] = [(cost, node, letter, digest, said)]
            elif cost == held[0][0]:
                held.append((cost, node, letter, digest, said))

        initial = role[:1]
        for state, (cost, node, digest) in self.front.items():
            offer(state, cost + DELETE, node, "D", digest, None)
            if unusable:
                continue
            stays = cost + (TRUNCATED if truncated else 0)
            to, name = (ASSISTANT, "assistant") if state == USER else (USER, "user")
            if initial == name[0]:
                offer(to, stays, node, "K", digest, role)
            else:
                offer(to, stays + REROLE, node, "R", digest, name)
            if initial == "s" and state == EMPTY:
                offer(SYSTEM, stays, node, "K", digest, role)
        found = {}
        for to, ties in offers.items():
            best = None
            for cost, node, letter, digest, said in ties:
                longer = extend(node, letter)
                if best is None or less(longer, best[1]):
                    best = cost, longer, digest, said
            cost, longer, digest, said = best
            found[to] = cost, longer, digest if said is None else self._say(digest, said, text)
        self.front = self._inserted(found)
        if max(node.length for _, node, _ in self.front.values()) - self.root.length > 2 * self.window + _SETTLE:
            self._settle()

    def _settle(self) -> None:
        """Write off the letters that all states share; only the nodes behind them stay."""
        ends = [node for _, node, _ in self.front.values()]
        shared = ends[0]
        for node in ends[1:]:
            shared = meeting(shared, node)
        self.settled.append(letters(shared, self.root))
        made = {shared: Node("", shared.length, shared.mark, ())}
        for end in ends:
            path = []
            while end not in made:
                path.append(end)
                end = end.up[0]
            for node in reversed(path):
                made[node] = extend(made[node.up[0]], node.letter)
        self.root = made[shared]
        self.front = {s: (cost, made[node], digest) for s, (cost, node, digest) in self.front.items()}
        self.window = max(node.length for _, node, _ in self.front.values()) - self.root.length

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, digest of the repaired conversation)"""
        cost, node, digest = self.front[ASSISTANT]
        if EMPTY in self.front:
            other = self.front[EMPTY]
            if other[0] < cost or (other[0] == cost and less(other[1], node)):
                cost, node, digest = other
        return cost, "".join([*self.settled, letters(node, self.root)]), digest[0].hexdigest()


def _report(conv, rows: Iterable[tuple]) -> tuple:
    """One conversation's counts and audit from its rows (turn, role, text, blank, again, cut)."""
    audit = Audit()
    low = high = last = before = None
    distinct = blanks = repeats = cuts = illegal = count = 0
    for turn, role, text, blank, again, cut in rows:
        count += 1
        if turn is not None and turn != last:
            low, high, last = turn if low is None else low, turn, turn
            distinct += 1
        blanks, repeats, cuts = blanks + blank, repeats + (again and not blank), cuts + (cut and not blank and not again)
        if before is not None and before + role[:1] not in LEGAL_PAIRS:
            illegal += 1
        before = role[:1]
        audit.row(role, text, blank or again, cut)
    gaps = 0 if low is None else min(high - low + 1 - distinct, _MOST)
    return (conv, count, gaps, blanks, repeats, cuts, illegal, *audit.result())


def prepared(
    rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None
) -> DataFrame:
    """(conv, turn, role, text, present, blank, again, cut), one conversation per partition, sorted."""
    col = lambda c: F.col(f"`{c}`")
    filled = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    clean = rows.select(
        col(conv_col).cast("long").alias("conv"),
        col(turn_col).cast("long").alias("turn"),
        filled(role_col).alias("role"),
        filled(text_col).alias("text"),
        there.alias("present"),
    ).repartition("conv")
    # Clustered by conversation already: the window sorts, but shuffles nothing.
    earlier = Window.partitionBy("conv", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.substring(F.rtrim(F.col("text"), F.lit(_BLANK)), -1, 1)
    marked = clean.withColumns(
        {
            "blank": ~F.col("text").rlike(f"[^{BLANKS}]"),
            "again": F.row_number().over(earlier) > 1,
            "cut": ~end.isin(*ENDS),
        }
    )
    return marked.sortWithinPartitions("conv", "present", F.col("turn").asc_nulls_first(), "role", "text")


_COLUMNS = ("conv", "present", "turn", "role", "text", "blank", "again", "cut")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _COLUMNS], strict=True)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its present rows) as a stream."""
    for conv, rows in groupby(_records(batches), key=lambda r: r[0]):
        yield conv, (r[2:] for r in rows if r[1])


_REPORT = (
    "conv long, rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)


def _report_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _REPORT.split(", "))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, held, size = _report_schema(), [], 0
    for conv, rows in _conversations(batches):
        held.append(_report(conv, rows))
        size += len(held[-1][8])
        if len(held) == 4096 or size > 1 << 24:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def audit(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest of the repaired text.

    Rows that do not meet the condition ``present`` only name their conversation.
    """
    ready = prepared(rows, conv_col, turn_col, role_col, text_col, present)
    return ready.select(*_COLUMNS).mapInArrow(_read, _REPORT).withColumnRenamed("conv", conv_col)


_TURNS = "conv long, place long, role string, text string, edit string"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns from a stream in which each conversation's audit stands before its rows."""
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def turns() -> Iterator[tuple]:
        flat = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for conv, rows in groupby(flat, key=lambda r: r[0]):
            edits, at, place, last = next(rows)[3], 0, 0, ""

            def said(role: str, text: str, edit: str) -> tuple:
                nonlocal place, last
                place, last = place + 1, role[:1]
                return conv, place, role, text, edit  # noqa: B023

            expected = lambda: "assistant" if last == "u" else "user"  # noqa: B023, E731
            for _, _, role, text in rows:
                while edits[at] == "I":
                    at += 1
                    yield said(expected(), "", "I")
                edit, at = edits[at], at + 1
                if edit != "D":
                    yield said(role if edit == "K" else expected(), text, edit)
            while at < len(edits):
                at += 1
                yield said(expected(), "", "I")

    held, size = [], 0
    for turn in turns():
        held.append(turn)
        size += len(turn[3])
        if len(held) == 4096 or size > 1 << 24:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def repaired(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
) -> DataFrame:
    """The repaired turns: conversation, place from 1, role, text and the edit that made the turn (K, R or I)."""
    ready = prepared(rows, conv_col, turn_col, role_col, text_col, present)
    audits = ready.select(*_COLUMNS).mapInArrow(_read, _REPORT).where("audit <> ''")
    heads = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    # The audit stands before the rows of its conversation.
    body = ready.where("present").select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    both = heads.unionByName(body).repartition("conv")
    stream = both.sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    return stream.select("conv", "kind", "role", "text").mapInArrow(_apply, _TURNS).withColumnRenamed("conv", conv_col)
