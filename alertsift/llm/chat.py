"""Chat formatting: records of several layouts become one marked text with a loss mask.

The nested field paths that a record fills (a path below a list: in any of its turns) are hashed to
a fingerprint. Each fingerprint names one declarative mapping to canonical turns (role, text); the
choice is one CASE over literal hashes, so a table may mix layouts row by row. Turns are written as
``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. In roles and texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so control strings occur only where the template puts
them and ``unescape`` gives the text back.

Defined cases: null roles and texts are empty; a record that fits no layout keeps its row with
null outputs, also if a turn has no known text but fills a field of an unknown name, or if its turns mix
layouts; an empty list counts as absent beside other fields, alone it gives an empty text; unknown columns,
and unknown fields beside a known text, are ignored; turns keep the order of their list, and equal turns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNT_ROLE = "assistant"


class Layout(NamedTuple):
    """Sets of field paths, and the turns that a record filling one of them maps to."""

    name: str
    paths: tuple[frozenset[str], ...]
    turns: Callable[[Callable[[str], Column], Callable[[Column, str], Column]], Column]


def _turn(role: Column, text: Column) -> Column:
    return F.struct(
        F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
    )


def _spoken(role: str, text: Column) -> Column:
    """One turn if the text is there, else none."""
    return F.when(text.isNotNull(), F.array(_turn(F.lit(role), text))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))


# The lists of turns, the fields of a turn, and the names that some layouts give to roles.
LISTS = ("turns", "messages", "conversations")
TURN_FIELDS = (("role", "text"), ("role", "content"), ("from", "value"))
SPEAKERS = {"human": "user", "gpt": "assistant"}
FIELDS = ("prompt", "completion", "response", "instruction", "input", "output", "system")
_KEYS = tuple(sorted({k for pair in TURN_FIELDS for k in pair}))
_TEXTS = tuple(sorted({text for _, text in TURN_FIELDS}))


def _listed(field: str, role: str, text: str) -> Callable:
    def renamed(value: Column) -> Column:
        out = value
        for old, new in (SPEAKERS if role == "from" else {}).items():
            out = F.when(value == old, new).otherwise(out)
        return out

    return lambda get, of: F.transform(get(field), lambda m: _turn(renamed(of(m, role)), of(m, text)))


def _instruction(get: Callable[[str], Column], _) -> Column:
    asked = F.when(get("input").isNull() | (get("input") == ""), get("instruction")).otherwise(
        F.concat_ws("\n\n", get("instruction"), get("input"))
    )
    return F.concat(_spoken("system", get("system")), _spoken("user", asked), _spoken("assistant", get("output")))


def _answered(answer: str) -> Callable:
    return lambda get, _: F.concat(
        _spoken("system", get("system")), _spoken("user", get("prompt")), _spoken("assistant", get(answer))
    )


def _list_layout(field: str, role: str, text: str, name: str) -> Layout:
    """A list of turns; roles or texts may be missing, and an empty list stands alone."""
    a, b = f"{field}[].{role}", f"{field}[].{text}"
    return Layout(name, (frozenset({a}), frozenset({b}), frozenset({a, b}), frozenset({f"{field}[]"})), _listed(field, role, text))


def _field_layout(name: str, required: tuple[str, ...], optional: tuple[str, ...], turns: Callable) -> Layout:
    some = [c for k in range(len(optional) + 1) for c in combinations(optional, k)]
    return Layout(name, tuple(frozenset((*required, *c)) for c in some), turns)


# The layouts in use, and every list with every pair of inner names. Of layouts that share a set
# of paths the last one names the record.
_USUAL = (("turns", "role", "text"), ("messages", "role", "content"), ("conversations", "from", "value"))
LAYOUTS = (
    *[_list_layout(f, r, t, f"{f}:{r}/{t}") for f in LISTS for r, t in TURN_FIELDS if (f, r, t) not in _USUAL],
    *[_list_layout(f, r, t, f) for f, r, t in _USUAL],
    _field_layout("instruction", ("instruction", "output"), ("input", "system"), _instruction),
    _field_layout("completion", ("prompt", "completion"), ("system",), _answered("completion")),
    _field_layout("response", ("prompt", "response"), ("system",), _answered("response")),
)

# A turn of a JSON record is a map, so that fields of other names are seen too.
RECORD = T.StructType(
    [
        *[T.StructField(f, T.ArrayType(T.MapType(T.StringType(), T.StringType()))) for f in LISTS],
        *[T.StructField(f, T.StringType()) for f in FIELDS],
    ]
)


def fingerprint_of(paths: frozenset[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(schema: T.StructType, above: str = "") -> list[str]:
    """The paths of all leaves, with ``[]`` behind a list."""
    found = []
    for field in schema.fields:
        path, kind = above + field.name, field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        found += field_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return found


def _inner(kind: T.DataType) -> tuple[Callable[[Column, str], Column], Callable[[Column], Column]]:
    """How to get a turn's field by name, and whether a turn fills a field of no known name."""
    if isinstance(kind, T.MapType):
        other = lambda m: F.size(F.map_filter(m, lambda k, v: ~k.isin(*_KEYS) & v.isNotNull())) > 0
        return lambda m, k: F.try_element_at(m, F.lit(k)), other
    names = kind.fieldNames() if isinstance(kind, T.StructType) else []
    leaves = {p.split(".")[0].removesuffix("[]") for p in field_paths(kind)} if names else set()
    strange = sorted(leaves - {*_KEYS, "turn"})
    nothing = F.lit(None).cast("string")
    has = lambda m: reduce(lambda x, n: x | m[n].isNotNull(), strange, F.lit(False))
    return lambda m, k: m[k].cast("string") if k in names else nothing, has


def _list_paths(field: str, value: Column, of: Callable, strange: Callable) -> dict[str, Column]:
    """Per path below a list whether any turn fills it; ``?`` stands for text under an unknown name."""
    fills = lambda k: lambda m: of(m, k).isNotNull()
    filled = {f"{field}[].{k}": F.exists(value, fills(k)) for k in _KEYS}
    silent = lambda m: reduce(lambda x, k: x & of(m, k).isNull(), _TEXTS, F.lit(True))
    return filled | {f"{field}[].?": F.exists(value, lambda m: silent(m) & strange(m))}


def _mapped(get: Callable[[str], Column], have: dict[str, T.DataType]) -> Column:
    """Fingerprint, layout name and turns of a record with the columns ``have``."""
    filled = {f: get(f).isNotNull() for f in FIELDS if f in have}
    inner = {}
    for field in LISTS:
        kind = have.get(field)
        if isinstance(kind, T.ArrayType):
            inner[field] = _inner(kind.elementType)
            filled |= _list_paths(field, get(field), *inner[field])
    no_paths = F.array().cast("array<string>")
    present = lambda marks: F.array_compact(F.array(*[F.when(marks[p], F.lit(p)) for p in sorted(marks)])) if marks else no_paths
    # A list counts by itself only if nothing else is filled, and then the first one.
    lists = {f"{f}[]": get(f).isNotNull() for f in inner}
    paths = let(present(filled), lambda p: F.when(F.size(p) > 0, p).otherwise(F.slice(present(lists), 1, 1)))
    return let(F.md5(F.array_join(paths, "\n")), lambda mark: _chosen(mark, get, have, inner))


def _chosen(mark: Column, get: Callable, have: dict, inner: dict) -> Column:
    """(mark, name, turns) of the layout that the fingerprint names; the fingerprint is computed once."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        sets = [p for p in layout.paths if all(x.split("[")[0] in have for x in p)]
        used = {x.split("[")[0] for p in sets for x in p}
        if not sets or not used & set(LISTS) <= set(inner):
            continue
        of = next((inner[f][0] for f in used if f in inner), None)
        fits = mark.isin([fingerprint_of(p) for p in sets])
        name = F.when(fits, layout.name).otherwise(name)
        turns = F.when(fits, layout.turns(get, of)).otherwise(turns)
    return F.struct(mark.alias("mark"), name.alias("name"), turns.alias("turns"))


def canonical_turns(df: DataFrame, record: str | None = None) -> DataFrame:
    """Add ``fingerprint``, ``layout`` and ``canonical`` (an array of role and text).

    With ``record`` the fields are read from that JSON column, else from the columns of ``df``.
    """
    source = df if record is None else df.withColumn("__record", F.from_json(F.col(record), RECORD))
    schema = df.schema if record is None else RECORD
    have = {f.name: f.dataType for f in schema.fields}
    field = (lambda f: F.col(f"`{f}`")) if record is None else (lambda f: F.col("__record")[f])
    get = lambda f: field(f) if f in have else F.lit(None).cast("string")
    named = {"fingerprint": F.col("__out.mark"), "layout": F.col("__out.name"), "canonical": F.col("__out.turns")}
    return source.withColumn("__out", _mapped(get, have)).withColumns(named).drop("__record", "__out")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "canonical") -> DataFrame:
    """Add ``segments`` (text, loss) in order, and ``formatted``, their concatenation."""

    def pieces(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(
            part(F.concat(F.lit(START), escape(turn["role"]), F.lit(SEPARATOR)), no),
            part(escape(turn["text"]), turn["role"] == LEARNT_ROLE),
            part(F.lit(END + "\n"), no),
        )

    cut = df.withColumn("segments", F.flatten(F.transform(F.col(turns), pieces)))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    quoted = lambda s: s.replace("|", "\\|")
    turns = F.split(formatted, quoted(START))

    def read(piece: Column) -> Column:
        parts = F.split(piece, f"{quoted(SEPARATOR)}|{quoted(END)}")
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    return F.transform(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))), read)


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
