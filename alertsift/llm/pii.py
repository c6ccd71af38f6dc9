"""Personal data: exact base patterns, and further spans by weak supervision.

Base. Four patterns (email, ip, card, phone) with their checks. The expressions given here are
written so that Java's matcher needs neither deep recursion nor quadratic retries, and match
the same spans as the plain ones.

Method. Wider patterns propose candidate spans. Five labelers vote on each (form, shape,
gazetteer, context for, context against) with +1, -1 or 0. The votes of the whole corpus are
counted per combination, a table of bounded size. Expectation-maximisation on that table
estimates each labeler's reliability and a posterior per combination, and a logistic span
classifier is trained on those soft labels and the span's features. It is compiled into one
expression; spans it accepts that touch no base span are added. Everything on the rows is
built of DataFrame functions.

Defined cases: null and empty texts have no spans; places are code points, ends exclusive;
the whole text is searched; repeated rows are searched each; columns of the input that carry
an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

# The four base patterns. A match starts where its first run starts, or where the
# last match ended (\G), since a later start in the same run could only fail in the same way.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone", "secret")
_SPAN = "struct<start:int,stop:int,text:string,left:string>"
SPAN = f"array<{_SPAN}>"
CONTEXT = 32


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(d: Column, i: Column) -> Column:
        twice = d * (1 + (i - 1) % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    number = lambda i: F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + doubled(number(i), i))
    return total % 10 == 0


def _card_ok(text: Column) -> Column:
    return let(_digits(text), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))


class Pattern(NamedTuple):
    kind: str
    pattern: str
    hint: str  # a cheap expression that every text with a match fits
    good: Callable[[Column], Column]


BASE = (
    Pattern("email", EMAIL, "@", lambda t: F.lit(True)),
    Pattern("ip", IP, r"[0-9]\.[0-9]", lambda t: t.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    Pattern("card", CARD, r"[0-9][\x20-]?[0-9]", _card_ok),
    Pattern("phone", PHONE, r"\+[0-9]", lambda t: F.length(_digits(t)).between(9, 15)),
)


def spans(text: Column, pattern: str, hint: str) -> Column:
    """All leftmost matches that do not overlap: start, stop, text, and what stands before.

    The pieces between the matches give the places: Spark returns matches without them.
    """

    def place(at: Column, pair: Column) -> Column:
        start = at + F.length(pair["gaps"])
        stop, left = start + F.length(pair["found"]), F.right(pair["gaps"], F.lit(CONTEXT))
        return F.struct(start.alias("start"), stop.alias("stop"), pair["found"].alias("text"), left.alias("left"))

    pairs = F.arrays_zip(
        F.split(text, pattern).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    past = lambda at, pair: at + F.length(pair["gaps"]) + F.coalesce(F.length(pair["found"]), F.lit(0))
    found = running(pairs, F.lit(0), past, place, _SPAN)
    return F.when(text.rlike(hint), F.filter(found, lambda s: s["text"].isNotNull())).otherwise(F.array().cast(SPAN))


def _named(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), s["stop"].alias("stop"), F.lit(kind).alias("kind")
        ),
    )


def base_spans(text: Column) -> Column:
    """All base spans as (start, place of the kind, stop, kind), in that order."""

    def good(p: Pattern) -> Column:
        return _named(F.filter(spans(text, p.pattern, p.hint), lambda s: p.good(s["text"])), p.kind)

    return F.sort_array(F.concat(*map(good, BASE)))


# Candidate patterns, cue words and known beginnings of the labelers.
_AT, _DOT = r" ?(?:\(at\)|\[at\]|@| at ) ?", r" ?(?:\(dot\)|\[dot\]| dot ) ?"
CANDIDATES = (
    Pattern("email", rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", r"[(\[ ]dot[)\] ]", None),
    Pattern("phone", r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,4}+(?![0-9.-])", r"[0-9][)]?[\x20.-][0-9]", None),
    Pattern("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+", r"[A-Za-z0-9_+/=-]{20}", None),
)
CUES = {
    "email": "e-?mail|contact|write|mailto|courriel|correo",
    "phone": "phone|tel|call|mobile|fax|contact|anruf|appel|llam",
    "secret": "token|key|secret|passw|pwd|auth|credential|bearer",
}
AGAINST = "version|isbn|doi|uuid|commit|sha|md5|page|figure|fig|table|chapter|id"
KNOWN = {
    "email": r"(?i)(?:gmail|yahoo|outlook|hotmail|proton|icloud|example|mail)",
    "phone": r"^\(?0?(?:1|2|3|4|7|8|9)",
    "secret": r"^(?:ghp_|gho_|sk-|pk-|AKIA|ASIA|xox[abp]-|eyJ|AIza)",
}
FORM = {
    "email": r"(?i)[a-z0-9](?:com|org|net|edu|gov|de|fr|es|io)$",
    "phone": r"^\D*(?:\d\D*){9,15}$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]+$",
}
SHAPE = {
    "email": r"^[^ (\[]{2,}",
    "phone": r"^[^.\x20-]+([.\x20-])\d+(?:\1\d+)+$",
    "secret": r"(?<![0-9])(?:[0-9]++[A-Za-z]++){3}",
}
LABELERS = ("form", "shape", "gazetteer", "context", "against")


def votes(kind: str, text: Column, left: Column) -> dict[str, Column]:
    """What each labeler says of a candidate: 1 personal, -1 not, 0 nothing."""
    vote = lambda yes, no=0: F.when(yes, 1).otherwise(no)
    return {
        "form": vote(text.rlike(FORM[kind]), -1),
        "shape": vote(text.rlike(SHAPE[kind]), -1),
        "gazetteer": vote(text.rlike(KNOWN[kind])),
        "context": vote(left.rlike(rf"(?i)\b(?:{CUES[kind]})\w*\W*$")),
        "against": F.when(left.rlike(rf"(?i)\b(?:{AGAINST})\W*$"), -1).otherwise(0),
    }


def features(text: Column) -> dict[str, Column]:
    """The span's own features, each with few values."""
    return {
        "size": F.least(F.floor(F.length(text) / 12), F.lit(4)).cast("int"),
        "digits": F.floor(4 * F.length(_digits(text)) / F.length(text)).cast("int"),
    }


def candidates(text: Column) -> Column:
    """Candidate spans with their kind, votes and features."""

    def described(kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(KINDS.index(kind)).alias("place"),
            s["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            *[c.alias(n) for n, c in (votes(kind, s["text"], s["left"]) | features(s["text"])).items()],
        )

    return F.concat(*[F.transform(spans(text, p.pattern, p.hint), described(p.kind)) for p in CANDIDATES])


class Model(NamedTuple):
    reliability: dict[str, dict[int, tuple[float, float]]]  # per labeler and vote: P(vote | personal), P(vote | not)
    intercept: float
    weights: dict[tuple[str, object], float]  # per (feature, value)

    def odds(self, candidate: Column) -> Column:
        total = F.lit(self.intercept)
        for name in ("kind", *LABELERS, "size", "digits"):
            value = F.lit(0.0)
            for (feature, level), weight in self.weights.items():
                if feature == name:
                    value = F.when(candidate[name] == F.lit(level), weight).otherwise(value)
            total = total + value
        return total


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Reliabilities and the span classifier from the votes of all candidates of all texts.

    The vote table that reaches the driver has at most kinds x votes x feature values rows.
    """
    names = ["kind", *LABELERS, "size", "digits"]
    counted = docs.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c")).select("c.*")
    table = counted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toPandas()
    if table.empty:
        return Model({}, -50.0, {})
    n = table["n"].to_numpy(float)
    posterior = (table[list(LABELERS)].sum(axis=1) > 0).to_numpy(float) * 0.8 + 0.1
    reliability: dict[str, dict[int, tuple[float, float]]] = {}
    for _ in range(60):
        yes, no = n * posterior, n * (1 - posterior)
        share = (yes.sum() + 1) / (n.sum() + 2)
        odds = np.full(len(table), np.log(share / (1 - share)))
        for name in LABELERS:
            vote, reliability[name] = table[name].to_numpy(), {}
            for level in (-1, 0, 1):
                at = vote == level
                p = (yes[at].sum() + 1) / (yes.sum() + 3), (no[at].sum() + 1) / (no.sum() + 3)
                reliability[name][level] = p
                odds[at] += np.log(p[0] / p[1])
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    columns = [(f, v) for f in names for v in sorted(table[f].unique())]
    x = np.column_stack([np.ones(len(table)), *[(table[f] == v).to_numpy(float) for f, v in columns]])
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1000.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (posterior - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    plain = lambda v: v if isinstance(v, str) else int(v)
    return Model(reliability, float(w[0]), {(f, plain(v)): float(b) for (f, v), b in zip(columns, w[1:], strict=True)})


_PLACED = "struct<start:int,added:int,place:int,stop:int,kind:string,reached:int,next:int>"


def _apart(base: Column, added: Column) -> Column:
    """The spans of ``added`` that touch no base span, by a scan in each direction."""
    last = 2**31 - 1

    def marked(spans: Column, mark: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(mark).alias("added"), s["place"].alias("place"), s["stop"].alias("stop"),
                s["kind"].alias("kind"), F.lit(0).alias("reached"), F.lit(last).alias("next"),
            ),
        )

    of_base = lambda s, value, other: F.when(s["added"] == 0, value).otherwise(other)
    forth = running(
        F.sort_array(F.concat(marked(base, 0), marked(added, 1))),
        F.lit(0),
        lambda at, s: of_base(s, F.greatest(at, s["stop"]), at),
        lambda at, s: s.withField("reached", at),
        _PLACED,
    )
    back = running(
        F.reverse(forth), F.lit(last), lambda at, s: of_base(s, s["start"], at), lambda at, s: s.withField("next", at), _PLACED
    )
    free = F.filter(back, lambda s: (s["added"] == 1) & (s["reached"] <= s["start"]) & (s["next"] >= s["stop"]))
    return F.transform(free, lambda s: F.struct(*[s[n].alias(n) for n in ("start", "place", "stop", "kind")]))


def find(docs: DataFrame, model: Model, text_col: str = "text", odds: float = 1.0) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, place, stop, kind), in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def merged(base: Column) -> Column:
        accepted = F.filter(candidates(text), lambda c: model.odds(c) >= odds)
        plain = F.transform(accepted, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "place", "stop", "kind")]))
        spans = let(plain, lambda p: F.when(F.size(p) > 0, F.sort_array(F.concat(base, _apart(base, p)))).otherwise(base))
        return F.struct(base.alias("base"), spans.alias("spans"))

    both = docs.withColumn("_both", let(base_spans(text), merged))
    return both.withColumns({"base": F.col("_both.base"), "spans": F.col("_both.spans")}).drop("_both")


def listed(found: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redact(text: Column, found: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""

    size = 256

    def cut(region: Column, begin: Column) -> Callable[[Column, Column], Column]:
        def one(state: Column, s: Column) -> Column:
            before = F.substr(region, state["at"] - begin + 1, s["start"] - state["at"])
            fresh = F.array_append(state["out"], F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.struct(
                F.greatest(state["at"], s["stop"]).alias("at"),
                F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
            )

        return one

    def piece(state: Column, k: Column) -> Column:
        """Up to ``size`` spans, cut from their own stretch of the text."""

        def inside(spans: Column) -> Column:
            until = F.greatest(state["at"], F.array_max(F.transform(spans, lambda s: s["stop"])))
            region = F.substr(text, state["at"] + 1, until - state["at"])
            start = F.struct(state["at"].alias("at"), none.alias("out"))
            done = let(region, lambda r: F.aggregate(spans, start, cut(r, state["at"])))
            return let(
                done,
                lambda d: F.struct(d["at"].alias("at"), F.array_append(state["out"], F.array_join(d["out"], "")).alias("out")),
            )

        return let(F.slice(found, k * size + 1, F.lit(size)), inside)

    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
    pieces = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / size).cast("int"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(pieces, begin, piece, rest)).otherwise(text)
