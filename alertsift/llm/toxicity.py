"""Toxic passages by maximum-scoring segments.

Learning. The words of labelled documents are counted per class, and so are their beginnings of
4 to 8 letters, which stand in for unseen words of the same stem. Each such term gets its
log-odds ratio between the classes under an informative Dirichlet prior (its share of all
counted words). Terms of significant positive ratio, and the longer terms below them, form the
lexicon; a word is scored by its longest known term.

Scoring. A word of the lexicon adds its ratio, every other word subtracts ``DRIFT``. One linear
scan finds all maximal segments of a text. Under the background model a segment of score s in
n words is expected K n exp(-lambda s) times by chance (extreme-value theory): lambda makes
the mean of exp(lambda s) one on the words of clean documents, K is the rate of their segments.
The evidence of a text sums -log of that expectation over its segments, and a logistic curve
fitted on the labelled documents turns evidence into a score from 0 to 1.

Bounds that are parameters of the fit: ``fit_rows`` labelled documents at most (about; chosen by
a hash of their id, all of them below that number) and ``lexicon`` terms of the highest z, with four times as
many longer terms below them: a beginning whose longer terms do not fit any more is given up with them.

Defined cases: null and blank texts have no evidence and get the curve's value there; texts of any
length are scanned once; repeated rows are scored each; labels that are null are unused, of
several labels of one id the greatest counts; without usable labels every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

DRIFT = 0.6
SHORTEST, LONGEST = 4, 8
WORD = regex.compile(r"\p{L}+")
KNOWN_WORDS = 400_000  # scores kept per worker


class Model(NamedTuple):
    terms: dict[str, float]  # a whole word ends with "$"
    rate: float  # lambda
    level: float  # K
    curve: tuple[float, float, float]  # intercept, weight of log evidence, weight of log length

    def name(self) -> int:
        return hash(frozenset(self.terms.items()))


class _Scores(dict):
    """word -> score, 0.0 for words without a known term; resolved once per word."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: str) -> float:
        if len(self) > KNOWN_WORDS:
            self.clear()
        score = self.terms.get(word + "$")
        for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if score is not None:
                break
            score = self.terms.get(word[:k])
        self[word] = score = max(score or 0.0, 0.0)
        return score


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) in one pass.

    ``hits`` are the places and scores of the scoring words; each place between costs DRIFT. A
    kept segment remembers its cumulative sums and the nearest one before it that began lower.
    """
    kept: list[list] = []  # first, last, sum before, sum after, index of the lower one
    for place, gain in hits:
        before = sum_at(kept, place)
        first, after = place, before + gain
        low = len(kept) - 1
        while True:
            while low >= 0 and kept[low][2] >= before:
                low = kept[low][4]
            if low < 0 or kept[low][3] >= after:
                kept.append([first, place, before, after, low])
                break
            first, before = kept[low][0], kept[low][2]
            del kept[low:]
            low = len(kept) - 1
        kept[-1].append(after)
    return [(k[0], k[1], k[3] - k[2]) for k in kept]


def sum_at(kept: list[list], place: int) -> float:
    """The cumulative sum before the word at ``place``."""
    if not kept:
        return -DRIFT * place
    return kept[-1][3] - DRIFT * (place - kept[-1][1] - 1)


def _hits(text: str | None, scores: _Scores) -> tuple[int, list[tuple[int, float]]]:
    words = WORD.findall((text or "").lower())
    return len(words), [(k, s) for k, s in enumerate(map(scores.__getitem__, words)) if s > 0]


def evidence(n: int, found: list[tuple[int, int, float]], rate: float, level: float) -> tuple[float, list]:
    """Summed -log expectation of the significant segments, and those segments."""
    kept, total = [], 0.0
    for first, last, score in found:
        weight = rate * score - math.log(level * max(n, 1))
        if weight > 0:
            kept.append((first, last, weight))
            total += weight
    return total, kept


def _terms(word: Column) -> Column:
    lengths = F.sequence(F.lit(SHORTEST), F.lit(LONGEST))
    starts = F.transform(F.filter(lengths, lambda k: k <= F.length(word)), lambda k: F.substring(word, F.lit(1), k))
    return F.array_append(starts, F.concat(word, F.lit("$")))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = 200_000,
    lexicon: int = 50_000,
    least_count: int = 10,
    least_z: float = 4.0,
) -> Model:
    """Fit the lexicon, the extreme-value level and the curve on the labelled documents."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(
        F.max(label_col).cast("int").alias("_y")
    )
    share = min(1.0, fit_rows / max(marked.count(), 1))
    chosen = marked.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20)))
    # The sample is bounded by fit_rows, so its ids (12 bytes each) may be broadcast.
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(chosen), id_col).select("_y", "_t")
    words = texts.select("_y", F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counted = words.groupBy("word").agg(F.sum("_y").alias("bad"), F.count("*").alias("all"))
    terms = staged(
        counted.select(F.explode(_terms(F.col("word"))).alias("term"), "bad", "all")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
        .where(F.col("all") >= least_count),
        "terms",
    )
    totals = counted.agg(F.sum("bad").alias("bad"), F.sum("all").alias("all")).first()
    bad_words, all_words = totals["bad"] or 0, totals["all"] or 0
    if bad_words == 0 or bad_words == all_words:
        return Model({}, 1.0, 1.0, (-50.0, 0.0, 0.0))
    strength = 0.01 * all_words  # the prior weighs as a hundredth of the counted words
    prior = strength * F.col("all") / all_words
    odds = lambda c, n: F.log((c + prior) / (n + strength - c - prior))
    clean = F.col("all") - F.col("bad")
    rated = terms.withColumn("ratio", odds(F.col("bad"), bad_words) - odds(clean, all_words - bad_words)).withColumn(
        "z", F.col("ratio") / F.sqrt(1 / (F.col("bad") + prior) + 1 / (clean + prior))
    )
    strong = (F.col("z") >= least_z) & (F.col("ratio") >= 1)
    top = rated.where(strong).orderBy(F.desc("z"), "term").limit(lexicon).select("term", "ratio", "all").collect()
    heads = docs.sparkSession.createDataFrame([(r["term"],) for r in top if not r["term"].endswith("$")], "head string")
    below = (
        rated.where(~strong)
        .withColumn("head", F.explode(_terms(F.regexp_replace("term", r"\$$", ""))))
        .where(F.col("head") != F.col("term"))
        .join(F.broadcast(heads), "head")
    )
    # A beginning whose exceptions do not fit is given up itself, so that no exception is lost.
    exceptions = {r["head"]: r["count"] for r in below.groupBy("head").count().collect()}
    room, kept = 4 * lexicon, []
    for r in top:
        if exceptions.get(r["term"], 0) <= room:
            room -= exceptions.get(r["term"], 0)
            kept.append(r)
    given_up = docs.sparkSession.createDataFrame([(t,) for t in {r["term"] for r in top} - {r["term"] for r in kept}], "head string")
    rest = below.join(F.broadcast(given_up), "head", "left_anti").select("term", "ratio").distinct()
    known = {r["term"]: r["ratio"] for r in kept} | {r["term"]: r["ratio"] for r in rest.collect()}
    draft = Model(known, 1.0, 1.0, (0.0, 0.0, 0.0))
    return _calibrated(texts, draft)


def _calibrated(texts: DataFrame, draft: Model) -> Model:
    """lambda and K from the clean documents, the curve from all; rows are bounded by the sample."""
    small_batches(texts.sparkSession)
    terms = texts.sparkSession.sparkContext.broadcast(draft.terms)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = _Scores(terms.value)
        for batch in batches:
            rows = []
            for label, text in zip(batch["_y"], batch["_t"], strict=True):
                n, hits = _hits(text, scores)
                rows.append((label, n, [s for _, s in hits], [s for *_, s in segments(hits)]))
            yield pd.DataFrame(rows, columns=["y", "n", "gains", "found"])

    scanned = staged(texts.mapInPandas(scan, "y int, n long, gains array<double>, found array<double>"), "scanned")
    clean = scanned.where("y = 0")
    # Background scores, in steps of a tenth: a table of bounded size.
    steps = clean.select(F.explode("gains").alias("s")).groupBy(F.round("s", 1).alias("s")).count().collect()
    n = clean.agg(F.sum("n")).first()[0] or 1
    gains = np.array([r["s"] for r in steps]), np.array([r["count"] for r in steps], float)
    rate = _lambda(*gains, n)
    floor = 1.0
    many = clean.select(F.explode("found").alias("s")).where(F.col("s") >= floor).count()
    level = max(many, 1) * math.exp(rate * floor) / n
    weigh = F.aggregate(
        F.transform("found", lambda s: F.greatest(F.lit(0.0), s * rate - F.log(F.lit(level) * F.greatest("n", F.lit(1))))),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    rows = scanned.select("y", "n", weigh.alias("e")).toPandas()
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows["e"]), np.log1p(rows["n"])])
    return Model(draft.terms, rate, level, tuple(_logistic(x, rows["y"].to_numpy(float))))


def _lambda(score: np.ndarray, count: np.ndarray, words: int) -> float:
    """The positive root of mean(exp(lambda s)) = 1, by bisection; 1 if clean words never score."""
    if not len(score):
        return 1.0
    share, rest = count / words, 1 - count.sum() / words

    def mean(rate: float) -> float:
        return float((share * np.exp(rate * score)).sum() + rest * math.exp(-rate * DRIFT)) - 1

    low, high = 1e-3, 10.0
    if mean(low) >= 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


_WORKER: dict[int, _Scores] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages`` (first and last word, evidence)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.name(), model))

    @F.pandas_udf("score double, passages array<struct<first:int,last:int,evidence:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        name, model = shared.value
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = _Scores(model.terms)
        scores, rows = _WORKER[name], []
        for text in texts:
            n, hits = _hits(text, scores)
            total, passages = evidence(n, segments(hits), model.rate, model.level)
            a, b, c = model.curve
            odds = a + b * math.log1p(total) + c * math.log1p(n)
            rows.append((1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), passages))
        return pd.DataFrame(rows, columns=["score", "passages"])

    judged = docs.withColumn("_judged", judge(F.col(text_col)))
    return judged.withColumns(
        {
            "score": F.col("_judged.score"),
            "predicted": (F.col("_judged.score") >= 0.7).cast("int"),
            "passages": F.col("_judged.passages"),
        }
    ).drop("_judged")
