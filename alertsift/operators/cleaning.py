"""Cleaning, imputation, encoding and scaling of packet and flow features.

Fitting reduces the data to a few numbers per column (medians, quartiles, modes) which then
stand as literals in the transforming expressions, so applying them is one projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .quantiles import exact_quantiles

_INF = float("inf")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def _fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def sentinel_to_null(df: DataFrame, columns: Sequence[str] | None = None, minus_one: bool = True, infinite: bool = True) -> DataFrame:
    """-1, "-1", NaN and (if asked) both infinities become null."""
    out = {}
    for name in columns or df.columns:
        kind, col = df.schema[name].dataType, _q(name)
        if isinstance(kind, T.StringType):
            bad = (col == "-1") if minus_one else F.lit(False)
        elif isinstance(kind, T.NumericType):
            bad = (col == -1) if minus_one else F.lit(False)
            if _fractional(df, name):
                bad = bad | F.isnan(col)
                if infinite:
                    bad = bad | (F.abs(col) == _INF)
        else:
            continue
        out[name] = F.when(~bad, col)
    return df.withColumns(out)


def cap_infinity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For columns with an infinity: flag either sign, replace +inf by the greatest other value."""
    names = [c for c in (columns or numeric_columns(df)) if _fractional(df, c)]
    if not names:
        return df
    stats = df.agg(
        *[F.count_if(F.abs(_q(c)) == _INF).alias(f"n{i}") for i, c in enumerate(names)],
        *[F.max(F.when(_q(c) != _INF, _q(c))).alias(f"m{i}") for i, c in enumerate(names)],
    ).first()
    out = {}
    for i, c in enumerate(names):
        if stats[f"n{i}"]:
            out[f"{c}_is_infinite"] = F.coalesce(F.abs(_q(c)) == _INF, F.lit(False)).cast("int")
            out[c] = F.when(_q(c) == _INF, F.lit(stats[f"m{i}"])).otherwise(_q(c))
    return df.withColumns(out) if out else df


def missing_indicators(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``<c>_is_missing`` for the columns that have any null."""
    names = list(columns or numeric_columns(df))
    nulls = df.agg(*[F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return df.withColumns({f"{c}_is_missing": _q(c).isNull().cast("int") for i, c in enumerate(names) if nulls[i]})


def _fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(_q(c), F.lit(v)) for c, v in values.items() if v is not None})


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, fallback: float | None = None) -> DataFrame:
    """Null to the exact whole-frame median; an all-null column takes ``fallback`` if given."""
    names = list(columns or numeric_columns(df))
    medians = {c: q[0] for c, q in exact_quantiles(df, names, [0.5]).items()}
    return _fill(df, {c: fallback if m is None else m for c, m in medians.items()})


def fill_unknown(df: DataFrame, columns: Sequence[str] | None = None, value: str = "unknown") -> DataFrame:
    return _fill(df, {c: value for c in (columns or text_columns(df))})


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column; the smallest of equally frequent ones."""
    modes = {}
    for c in columns:
        top = (
            df.where(_q(c).isNotNull())
            .groupBy(_q(c).alias("v"))
            .agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), "v")
            .first()
        )
        modes[c] = top["v"] if top else None
    return modes


def mode_impute(df: DataFrame, modes: Mapping[str, object]) -> DataFrame:
    return _fill(df, modes)


def fit_categories(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list]:
    """Sorted distinct values per column; an error above ``limit`` values, which is no category."""
    out = {}
    for c in columns:
        rows = df.where(_q(c).isNotNull()).select(_q(c).alias("v")).distinct().limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{c} has more than {limit} values")
        out[c] = sorted(r["v"] for r in rows)
    return out


def one_hot(df: DataFrame, categories: Mapping[str, list]) -> DataFrame:
    """``<column>_<value>`` 0/1 columns in place of each column; unseen values give all zeros."""
    flags = {
        f"{c}_{v}": F.coalesce(_q(c) == v, F.lit(False)).cast("int") for c, values in categories.items() for v in values
    }
    return df.withColumns(flags).drop(*categories)


def one_hot_packets(df: DataFrame) -> DataFrame:
    """Encode the three low-cardinality packet columns, as far as present; drop the constant one."""
    df = df.drop(*S.CONSTANT_COLUMNS)
    return one_hot(df, fit_categories(df, [c for c in S.ONE_HOT_COLUMNS if c in df.columns]))


def identifier_columns(names: Sequence[str], words: Sequence[str] = tuple(S.IDENTIFIER_WORDS)) -> list[str]:
    """Names that contain an identity word between spaces, dashes or underscores."""
    wanted = set(words)
    return [n for n in names if wanted & set(re.split(r"[ \-_]", n.lower()))]


def split_identifiers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(behaviour columns, identity columns)."""
    ids = identifier_columns(df.columns)
    return df.drop(*ids), df.select(*[_q(c) for c in ids])


def keep_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns that have at least one value."""
    names = numeric_columns(df)
    counts = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return df.select(*[_q(c) for i, c in enumerate(names) if counts[i]])


def log1p(df: DataFrame, columns: Sequence[str], absolute: bool = False) -> DataFrame:
    """log(1 + x), or of |x|. Spark gives null at or below -1."""
    return df.withColumns({c: F.log1p(F.abs(_q(c)) if absolute else _q(c).cast("double")) for c in columns})


def hex_to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``0x..`` text to its value, other text to a number if it is one, null to the median.

    All digits count, however many; text with anything but digits behind ``0x`` is no number.
    """
    parsed = df.withColumns({c: F.when(_q(c).startswith("0x"), _hex_value(_q(c))).otherwise(_q(c).try_cast("double")) for c in columns})
    return median_impute(parsed, columns)


def _hex_value(text: Column) -> Column:
    digits = F.substring(text, 3, 1 << 30)
    digit = lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1).cast("double")
    long = F.aggregate(F.split(F.lower(digits), ""), F.lit(0.0), lambda total, c: F.when(c == "", total).otherwise(total * 16 + digit(c)))
    short = F.conv(digits, 16, 10).try_cast("double")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,16}$"), short).when(digits.rlike("^[0-9a-fA-F]+$"), long)


@dataclass(frozen=True)
class Scaling:
    """Centre and (non-zero) scale per column."""

    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_q(c) - F.lit(self.centre[c])) / F.lit(self.scale[c]) for c in self.centre})


def fit_robust(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Median and interquartile range; a zero range divides by 1."""
    quartiles = {c: q for c, q in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items() if q[0] is not None}
    return Scaling({c: q[1] for c, q in quartiles.items()}, {c: (q[2] - q[0]) or 1.0 for c, q in quartiles.items()})


def fit_standard(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Mean and population standard deviation; a zero deviation divides by 1."""
    row = df.agg(
        *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(_q(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    used = [(i, c) for i, c in enumerate(columns) if row[f"m{i}"] is not None]
    return Scaling({c: row[f"m{i}"] for i, c in used}, {c: row[f"s{i}"] or 1.0 for i, c in used})


@dataclass(frozen=True)
class Preprocessor:
    """Imputation, indicators, optional scaling and one-hot encoding fitted on training rows."""

    medians: dict[str, float]
    indicators: list[str]
    modes: dict[str, object]
    categories: dict[str, list]
    scaling: Scaling | None

    @property
    def features(self) -> list[str]:
        hot = [f"{c}_{v}" for c, values in self.categories.items() for v in values]
        return [*self.medians, *[f"{c}_is_missing" for c in self.indicators], *hot]

    def apply(self, df: DataFrame) -> DataFrame:
        """Add the feature columns; numeric ones are replaced, categorical ones dropped."""
        df = sentinel_to_null(df, [*self.medians, *self.categories])
        df = df.withColumns({f"{c}_is_missing": _q(c).isNull().cast("double") for c in self.indicators})
        df = df.withColumns({c: F.coalesce(_q(c).cast("double"), F.lit(m)) for c, m in self.medians.items()})
        if self.scaling:
            df = self.scaling.apply(df)
        return one_hot(mode_impute(df, self.modes), self.categories)


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = False) -> Preprocessor:
    """Train-only medians, missing indicators, modes and categories; all-null columns drop out."""
    train = sentinel_to_null(train, [*numeric, *categorical])
    medians = {c: q[0] for c, q in exact_quantiles(train, list(numeric), [0.5]).items() if q[0] is not None}
    nulls = train.agg(*[F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(medians)]).first()
    indicators = [c for i, c in enumerate(medians) if nulls[i]]
    modes = fit_modes(train, categorical)
    categories = fit_categories(mode_impute(train, modes), categorical)
    scaling = None
    if scale:
        filled = train.withColumns(
            {c: F.coalesce(_q(c).cast("double"), F.lit(m)) for c, m in medians.items()}
            | {f"{c}_is_missing": _q(c).isNull().cast("double") for c in indicators}
        )
        scaling = fit_standard(filled, [*medians, *[f"{c}_is_missing" for c in indicators]])
    return Preprocessor(medians, indicators, modes, categories, scaling)


def forbid_columns(names: Sequence[str], forbidden: Sequence[str] = tuple(S.FORBIDDEN_FEATURES)) -> None:
    """Fail if a model matrix holds an identity, label or diagnostic column."""
    leaked = sorted(set(names) & set(forbidden))
    if leaked:
        raise ValueError(f"forbidden model columns: {leaked}")


def encode_target(df: DataFrame, label: str = "label") -> DataFrame:
    """``y_binary`` (any attack) and ``y_class``, the place of the label in alphabetical order."""
    classes = fit_categories(df, [label])[label]
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), _q(label)) - 1
    return df.withColumns({"y_binary": (_q(label) != S.BENIGN).cast("int"), "y_class": place.cast("int")})


def prepare_packets(df: DataFrame, identifiers: Sequence[str], label: str = "label", fit_on: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Raw packets to scaled behaviour features; returns (frame, feature names).

    Identifier columns are kept under ``id_<name>``. ``fit_on`` limits the rows that medians
    and scales are learnt from (default: all). Fails on missing identifiers, when no feature
    is left, or when a feature ends up null.
    """
    absent = [c for c in identifiers if c not in df.columns]
    if absent:
        raise ValueError(f"packet data is missing {absent}")
    kept = [f"id_{c}" for c in identifiers]
    df = df.withColumns({f"id_{c}": _q(c) for c in identifiers})
    raw = [c for c in df.columns if c not in kept and c != label]
    df = sentinel_to_null(df, raw, infinite=False)
    numeric = [c for c in raw if c in numeric_columns(df)]
    text = [c for c in raw if c not in numeric]
    df = missing_indicators(cap_infinity(df, numeric), numeric)
    sample = df if fit_on is None else df.where(fit_on)
    medians = {c: q[0] for c, q in exact_quantiles(sample, numeric, [0.5]).items()}
    df = one_hot_packets(fill_unknown(_fill(df, medians), text))
    names = [c for c in df.columns if c not in kept and c != label]
    behaviour = [c for c in names if c not in identifier_columns(names)]
    frame = df.select(*kept, label, *[_q(c) for c in behaviour])
    features = [c for c in behaviour if c in numeric_columns(frame)]
    if features:
        counts = frame.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(features)]).first()
        features = [c for i, c in enumerate(features) if counts[i]]
    if not features:
        raise ValueError("no numeric features left")
    logged = log1p(frame.select(*kept, label, *[_q(c) for c in features]), features)
    # -inf has no logarithm either, so it shows up as a null feature below.
    fitted = logged if fit_on is None else log1p(frame.where(fit_on).select(*[_q(c) for c in features]), features)
    bad = logged.agg(*[F.count_if(_q(c).isNull() | F.isnan(_q(c))).alias(f"n{i}") for i, c in enumerate(features)]).first()
    broken = [c for i, c in enumerate(features) if bad[i]]
    if broken:
        raise ValueError(f"null features after the logarithm: {broken[:8]}")
    return fit_robust(fitted, features).apply(logged), features
