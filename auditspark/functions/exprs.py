"""Reusable column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark.functions import vocab

# ---------------------------------------------------------------- typing and coercion


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def null_if_nan(column: Column, dtype: T.DataType) -> Column:
    """NaN and NULL are both "missing"; only floating columns can hold NaN."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def to_number(column: Column, dtype: T.DataType | None = None) -> Column:
    """Numeric coercion: anything that does not parse is missing."""
    if isinstance(dtype, T.BooleanType):
        return column.cast("int").cast("double")
    number = column.cast("double") if dtype is not None and is_numeric(dtype) \
        else column.try_cast("double")
    return F.when(~F.isnan(number), number)


def as_text(column: Column, dtype: T.DataType) -> Column:
    """String form used for levels and distinct counts; -0.0 and 0.0 are one value."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), F.when(column == 0, F.lit("0.0"))
                      .otherwise(column.cast("string")))
    return column.cast("string")


def frame_dtype(dtype: T.DataType, n_missing: Column) -> Column:
    """Column type as a CSV reader without nullable integers reports it.

    An integer column with any missing value is a float there, which matters because the
    identifier rule exempts floats.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(n_missing > 0, "object").otherwise("bool")
    if is_floating(dtype):
        return F.lit("float64")
    if is_numeric(dtype):
        return F.when(n_missing > 0, "float64").otherwise("int64")
    return F.lit("object")


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


# ---------------------------------------------------------------- deterministic draws

_HEX = 13  # 13 hex digits = 52 bits, exact in a double


def draw(seed: int, row_id: Column, salt: str = "") -> Column:
    """Uniform integer in [0, 2^52) fixed by (seed, salt, row id) alone.

    Depends on no row order, partitioning or engine, so any SQL engine with md5 can repeat it.
    """
    text = F.concat_ws("|", F.lit(f"{seed}{salt}"), row_id.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("bigint")


def uniform(seed: int, row_id: Column, salt: str = "") -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, row_id, salt) / F.lit(float(1 << 52))


# ---------------------------------------------------------------- strings


def slug(name: Column) -> Column:
    """snake_case identifier: runs of anything that is not a letter or digit become one ``_``."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def truncate(message: Column, limit: int = vocab.ERROR_MESSAGE_LIMIT) -> Column:
    return F.substring(message, 1, limit)


def flatten_note(note: Column, limit: int = vocab.NOTE_LIMIT) -> Column:
    """One line, at most ``limit`` characters."""
    return F.substring(F.trim(F.regexp_replace(note, r"\s+", " ")), 1, limit)


# ---------------------------------------------------------------- intervals and verdicts


def wilson(successes: Column, n: Column, z: float = vocab.WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; no trials means the whole range."""
    p = successes / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    centre = p + z * z / (2.0 * n)
    scale = 1 + z * z / n
    low = F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / scale)).otherwise(F.lit(0.0))
    high = F.when(n > 0, F.least(F.lit(1.0), (centre + half) / scale)).otherwise(F.lit(1.0))
    return low, high


def disjoint(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return (a_high < b_low) | (b_high < a_low)


def power_verdict(a_reps: Column, b_reps: Column, separated: Column) -> Column:
    """Fewer than two replicates on either side outranks any distance between the intervals."""
    return (
        F.when((a_reps < 2) | (b_reps < 2), F.lit("underpowered"))
        .when(separated, F.lit("separates"))
        .otherwise(F.lit("not separating"))
    )


def signed(metric: Column) -> Column:
    """+1 where a larger metric is better, -1 where a smaller one is, +1 when unknown."""
    lower = [name for name, greater in vocab.GREATER_IS_BETTER.items() if not greater]
    return F.when(metric.isin(lower), F.lit(-1.0)).otherwise(F.lit(1.0))


# ---------------------------------------------------------------- metric predicates

# The two words that may follow a metric's column, and what they ask of it.
_ASKS = {"notnull": Column.isNotNull, "isnull": Column.isNull}


def metric_ask(spec: str) -> tuple[str, Callable[[Column], Column] | None]:
    """The column that ``spec`` names and what it asks of it; None asks whether it is true."""
    name, *asked = spec.split(":", 1)
    strange = [word for word in asked if word not in _ASKS]
    if strange:
        raise ValueError(f"unknown predicate {strange[0]!r}: {spec!r} may ask {sorted(_ASKS)}")
    return name, _ASKS[asked[0]] if asked else None


def truthy(column: Column, dtype: T.DataType) -> Column:
    """Whether a recorded value counts as a success; NULL stays NULL."""
    if isinstance(dtype, T.BooleanType):
        return column
    if is_numeric(dtype):
        return column != 0
    if isinstance(dtype, T.StringType):
        return column != ""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.when(column.isNotNull(), F.size(column) > 0)
    return F.when(column.isNotNull(), F.lit(True))


def metric_outcome(df: DataFrame, spec: str) -> Column:
    """Boolean success of ``spec`` per row; NULL means excluded from the denominator."""
    name, ask = metric_ask(spec)
    types = field_types(df)
    column = F.col(name) if name in types else F.lit(None).cast("boolean")
    return ask(column) if ask else truthy(column, types.get(name, T.BooleanType()))
