"""Null-safe numeric expressions.

The missing marker is null. NaN and the infinities of a source become null on the way in, because
Spark orders NaN above every number and treats NaN as equal to itself. Rules that apply to every
column of a wide table are SQL text, so that a table of any width is one ``selectExpr``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite_test(value: str) -> str:
    """SQL text: known, not NaN and not infinite."""
    return f"({value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < double('Infinity'))"


def finite_text(value: str) -> str:
    return f"CASE WHEN {finite_test(value)} THEN {value} END"


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def is_finite(name: str) -> Column:
    return F.expr(finite_test(quoted(name)))


def numeric_columns(df: DataFrame, skip=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, skip=()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in skip
    ]


def fractional_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and the infinities of all fractional columns into null."""
    fractional = set(fractional_columns(df))
    return df.selectExpr(*[
        f"{finite_text(quoted(c))} AS {quoted(c)}" if c in fractional else quoted(c) for c in df.columns
    ])


def to_number(c: Column) -> Column:
    """Coerce to double; text that is no number becomes null, and so do NaN and the infinities."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
