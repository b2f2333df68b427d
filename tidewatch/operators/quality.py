"""Cleaning, table contracts and row contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import FlowDataError, check_positive, need_columns
from tidewatch.functions.columns import BYTE_CAP
from tidewatch.functions.numbers import is_finite, missing_to_null
from tidewatch.session import listed_side


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def check_table(df: DataFrame, columns=(), min_rows: int = 1) -> DataFrame:
    """Refuse a table without the columns or with fewer than ``min_rows`` rows."""
    need_columns(df, columns)
    if min_rows > 0 and df.select(F.lit(1)).limit(min_rows).count() < min_rows:
        raise FlowDataError(f"table has fewer than {min_rows} row(s)")
    return df


def check_target(df: DataFrame, target: str, min_classes: int = 2) -> DataFrame:
    """Refuse a target with nulls or with fewer than ``min_classes`` classes."""
    check_table(df, [target])
    facts = df.agg(
        F.count_if(F.col(target).isNull()).alias("missing"), F.count_distinct(target).alias("classes")
    ).first()
    if facts["missing"]:
        raise FlowDataError(f"target {target} is null in {facts['missing']} row(s)")
    if facts["classes"] < min_classes:
        raise FlowDataError(f"target {target} has {facts['classes']} class(es), needs {min_classes}")
    return df


def constant_columns(df: DataFrame, target: str) -> DataFrame:
    """Rows ``(column)`` for every non-target column with at most one value, null counted as one.

    ``min = max`` and a null count decide it in one aggregate with constant-size state.
    """
    names = [c for c in df.columns if c != target]
    tests = [
        F.struct(
            F.lit(c).alias("column"),
            (
                (F.count(c) == 0) | ((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)))
            ).alias("constant"),
        )
        for c in names
    ]
    return df.agg(F.array(*tests).alias("_t")).select(F.explode("_t").alias("_e")).select("_e.*") \
        .filter("constant").select("column")


def drop_rows_without(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def clean(df: DataFrame, target: str = "label", drop_constants: bool = True) -> DataFrame:
    """Null out non-finite numbers, drop target-less rows, duplicate rows, then constant columns.

    Duplicates collapse on the map side first, so a row repeated in a third of the table costs one
    row per map task in the shuffle.
    """
    check_table(df, [target])
    distinct = drop_rows_without(missing_to_null(df), target).dropDuplicates()
    if not drop_constants:
        return distinct
    # Dropping duplicates changes neither min, max nor "any null": the deduplicated and the
    # plain table have the same constant columns, and the plain one needs no shuffle.
    plain = drop_rows_without(missing_to_null(df), target)
    return distinct.drop(*[r["column"] for r in constant_columns(plain, target).collect()])


def collapse_label(df: DataFrame, target: str = "label", harmless: str = "normal", other: str = "attack") -> DataFrame:
    return df.withColumn(target, F.when(F.col(target) == harmless, F.lit(harmless)).otherwise(F.lit(other)))


def cap_bytes(df: DataFrame, columns=("src_bytes", "dst_bytes"), cap: int = BYTE_CAP) -> DataFrame:
    """Cap the byte columns; null stays null."""
    return df.withColumns({
        c: F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(cap).cast(df.schema[c].dataType)))
        for c in columns if c in df.columns
    })


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def _violations(tests: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(broken, F.lit(text)) for text, broken in tests]), lambda v: v.isNotNull())


def record_violations(df: DataFrame, expected: list[str]) -> DataFrame:
    """Add ``violations``: expected features that are absent, null or not finite."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    tests = []
    for c in expected:
        if c not in df.columns:
            tests.append((f"{c} is missing", F.lit(True)))
            continue
        tests.append((f"{c} is null", F.col(c).isNull()))
        if c in numeric:
            tests.append((f"{c} is not finite", F.col(c).isNotNull() & ~is_finite(c)))
    return df.withColumn("violations", _violations(tests))


# Defaults a submitted record takes for the eight typed fields.
RECORD_DEFAULTS = {
    "duration": 0.0, "protocol_type": "tcp", "service": "http", "flag": "SF",
    "src_bytes": 0, "dst_bytes": 0, "count": 1, "srv_count": 1,
}


def apply_record_contract(df: DataFrame) -> DataFrame:
    """Fill defaults, trim the text fields and add ``violations`` for negatives and blanks."""
    out, tests = {}, []
    for c, default in RECORD_DEFAULTS.items():
        kind = "string" if isinstance(default, str) else "double" if isinstance(default, float) else "bigint"
        value = F.coalesce(F.col(c), F.lit(default).cast(kind)) if c in df.columns else F.lit(default).cast(kind)
        out[c] = F.trim(value) if kind == "string" else value
        tests.append((f"{c} is empty", F.col(c) == "") if kind == "string" else (f"{c} is negative", F.col(c) < 0))
    return df.withColumns(out).withColumn("violations", _violations(tests))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a table with ``violations``."""
    ok = F.size("violations") == 0
    return df.filter(ok).drop("violations"), df.filter(~ok)


def unknown_labels(df: DataFrame, target: str, classes: list[str]) -> DataFrame:
    """Distinct labels outside ``classes``."""
    check_positive(len(classes), "number of classes")
    known = listed_side(df.sparkSession, [(str(c),) for c in classes], f"{target} string")
    seen = df.select(F.col(target).cast("string").alias(target)).distinct()
    return seen.join(known, target, "left_anti")
