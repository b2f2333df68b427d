"""Fitted preprocessing: median imputation, one-hot levels, scaling and label indices.

Fitting reads the table three times (medians, category counts, moments) and keeps only per-column
facts. Applying them is one projection of built-in expressions.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import FlowDataError, need_columns
from tidewatch.functions.numbers import categorical_columns, missing_to_null, numeric_columns, to_number
from tidewatch.operators.quality import check_table, unknown_labels
from tidewatch.operators.quantiles import medians
from tidewatch.session import settle

UNKNOWN = "__unknown__"
SCALERS = ("standard", "minmax", "none")


@dataclass
class EncoderState:
    """Everything learned while fitting; small, JSON-safe."""

    target: str
    scaler: str
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    levels: dict[str, list[str]]
    modes: dict[str, str]
    classes: list[str]
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        """Encoded columns: numbers first, then per category its levels and the unknown slot."""
        return self.numeric + [f"{c}_{level}" for c in self.categorical for level in [*self.levels[c], UNKNOWN]]

    @property
    def defaults(self) -> dict[str, float | str]:
        return {**self.medians, **self.modes}


def as_category(df: DataFrame, name: str) -> Column:
    """Category text of a string or boolean column."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return F.when(F.col(name), F.lit("True")).when(~F.col(name), F.lit("False"))
    return F.col(name).cast("string")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, level, n)``, null level included. Repeats collapse before the shuffle."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), as_category(df, c).alias("level")) for c in columns
    ])).alias("_e")
    return df.select(pairs).select("_e.*").groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))


def category_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, level)``, the distinct non-null levels."""
    return category_counts(df, columns).filter(F.col("level").isNotNull()).select("column", "level")


def category_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mode)``; ties go to the smallest level."""
    counts = category_counts(df, columns).filter(F.col("level").isNotNull())
    return counts.groupBy("column").agg(F.min(F.struct(-F.col("n"), F.col("level"))).alias("_m")) \
        .select("column", F.col("_m.level").alias("mode"))


def median_table(df: DataFrame, columns: list[str]) -> DataFrame:
    found = medians(df, columns)
    return df.sparkSession.createDataFrame([(c, found[c]) for c in columns], "column string, median double")


def impute(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Coerce the columns to double and fill what is missing."""
    return df.withColumns({c: F.coalesce(to_number(F.col(c)), F.lit(float(v))) for c, v in values.items()})


def one_hot(category: Column, column: str, levels: list[str]) -> dict[str, Column]:
    """One 0/1 column per level and one for anything else, null included."""
    out = {f"{column}_{level}": F.when(category == level, 1.0).otherwise(0.0) for level in levels}
    known = F.coalesce(category.isin(levels), F.lit(False)) if levels else F.lit(False)
    out[f"{column}_{UNKNOWN}"] = F.when(known, 0.0).otherwise(1.0)
    return out


def scaling_facts(scaler: str, low, high, mean, deviation) -> tuple[float, float]:
    """(center, scale) with 1 in place of a zero scale, so an unseen level keeps its full weight."""
    if scaler == "standard":
        return mean, (deviation if high != low and deviation > 0 else 1.0)
    if scaler == "minmax":
        return low, (high - low if high != low else 1.0)
    return 0.0, 1.0


def scale_table(df: DataFrame, columns: list[str], scaler: str) -> DataFrame:
    """The columns scaled with facts taken from the same table."""
    facts = _moments(df, {c: F.col(c).cast("double") for c in columns})
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(center)) / F.lit(scale)
        for c in columns for center, scale in [scaling_facts(scaler, *facts[c])]
    })


def _moments(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple]:
    row = df.agg(*[
        F.struct(F.min(v), F.max(v), F.avg(v), F.stddev_pop(v)).alias(f"s{i}") for i, v in enumerate(columns.values())
    ]).first()
    return {c: tuple(0.0 if x is None else float(x) for x in row[i]) for i, c in enumerate(columns)}


def class_names(df: DataFrame, target: str) -> list[str]:
    rows = df.select(F.col(target).cast("string").alias("c")).filter("c is not null").distinct().collect()
    return sorted(r["c"] for r in rows)


def encode_label(target: Column, classes: list[str]) -> Column:
    """0-based class index in text order; null for an unknown label."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), target.cast("string"))
    return F.when(place > 0, place - 1).cast("double")


def decode_label(index: Column, classes: list[str]) -> Column:
    """Class name of an index; an index outside the list keeps its own text."""
    known = F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))
    return F.coalesce(F.when(index.cast("int") >= 0, known), index.cast("bigint").cast("string"))


class FlowEncoder(Estimator):
    """Learns an :class:`EncoderModel` from a labelled table."""

    def __init__(self, target: str = "label", scaler: str = "standard", drop=(), max_levels: int | None = None):
        super().__init__()
        if scaler not in SCALERS:
            raise FlowDataError(f"unknown scaler {scaler!r}; choose one of {', '.join(SCALERS)}")
        self.target, self.scaler, self.drop, self.max_levels = target, scaler, list(drop), max_levels

    def _fit(self, df: DataFrame) -> EncoderModel:
        df = missing_to_null(check_table(df, [self.target]))
        skip = {self.target, *self.drop}
        numeric, categorical = numeric_columns(df, skip), categorical_columns(df, skip)
        if not numeric and not categorical:
            raise FlowDataError("no usable feature columns")
        middle = medians(df, numeric) if numeric else {}
        levels: dict[str, list[str]] = {c: [] for c in categorical}
        modes: dict[str, str] = {}
        counts: dict[tuple[str, str], int] = {}
        # One row per level, each of which becomes a column; max_levels, if asked for, refuses wide ones before they are read.
        found = category_counts(df, [*categorical, self.target])
        if self.max_levels is not None:
            found = settle(found)
            sizes = found.filter("level is not null").groupBy("column").count().filter(F.col("count") > self.max_levels)
            if wide := sorted(r["column"] for r in sizes.collect()):
                raise FlowDataError(f"more than {self.max_levels} levels in: {', '.join(wide)}")
        rows = found.collect()
        total = sum(r["n"] for r in rows if r["column"] == self.target)
        classes = sorted(r["level"] for r in rows if r["column"] == self.target and r["level"] is not None)
        for r in rows:
            if r["column"] != self.target and r["level"] is not None:
                levels[r["column"]].append(r["level"])
                counts[r["column"], r["level"]] = r["n"]
        for c in categorical:
            levels[c].sort()
            if not levels[c]:
                raise FlowDataError(f"categorical column {c} holds no value")
            modes[c] = min(levels[c], key=lambda level: (-counts[c, level], level))
        state = EncoderState(self.target, self.scaler, numeric, categorical, middle, levels, modes, classes)
        if self.scaler != "none":
            facts = _moments(df, {c: F.coalesce(to_number(F.col(c)), F.lit(middle[c])) for c in numeric}) if numeric else {}
            for c in categorical:
                unknown = total - sum(counts[c, level] for level in levels[c])
                for level, n in [*[(level, counts[c, level]) for level in levels[c]], (UNKNOWN, unknown)]:
                    share = n / total  # a 0/1 column's moments follow from its count of ones
                    facts[f"{c}_{level}"] = (
                        1.0 if n == total else 0.0, 1.0 if n else 0.0, share, math.sqrt(share * (1.0 - share))
                    )
            for name in state.features:
                state.center[name], state.scale[name] = scaling_facts(self.scaler, *facts[name])
        return EncoderModel(state)


class EncoderModel(Model):
    """Applies a fitted :class:`EncoderState`."""

    def __init__(self, state: EncoderState):
        super().__init__()
        self.state = state

    def fill_defaults(self, df: DataFrame) -> DataFrame:
        """Add absent input columns with the learned median or mode."""
        absent = {c: F.lit(v) for c, v in self.state.defaults.items() if c not in df.columns}
        return df.withColumns(absent) if absent else df

    def encoded(self, df: DataFrame) -> dict[str, Column]:
        s = self.state
        out = {c: F.coalesce(to_number(F.col(c)), F.lit(s.medians[c])) for c in s.numeric}
        for c in s.categorical:
            out.update(one_hot(as_category(df, c), c, s.levels[c]))
        if s.scaler != "none":
            out = {c: (v - F.lit(s.center[c])) / F.lit(s.scale[c]) for c, v in out.items()}
        return out

    def transform_features(self, df: DataFrame, keep=(), columns=None, fill_missing: bool = False) -> DataFrame:
        """``keep`` columns followed by the encoded features (or the chosen ``columns`` of them)."""
        if fill_missing:
            df = self.fill_defaults(df)
        need_columns(df, self.state.numeric + self.state.categorical)
        made = self.encoded(df)
        wanted = columns if columns is not None else self.state.features
        return df.select(*keep, *[
            (made[c] if c in made else F.lit(0.0)).alias(c) for c in wanted
        ])

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.transform_features(df, keep=[self.state.target] if self.state.target in df.columns else [])

    def check_labels(self, df: DataFrame) -> DataFrame:
        """Refuse labels that were not there when fitting."""
        unseen = unknown_labels(df, self.state.target, self.state.classes).collect()
        if unseen:
            raise FlowDataError(f"unseen label(s): {', '.join(sorted(str(r[0]) for r in unseen))}")
        return df

    def label_index(self) -> Column:
        return encode_label(F.col(self.state.target), self.state.classes)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self.state)),)], "state string") \
            .coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> EncoderModel:
        return EncoderModel(EncoderState(**json.loads(spark.read.text(path).first()[0])))
