"""Exploratory tables: class balance, column quality, summary statistics, correlation, PCA."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import numeric_columns
from tidewatch.operators.gram import pearson
from tidewatch.operators.quantiles import exact_quantiles


def class_distribution(df: DataFrame, target: str = "label", class_names: list[str] | None = None) -> DataFrame:
    """``(class, n, share)``; integer targets are named through ``class_names`` when given."""
    named = F.col(target).cast("string")
    if class_names is not None:
        # get() is null outside the list; such an index keeps its own text.
        named = F.coalesce(F.get(F.array(*[F.lit(c) for c in class_names]), F.col(target).cast("int")), named)
    counts = df.filter(F.col(target).isNotNull()).groupBy(named.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n") / total).orderBy("class")


def class_percentages(df: DataFrame, target: str = "label") -> DataFrame:
    return class_distribution(df, target).select(
        "class", "n", (F.col("share") * 100).alias("percent")
    ).orderBy(F.desc("n"), "class")


def column_quality(df: DataFrame) -> DataFrame:
    """``(column, type, missing, missing_pct, distinct_values)`` for every column, in one aggregate."""
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.count_if(F.col(name).isNull()).alias("missing"),
            F.round(
                F.coalesce(F.try_divide(F.count_if(F.col(name).isNull()) * F.lit(100.0), F.count(F.lit(1))), F.lit(0.0)), 3
            ).alias("missing_pct"),
            F.count_distinct(name).alias("distinct_values"),
        )
        for name, kind in df.dtypes
    ]
    return df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")


def most_missing(df: DataFrame, limit: int = 15) -> DataFrame:
    """``(column, missing)`` of the columns with the most nulls: one count per column, no distinct values."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return counts.select(F.explode(named).alias("_e")).select("_e.*").orderBy(F.desc("missing"), "column").limit(limit)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n, mean, std, min, q25, q50, q75, max)``; std is the sample deviation."""
    columns = columns or numeric_columns(df)
    entries = []
    for c in columns:
        v = F.col(c).cast("double")
        entries.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        ))
    moments = df.agg(F.array(*entries).alias("_e")).select(F.explode("_e").alias("_e")).select("_e.*")
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q75"),
    )
    # Both sides have one row per column.
    return moments.join(F.broadcast(quartiles), "column").select(
        "column", "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def percentiles_by_class(df: DataFrame, features: list[str], probs: list[float], target: str = "label") -> DataFrame:
    """``(label, column, prob, value)``: the data behind a per-class distribution plot."""
    return exact_quantiles(df, features, probs, by=[target])


def histogram_by_class(df: DataFrame, feature: str, low: float, high: float, bins: int, target: str = "label") -> DataFrame:
    """``(label, bin, n)`` over ``bins`` equal-width bins."""
    bucket = F.width_bucket(F.col(feature).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(feature).isNotNull()).groupBy(target, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def guarded_corr(a: str, b: str):
    """Pearson r over rows where both are known; null where a side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x = F.when(both, F.col(a).cast("double"))
    y = F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(i, j, column_i, column_j, r)`` for i < j, each over the rows where both are known; null r where a side does not vary."""
    return pearson(df, columns or numeric_columns(df)).drop("n")


def pca_projection(df: DataFrame, features: list[str], keep: list[str], k: int = 2, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """First ``k`` principal components of the standardised features, and their variance shares."""
    stats = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)],
    ).first()
    scaled = df.select(*keep, *[
        ((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0)).alias(c)
        for i, c in enumerate(features)
    ])
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(scaled)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    parts = vector_to_array("_p")
    projected = model.transform(vectors).select(*keep, *[parts[i].alias(f"pc{i + 1}") for i in range(k)])
    return projected, [float(v) for v in model.explainedVariance.toArray()]
