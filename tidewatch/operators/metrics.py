"""Multiclass evaluation tables. All but AUC and ROC are derived from one (truth, prediction) count."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.score_cells import CELL_ROWS, auc_table, roc_table, score_cells
from tidewatch.session import listed_side


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(truth, predicted, n)`` for the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """The full class x class grid, zeros included, plus the row-normalised ``share``."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[truth]
    grid = listed_side(spark, [(a, b) for a in classes for b in classes], f"truth {kind}, predicted {kind}")
    counts = pair_counts(df, truth, predicted)
    full = grid.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )
    row_total = F.sum("n").over(Window.partitionBy("truth"))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), row_total), F.lit(0.0)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_scores(counts: DataFrame) -> DataFrame:
    """``(class, tp, support, predicted_n, precision, recall, f1)`` from ``(truth, predicted, n)``.

    One row per class met as truth or prediction (or listed in a zero-filled grid).
    """
    hit = F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted_n")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted_n")),
    )).alias("_e")).select("_e.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted_n")])
    precision, recall = safe_ratio(F.col("tp"), F.col("predicted_n")), safe_ratio(F.col("tp"), F.col("support"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", safe_ratio(F.lit(2.0) * F.col("tp"), F.col("support") + F.col("predicted_n"))
    )


def headline_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(metric, value)``: accuracy, macro and weighted precision, recall and F1.

    Macro means average over the classes seen in truth or prediction.
    """
    scores = class_scores(pair_counts(df, truth, predicted))
    total = F.sum("support")
    row = scores.agg(
        safe_ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[safe_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
    )
    return row.unpivot([], list(row.columns), "metric", "value")


def class_report(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Per-class rows over the fixed class list, then ``macro avg`` and ``weighted avg``."""
    grid = confusion(df, truth, predicted, classes).select("truth", "predicted", "n")
    scores = class_scores(grid).select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    measures = ("precision", "recall", "f1")
    macro = scores.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = scores.agg(
        F.lit("weighted avg").alias("class"),
        *[safe_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return scores.unionByName(macro).unionByName(weighted)


def auc_per_class(df: DataFrame, truth: str, scores: dict[str, Column], cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(class, auc)`` one against the rest; tied scores count half; null where a side is empty."""
    return auc_table(score_cells(df, truth, scores, cell_rows))


def auc_roc(df: DataFrame, truth: str, scores: dict[str, Column], classes: list[str]) -> DataFrame:
    """One row ``(auc_roc)``: the second class for two classes, else the mean over all; NaN if undefined."""
    per = auc_per_class(df, truth, {classes[1]: scores[classes[1]]} if len(classes) == 2 else scores)
    usable = F.count("auc") == F.count(F.lit(1))
    return per.agg(F.when(usable, F.avg("auc")).otherwise(F.lit(float("nan"))).alias("auc_roc"))


def roc_points(df: DataFrame, truth: str, scores: dict[str, Column], corners: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` by falling threshold, from (0, 0); classes without positives are left out.

    ``corners`` keeps only the points where the curve turns.
    """
    return roc_table(score_cells(df, truth, scores, cell_rows), corners)


def hit_rate(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(class, n, hits, rate)`` per true class."""
    hit = F.count_if(F.col(truth) == F.col(predicted))
    return df.groupBy(F.col(truth).alias("class")).agg(F.count(F.lit(1)).alias("n"), hit.alias("hits")).withColumn(
        "rate", safe_ratio(F.col("hits"), F.col("n"))
    )


def balanced_weights(df: DataFrame, target: str = "label") -> DataFrame:
    """``(class, n, weight)`` with weight ``rows / (classes * class rows)``."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per class
    return counts.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")).cast("double")
    )


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol):
    """Macro F1 over the classes seen in truth or prediction, for tuning and cross-validation."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol)

    def _evaluate(self, dataset: DataFrame) -> float:
        scores = class_scores(pair_counts(dataset, self.getLabelCol(), self.getPredictionCol()))
        return float(scores.agg(F.coalesce(F.avg("f1"), F.lit(0.0))).first()[0])

    def isLargerBetter(self) -> bool:
        return True
