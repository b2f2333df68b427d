"""Rolling and lifetime detection statistics, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import check_positive
from tidewatch.operators.ordering import rolling_rows, row_index, running_sums

WINDOW_ROWS = 500
BATCH_ROWS = 100
ORDER = ["ts_us", "flow_id"]


def newest(detections: DataFrame, size: int = WINDOW_ROWS) -> DataFrame:
    """The last ``size`` detections (per-partition top-n, then a merge of those)."""
    check_positive(size, "window size")
    return detections.orderBy(*[F.desc(c) for c in ORDER]).limit(size)


def class_counts(window: DataFrame) -> DataFrame:
    return window.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("n"))


def trending_class(window: DataFrame) -> DataFrame:
    """One row: the most frequent attack class; of equals, the one seen first in the window."""
    seen = window.filter("is_attack").groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first")
    )
    return seen.agg(F.min_by("predicted_class", F.struct(-F.col("n"), F.col("first"))).alias("trending_class"))


def rolling_snapshot(detections: DataFrame, size: int = WINDOW_ROWS) -> DataFrame:
    """One row: window statistics and the trending class, from one count per class."""
    attacks = F.count_if("is_attack")
    per_class = newest(detections, size).groupBy("predicted_class").agg(
        F.count(F.lit(1)).alias("n"), attacks.alias("a"), F.sum("confidence").alias("c"),
        F.min(F.when(F.col("is_attack"), F.struct(*ORDER))).alias("first"),
    )
    n, a = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0))
    rank = F.when(F.col("a") > 0, F.struct((-F.col("a")).alias("r"), "first", "predicted_class"))
    return per_class.agg(
        n.alias("processed"), a.alias("attacks"),
        F.round(F.coalesce(F.try_divide(a, n), F.lit(0.0)), 4).alias("attack_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("c"), n), F.lit(0.0)), 4).alias("mean_confidence"),
        F.min(rank)["predicted_class"].alias("trending_class"),
    )


def lifetime_stats(detections: DataFrame) -> DataFrame:
    attacks, n = F.count_if("is_attack"), F.count(F.lit(1))
    return detections.agg(
        n.alias("total_processed"), attacks.alias("total_attacks"),
        F.round(F.coalesce(F.try_divide(attacks, n), F.lit(0.0)), 4).alias("lifetime_attack_rate"),
    )


def running_totals(detections: DataFrame) -> DataFrame:
    """Per row: flows and attacks so far, and their rate."""
    sums = running_sums(
        detections, [], ORDER,
        {"total_processed": F.lit(1).cast("bigint"), "total_attacks": F.col("is_attack").cast("bigint")},
    )
    return sums.withColumn("lifetime_attack_rate", F.round(F.col("total_attacks") / F.col("total_processed"), 4))


def rolling_per_row(detections: DataFrame, size: int = WINDOW_ROWS, block: int = 100_000) -> DataFrame:
    """Per row: statistics over the last ``size`` rows up to it."""
    check_positive(size, "window size")
    out = rolling_rows(detections, ORDER, size, {
        "processed": lambda w: F.count(F.lit(1)).over(w),
        "attacks": lambda w: F.sum(F.col("is_attack").cast("bigint")).over(w),
        "mean_confidence": lambda w: F.avg("confidence").over(w),
    }, block)
    return out.withColumn("attack_rate", F.round(F.col("attacks") / F.col("processed"), 4)) \
        .withColumn("mean_confidence", F.round("mean_confidence", 4))


def micro_batches(detections: DataFrame, size: int = BATCH_ROWS) -> DataFrame:
    """Add ``batch_no``: every ``size`` rows in arrival order, the last batch short."""
    check_positive(size, "batch size")
    return row_index(detections, ORDER, "_at").withColumn("batch_no", F.floor(F.col("_at") / size).cast("bigint")).drop("_at")


def streaming_lifetime(detections: DataFrame) -> DataFrame:
    """Lifetime counters of a streaming table, for update or complete mode."""
    return lifetime_stats(detections)
