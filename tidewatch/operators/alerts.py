"""From detections to alerts: grading, building, filtering, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError, check_positive
from tidewatch.functions.columns import SEVERITIES
from tidewatch.functions.scoring import alert_message, rounded_map, severity_name, severity_rank
from tidewatch.operators.throttle import THROTTLE_LIMIT, THROTTLE_SECONDS, TICK_MICROS, dispatched

HISTORY = 500


def grade(detections: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Add ``severity_rank`` and ``severity``; both null unless the row is an attack."""
    rank = severity_rank(F.col("confidence"), F.col("predicted_class"), thresholds)
    return detections.withColumn("severity_rank", F.when(F.col("is_attack"), rank)) \
        .withColumn("severity", severity_name(F.col("severity_rank")))


def rank_of(severity: str) -> int:
    if severity not in SEVERITIES:
        raise FlowDataError(f"unknown severity {severity!r}")
    return SEVERITIES.index(severity)


def build_alerts(detections: DataFrame, thresholds: dict[str, float] | None = None, min_severity: str = "LOW") -> DataFrame:
    """Alert candidates: attacks at or above ``min_severity``, with id, message and throttle key.

    The id is a digest of the flow, its time and its class, so a replayed batch gives the same alerts.
    """
    attacks = grade(detections.filter("is_attack"), thresholds).filter(F.col("severity_rank") >= rank_of(min_severity))
    summary = F.col("flow_summary") if "flow_summary" in detections.columns else None
    made = {
        "alert_id": F.substring(F.sha2(F.concat_ws(
            "|", F.col("flow_id").cast("string"), F.col("ts_us").cast("string"), "predicted_class"), 256), 1, 12),
        "timestamp": F.timestamp_micros("ts_us"),
        "message": alert_message(F.col("predicted_class"), F.col("confidence"), summary),
        "throttle_key": F.concat_ws(":", "predicted_class", "severity"),
        "confidence": F.round("confidence", 6),
    }
    if "class_probabilities" in detections.columns:
        made["class_probabilities"] = rounded_map(F.col("class_probabilities"))
    return attacks.withColumns(made)


def handle(
    detections: DataFrame, thresholds=None, min_severity: str = "LOW", window_seconds: float = THROTTLE_SECONDS,
    limit: int = THROTTLE_LIMIT, tick_us: int = TICK_MICROS,
) -> DataFrame:
    """The alerts that go out: attack filter, build, severity filter, then the rate limit per key.

    The severity filter comes first, so what it drops uses up no quota.
    """
    return dispatched(build_alerts(detections, thresholds, min_severity), window_seconds, limit, tick_us=tick_us)


def history(alerts: DataFrame, size: int = HISTORY) -> DataFrame:
    """The newest ``size`` alerts (per-partition top-n, no global sort)."""
    return alerts.orderBy(F.desc("ts_us"), F.desc("flow_id")).limit(max(1, size))


def recent(alerts: DataFrame, limit: int = 50, size: int = HISTORY) -> DataFrame:
    """The newest ``limit`` alerts of the kept history, newest last."""
    check_positive(limit, "limit")
    return history(alerts, min(limit, max(1, size))).orderBy("ts_us", "flow_id")


def severity_counts(alerts: DataFrame) -> DataFrame:
    """``(severity, n)`` for all four levels, zeros included."""
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    return counts.unpivot([], SEVERITIES, "severity", "n")


def batch_summary(detections: DataFrame) -> DataFrame:
    return detections.agg(F.count(F.lit(1)).alias("flows"), F.count_if("is_attack").alias("attacks"))


def counters(detections: DataFrame, alerts: DataFrame) -> DataFrame:
    """``(name, label, value)``: flows, attacks and alerts by severity."""
    totals = batch_summary(detections).select(
        F.col("flows").alias("flows_processed_total"), F.col("attacks").alias("attacks_detected_total")
    ).unpivot([], ["flows_processed_total", "attacks_detected_total"], "name", "value")
    by_level = severity_counts(alerts).select(F.lit("alerts_total").alias("name"), F.col("severity").alias("label"), F.col("n").alias("value"))
    return totals.withColumn("label", F.lit("")).unionByName(by_level)
