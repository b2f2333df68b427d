"""Continuous detection and alerting on Structured Streaming.

Each micro-batch runs the batch operators on its rows plus a small state: per throttle key the log of
recent dispatches and the suppressed count, the newest window rows, and the lifetime counters. The
state of batch ``b`` is a table under ``state/batch=b`` and is built from batch ``b - 1`` only, so a
batch replayed after a failure gives the same alerts and the same state. Within a batch, equal clock
readings collapse on the map side before any key's rows meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.errors import FlowDataError, check_positive
from tidewatch.operators.alerts import build_alerts
from tidewatch.operators.throttle import STATE_SCHEMA, THROTTLE_LIMIT, THROTTLE_SECONDS, TICK_MICROS, throttle_batch
from tidewatch.session import path_exists, remove_path, settle
from tidewatch.sources.sinks import Fanout
from tidewatch.streaming.rolling import BATCH_ROWS, ORDER, WINDOW_ROWS, class_counts, lifetime_stats, micro_batches, newest, rolling_snapshot

WINDOW_SCHEMA = "ts_us bigint, flow_id bigint, predicted_class string, confidence double, is_attack boolean"
TOTALS_SCHEMA = "total_processed bigint, total_attacks bigint"


def flow_stream(
    spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_trigger: int = 1, pattern: str | None = None
) -> DataFrame:
    """A folder of flow files (those named like ``pattern``) as a stream of micro-batches."""
    check_positive(files_per_trigger, "files per trigger")
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


class AlertStream:
    """Scores a stream of flows, keeps rolling statistics and sends rate-limited alerts to sinks."""

    def __init__(
        self, spark: SparkSession, folder: str, detect: Callable[[DataFrame], DataFrame], fanout: Fanout,
        thresholds: dict[str, float] | None = None, min_severity: str = "LOW", window_seconds: float = THROTTLE_SECONDS,
        limit: int = THROTTLE_LIMIT, window_rows: int = WINDOW_ROWS, tick_us: int = TICK_MICROS,
        on_batch: Callable[[DataFrame, int], None] | None = None,
    ):
        check_positive(window_rows, "window size")
        self.spark, self.folder, self.detect, self.fanout = spark, folder.rstrip("/"), detect, fanout
        self.thresholds, self.min_severity = thresholds, min_severity
        self.window_seconds, self.limit, self.tick_us = window_seconds, limit, tick_us
        self.window_rows, self.on_batch = window_rows, on_batch
        self.callback_failures = 0

    def _state(self, name: str, batch_id: int, schema: str) -> DataFrame:
        path = f"{self.folder}/state/batch={batch_id}/{name}"
        if batch_id < 0:
            return self.spark.createDataFrame([], schema)
        if not path_exists(self.spark, path):
            raise FlowDataError(f"state of batch {batch_id} is gone: {path}")
        return self.spark.read.schema(schema).parquet(path)

    def _keep(self, table: DataFrame, name: str, batch_id: int) -> None:
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch_id}/{name}")

    def process(self, flows: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        detections = settle(self.detect(flows))
        if self.on_batch is not None:
            try:
                self.on_batch(detections, batch_id)
            except Exception:  # a failing callback must not stop the stream
                self.callback_failures += 1
        candidates = build_alerts(detections, self.thresholds, self.min_severity)
        before = self._state("throttle", batch_id - 1, STATE_SCHEMA)
        alerts, after = throttle_batch(candidates, before, self.window_seconds, self.limit, self.tick_us)
        self._keep(after, "throttle", batch_id)
        slim = detections.select(*ORDER, "predicted_class", "confidence", "is_attack")
        self._keep(newest(self._state("window", batch_id - 1, WINDOW_SCHEMA).unionByName(slim), self.window_rows), "window", batch_id)
        totals = self._state("totals", batch_id - 1, TOTALS_SCHEMA).unionByName(
            lifetime_stats(slim).select("total_processed", "total_attacks")
        ).agg(F.sum("total_processed").alias("total_processed"), F.sum("total_attacks").alias("total_attacks"))
        self._keep(totals, "totals", batch_id)
        self.fanout.dispatch(alerts, batch_id).write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch_id={batch_id}")
        # A batch may be replayed until the next one is through; older state is never read again.
        remove_path(self.spark, f"{self.folder}/state/batch={batch_id - 2}")

    def start(self, flows: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        return (
            flows.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def latest(self) -> int:
        """Newest batch with complete state, -1 if there is none."""
        path = f"{self.folder}/state"
        if not path_exists(self.spark, path):
            return -1
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(jvm)
        ids = [int(f.getPath().getName().split("=")[1]) for f in found if f.getPath().getName().startswith("batch=")]
        return max([b for b in ids if path_exists(self.spark, f"{path}/batch={b}/totals/_SUCCESS")], default=-1)

    def window(self) -> DataFrame:
        return self._state("window", self.latest(), WINDOW_SCHEMA)

    def statistics(self) -> dict[str, DataFrame]:
        """Lifetime counters, rolling snapshot, class counts of the window and suppressed counts."""
        at = self.latest()
        totals = self._state("totals", at, TOTALS_SCHEMA)
        return {
            "lifetime": totals.withColumn("lifetime_attack_rate", F.round(
                F.coalesce(F.try_divide("total_attacks", "total_processed"), F.lit(0.0)), 4)),
            "window": rolling_snapshot(self.window(), self.window_rows),
            "class_counts": class_counts(self.window()),
            "suppressed": self._state("throttle", at, STATE_SCHEMA).select("throttle_key", "suppressed"),
        }


def process_in_batches(stream: AlertStream, flows: DataFrame, batch_rows: int = BATCH_ROWS) -> int:
    """Replay a bounded table through the stream in batches of ``batch_rows`` rows, in arrival order.

    The numbered rows are written by batch once, so each batch reads its own rows only.
    """
    path = f"{stream.folder}/replay"
    micro_batches(flows, batch_rows).repartition("batch_no").write.mode("overwrite").partitionBy("batch_no").parquet(path)
    last = stream.spark.read.parquet(path).agg(F.max("batch_no")).first()[0] if not flows.isEmpty() else None
    if last is None:
        return 0
    for b in range(last + 1):
        stream.process(stream.spark.read.schema(flows.schema).parquet(f"{path}/batch_no={b}"), b)
    return last + 1
