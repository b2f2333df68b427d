"""The rate limit as a keyed operator of Structured Streaming, and the alert stream that runs on it.

Spark keeps one value per throttle key in its state store (RocksDB, checkpointed): the clock readings of the
key's last dispatches. A batch of the stream touches only the keys that it brings, not a table of all. A timer in
event time drops a key's log once the watermark has passed all that could still count it.

Before the rows of a key meet, each task keeps of equal clock readings the rows that could go out and counts the
rest, so a burst of a busy key shrinks to ``limit`` rows per reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.operators.alerts import build_alerts, recent, severity_counts
from tidewatch.operators.throttle import THROTTLE_LIMIT, THROTTLE_SECONDS, TICK_MICROS, check_limits, fold_ticks
from tidewatch.session import path_exists
from tidewatch.sources.sinks import Fanout

#: Rows that are later than the newest row by more than this do not reach the operator; Spark counts them.
LATENESS = "7 days"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOG = "log array<bigint>, due_ms bigint"


class KeyLog(StatefulProcessor):
    """Lets the rows of a key pass while fewer than ``limit`` went out in the window; remembers when they did."""

    def __init__(self, columns: list[str], window_us: int, limit: int, tick_us: int):
        self.columns, self.window_us, self.limit, self.tick_us = columns, window_us, limit, tick_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", _LOG)

    def _due(self, log: list[int]) -> int:
        """The first millisecond of the watermark at which no reading can meet this log any more."""
        return (log[-1] + self.window_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.log.get() if self.log.exists() else ([], -1)
        log, due = [int(t) for t in held[0]], int(held[1])
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "flow_id"], ignore_index=True)
        # Arrival order rules: a late row is judged at the key's latest clock reading.
        at = frame["ts_us"].to_numpy() // self.tick_us * self.tick_us
        at = np.maximum(at, log[-1]) if log else at
        ticks, first = np.unique(at, return_index=True)
        counts = np.add.reduceat(frame["n"].to_numpy(), first)
        out, log = fold_ticks(ticks, counts, log, self.window_us, self.limit)
        place = np.arange(len(at)) - first[np.searchsorted(ticks, at)]
        free, before = np.zeros(len(ticks), np.int64), np.zeros(len(ticks), np.int64)
        for tick, allowed, in_window in out:
            k = np.searchsorted(ticks, tick)
            free[k], before[k] = allowed, in_window
        own = np.searchsorted(ticks, at)
        sent = frame[place < free[own]][self.columns].copy()
        sent["count_in_window"] = (before[own] + place + 1)[place < free[own]]
        sent["suppressed"] = pd.array([None] * len(sent), dtype="Int64")
        if len(sent):
            yield sent
        summary = {c: [None] for c in self.columns} | {"throttle_key": [key[0]], "count_in_window": [None], "suppressed": [int(counts.sum()) - len(sent)]}
        yield pd.DataFrame(summary)[[*self.columns, "count_in_window", "suppressed"]]
        if due < 0:
            due = self._due(log)
            self.handle.registerTimer(due)
        self.log.update((log, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        log = [int(t) for t in self.log.get()[0]]
        due = self._due(log)
        if due <= timerValues.getCurrentWatermarkInMs():
            self.log.clear()
        else:
            self.handle.registerTimer(due)
            self.log.update((log, due))
        return iter([])

    def close(self) -> None:
        pass


def _shrunk(limit: int, tick_us: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            frame = frame.sort_values(["throttle_key", "ts_us", "flow_id"], ignore_index=True)
            reading = frame.groupby(["throttle_key", frame["ts_us"] // tick_us], sort=False)["flow_id"]
            place, size = reading.cumcount(), frame.groupby(["throttle_key", frame["ts_us"] // tick_us], sort=False)["ts_us"].transform("size")
            # The last row that could go out counts those that cannot.
            frame["n"] = np.where(place == limit - 1, size - limit + 1, 1)
            yield frame[place < limit]

    return work


def throttle_stream(
    candidates: DataFrame, window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT, tick_us: int = TICK_MICROS, lateness: str = LATENESS
) -> DataFrame:
    """What of a stream of alert candidates goes out, with ``count_in_window``, and how much was held back.

    ``candidates`` has ``throttle_key`` (not empty), ``ts_us``, ``flow_id`` (unique) and columns of plain types. A row without a
    ``flow_id`` reports a key's ``suppressed`` count of a batch. The order of the batches rules over late rows as long as they are no later
    than ``lateness``. The session needs RocksDB as its state store.
    """
    window_us = check_limits(window_seconds, limit)
    key = F.when(F.coalesce(F.col("throttle_key"), F.lit("")) == "", F.raise_error(F.lit("throttle key must not be empty"))).otherwise(F.col("throttle_key"))
    rows = candidates.withColumn("throttle_key", key)
    columns, kept = rows.columns, StructType([StructField(f.name, f.dataType) for f in rows.schema])
    few = rows.mapInPandas(_shrunk(limit, tick_us), StructType([*kept, StructField("n", LongType())]))
    # The watermark starts at the epoch, and what is not after it would be late.
    timed = few.withColumn("_event_time", F.timestamp_micros(F.greatest("ts_us", F.lit(1000)))).withWatermark("_event_time", lateness)
    out = StructType([*kept, StructField("count_in_window", LongType()), StructField("suppressed", LongType())])
    return timed.groupBy("throttle_key").transformWithStateInPandas(
        statefulProcessor=KeyLog(columns, window_us, limit, tick_us), outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


class KeyedAlertStream:
    """Scores a stream of flows and sends rate-limited alerts to sinks; the rate limit's state is Spark's.

    What went out and what was held back lie under ``folder`` by batch, so a batch replayed after a failure replaces its own rows.
    """

    COLUMNS = ["flow_id", "ts_us", "throttle_key", "alert_id", "predicted_class", "severity", "severity_rank", "confidence", "message"]

    def __init__(
        self, spark: SparkSession, folder: str, detect: Callable[[DataFrame], DataFrame], fanout: Fanout, thresholds: dict[str, float] | None = None,
        min_severity: str = "LOW", window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT, tick_us: int = TICK_MICROS, lateness: str = LATENESS,
    ):
        check_limits(window_seconds, limit)
        self.spark, self.folder, self.detect, self.fanout = spark, folder.rstrip("/"), detect, fanout
        self.thresholds, self.min_severity = thresholds, min_severity
        self.window_seconds, self.limit, self.tick_us, self.lateness = window_seconds, limit, tick_us, lateness

    def _deliver(self, rows: DataFrame, batch_id: int) -> None:
        path = f"{self.folder}/judged/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        alerts = self.spark.read.schema(rows.schema).parquet(path).where("flow_id is not null").drop("suppressed").withColumn("timestamp", F.timestamp_micros("ts_us"))
        self.fanout.dispatch(alerts, batch_id).write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch_id={batch_id}")

    def start(self, flows: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        candidates = build_alerts(self.detect(flows), self.thresholds, self.min_severity).select(*self.COLUMNS)
        before = self.spark.conf.get(STORE)
        self.spark.conf.set(STORE, ROCKS)
        try:
            judged = throttle_stream(candidates, self.window_seconds, self.limit, self.tick_us, self.lateness)
            return (
                judged.writeStream.foreachBatch(self._deliver).option("checkpointLocation", f"{self.folder}/checkpoint")
                .outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
            )
        finally:
            self.spark.conf.set(STORE, before)

    def judged(self) -> DataFrame:
        """Sent alerts, and rows without ``flow_id`` that count what was held back."""
        path = f"{self.folder}/judged"
        if path_exists(self.spark, path):
            return self.spark.read.parquet(path)
        names = {"flow_id": "bigint", "ts_us": "bigint", "severity_rank": "int", "confidence": "double"}
        return self.spark.createDataFrame([], ", ".join(f"{c} {names.get(c, 'string')}" for c in self.COLUMNS) + ", count_in_window bigint, suppressed bigint")

    def statistics(self, newest: int = 20) -> dict[str, DataFrame]:
        """Alerts by severity, the newest alerts, and candidates sent and held back per key."""
        judged = self.judged()
        sent = judged.where("flow_id is not null")
        return {
            "severity_counts": severity_counts(sent),
            "recent_alerts": recent(sent.drop("suppressed"), newest),
            "keys": judged.groupBy("throttle_key").agg(
                F.count("flow_id").alias("sent"), F.coalesce(F.sum("suppressed"), F.lit(0)).alias("suppressed")),
        }
