"""Alert delivery: named channels, failures isolated and counted.

A channel is a callable ``(alerts, batch_id) -> None``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Channel = Callable[[DataFrame, int], None]

OUTCOMES = "batch_id bigint, channel string, ok boolean, n bigint, error string"


def json_lines(path: str) -> Channel:
    """Append alerts as JSON lines; each batch owns a folder, so a replayed batch replaces its own output."""

    def send(alerts: DataFrame, batch_id: int) -> None:
        alerts.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")

    return send


def parquet_log(path: str) -> Channel:
    def send(alerts: DataFrame, batch_id: int) -> None:
        alerts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return send


def as_json(alerts: DataFrame) -> DataFrame:
    return alerts.select(F.to_json(F.struct("*")).alias("value"))


def build_channels(names: list[str], known: dict[str, Channel], fallback: str | None = None) -> dict[str, Channel]:
    """Channels by name; unknown names are skipped, none left falls back to ``fallback``."""
    chosen = {n: known[n] for n in names if n in known}
    if not chosen and fallback is not None:
        chosen = {fallback: known[fallback]}
    return chosen


class Fanout:
    """Sends a batch to every channel; one failing channel does not stop the others."""

    def __init__(self, spark: SparkSession, channels: dict[str, Channel]):
        self.spark, self.channels = spark, dict(channels)
        self.failures: dict[str, int] = {}

    def add(self, name: str, channel: Channel) -> None:
        self.channels[name] = channel

    def dispatch(self, alerts: DataFrame, batch_id: int = 0) -> DataFrame:
        """Returns ``(batch_id, channel, ok, n, error)``."""
        held = alerts.persist()
        try:
            n = held.count()
            rows = []
            for name, send in self.channels.items():
                try:
                    send(held, batch_id)
                    rows.append((batch_id, name, True, n, None))
                except Exception as error:  # the other channels must still get the batch
                    self.failures[name] = self.failures.get(name, 0) + 1
                    rows.append((batch_id, name, False, n, str(error)))
        finally:
            held.unpersist()
        return self.spark.createDataFrame(rows, OUTCOMES)


def failure_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("channel").agg(F.count_if(~F.col("ok")).alias("failures"))
