"""Sliding-log rate limit per alert key.

An alert goes out if fewer than ``limit`` alerts of its key went out in the last ``window_seconds``
(an alert exactly that old still counts); what is held back leaves no trace in the log. The rule feeds
on its own output, so it is a fold along time, not a window function. What keeps it distributed:

* Rows of equal (key, clock reading) become one row with a count, on the map side.
* The readings, in (key, time) order, are cut into segments of ``segment_rows``, so a task never holds
  more than a segment, whatever the key's share of the table.
* Silence longer than the window between two segments of a key empties the log: what follows is a
  piece of its own. The segments of one piece are folded one round after another, each starting from the
  log that the last one left (at most ``limit`` times).
* Only readings that let something out leave the fold: at most ``limit`` per window and key.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError, check_positive
from tidewatch.operators.ordering import row_index, running_sums
from tidewatch.session import checkpoint_folder, settle, small_side

THROTTLE_SECONDS = 60
THROTTLE_LIMIT = 5
TICK_MICROS = 1  # resolution of the clock; larger values merge more rows per reading
SEGMENT_ROWS = 5_000_000

OUT_SCHEMA = "throttle_key string, tick bigint, allowed bigint, in_window bigint"
STATE_SCHEMA = "throttle_key string, log array<bigint>, suppressed bigint"


def check_limits(window_seconds: float, limit: int) -> int:
    if window_seconds <= 0:
        raise FlowDataError(f"window_seconds must be positive, got {window_seconds}")
    check_positive(limit, "limit")
    return int(round(window_seconds * 1_000_000))


def fold_ticks(ticks: np.ndarray, counts: np.ndarray, log: list[int], window_us: int, limit: int):
    """Run the rule over one key's ascending clock readings.

    Returns ``[(tick, allowed, already in window)]`` for readings that let something out, and the
    log left behind. Readings that meet a full log are jumped over, not visited.
    """
    out, at, log = [], 0, list(log)
    while at < len(ticks):
        now = int(ticks[at])
        while log and log[0] < now - window_us:
            log.pop(0)
        free = limit - len(log)
        if free > 0:
            taken = min(free, int(counts[at]))
            out.append((now, taken, len(log)))
            log.extend([now] * taken)
            at += 1
        else:
            at = max(at + 1, int(np.searchsorted(ticks, log[0] + window_us, side="right")))
    return out, log


def clock_readings(candidates: DataFrame, tick_us: int = TICK_MICROS) -> DataFrame:
    """``(throttle_key, tick, n)``; ``tick`` is the time in microseconds, rounded down to the resolution."""
    key = F.when(
        F.coalesce(F.col("throttle_key"), F.lit("")) == "", F.raise_error(F.lit("throttle key must not be empty"))
    ).otherwise(F.col("throttle_key"))
    # Settled: what the candidates come from (a scored table) is dearer than these three columns.
    return settle(candidates.groupBy(key.alias("throttle_key"), _tick(tick_us).alias("tick")).agg(F.count(F.lit(1)).alias("n")))


def _tick(tick_us: int):
    return (F.col("ts_us") if tick_us == 1 else F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(tick_us))).cast("bigint")


def _segments(readings: DataFrame, window_us: int, segment_rows: int) -> list[DataFrame]:
    """Readings with ``piece`` by turn: pieces are independent, a piece's turns are not.

    Each turn is a folder of its own, so a round reads its own rows and no others.
    """
    spread = row_index(readings, ["throttle_key", "tick"], "_at")
    cut = settle(spread.withColumn("_segment", F.floor(F.col("_at") / segment_rows).cast("bigint")).drop("_at"))
    # One row per (key, segment): rows / segment_rows plus the number of keys.
    edges = cut.groupBy("throttle_key", "_segment").agg(F.min("tick").alias("_from"), F.max("tick").alias("_to"))
    timeline = Window.partitionBy("throttle_key").orderBy("_segment")
    fresh = F.coalesce(F.col("_from") - F.lag("_to").over(timeline) > window_us, F.lit(True))
    chained = edges.withColumn("_fresh", fresh.cast("bigint")).withColumn(
        "piece", F.sum("_fresh").over(timeline) - 1
    ).withColumn(
        "turn", F.row_number().over(Window.partitionBy("throttle_key", "piece").orderBy("_segment")) - 1
    ).select("throttle_key", "_segment", "piece", "turn")
    placed = cut.join(small_side(chained), ["throttle_key", "_segment"]).drop("_segment")
    spark = readings.sparkSession
    path = f"{checkpoint_folder(spark)}/turns-{uuid.uuid4().hex}"
    placed.write.partitionBy("turn").parquet(path)
    schema = placed.drop("turn").schema
    last = chained.agg(F.max("turn")).first()[0]
    if last is None:
        return [spark.createDataFrame([], schema)]
    return [spark.read.schema(schema).parquet(f"{path}/turn={turn}") for turn in range(last + 1)]


def _folder(window_us: int, limit: int):
    def fold(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = left.sort_values("tick")
        start = [int(t) for t in right["log"].iloc[0]] if len(right) else []
        out, log = fold_ticks(rows["tick"].to_numpy(), rows["n"].to_numpy(), start, window_us, limit)
        # The log left behind travels as a last row without a tick.
        columns = list(zip(*out)) if out else [(), (), ()]
        facts = [pd.array([*values, None], dtype="Int64") for values in columns]
        size = len(out) + 1
        return pd.DataFrame({
            "throttle_key": [key[0]] * size, "piece": [key[1]] * size,
            "tick": facts[0], "allowed": facts[1], "in_window": facts[2], "log": [None] * len(out) + [log],
        })

    return fold


_FOLD_SCHEMA = "throttle_key string, piece bigint, tick bigint, allowed bigint, in_window bigint, log array<bigint>"


def allowed_ticks(
    readings: DataFrame, window_us: int, limit: int, state: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(readings that let something out, log per key at the end)."""
    spark = readings.sparkSession
    if state is not None:
        # Arrival order rules: a late event is judged at the key's latest clock reading.
        last = small_side(state.select("throttle_key", F.array_max("log").alias("_last")))
        readings = settle(readings.join(last, "throttle_key", "left").groupBy(
            "throttle_key", F.greatest("tick", F.coalesce("_last", "tick")).alias("tick")
        ).agg(F.sum("n").alias("n")))
    turns = _segments(readings, window_us, segment_rows)
    logs = spark.createDataFrame([], "throttle_key string, piece bigint, log array<bigint>")
    if state is not None:
        logs = state.select("throttle_key", F.lit(0).cast("bigint").alias("piece"), "log")
    done = []
    for part in turns:
        folded = part.groupBy("throttle_key", "piece").cogroup(logs.groupBy("throttle_key", "piece")).applyInPandas(
            _folder(window_us, limit), _FOLD_SCHEMA
        )
        folded = settle(folded)
        done.append(folded)
        logs = folded.filter(F.col("tick").isNull()).select("throttle_key", "piece", "log")
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    ticks = everything.filter(F.col("tick").isNotNull()).select("throttle_key", "tick", "allowed", "in_window")
    ends = everything.filter(F.col("tick").isNull()).groupBy("throttle_key").agg(
        F.max_by("log", F.struct("piece", F.coalesce(F.array_max("log"), F.lit(0)))).alias("log")
    )
    return ticks, ends


def pick_dispatched(candidates: DataFrame, ticks: DataFrame, limit: int, tick_us: int, last: DataFrame | None = None) -> DataFrame:
    """The rows let out: the first ``allowed`` of each reading, in (time, flow) order."""
    staged = candidates.withColumn("_tick", _tick(tick_us))
    if last is not None:
        staged = staged.join(last, "throttle_key", "left").withColumn(
            "_tick", F.greatest("_tick", F.coalesce("_last", "_tick"))).drop("_last")
    joined = staged.join(small_side(ticks.withColumnRenamed("tick", "_tick")), ["throttle_key", "_tick"])
    place = F.row_number().over(Window.partitionBy("throttle_key", "_tick").orderBy("ts_us", "flow_id"))
    # The constant bound lets Spark cut each group to ``limit`` rows before the shuffle.
    return joined.withColumn("_r", place).filter(F.col("_r") <= limit).filter(F.col("_r") <= F.col("allowed")) \
        .withColumn("count_in_window", F.col("in_window") + F.col("_r")).drop("_tick", "_r", "allowed", "in_window")


def dispatched(
    candidates: DataFrame, window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT,
    tick_us: int = TICK_MICROS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Candidates that go out, with ``count_in_window``. Needs ``throttle_key, ts_us, flow_id``."""
    window_us = check_limits(window_seconds, limit)
    ticks, _ = allowed_ticks(clock_readings(candidates, tick_us), window_us, limit, segment_rows=segment_rows)
    return pick_dispatched(candidates, ticks, limit, tick_us)


def decisions(
    candidates: DataFrame, window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT,
    tick_us: int = TICK_MICROS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``(flow_id, throttle_key, ts_us, allowed, count_in_window, suppressed_total)`` for every candidate.

    ``suppressed_total`` is the key's count so far. ``flow_id`` is unique.
    """
    candidates = settle(candidates.select("flow_id", "throttle_key", "ts_us"))
    out = dispatched(candidates, window_seconds, limit, tick_us, segment_rows).select("flow_id", "count_in_window")
    # A held-back alert always meets a full log.
    marked = candidates.join(out, "flow_id", "left").withColumn("allowed", F.col("count_in_window").isNotNull()) \
        .withColumn("count_in_window", F.coalesce("count_in_window", F.lit(limit)).cast("bigint"))
    return running_sums(
        marked, ["throttle_key"], ["ts_us", "flow_id"], {"suppressed_total": (~F.col("allowed")).cast("bigint")}
    )


def suppressed_totals(
    candidates: DataFrame, window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT,
    tick_us: int = TICK_MICROS, segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """``(throttle_key, candidates, allowed, suppressed)``."""
    window_us = check_limits(window_seconds, limit)
    readings = clock_readings(candidates, tick_us)
    ticks, _ = allowed_ticks(readings, window_us, limit, segment_rows=segment_rows)
    seen = readings.groupBy("throttle_key").agg(F.sum("n").alias("candidates"))
    sent = ticks.groupBy("throttle_key").agg(F.sum("allowed").alias("allowed"))
    return seen.join(sent, "throttle_key", "left").select(
        "throttle_key", "candidates", F.coalesce("allowed", F.lit(0)).alias("allowed"),
        (F.col("candidates") - F.coalesce("allowed", F.lit(0))).alias("suppressed"),
    )


def throttle_batch(
    candidates: DataFrame, state: DataFrame, window_seconds: float = THROTTLE_SECONDS, limit: int = THROTTLE_LIMIT,
    tick_us: int = TICK_MICROS,
) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: (alerts that go out, next state). The state has one row per key."""
    window_us = check_limits(window_seconds, limit)
    readings = clock_readings(candidates, tick_us)
    ticks, ends = allowed_ticks(readings, window_us, limit, state=state)
    last = small_side(state.select("throttle_key", F.array_max("log").alias("_last")))
    out = pick_dispatched(candidates, ticks, limit, tick_us, last)
    seen = readings.groupBy("throttle_key").agg(F.sum("n").alias("_seen"))
    sent = ticks.groupBy("throttle_key").agg(F.sum("allowed").alias("_sent"))
    fresh = seen.join(sent, "throttle_key", "left").join(ends, "throttle_key").select(
        "throttle_key", F.col("log").alias("_log"), (F.col("_seen") - F.coalesce("_sent", F.lit(0))).alias("_more")
    )
    following = state.join(fresh, "throttle_key", "full_outer").select(
        "throttle_key", F.coalesce("_log", "log").alias("log"),
        (F.coalesce("suppressed", F.lit(0)) + F.coalesce("_more", F.lit(0))).alias("suppressed"),
    )
    return out, following
