import random

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators import alerts as al
from tidewatch.plans.scores import score_flows
from tidewatch.sources.flow_view import flows
from tidewatch.sources.sinks import Fanout, parquet_log
from tidewatch.streaming.alerting import flow_stream
from tidewatch.streaming.keyed import ROCKS, STORE, KeyedAlertStream, throttle_stream
from tests.conftest import SMALL
from tests.test_alerts import by_hand

EVENTS = "flow_id bigint, throttle_key string, ts_us bigint"
DAY = 86_400


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield spark
    spark.conf.set(STORE, before)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, **options):
    """All that has arrived since the last run, each file a batch."""
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = (
        throttle_stream(source, 60, 2, **options).writeStream.foreachBatch(lambda rows, b: rows.write.mode("overwrite").parquet(f"{folder}/out/b={b}"))
        .option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.parquet(f"{folder}/out").collect()
    return {r.flow_id: r.count_in_window for r in found if r.flow_id is not None}, sum(r.suppressed for r in found if r.flow_id is None)


def test_keyed_throttle_over_restarts(rocks, tmp_path):
    draw, events, t = random.Random(2), [], 0
    for _ in range(150):
        t += draw.choice([0, 0, 1, 20, 70])
        events.append((draw.choice("aaab"), t))
    want = {i: n for i, (ok, n, _) in enumerate(by_hand(events, 60, 2)) if ok}
    for low in range(0, 150, 50):  # every arrival is a run of its own, from the checkpoint of the last
        arrive(rocks, tmp_path, [(i, k, s * 1_000_000) for i, (k, s) in list(enumerate(events))[low : low + 50]])
        sent, held = run(rocks, tmp_path)
    assert sent == want and held == 150 - len(want)


def test_keyed_throttle_drops_old_logs_and_keeps_late_rows(rocks, tmp_path):
    state = lambda: {r.key[0]: list(r.value.log) for r in rocks.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "log").load().collect()}
    arrive(rocks, tmp_path, [(1, "a", 0), (2, "a", 1_000_000), (3, "a", 2_000_000), (4, "b", -5)])
    assert run(rocks, tmp_path, lateness="100 seconds") == ({1: 1, 2: 2, 4: 1}, 1)
    assert state() == {"a": [0, 1_000_000], "b": [-5]}
    arrive(rocks, tmp_path, [(5, "c", 150_000_000), (6, "c", 140_000_000)])
    arrive(rocks, tmp_path, [(7, "a", 70_000_000), (8, "c", 149_000_000)])  # late, but not too late
    sent, held = run(rocks, tmp_path, lateness="100 seconds")
    assert sent == {1: 1, 2: 2, 4: 1, 5: 2, 6: 1, 7: 1} and held == 2
    arrive(rocks, tmp_path, [(9, "d", 10**9)])
    run(rocks, tmp_path, lateness="100 seconds")
    assert state() == {"d": [10**9]}


def test_keyed_throttle_of_a_burst(rocks, tmp_path):
    arrive(rocks, tmp_path, [(i, "k", 5_000_000) for i in range(1000)] + [(i, "k", 5_000_001) for i in range(1000, 1500)] + [(2000, "l", 0)])
    assert run(rocks, tmp_path) == ({0: 1, 1: 2, 2000: 1}, 1498)


def test_keyed_throttle_refusals(rocks, tmp_path):
    arrive(rocks, tmp_path, [(1, "", 0)])
    with pytest.raises(Exception, match="must not be empty"):
        run(rocks, tmp_path)
    with pytest.raises(FlowDataError):
        KeyedAlertStream(rocks, "x", None, None, limit=0)


def test_alert_stream_equals_batch(spark, tmp_path):
    table, fan = flows(spark, SMALL), Fanout(spark, {"log": parquet_log(str(tmp_path / "out")), "broken": lambda a, b: 1 / 0})
    stream = KeyedAlertStream(spark, str(tmp_path / "run"), score_flows, fan, window_seconds=DAY, limit=2)
    assert stream.statistics()["severity_counts"].agg(F.sum("n")).first()[0] == 0
    for low, high in [(0, 400), (400, 10**9)]:
        table.filter((F.col("flow_id") >= low) & (F.col("flow_id") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(flow_stream(spark, str(tmp_path / "in"), table.schema)).awaitTermination()
    scored = score_flows(table)
    want = al.handle(scored, window_seconds=DAY, limit=2).select("flow_id", "severity", "ts_us", "count_in_window", "alert_id").collect()
    got = spark.read.parquet(str(tmp_path / "out")).select("flow_id", "severity", "ts_us", "count_in_window", "alert_id").collect()
    assert sorted(got) == sorted(want) and fan.failures["broken"] >= 2
    stats = stream.statistics(5)
    assert {r.severity: r.n for r in stats["severity_counts"].collect()} == {s: sum(r.severity == s for r in want) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL")}
    assert [r.flow_id for r in stats["recent_alerts"].collect()] == [r.flow_id for r in sorted(want, key=lambda r: (r.ts_us, r.flow_id))][-5:]
    keys = stats["keys"].agg(F.sum("sent"), F.sum("suppressed")).first()
    assert tuple(keys) == (len(want), al.build_alerts(scored).count() - len(want))
