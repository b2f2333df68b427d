import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators import alerts as al
from tidewatch.plans.scores import score_flows
from tidewatch.sources.flow_view import flows
from tidewatch.sources.sinks import Fanout, parquet_log
from tidewatch.streaming import rolling as ro
from tidewatch.streaming.alerting import AlertStream, flow_stream, process_in_batches
from tests.conftest import SMALL

SLIM = "flow_id bigint, ts_us bigint, predicted_class string, confidence double, is_attack boolean"
DAY = 86_400


def test_file_stream_equals_batch(spark, tmp_path):
    table = flows(spark, SMALL)
    # Three files in time order, cut at uneven places.
    for i, (low, high) in enumerate([(0, 200), (200, 650), (650, 10**9)]):
        table.filter((F.col("flow_id") >= low) & (F.col("flow_id") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    schema = table.schema
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "false")
    fan = Fanout(spark, {"log": parquet_log(str(tmp_path / "out")), "broken": lambda a, b: 1 / 0})
    calls = []

    def callback(df, batch):
        calls.append(batch)
        raise RuntimeError("bad callback")

    stream = AlertStream(spark, str(tmp_path / "run"), score_flows, fan, window_seconds=DAY, limit=2, window_rows=300, on_batch=callback)
    for i in range(3):  # one micro-batch per file, in order
        query = stream.start(flow_stream(spark, str(tmp_path / "in" / f"part={i}"), schema)) if i == 0 else None
        if query:
            query.awaitTermination()
        else:
            stream.process(spark.read.schema(schema).parquet(str(tmp_path / "in" / f"part={i}")), i)
    sent = {r["flow_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    scored = score_flows(table)
    want = {r["flow_id"] for r in al.handle(scored, window_seconds=DAY, limit=2).collect()}
    assert sent == want and 0 < len(sent) < al.build_alerts(scored).count()
    assert calls == [0, 1, 2] and stream.callback_failures == 3 and fan.failures == {"broken": 3}
    stats = stream.statistics()
    assert stats["lifetime"].collect() == ro.lifetime_stats(scored).collect()
    assert stats["window"].collect() == ro.rolling_snapshot(scored, 300).collect()
    assert stats["suppressed"].agg(F.sum("suppressed")).first()[0] == al.build_alerts(scored).count() - len(sent)
    stream.process(spark.read.schema(schema).parquet(str(tmp_path / "in" / "part=2")), 2)  # a replayed batch
    assert {r["flow_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert stream.statistics()["lifetime"].collect() == ro.lifetime_stats(scored).collect()


def test_sixty_flows_in_batches_of_twenty(spark, tmp_path):
    table = flows(spark, SMALL).filter("flow_id < 60")
    stream = AlertStream(spark, str(tmp_path), score_flows, Fanout(spark, {}), window_rows=40)
    assert process_in_batches(stream, table, 20) == 3
    stats = stream.statistics()
    assert stats["lifetime"].first()["total_processed"] == 60
    assert stats["window"].first()["processed"] == 40
    assert stats["class_counts"].agg(F.sum("n")).first()[0] == 40
    assert process_in_batches(AlertStream(spark, str(tmp_path / "none"), score_flows, Fanout(spark, {})), table.filter("false")) == 0
    with pytest.raises(FlowDataError, match="is gone"):
        stream.process(table, 99)


def test_no_flows(spark):
    row = ro.rolling_snapshot(spark.createDataFrame([], SLIM)).first()
    assert tuple(row) == (0, 0, 0.0, 0.0, None)
    assert tuple(ro.lifetime_stats(spark.createDataFrame([], SLIM)).first()) == (0, 0, 0.0)


def test_trending_ties_go_to_the_first_seen(spark):
    rows = [(0, 0, "u2r", 0.9, True), (1, 1, "dos", 0.9, True), (2, 2, "dos", 0.9, True), (3, 3, "u2r", 0.9, True), (4, 4, "normal", 0.9, False)]
    assert ro.trending_class(spark.createDataFrame(rows, SLIM)).first()[0] == "u2r"
    assert ro.trending_class(ro.newest(spark.createDataFrame(rows, SLIM), 4)).first()[0] == "dos"


def test_impossible_threshold_flags_nothing(spark):
    assert score_flows(flows(spark, SMALL), threshold=1.01).filter("is_attack").count() == 0


def test_sizes_are_checked(spark):
    empty = spark.createDataFrame([], SLIM)
    for call in (lambda: ro.newest(empty, 0), lambda: ro.micro_batches(empty, 0), lambda: AlertStream(spark, "x", None, None, window_rows=0)):
        with pytest.raises(FlowDataError):
            call()
