import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.functions.scoring import best_class, check_thresholds, softmax
from tidewatch.operators import alerts as al
from tidewatch.operators import throttle as th
from tidewatch.sources import sinks

SCHEMA = ("flow_id bigint, ts_us bigint, predicted_class string, confidence double, is_attack boolean, "
          "class_probabilities map<string,double>, flow_summary map<string,string>")


def detection(spark, *rows):
    full = [(i, i * 1000, c, p, c != "normal", {c: p}, {"service": "http", "flag": None}) for i, (c, p) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_grades_and_escalation(spark):
    rows = [("dos", 0.55), ("dos", 0.75), ("dos", 0.90), ("dos", 0.99), ("u2r", 0.90), ("U2R", 0.99), ("normal", 0.99), ("r2l", 0.6)]
    out = al.grade(detection(spark, *rows)).orderBy("flow_id").collect()
    assert [r["severity"] for r in out] == ["LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL", None, "MEDIUM"]


def test_thresholds_are_checked():
    with pytest.raises(FlowDataError):
        check_thresholds({"low": 0.5})
    with pytest.raises(FlowDataError):
        check_thresholds({"low": 0.9, "medium": 0.7, "high": 0.85, "critical": 0.95})
    with pytest.raises(FlowDataError):
        al.rank_of("SEVERE")


def test_alert_row(spark):
    row = al.build_alerts(detection(spark, ("normal", 0.9), ("dos", 0.951234567))).collect()
    assert len(row) == 1
    alert = row[0]
    assert alert["message"] == "DOS traffic detected with 95.1% confidence [service=http]"
    assert len(alert["alert_id"]) == 12 and alert["throttle_key"] == "dos:CRITICAL" and alert["confidence"] == 0.951235


def test_limits_filters_and_history(spark):
    five = detection(spark, *[("dos", 0.9)] * 5)
    assert al.handle(five, limit=2).count() == 2
    assert al.handle(detection(spark, ("probe", 0.72)), min_severity="CRITICAL").count() == 0
    critical = al.build_alerts(detection(spark, *[("dos", 0.99)] * 5))
    kept = al.history(critical, 3)
    counts = {r["severity"]: r["n"] for r in al.severity_counts(kept).collect()}
    assert counts == {"LOW": 0, "MEDIUM": 0, "HIGH": 0, "CRITICAL": 3}
    assert [r["flow_id"] for r in al.recent(critical, 2, 3).collect()] == [3, 4]
    with pytest.raises(FlowDataError):
        al.recent(critical, 0)
    table = {(r["name"], r["label"]): r["value"] for r in al.counters(five, critical).collect()}
    assert table["attacks_detected_total", ""] == 5 and table["alerts_total", "CRITICAL"] == 5


def test_softmax_and_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0],)], "s array<double>").select(softmax(F.col("s")).alias("p"))
    rows = df.select("p", best_class(F.col("p"), ["a", "b"]).alias("c")).collect()
    assert rows[0]["p"] == [0.5, 0.5] and rows[0]["c"] == "a"
    assert rows[1]["c"] == "b" and sum(rows[1]["p"]) == pytest.approx(1.0)


def candidates(spark, events):
    rows = [(i, k, int(t * 1_000_000)) for i, (k, t) in enumerate(events)]
    return spark.createDataFrame(rows, "flow_id bigint, throttle_key string, ts_us bigint")


def by_hand(events, window, limit):
    logs, held, out = {}, {}, []
    for key, t in events:
        log = [x for x in logs.get(key, []) if x >= t - window]
        ok = len(log) < limit
        if ok:
            log.append(t)
        else:
            held[key] = held.get(key, 0) + 1
        logs[key] = log
        out.append((ok, len(log), held.get(key, 0)))
    return out


@pytest.mark.parametrize("limit,events,want", [
    (3, [("dos:HIGH", 0)] * 5, [True, True, True, False, False]),
    (1, [("k", 0), ("k", 0), ("k", 61)], [True, False, True]),
    (1, [("k", 0), ("k", 60), ("k", 61)], [True, False, True]),
    (1, [("dos:HIGH", 0), ("probe:LOW", 0)], [True, True]),
])
def test_throttle_cases(spark, limit, events, want):
    out = th.decisions(candidates(spark, events), 60, limit).orderBy("flow_id").collect()
    assert [r["allowed"] for r in out] == want


@pytest.mark.parametrize("segment_rows", [th.SEGMENT_ROWS, 7, 40])
def test_throttle_equals_the_row_by_row_rule(spark, segment_rows):
    rng = random.Random(11)
    events, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0.0, 0.0, 0.5, 3.0, 9.0, 45.0, 130.0])
        events.append((rng.choice(["hot", "hot", "hot", "a", "b"]), t))
    want = by_hand(events, 60, 4)
    got = th.decisions(candidates(spark, events), 60, 4, segment_rows=segment_rows).orderBy("flow_id").collect()
    assert [(r["allowed"], r["count_in_window"], r["suppressed_total"]) for r in got] == want
    totals = th.suppressed_totals(candidates(spark, events), 60, 4, segment_rows=segment_rows).collect()
    for r in totals:
        assert r["suppressed"] == sum(1 for (k, _), (ok, *_x) in zip(events, want) if k == r["throttle_key"] and not ok)


@pytest.mark.parametrize("segment_rows", [3, 50])
def test_throttle_segments_of_one_busy_key(spark, segment_rows):
    rng = random.Random(5)
    events = [("k", round(t, 3)) for t in sorted(rng.uniform(0, 900) for _ in range(60))]
    got = th.decisions(candidates(spark, events), 60, 2, segment_rows=segment_rows).orderBy("flow_id").collect()
    assert [r["allowed"] for r in got] == [ok for ok, *_ in by_hand(events, 60, 2)]


def test_throttle_of_nothing(spark):
    assert th.decisions(candidates(spark, [("k", 0)]).limit(0), 60, 2).count() == 0


def test_throttle_across_batches(spark):
    rng = random.Random(2)
    events, t = [], 0
    for _ in range(120):
        t += rng.choice([0, 1, 20, 70])
        events.append((rng.choice("ab"), t))
    want = {i for i, (ok, *_x) in enumerate(by_hand(events, 60, 2)) if ok}
    state, sent = spark.createDataFrame([], th.STATE_SCHEMA), set()
    everything = candidates(spark, events)
    for low in range(0, 120, 30):
        out, state = th.throttle_batch(everything.filter((F.col("flow_id") >= low) & (F.col("flow_id") < low + 30)), state, 60, 2)
        sent |= {r["flow_id"] for r in out.collect()}
        state = spark.createDataFrame(state.collect(), th.STATE_SCHEMA)
    assert sent == want
    assert sum(r["suppressed"] for r in state.collect()) == 120 - len(want)


def test_throttle_refusals(spark):
    df = candidates(spark, [("", 0)])
    with pytest.raises(Exception, match="must not be empty"):
        th.dispatched(df).collect()
    for bad in ({"window_seconds": 0}, {"limit": 0}):
        with pytest.raises(FlowDataError):
            th.dispatched(candidates(spark, [("k", 0)]), **bad)


def test_sinks(spark, tmp_path):
    alerts = al.build_alerts(detection(spark, ("r2l", 0.88)))

    def broken(_alerts, _batch):
        raise OSError("no route")

    fan = sinks.Fanout(spark, {"bad": broken})
    fan.add("file", sinks.json_lines(str(tmp_path / "log")))
    outcome = {r["channel"]: r["ok"] for r in fan.dispatch(alerts, 4).collect()}
    assert outcome == {"bad": False, "file": True} and fan.failures == {"bad": 1}
    lines = spark.read.text(str(tmp_path / "log")).collect()
    assert len(lines) == 1 and json.loads(lines[0][0])["predicted_class"] == "r2l"
    assert json.loads(sinks.as_json(alerts).first()[0])["severity"] == "CRITICAL"
    assert {r["channel"]: r["failures"] for r in sinks.failure_counts(fan.dispatch(alerts)).collect()} == {"bad": 1, "file": 0}
    known = {"console": broken, "file": broken}
    assert list(sinks.build_channels(["file", "pager"], known)) == ["file"]
    assert list(sinks.build_channels(["pager"], known, "console")) == ["console"]
