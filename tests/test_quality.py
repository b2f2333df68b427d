import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators import quality as qu
from tidewatch.sources.tables import read_flows, read_or_build, write_flows


def test_clean_drops_copies_and_constants(spark):
    once = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(1).alias("still"), F.lit(None).cast("int").alias("blank"), F.lit("x").alias("label"))
    out = qu.clean(once.union(once))
    assert out.columns == ["a", "label"] and out.count() == 50


def test_clean_drops_rows_without_target_and_nulls_infinity(spark):
    out = qu.clean(spark.createDataFrame([(float("inf"), "x"), (1.0, None), (2.0, "y")], "a double, label string"))
    assert sorted(out.collect(), key=str) == sorted([(2.0, "y"), (None, "x")], key=str)


def test_null_beside_one_value_is_not_constant(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "a int, label string")
    assert qu.constant_columns(df, "label").count() == 0


def test_target_contract(spark):
    with pytest.raises(FlowDataError):
        qu.check_target(spark.createDataFrame([("a",), ("a",)], "label string"), "label")
    with pytest.raises(FlowDataError):
        qu.check_target(spark.createDataFrame([("a",), (None,), ("b",)], "label string"), "label")
    with pytest.raises(FlowDataError):
        qu.check_table(spark.createDataFrame([(1,)], "a int"), ["b"])
    with pytest.raises(FlowDataError):
        qu.check_table(spark.createDataFrame([(1,)], "a int"), ["a"], min_rows=2)


def test_record_contract_and_quarantine(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, None), (3, 1.0)], "flow_id int, duration double")
    out = {r["flow_id"]: r["violations"] for r in qu.record_violations(df, ["duration"]).collect()}
    assert out == {1: ["duration is not finite"], 2: ["duration is null"], 3: []}
    assert qu.record_violations(df, ["flag"]).first()["violations"] == ["flag is missing"]
    bytes_ = spark.createDataFrame([(-10, " http "), (5, " ")], "src_bytes bigint, service string")
    rows = qu.apply_record_contract(bytes_).orderBy("src_bytes").collect()
    assert rows[0]["violations"] == ["src_bytes is negative"] and rows[0]["service"] == "http"
    assert rows[1]["violations"] == ["service is empty"] and rows[1]["count"] == 1 and rows[1]["flag"] == "SF"
    valid, bad = qu.split_valid(qu.record_violations(df, ["duration"]))
    assert valid.count() == 1 and bad.count() == 2


def test_labels_and_caps(spark):
    df = spark.createDataFrame([("normal", 20_000_000, None), ("dos", 1, 2)], "label string, src_bytes bigint, dst_bytes bigint")
    assert {r["label"] for r in qu.collapse_label(df).collect()} == {"normal", "attack"}
    assert [tuple(r) for r in qu.cap_bytes(df).select("src_bytes", "dst_bytes").collect()] == [(10_000_000, None), (1, 2)]
    assert [r[0] for r in qu.unknown_labels(df, "label", ["normal"]).collect()] == ["dos"]
    assert spark.range(1).select(qu.clip(F.lit(1.5), 0.0, 1.0)).first()[0] == 1.0


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, "tcp", "normal"), (2.5, "udp", "dos")], "duration double, protocol_type string, label string")
    for name in ("a.parquet", "a.csv"):
        path = write_flows(df, str(tmp_path / name))
        assert sorted(read_flows(spark, path).collect()) == sorted(df.collect())
    write_flows(df.withColumnRenamed("label", " label "), str(tmp_path / "blank.csv"))
    assert "label" in read_flows(spark, str(tmp_path / "blank.csv")).columns
    with pytest.raises(FlowDataError):
        read_flows(spark, write_flows(df, str(tmp_path / "a.txt")))
    with pytest.raises(FlowDataError):
        read_flows(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FlowDataError):
        read_flows(spark, str(tmp_path / "a.parquet"), target="class")
    calls = []
    for _ in range(2):
        out = read_or_build(spark, str(tmp_path / "b.parquet"), lambda: calls.append(1) or df)
        assert out.count() == 2
    assert calls == [1]
