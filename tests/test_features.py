import math

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.flow_features import add_features, connection_ratios, derived_names, engineer, traffic_rates
from tidewatch.functions.columns import FEATURES


def test_all_inputs_give_22_features():
    assert len(derived_names(FEATURES)) == 22


def test_partial_inputs(spark):
    out = engineer(spark.createDataFrame([(1.0, 3), (2.0, 4)], "duration double, count int"))
    assert "packet_rate" in out.columns and "byte_ratio" not in out.columns


def test_zero_division_is_finite(spark):
    row = engineer(spark.createDataFrame([(0.0, 100, 0)], "duration double, src_bytes bigint, dst_bytes bigint")).first()
    assert math.isfinite(row["src_byte_rate"]) and math.isfinite(row["byte_ratio"])
    assert row["is_upload_heavy"] == 1


def test_divisor_of_exactly_zero_becomes_zero(spark):
    row = engineer(spark.createDataFrame([(-1e-6, 5)], "duration double, src_bytes bigint")).first()
    assert row["src_byte_rate"] == 0.0


@pytest.mark.parametrize("value,band", [
    (1.0, "instant"), (1.1, "short"), (10.0, "short"), (60.0, "medium"), (300.0, "long"), (301.0, "persistent"), (None, None)])
def test_bands_are_right_closed(spark, value, band):
    row = engineer(spark.createDataFrame([(value,)], "duration double")).first()
    assert row["duration_band"] == band
    assert row["duration"] == (value or 0.0)


def test_missing_counts_as_zero_in_privilege_sum_only(spark):
    df = spark.createDataFrame([(None, 2, None, 1)], "root_shell int, num_root int, num_file_creations int, num_access_files int")
    row = engineer(df).first()
    assert (row["privilege_activity"], row["has_privilege_activity"], row["file_activity"], row["root_shell"]) == (2, 1, 0, 0)


def test_nonfinite_numbers_become_zero(spark):
    row = engineer(spark.createDataFrame([(float("inf"), float("nan"))], "serror_rate double, rerror_rate double")).first()
    assert (row["serror_rate"], row["rerror_rate"], row["error_rate_total"]) == (0.0, 0.0, 0.0)


def test_untouched_columns_keep_nulls(spark):
    row = engineer(spark.createDataFrame([(None, 1.0)], "flow_id bigint, duration double"), untouched=["flow_id"]).first()
    assert row["flow_id"] is None


def test_a_user_step_joins_the_chain(spark):
    df = spark.createDataFrame([(4, 2)], "count int, srv_count int")
    step = lambda have: {"count_gap": "count - srv_count"} if {"count", "srv_count"} <= have else {}
    assert engineer(df, [step]).first()["count_gap"] == 2
    assert set(add_features(df, connection_ratios).columns) == {"count", "srv_count", "srv_count_ratio"}
    assert add_features(df, traffic_rates).columns == df.columns


def test_features_add_no_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("duration"), F.col("id").alias("count"))
    assert "Exchange" not in engineer(df)._jdf.queryExecution().executedPlan().toString()
