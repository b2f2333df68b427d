import hashlib

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators.shuffle import shuffled


def test_places_are_a_permutation_by_hash(spark):
    df = spark.range(20_000).select(F.col("id").alias("flow_id"), (F.col("id") % 7).alias("v"))
    out = shuffled(df, "flow_id", seed=5, rows_per_part=3_000)
    got = {r["flow_id"]: r["place"] for r in out.collect()}
    want = sorted(range(20_000), key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert [got[i] for i in want] == list(range(20_000))
    again = shuffled(df.repartition(13, "v"), "flow_id", seed=5, rows_per_part=700)
    assert {r["flow_id"]: r["place"] for r in again.collect()} == got
    assert {r["flow_id"]: r["place"] for r in shuffled(df, "flow_id", seed=6).collect()} != got


def test_partitions_hold_places_in_order(spark):
    df = spark.range(5_000).withColumnRenamed("id", "flow_id")
    out = shuffled(df, "flow_id", rows_per_part=600)
    seen = out.withColumn("part", F.spark_partition_id()).collect()
    assert [r["place"] for r in seen] == list(range(5_000)) and len({r["part"] for r in seen}) == 9
    # The rows travel once.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1


def test_repeated_and_missing_ids(spark):
    rows = [(1, "b"), (1, "a"), (None, "x"), (None, None), (2, "c"), (1, "a")] * 3
    df = spark.createDataFrame(rows, "flow_id bigint, v string")
    first = sorted((r["place"], r["flow_id"], r["v"]) for r in shuffled(df, "flow_id").collect())
    assert [p for p, _, _ in first] == list(range(18)) and sorted(map(str, rows)) == sorted(str(r[1:]) for r in first)
    assert first == sorted((r["place"], r["flow_id"], r["v"]) for r in shuffled(df.repartition(5), "flow_id").collect())


def test_empty_tables_and_taken_names(spark):
    empty = shuffled(spark.createDataFrame([], "flow_id bigint, m map<string,int>"), "flow_id")
    assert empty.columns == ["flow_id", "m", "place"] and empty.count() == 0
    with pytest.raises(FlowDataError):
        shuffled(spark.range(3).withColumn("place", F.lit(1)), "id")
    assert [r["at"] for r in shuffled(spark.range(3).withColumn("place", F.lit(1)), "id", name="at").collect()] == [0, 1, 2]
