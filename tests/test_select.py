import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators import profile as pr
from tidewatch.operators import select as se
from tidewatch.operators.gram import pearson
from tidewatch.sources.tables import read_selection, write_selection


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i / 10, 2 * i / 10, math.sin(i / 10), 5.0, float(i % 3), None if i % 9 == 0 else i % 3 + 0.1 * (i % 2), i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, cls double, gap double, y int").cache()


def test_earlier_column_wins(table):
    assert se.drop_correlated(table, ["a", "b", "c"]) == ["a", "c"]
    assert se.drop_correlated(table, ["a"]) == ["a"]
    assert "flat" in se.drop_correlated(table, ["a", "flat"])


def test_correlation_handles_constants_and_gaps(table):
    got = {(r["column_i"], r["column_j"]): r["r"] for r in pr.correlation_matrix(table, ["a", "b", "flat", "gap", "cls"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "flat"] is None
    pdf = table.toPandas()
    assert got["gap", "cls"] == pytest.approx(pdf["gap"].corr(pdf["cls"]))
    scores = {r["feature"]: r["score"] for r in se.correlation_scores(table, ["flat", "cls"], "y").collect()}
    assert scores == {"flat": 0.0, "cls": pytest.approx(1.0)}


def test_correlation_over_shared_rows(spark):
    rng = np.random.default_rng(11)
    n = 2000
    pdf = pd.DataFrame({"a": rng.normal(1e6, 1, n), "b": rng.integers(0, 4, n).astype(float), "c": rng.normal(0, 1e-3, n), "d": 7.25})
    pdf["e"] = pdf["a"] * 3 + pdf["c"] * 500
    pdf.loc[rng.random(n) < 0.4, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "c"] = np.nan
    pdf.loc[:, "f"] = np.where(pdf["a"].isna(), pdf["b"], 2.0)  # varies, but not where a is known
    pdf["none"] = np.nan
    rows = [tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)]
    names = list(pdf.columns)
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    got = {(r["column_i"], r["column_j"]): (r["n"], r["r"]) for r in pearson(df, names).collect()}
    assert len(got) == len(names) * (len(names) - 1) // 2
    for (x, y), (count, r) in got.items():
        both = pdf[[x, y]].dropna()
        assert count == len(both)
        flat = both[x].nunique() < 2 or both[y].nunique() < 2
        assert r is None if flat else r == pytest.approx(both[x].corr(both[y]), abs=1e-9), (x, y)
    assert got["a", "f"][1] is None and got["a", "none"] == (0, None)


def test_correlation_of_little(spark):
    empty = spark.createDataFrame([], "a double, b int, c double")
    assert [(r["n"], r["r"]) for r in pearson(empty, ["a", "b", "c"]).collect()] == [(0, None)] * 3
    assert pearson(empty, ["a"]).count() == 0
    odd = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (float("nan"), 1.0), (3.0, float("inf")), (4.0, 8.0)], "a double, b double")
    assert [(r["n"], r["r"]) for r in pearson(odd, ["a", "b"]).collect()] == [(3, pytest.approx(1.0))]


def test_mutual_information_of_a_copy_is_the_entropy(table):
    scores = {r["feature"]: r["score"] for r in se.mutual_information(table, ["cls", "flat"], "y").collect()}
    assert scores["cls"] == pytest.approx(math.log(3), abs=1e-9) and scores["flat"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("method", se.METHODS)
def test_methods_pick_the_informative_column(table, method):
    got = se.select_features(table, ["a", "c", "cls"], "y", method, top_k=2, trees=5, depth=4) if method in ("importance", "rfe") \
        else se.select_features(table, ["a", "c", "cls"], "y", method, top_k=2)
    assert len(got.selected) == 2 and "cls" in got.selected
    if method != "rfe":  # elimination leaves its survivors tied at rank 1
        assert got.selected[0] == "cls"


def test_caps_refusals_and_json(spark, table, tmp_path):
    assert len(se.select_features(table, ["a", "c"], "y", "correlation", top_k=99).selected) == 2
    for bad in ({"method": "magic"}, {"top_k": 0}):
        with pytest.raises(FlowDataError):
            se.select_features(table, ["a"], "y", **bad)
    picked = se.select_features(table, ["a", "c", "cls"], "y", "correlation", top_k=1)
    write_selection(spark, picked, str(tmp_path / "s"))
    assert read_selection(spark, str(tmp_path / "s")) == picked
    spark.createDataFrame([(["a"],)], "selected array<string>").write.json(str(tmp_path / "t"))
    assert read_selection(spark, str(tmp_path / "t")) == se.Selection("unknown", ["a"], {})
    table_ = picked.to_table(spark).filter("selected").collect()
    assert [(r["feature"], r["rank"]) for r in table_] == [("cls", 1)]


def test_profile_tables(spark, table):
    quality = {r["column"]: r for r in pr.column_quality(table).collect()}
    assert quality["gap"]["missing"] == 14 and quality["flat"]["distinct_values"] == 1
    assert pr.duplicate_count(table.select("cls")).first()[0] == 117
    named = pr.class_distribution(table, "y", ["zero", "one"]).collect()
    assert [(r["class"], r["n"]) for r in named] == [("2", 40), ("one", 40), ("zero", 40)]
    points, shares = pr.pca_projection(table, ["a", "b", "c"], ["y"])
    assert points.columns == ["y", "pc1", "pc2"] and shares[0] > 0.6 and sum(shares) <= 1.0 + 1e-9
    assert pr.most_missing(table, 1).first()["column"] == "gap"
    assert pr.histogram_by_class(table, "a", 0, 12, 4, "y").agg(F.sum("n")).first()[0] == 120


def test_correlation_scores_are_few_aggregates_however_many_columns(spark):
    columns = [f"c{k}" for k in range(12)]
    table = spark.range(200).select(F.pmod("id", F.lit(5)).cast("double").alias("y"), *[F.when(F.col("id") % 9 != 0, F.sin(F.col("id") * (k + 1))).alias(c) for k, c in enumerate(columns)])
    scored = se.correlation_scores(table, columns, "y")
    assert scored._jdf.queryExecution().executedPlan().toString().count("stddev") == 0
    rows = table.toPandas()
    assert {r["feature"]: r["score"] for r in scored.collect()} == pytest.approx({c: abs(rows[c].corr(rows.y)) for c in columns})


def test_bins_are_counted_without_a_row_per_column_and_value(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(v, w, y) for v in (None, nan, -inf, -0.0, 0.0, 1.0, 1.5, inf) for w in (2, None) for y in ("a", "b", None)]
    df = spark.createDataFrame(rows, "v double, w int, y string").repartition(3)
    edges = {"v": [0.0, 1.0, nan], "w": []}
    found = se.bin_counts(df, edges, "y")
    got = {(r["feature"], r["bin"], r["class"]): r["n"] for r in found.collect()}
    place = F.size(F.filter(F.array(*map(F.lit, edges["v"])), lambda edge: edge < F.col("v")))
    want = {("v", r["bin"], r["y"]): r["n"] for r in df.groupBy(place.alias("bin"), "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want | {("w", 0, y): 16 for y in ("a", "b", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    assert se.bin_counts(df.limit(0), edges, "y").count() == 0
