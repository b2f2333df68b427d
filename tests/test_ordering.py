import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles
from tidewatch.operators.ordering import rolling_rows, row_index, running_sums
from tidewatch.operators.quantiles import exact_quantiles, medians


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows under one key, a third with one value."""
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "key": np.where(rng.random(n) < 0.66, "hot", rng.choice(list("abcd"), n)),
        "v": np.where(rng.random(n) < 0.33, 7.0, rng.normal(0, 50, n).round(1)), "at": rng.permutation(n),
    })
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_row_index_and_running_sums(spark, skewed):
    pdf, df = skewed
    got = row_index(df, ["at"]).toPandas()
    assert (got["row_index"] == got["at"]).all()
    out = running_sums(df, ["key"], ["at"], {"total": F.lit(1), "vsum": F.col("v")}).toPandas().sort_values("id")
    want = pdf.sort_values("at")
    want["total"], want["vsum"] = want.groupby("key").cumcount() + 1, want.groupby("key")["v"].cumsum()
    want = want.sort_values("id")
    assert (out["total"].to_numpy() == want["total"].to_numpy()).all()
    assert np.allclose(out["vsum"], want["vsum"])


def test_running_sums_with_null_group(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 3, 7)], "g string, o int, v int")
    out = running_sums(df, ["g"], ["o"], {"s": F.col("v")})
    assert sorted((r["o"], r["s"]) for r in out.collect()) == [(1, 5), (2, 11), (3, 7)]


@pytest.mark.parametrize("size,block", [(1, 10), (7, 7), (40, 64), (500, 100)])
def test_rolling_rows_across_blocks(skewed, size, block):
    pdf, df = skewed
    out = rolling_rows(df, ["at"], size, {"s": lambda w: F.sum("v").over(w), "n": lambda w: F.count(F.lit(1)).over(w)}, block)
    got = out.toPandas().sort_values("at")
    want = pdf.sort_values("at")["v"].rolling(size, min_periods=1)
    assert len(got) == len(pdf)
    assert np.allclose(got["s"], want.sum()) and (got["n"].to_numpy() == want.count().to_numpy()).all()


def test_quantiles_equal_pandas(spark, skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    df = df.withColumn("w", F.when(F.col("id") % 3 == 0, F.col("v") * F.col("at"))).withColumn("none", F.lit(None).cast("double"))
    rows = df.toPandas()
    for by in ([], ["key"]):
        found = {tuple(r[c] for c in [*by, "column", "prob"]): r["value"] for r in exact_quantiles(df, ["v", "w", "none"], probs, by=by).collect()}
        groups = rows.groupby("key") if by else [(None, rows)]
        want = {(*([k] if by else []), c, p): None if c == "none" else g[c].dropna().astype(float).quantile(p) for k, g in groups for c in ("v", "w", "none") for p in probs}
        assert found.keys() == want.keys()
        for k, value in want.items():
            assert found[k] == (None if value is None or value != value else pytest.approx(value)), k
    assert medians(df, ["v", "none"]) == {"v": pytest.approx(pdf["v"].median()), "none": 0.0}
    assert medians(df.limit(0), ["v"]) == {"v": 0.0}


def test_quantiles_by_bits_are_those_of_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, np.inf, -np.inf, np.nan, 5e-324, -5e-324]
    rows = [(float(a), 1.7e15 + float(rng.integers(0, 10**6)), None, k % 5 if k % 3 else None) for k, a in enumerate([*rng.normal(0, 100, 1500), *odd])]
    df = spark.createDataFrame(rows, "a double, near double, none double, few int").repartition(3)
    probs = [0, 0.001, 0.25, 0.5, 0.77, 1.0]
    for most, held in ((quantiles._CELL_ROWS, quantiles._HELD), (10, 50)):  # cells cut again, counts handed on early
        monkeypatch.setattr(quantiles, "_CELL_ROWS", most)
        monkeypatch.setattr(quantiles, "_HELD", held)
        found = {(r["column"], r["prob"]): r["value"] for r in exact_quantiles(df, df.columns, probs).collect()}
        assert len(found) == len(probs) * 4 and found["none", 0.5] is None
        for i, name in ((0, "a"), (1, "near"), (3, "few")):
            own = np.sort(np.array([r[i] for r in rows if r[i] is not None], float))
            for p in probs:
                place = p * (len(own) - 1)
                low, high, share = own[int(np.floor(place))], own[int(np.ceil(place))], place - np.floor(place)
                np.testing.assert_array_equal(found[name, p], low if low == high else (1 - share) * low + share * high)


def test_medians_make_no_row_per_value(spark, monkeypatch):
    """Values stay in their columns: a row per column and value was most of the time of a wide table."""
    seen = []
    monkeypatch.setattr(quantiles, "settle", lambda df: seen.append(df) or df.localCheckpoint())
    df = spark.range(100).select(*[(F.col("id") * k).alias(f"c{k}") for k in range(1, 6)])
    assert medians(df, df.columns) == {f"c{k}": 49.5 * k for k in range(1, 6)}
    assert seen and not any("Generate" in d._jdf.queryExecution().executedPlan().toString() for d in seen)
