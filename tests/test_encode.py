import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators.encode import EncoderModel, FlowEncoder, decode_label, encode_label, scale_table


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1.0, None, "http", True, "normal"), (2.0, 4, "ssh", False, "dos"), (float("nan"), 8, "http", True, "dos"), (5.0, 6, None, None, "probe")]
    return spark.createDataFrame(rows, "duration double, count int, service string, secure boolean, label string")


def test_state(table):
    state = FlowEncoder().fit(table).state
    assert state.numeric == ["duration", "count"] and state.medians == {"duration": 2.0, "count": 6.0}
    assert state.levels == {"service": ["http", "ssh"], "secure": ["False", "True"]}
    assert state.modes == {"service": "http", "secure": "True"}
    assert state.features == ["duration", "count", "service_http", "service_ssh", "service___unknown__", "secure_False", "secure_True", "secure___unknown__"]
    assert state.classes == ["dos", "normal", "probe"]


def test_standard_scale_has_zero_mean_and_unseen_levels_keep_their_weight(spark, table):
    model = FlowEncoder().fit(table)
    out = model.transform_features(table)
    means = out.agg(*[F.avg(c).alias(c) for c in out.columns]).first()
    assert all(abs(m) < 1e-9 for m in means)
    new = spark.createDataFrame([(1.0, 1, "gopher", True, "dos")], table.schema)
    seen = FlowEncoder().fit(table.na.fill({"service": "http"}))
    row = seen.transform_features(new).first()
    assert row["service___unknown__"] == 1.0
    assert seen.transform_features(new).columns == seen.transform_features(table).columns


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "a double, b double")
    for scaler in ("standard", "minmax"):
        assert {r["a"] for r in scale_table(df, ["a", "b"], scaler).collect()} == {0.0}


def test_labels(spark, table):
    model = FlowEncoder().fit(table)
    with pytest.raises(FlowDataError, match="brand_new"):
        model.check_labels(spark.createDataFrame([("brand_new",)], "label string"))
    out = table.select(model.label_index().alias("i")).withColumn("back", decode_label(F.col("i"), model.state.classes))
    assert {(r["i"], r["back"]) for r in out.collect()} == {(0.0, "dos"), (1.0, "normal"), (2.0, "probe")}
    odd = spark.createDataFrame([(9,)], "i int").select(decode_label(F.col("i"), ["a"])).first()[0]
    assert odd == "9"
    assert spark.range(1).select(encode_label(F.lit("zzz"), ["a"])).first()[0] is None


def test_missing_inputs(spark, table):
    model = FlowEncoder().fit(table)
    part = table.select("duration", "label")
    with pytest.raises(FlowDataError):
        model.transform_features(part)
    assert model.fill_defaults(part).first()["service"] == "http"
    assert model.transform_features(part, fill_missing=True).count() == 4


def test_refusals_and_persistence(spark, table, tmp_path):
    with pytest.raises(FlowDataError):
        FlowEncoder(scaler="robust")
    with pytest.raises(FlowDataError):
        FlowEncoder().fit(table.select("label"))
    with pytest.raises(FlowDataError):
        FlowEncoder().fit(table.drop("label"))
    model = FlowEncoder("label", "minmax", drop=["count"]).fit(table)
    model.save(spark, str(tmp_path / "enc"))
    again = EncoderModel.load(spark, str(tmp_path / "enc"))
    assert again.state == model.state
    assert again.transform(table).collect() == model.transform(table).collect()
