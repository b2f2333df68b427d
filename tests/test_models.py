import pytest
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators import train as tr
from tidewatch.operators.detect import Detector
from tidewatch.plans.queries import MODEL_INPUTS
from tidewatch.plans.training import QUICK_MODELS, evaluate_plan, train_plan
from tidewatch.sources.registry import ModelRegistry


@pytest.fixture(scope="module")
def trained(spark, small_flows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("registry"))
    models = {**QUICK_MODELS, "mystery": {}}
    return train_plan(spark, small_flows, root, models=models, folds=2, top_k=10, method="correlation"), root


def test_training_run(spark, trained):
    result, _ = trained
    assert list(result["errors"]) == ["mystery"]
    table = result["comparison"].collect()
    assert len(table) == 2 and table[0]["cv_mean_f1_macro"] >= table[1]["cv_mean_f1_macro"]
    assert all(0.0 <= r["cv_std_f1_macro"] <= 0.5 and r["n_features"] == 10 for r in table)
    assert result["metrics"]["f1_macro"] > 0.5 and result["metrics"]["auc_roc"] > 0.7
    assert sum(result["sizes"].values()) == 1000
    assert result["best"] == max(result["validation"], key=lambda n: result["validation"][n]["f1_macro"])
    assert tr.best_model(result["models"]).cv_mean == max(m.cv_mean for m in result["models"].values())
    top = tr.feature_importance(result["models"]["random_forest"], spark, 5).collect()
    assert len(top) == 5 and top[0]["importance"] >= top[-1]["importance"]
    assert tr.feature_importance(result["models"]["logistic_regression"], spark, 3).count() == 3


def test_registry_and_detection(spark, trained, small_flows):
    result, root = trained
    registry = ModelRegistry(spark, root)
    assert registry.list_models().count() == 1 and registry.best().first()["model_name"] == result["best"]
    bundle = registry.load()
    detector = Detector(bundle, threshold=0.5)
    out = detector.detect(small_flows).cache()
    assert out.count() == 1000 and out.filter("size(class_probabilities) <> 5").count() == 0
    total = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, b: a + b)
    assert out.filter(F.abs(total - 1) > 1e-6).count() == 0
    assert out.filter("is_attack and (predicted_class = 'normal' or confidence < 0.5)").count() == 0
    hits = out.join(small_flows.select("flow_id", "label"), "flow_id").filter("predicted_class = label").count()
    assert hits > 500
    partial = detector.detect(small_flows.select("flow_id", "ts_us", "duration", "src_bytes", "dst_bytes", "flag"))
    row = partial.first()
    assert row["defaulted_features"] > row["defaulted_raw"] > 0 and set(row["flow_summary"]) == {"duration", "flag", "src_bytes", "dst_bytes"}
    with pytest.raises(FlowDataError):
        Detector(bundle, fill_missing=False).detect(small_flows.select("flow_id", "duration"))
    assert Detector(bundle, threshold=1.01).detect(small_flows).filter("is_attack").count() == 0
    with pytest.raises(FlowDataError):
        registry.load("/nowhere")
    with pytest.raises(FlowDataError):
        registry.save(bundle.model, "x", [], ["a"])


def test_reevaluation_survives_constant_columns(spark, trained, small_flows):
    _, root = trained
    flat = small_flows.withColumn("wrong_fragment", F.lit(0).cast("bigint"))
    tables = evaluate_plan(spark, flat, root, sample=400)
    got = {r["metric"]: r["value"] for r in tables["metrics"].collect()}
    assert got["accuracy"] > 0.4 and tables["confusion"].count() == 25
    with pytest.raises(FlowDataError, match="unseen"):
        evaluate_plan(spark, flat.withColumn("label", F.lit("worm")), root)


@pytest.mark.parametrize("name,params", [("gradient_boosting", {"maxIter": 3, "maxDepth": 3}), ("svm", {"maxIter": 10})])
def test_one_against_rest_models_give_probabilities(spark, name, params):
    df = spark.range(150).select(
        (F.col("id") % 3).cast("double").alias("label_index"), ((F.col("id") % 3) * 2 + F.rand(1)).alias("a"), F.rand(2).alias("b"))
    data = tr.assemble(tr.with_weights(df), ["a", "b"])
    model = tr.estimator_of(name, params, 150).fit(data)
    out = tr.scored(model, data)
    assert out.filter(F.size("probabilities") != 3).count() == 0
    assert out.filter("prediction = label_index").count() > 100


def test_grid_search_picks_a_point(spark):
    df = spark.range(90).select(F.col("id"), (F.col("id") % 2).cast("double").alias("label_index"), (F.col("id") % 2 + F.rand(1)).alias("a"))
    best = tr.train_one(df, "logistic_regression", ["a"], "id", {"maxIter": 5}, folds=2, tune=True, grid={"C": [0.01, 1.0]})
    assert best.params["C"] in (0.01, 1.0) and 0.5 < best.cv_mean <= 1.0
    with pytest.raises(FlowDataError):
        tr.estimator_of("magic")
    with pytest.raises(FlowDataError):
        tr.best_model({})


def test_model_inputs_are_flow_columns(small_flows):
    assert set(MODEL_INPUTS) <= set(small_flows.columns)


def test_candidates_share_their_folds(spark, monkeypatch):
    rows = [(i, float(i % 2) + 0.1 * (i % 5), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, label_index double")
    calls = []
    monkeypatch.setattr(tr, "assign_folds", lambda *a, plain=tr.assign_folds, **k: calls.append(1) or plain(*a, **k))
    models = {"logistic_regression": {"maxIter": 5}, "random_forest": {"numTrees": 2, "maxDepth": 2}, "unheard": {}}
    done, errors = tr.train_all(df, ["a"], "id", models, folds=2)
    assert list(done) == ["logistic_regression", "random_forest"] and list(errors) == ["unheard"] and len(calls) == 1
    alone = tr.train_one(df, "logistic_regression", ["a"], "id", {"maxIter": 5}, folds=2)
    assert alone.fold_scores == pytest.approx(done["logistic_regression"].fold_scores)
