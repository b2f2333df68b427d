"""Training and re-evaluation of flow classifiers, from table to registered model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.functions.flow_features import engineer
from tidewatch.operators import metrics as me
from tidewatch.operators.encode import EncoderModel, FlowEncoder, decode_label
from tidewatch.operators.quality import clean
from tidewatch.operators.sampling import sample_rows, split_rows
from tidewatch.operators.select import select_features
from tidewatch.operators.train import LABEL, assemble, comparison, scored, train_all
from tidewatch.session import settle, stored
from tidewatch.sources.registry import ModelRegistry
from tidewatch.sources.tables import write_report, write_selection

# Small settings for quick runs.
QUICK_MODELS = {
    "random_forest": {"numTrees": 10, "maxDepth": 6},
    "logistic_regression": {"maxIter": 30},
}


def distinct_flows(flows: DataFrame, id_column: str) -> DataFrame:
    """One row per distinct flow, whatever its id: of equal rows the one with the smallest id stays. Repeats collapse before the shuffle."""
    facts = [c for c in flows.columns if c != id_column]
    return flows.groupBy(*facts).agg(F.min(id_column).alias(id_column)).select(*flows.columns)


def evaluate(model, df: DataFrame, features: list[str], classes: list[str], id_column: str = "flow_id") -> dict[str, DataFrame]:
    """Metric tables of a model on encoded rows with ``label_index``."""
    out = settle(scored(model, assemble(df, features, keep=[id_column])))
    named = out.withColumns({
        "truth": decode_label(F.col(LABEL), classes), "predicted": decode_label(F.col("prediction"), classes)
    })
    tables = {
        "metrics": me.headline_metrics(named, "truth", "predicted"),
        "confusion": me.confusion(named, "truth", "predicted", classes),
        "classes": me.class_report(named, "truth", "predicted", classes),
    }
    if "probabilities" in out.columns:
        scores = {c: F.col("probabilities")[i] for i, c in enumerate(classes)}
        auc = me.auc_roc(named, "truth", scores, classes)
        tables["metrics"] = tables["metrics"].unionByName(auc.select(F.lit("auc_roc").alias("metric"), F.col("auc_roc").alias("value")))
    return tables


def _metric_map(tables: dict[str, DataFrame]) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in tables["metrics"].collect()}


def train_plan(
    spark: SparkSession, flows: DataFrame, root: str | None, models: dict | None = None, folds: int = 5, top_k: int = 30,
    method: str | None = "mutual_info", target: str = "label", id_column: str = "flow_id", ignore=("ts_us", "stream_key"),
    tune: bool = False, fit_on: str = "all", seed: int = 42, test_size: float = 0.15, val_size: float = 0.15,
) -> dict:
    """Clean, derive, encode, select, split, train, compare on validation, test the best, register it.

    By default the encoder and the selection are fitted on all rows, as the figures to match were;
    ``fit_on="train"`` keeps validation and test rows out of them. Without a ``method`` all encoded columns are used. With ``root`` the model, the
    selection and a report are written below it.
    """
    if fit_on not in ("all", "train"):
        raise FlowDataError("fit_on must be 'all' or 'train'")
    # Settled: deduplication shuffles the whole table, and all steps below read the result.
    cleaned = settle(clean(distinct_flows(flows.drop(*ignore), id_column), target))
    table = engineer(split_rows(cleaned, id_column, target, test_size, val_size, seed), untouched=[id_column])
    # All rows are seen without their split, which costs a hash and a join in each reading.
    seen = engineer(cleaned, untouched=[id_column]) if fit_on == "all" else table.filter("split = 'train'").drop("split")
    encoder: EncoderModel = FlowEncoder(target, drop=[id_column]).fit(seen)
    classes = encoder.state.classes
    encoder.check_labels(cleaned)
    matrix = stored(encoder.transform_features(
        table.withColumn(LABEL, encoder.label_index()), keep=[id_column, LABEL, "split"]))
    fit_rows = matrix if fit_on == "all" else matrix.filter("split = 'train'")
    selection = select_features(fit_rows, encoder.state.features, LABEL, method, top_k, seed=seed) if method else None
    chosen = selection.selected if selection else encoder.state.features
    parts = {name: matrix.filter(F.col("split") == name).select(id_column, LABEL, *chosen) for name in ("train", "val", "test")}
    trained, errors = train_all(parts["train"], chosen, id_column, models, folds, tune, seed)
    validation = {n: _metric_map(evaluate(m.model, parts["val"], chosen, classes, id_column)) for n, m in trained.items()}
    best, _ = sorted(validation.items(), key=lambda item: (-item[1]["f1_macro"], item[0]))[0]
    test = evaluate(trained[best].model, parts["test"], chosen, classes, id_column)
    metrics = _metric_map(test)
    sizes = {r["split"]: r["n"] for r in matrix.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = {
        "comparison": comparison(spark, trained), "best": best, "validation": validation, "test": test, "metrics": metrics,
        "selection": selection, "encoder": encoder, "classes": classes, "models": trained, "errors": errors, "sizes": sizes,
    }
    if root is not None:
        result["path"] = ModelRegistry(spark, root).save(
            trained[best].model, best, chosen, classes, metrics, encoder, trained[best].params, as_best=True)
        if selection:
            write_selection(spark, selection, f"{root}/selected_features")
        write_report({"comparison": result["comparison"], **test}, f"{root}/report")
    return result


def evaluate_plan(
    spark: SparkSession, flows: DataFrame, root: str, path: str | None = None, sample: int = 0, target: str = "label",
    id_column: str = "flow_id", ignore=("ts_us", "stream_key"), seed: int = 42,
) -> dict[str, DataFrame]:
    """Metric tables of a registered model on another labelled table.

    Columns that happen to be constant there are kept: the encoder still needs them.
    """
    bundle = ModelRegistry(spark, root).load(path)
    if bundle.encoder is None:
        raise FlowDataError("the registered model has no encoder")
    rows = sample_rows(flows, id_column, sample, seed) if sample else flows
    table = engineer(clean(distinct_flows(rows.drop(*ignore), id_column), target, drop_constants=False), untouched=[id_column])
    bundle.encoder.check_labels(table)
    matrix = bundle.encoder.transform_features(
        table.withColumn(LABEL, bundle.encoder.label_index()), keep=[id_column, LABEL], columns=bundle.features)
    return evaluate(bundle.model, matrix, bundle.features, bundle.classes, id_column)
