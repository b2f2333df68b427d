"""Every operator as a query over the given tables."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.functions.columns import CATEGORICAL, CLASS_MIX, FEATURES, NUMERIC
from tidewatch.functions.flow_features import derived_names, duration_band, engineer
from tidewatch.functions.numbers import to_number
from tidewatch.operators import alerts as al
from tidewatch.operators import encode as en
from tidewatch.operators import metrics as me
from tidewatch.operators import profile as pr
from tidewatch.operators import quality as qu
from tidewatch.operators import sampling as sa
from tidewatch.operators import select as se
from tidewatch.operators import throttle as th
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.operators.shuffle import shuffled
from tidewatch.plans.scores import CLASSES, score_flows
from tidewatch.sources.flow_view import flows, raw_flows
from tidewatch.streaming import rolling as ro

ONE_DAY = 24 * 3600
IDS = ["flow_id", "ts_us", "stream_key"]
COARSE = ["protocol_type", "service", "flag", "land", "urgent", "logged_in", "hot", "num_shells", "num_outbound_cmds", "label"]
RANKED = ["duration", "src_bytes", "dst_bytes", "count", "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate",
          "same_srv_rate", "diff_srv_rate", "dst_host_count", "total_bytes", "packet_rate", "error_rate_total",
          "privilege_activity", "num_failed_logins", "hot", "log_duration"]
SCALED = ["duration", "src_bytes", "count", "serror_rate", "urgent", "dst_host_count"]
IMPUTED = ["wrong_fragment", "num_failed_logins", "num_compromised", "num_file_creations", "dst_host_srv_diff_host_rate"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def big(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def lineitems(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def engineered(spark: SparkSession, d: str) -> DataFrame:
    return engineer(flows(spark, d), untouched=IDS)


def detections(spark: SparkSession, d: str) -> DataFrame:
    return score_flows(flows(spark, d))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return al.build_alerts(detections(spark, d))


# ---- features ---------------------------------------------------------------------------------


def engineer_features(spark, d):
    df = engineered(spark, d)
    kinds = dict(df.dtypes)
    out = []
    for c in sorted(derived_names(FEATURES)):
        if kinds[c] == "double":
            out.append(F.round(c, 2 if c in ("byte_ratio", "src_byte_rate", "dst_byte_rate") else 6).alias(c))
        else:
            out.append(F.col(c).cast("bigint").alias(c) if kinds[c] != "string" else F.col(c))
    return df.select("flow_id", *out)


def zero_filled_inputs(spark, d):
    return engineered(spark, d).select("flow_id", "wrong_fragment", "num_failed_logins", "num_compromised", r6("dst_host_srv_diff_host_rate").alias("dst_host_srv_diff_host_rate"))


def duration_band_counts(spark, d):
    return flows(spark, d).groupBy(F.expr(duration_band()).alias("duration_band")).agg(F.count(F.lit(1)).alias("n"))


# ---- quality ----------------------------------------------------------------------------------


def class_distribution(spark, d):
    return rounded(pr.class_distribution(flows(spark, d)), share=6)


def class_counts_pct(spark, d):
    return rounded(pr.class_percentages(flows(spark, d)), percent=6)


def column_quality(spark, d):
    return pr.column_quality(flows(spark, d).select(*FEATURES, "label")).drop("type").withColumnRenamed("column", "feature")


def most_missing(spark, d):
    return pr.most_missing(flows(spark, d).select(*FEATURES, "label"), 15).select(F.col("column").alias("feature"), "missing")


def duplicate_count(spark, d):
    return pr.duplicate_count(flows(spark, d).select(*COARSE))


def duplicate_lineitems(spark, d):
    items = lineitems(spark, d)
    return pr.duplicate_count(items.select("l_orderkey", "l_linenumber"))


def describe_numeric(spark, d):
    out = pr.describe(flows(spark, d), NUMERIC).withColumnRenamed("column", "feature")
    return rounded(out, mean=4, std=4, min=4, q25=4, q50=4, q75=4, max=4)


def describe_lineitem(spark, d):
    out = pr.describe(lineitems(spark, d), LINE_NUMBERS).withColumnRenamed("column", "feature")
    return rounded(out, mean=4, std=4, min=4, q25=4, q50=4, q75=4, max=4)


def clean_rows(spark, d):
    return qu.clean(flows(spark, d).select(*COARSE))


def constant_columns(spark, d):
    return qu.constant_columns(flows(spark, d).select(*FEATURES, "label"), "label").select(F.col("column").alias("feature"))


def nonfinite_to_null(spark, d):
    value = "dst_host_srv_diff_host_rate"
    both = raw_flows(spark, d).select("flow_id", F.isnan(value).alias("was_nan"), (F.col(value) == float("inf")).alias("was_inf")).join(
        flows(spark, d).select("flow_id", value), "flow_id")
    return both.groupBy("was_nan", "was_inf").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known"))


def numeric_coercion(spark, d):
    text = F.when(F.col("flow_id") % 9 == 0, F.concat(F.col("count").cast("string"), F.lit("x"))).otherwise(F.col("count").cast("string"))
    return flows(spark, d).select("flow_id", to_number(text).alias("number"))


def record_violations(spark, d):
    checked = qu.record_violations(raw_flows(spark, d), ["duration", "flag", "wrong_fragment", "num_failed_logins", "dst_host_srv_diff_host_rate", "payload_entropy"])
    return checked.select("flow_id", F.array_join("violations", "; ").alias("violations"))


def submitted(spark, d) -> DataFrame:
    """Flows as careless clients would submit them."""
    f = flows(spark, d)
    return f.select(
        "flow_id", F.when(F.col("flow_id") % 11 == 0, None).otherwise(F.col("duration")).alias("duration"),
        F.concat(F.lit(" "), "protocol_type").alias("protocol_type"),
        F.when(F.col("flow_id") % 13 == 0, F.lit("  ")).otherwise(F.col("service")).alias("service"), "flag",
        F.when(F.col("flow_id") % 17 == 0, F.lit(-10).cast("bigint")).otherwise(F.col("src_bytes")).alias("src_bytes"),
        "dst_bytes", "count",
    )


def flow_contract_violations(spark, d):
    out = qu.apply_record_contract(submitted(spark, d))
    return out.select("flow_id", "duration", "protocol_type", "service", "flag", "srv_count", F.array_join("violations", "; ").alias("violations"))


def quarantine_counts(spark, d):
    valid, quarantined = qu.split_valid(qu.apply_record_contract(submitted(spark, d)))
    return valid.agg(F.lit("valid").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        quarantined.agg(F.lit("quarantined").alias("part"), F.count(F.lit(1)).alias("n")))


def binary_labels(spark, d):
    return qu.collapse_label(flows(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def byte_cap(spark, d):
    return qu.cap_bytes(flows(spark, d)).select("flow_id", "src_bytes", "dst_bytes")


def unknown_labels(spark, d):
    return qu.unknown_labels(flows(spark, d), "label", ["normal", "dos", "probe"])


# ---- encode -----------------------------------------------------------------------------------


def medians(spark, d):
    return rounded(en.median_table(flows(spark, d), NUMERIC), median=6).withColumnRenamed("column", "feature")


def modes(spark, d):
    return en.category_modes(flows(spark, d), CATEGORICAL).withColumnRenamed("column", "feature")


def category_levels(spark, d):
    return en.category_levels(flows(spark, d), CATEGORICAL).withColumnRenamed("column", "feature")


def impute_median(spark, d):
    df = flows(spark, d)
    return en.impute(df, en.medians(df, IMPUTED)).select("flow_id", *[r6(c).alias(c) for c in IMPUTED])


def one_hot(spark, d):
    df = flows(spark, d)
    model = en.FlowEncoder(scaler="none").fit(df.select(*CATEGORICAL, "label"))
    return model.transform_features(df, keep=["flow_id"])


def standard_scale(spark, d):
    return en.scale_table(flows(spark, d), SCALED, "standard").select("flow_id", *[r6(c).alias(c) for c in SCALED])


def minmax_scale(spark, d):
    return en.scale_table(flows(spark, d), SCALED, "minmax").select("flow_id", *[r6(c).alias(c) for c in SCALED])


def encoded_matrix(spark, d):
    """Fit on flows with missing values, then impute, encode and scale them."""
    df = flows(spark, d).select("flow_id", *IMPUTED, "flag", "label")
    model = en.FlowEncoder(scaler="standard", drop=["flow_id"]).fit(df)
    return model.transform_features(df, keep=["flow_id"]).select(
        "flow_id", *[r6(c).alias(c) for c in model.state.features])


def label_encode(spark, d):
    df = flows(spark, d)
    names = en.class_names(df, "label")
    index = en.encode_label(F.col("label"), names)
    return df.select("flow_id", "label", index.cast("bigint").alias("label_index"), en.decode_label(index, names).alias("decoded"))


# ---- sampling ---------------------------------------------------------------------------------


def stratified_split(spark, d):
    return sa.split_rows(flows(spark, d), "flow_id").select("flow_id", "label", "split")


def split_sizes(spark, d):
    return stratified_split(spark, d).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def sample_random(spark, d):
    df = flows(spark, d)
    return sa.sample_rows(df, "flow_id", 700).select("flow_id", "label")


def sample_per_class(spark, d):
    return sa.sample_per_class(flows(spark, d), "flow_id", 25).select("flow_id", "label")


def sample_class_mix(spark, d):
    return sa.sample_class_mix(flows(spark, d), "flow_id", 500).select("flow_id", "label")


_FACTS = ["ts_us", "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "count"]


def shuffle_flows(spark, d):
    return shuffled(flows(spark, d), "flow_id").select("flow_id", "label", "place")


def kfold_assign(spark, d):
    return big(sa.assign_folds(flows(spark, d), "flow_id", 5).select("flow_id", "label", "fold"), "fold")


def kfold_null_labels(spark, d):
    """Folds where every tenth label is missing: the rows without one are a class of their own."""
    gaps = flows(spark, d).withColumn("label", F.when(F.col("flow_id") % 10 != 0, F.col("label")))
    return big(sa.assign_folds(gaps, "flow_id", 5).select("flow_id", "label", "fold"), "fold")


def train_clean_rows(spark, d):
    """Rows that training sees of a table in which every third flow comes twice, under another id."""
    from tidewatch.plans.training import distinct_flows

    own = flows(spark, d).select("flow_id", *_FACTS, "label")
    again = own.where("flow_id % 3 = 0").withColumn("flow_id", F.col("flow_id") + 1_000_000_000)
    return distinct_flows(own.unionByName(again), "flow_id").select("flow_id", *_FACTS, "label")


def weight_shares(spark, d):
    """Class counts of the table as a weight profile over the fixed class list plus one absent class."""
    counts = sa.class_counts(flows(spark, d), "label")
    shares = sa.weight_shares(counts, [*CLASS_MIX, "worm"])
    return rounded(spark.createDataFrame(list(shares.items()), "class string, share double"), share=6)


# ---- selection --------------------------------------------------------------------------------


def correlation_pairs(spark, d):
    out = pr.correlation_matrix(flows(spark, d), NUMERIC)
    return out.select("column_i", "column_j", r6(F.coalesce("r", F.lit(0.0))).alias("r"))


def correlation_lineitem(spark, d):
    items = lineitems(spark, d)
    return pr.correlation_matrix(items, LINE_NUMBERS).select("column_i", "column_j", F.round("r", 6).alias("r"))


def drop_correlated(spark, d):
    kept = se.drop_correlated(engineered(spark, d), RANKED, 0.9)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def indexed(spark, d) -> DataFrame:
    return engineered(spark, d).withColumn("label_index", en.encode_label(F.col("label"), CLASSES))


def corr_score(spark, d):
    return rounded(se.correlation_scores(indexed(spark, d), RANKED, "label_index"), score=6)


def mutual_info_binned(spark, d):
    return rounded(se.mutual_information(indexed(spark, d), RANKED, "label"), score=6)


def topk_features(spark, d):
    scores = se.correlation_scores(indexed(spark, d), RANKED, "label_index")
    return rounded(se.top_features(scores, 5), score=6)


def select_features(spark, d):
    picked = se.select_features(indexed(spark, d), RANKED, "label_index", "correlation", top_k=6, threshold=0.9)
    return rounded(big(picked.to_table(spark), "rank"), score=6).drop("method")


# ---- evaluation -------------------------------------------------------------------------------


def confusion_matrix(spark, d):
    return me.confusion(detections(spark, d), "label", "predicted_class", CLASSES).select("truth", "predicted", "n")


def confusion_normalised(spark, d):
    return rounded(me.confusion(detections(spark, d), "label", "predicted_class", CLASSES), share=6).drop("n")


def headline_metrics(spark, d):
    return rounded(me.headline_metrics(detections(spark, d), "label", "predicted_class"), value=6)


def per_class_report(spark, d):
    return rounded(me.class_report(detections(spark, d), "label", "predicted_class", [*CLASSES, "worm"]), precision=6, recall=6, f1=6)


def _score_columns():
    return {c: F.col(f"p_{c}") for c in CLASSES}


def auc_ovr(spark, d):
    return rounded(me.auc_per_class(detections(spark, d), "label", _score_columns()), auc=6)


def auc_macro(spark, d):
    return rounded(me.auc_roc(detections(spark, d), "label", _score_columns(), CLASSES), auc_roc=6)


def roc_points(spark, d):
    return rounded(me.roc_points(detections(spark, d), "label", _score_columns()), threshold=6, fpr=6, tpr=6)


def roc_corners(spark, d):
    return rounded(me.roc_points(detections(spark, d), "label", _score_columns(), corners=True), threshold=6, fpr=6, tpr=6)


def label_metrics(spark, d):
    """Two-class metrics on the labels table: quality as truth, toxic as prediction."""
    return rounded(me.headline_metrics(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic"), value=6)


def hit_rate(spark, d):
    return rounded(me.hit_rate(detections(spark, d), "label", "predicted_class"), rate=6)


def balanced_weights(spark, d):
    return rounded(me.balanced_weights(flows(spark, d)), weight=6)


def feature_by_class_percentiles(spark, d):
    out = pr.percentiles_by_class(flows(spark, d), ["duration", "src_bytes"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return rounded(out.withColumnRenamed("column", "feature"), value=6)


def histogram_by_class(spark, d):
    return pr.histogram_by_class(flows(spark, d), "duration", 0.0, 200.0, 20)


# ---- detection and alerts ---------------------------------------------------------------------


def softmax_scores(spark, d):
    return detections(spark, d).select("flow_id", *[r6(f"p_{c}").alias(f"p_{c}") for c in CLASSES])


def detect_rows(spark, d):
    return detections(spark, d).select("flow_id", "predicted_class", r6("confidence").alias("confidence"), "is_attack")


def batch_summary(spark, d):
    return al.batch_summary(detections(spark, d))


def severity_grade(spark, d):
    return al.grade(detections(spark, d)).select("flow_id", "severity", F.col("severity_rank").cast("bigint").alias("severity_rank"))


def alert_messages(spark, d):
    # Two of the summary's numbers are left out of the comparison: engines print doubles differently.
    return candidates(spark, d).select("flow_id", "alert_id", "severity", "throttle_key", F.regexp_replace("message", "duration=[^,]*, ", "").alias("message"))


def severity_counts(spark, d):
    return al.severity_counts(candidates(spark, d))


def recent_alerts(spark, d):
    return al.recent(candidates(spark, d), 50).select("flow_id", "severity", "predicted_class", "confidence")


def minimum_severity(spark, d):
    return al.build_alerts(detections(spark, d), min_severity="HIGH").groupBy("predicted_class", "severity").agg(F.count(F.lit(1)).alias("n"))


def alert_counters(spark, d):
    scored = detections(spark, d)
    return al.counters(scored, al.build_alerts(scored))


def throttle_alerts(spark, d):
    return th.dispatched(candidates(spark, d), ONE_DAY, 5).select("flow_id", "throttle_key", "count_in_window")


def throttle_decisions(spark, d):
    return th.decisions(candidates(spark, d), ONE_DAY, 5).select("flow_id", "throttle_key", "allowed", "count_in_window", "suppressed_total")


def suppressed_totals(spark, d):
    return th.suppressed_totals(candidates(spark, d), ONE_DAY, 5)


def alerts_sent(spark, d):
    """The whole alert path: grade, minimum severity, throttle, then counts by severity."""
    return al.severity_counts(al.handle(detections(spark, d), min_severity="MEDIUM", window_seconds=ONE_DAY, limit=3))


# ---- stream statistics ------------------------------------------------------------------------


def rolling_stats(spark, d):
    return ro.rolling_snapshot(detections(spark, d), 500)


def rolling_class_counts(spark, d):
    return ro.class_counts(ro.newest(detections(spark, d), 500))


def trending_class(spark, d):
    return ro.trending_class(ro.newest(detections(spark, d), 500))


def lifetime_stats(spark, d):
    return ro.lifetime_stats(detections(spark, d))


def running_totals(spark, d):
    slim = detections(spark, d).select("flow_id", "ts_us", "is_attack")
    return ro.running_totals(slim).drop("ts_us", "is_attack")


def rolling_per_row(spark, d):
    slim = detections(spark, d).select("flow_id", "ts_us", "is_attack", "confidence")
    return ro.rolling_per_row(slim, 100, 1000).drop("ts_us", "is_attack", "confidence")


def micro_batches(spark, d):
    return ro.micro_batches(flows(spark, d).select("flow_id", "ts_us"), 100).select("flow_id", "batch_no")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, where every executor can write."""
    from tidewatch.session import checkpoint_folder

    return f"{checkpoint_folder(spark)}/tidewatch-{uuid.uuid4().hex}"


# ---- sources, contracts, saved models -----------------------------------------------------------


def csv_round_trip(spark, d):
    """Flows written as CSV under padded column names and read back."""
    from tidewatch.sources.tables import read_flows, write_flows

    own = flows(spark, d).select("flow_id", "service", "src_bytes", "label")
    path = write_flows(own.toDF(*[f" {c} " for c in own.columns]), f"{_scratch(spark)}/flows.csv")
    return read_flows(spark, path, schema="` flow_id ` bigint, ` service ` string, ` src_bytes ` bigint, ` label ` string")


def parquet_built_once(spark, d):
    """A table that is built where it is absent and read where it is there: the second builder must not run."""
    from tidewatch.sources.tables import read_or_build

    own, path = flows(spark, d).select("flow_id", "flag", "dst_bytes", "label"), f"{_scratch(spark)}/flows.parquet"
    read_or_build(spark, path, lambda: own)
    return read_or_build(spark, path, lambda: own.limit(0))


def report_read_back(spark, d):
    """The class distribution written as a report and read again."""
    from tidewatch.sources.tables import write_report

    path = write_report({"classes": class_distribution(spark, d)}, _scratch(spark))["classes"]
    return spark.read.schema("class string, n bigint, share double").json(path)


def selection_read_back(spark, d):
    """The correlation selection written and read again."""
    from tidewatch.sources.tables import read_selection, write_selection

    path = f"{_scratch(spark)}/selection"
    write_selection(spark, se.Selection("correlation", *_by_correlation(spark, d)), path)
    found = read_selection(spark, path)
    return rounded(spark.createDataFrame([(f, found.scores[f]) for f in found.selected], "feature string, score double"), score=6)


def _by_correlation(spark, d):
    scores = {r["feature"]: r["score"] for r in topk_features(spark, d).collect()}
    return list(scores), scores


def alerts_json_lines(spark, d):
    """Alerts as JSON lines; a channel that fails beside it must not keep them back."""
    from tidewatch.sources.sinks import Fanout, json_lines

    def broken(alerts, batch_id):
        raise RuntimeError("out of order")

    path = _scratch(spark)
    Fanout(spark, {"broken": broken, "lines": json_lines(path)}).dispatch(candidates(spark, d).select("flow_id", "alert_id", "severity", "throttle_key"), 0)
    return spark.read.schema("flow_id bigint, alert_id string, severity string, throttle_key string").json(f"{path}/batch_id=0")


def target_contract(spark, d):
    """Whether a label column is refused: as it is, with gaps, with one class, and without rows."""
    own = flows(spark, d).select("flow_id", "label")
    cases = {
        "as it is": own, "gaps": own.withColumn("label", F.when(F.col("flow_id") % 10 != 0, F.col("label"))),
        "one class": own.where("label = 'normal'"), "no rows": own.where("flow_id < 0"),
    }

    def refused(df):
        try:
            qu.check_target(df, "label")
        except FlowDataError:
            return True
        return False

    return spark.createDataFrame([(name, refused(df)) for name, df in cases.items()], "case string, refused boolean")


def split_single_row_class(spark, d):
    """A class of one row cannot be stratified: the draws are over all rows."""
    own = flows(spark, d).select("flow_id", F.when(F.col("flow_id") == 0, "alone").otherwise(F.col("label")).alias("label"))
    return sa.split_rows(own, "flow_id", "label").select("flow_id", "split")


def saved_model_scores(spark, d):
    """A saved model's class and confidence against its exported coefficients, on flows that lack one of its inputs."""
    from tidewatch.operators.detect import Detector
    from tidewatch.sources.registry import ModelRegistry

    root = _scratch(spark)
    _one_model(spark, d, root)
    bundle = ModelRegistry(spark, root).load()
    detector = Detector(bundle)
    given = model_flows(spark, d).drop("num_compromised", "label")
    inner = bundle.model.stages[0]
    inputs = detector.prepare(given, ["flow_id"])
    scores = F.array(*[
        sum((F.col(f) * float(w) for f, w in zip(bundle.features, weights)), F.lit(float(bias)))
        for weights, bias in zip(inner.coefficientMatrix.toArray(), inner.interceptVector.toArray())
    ])
    parts = F.transform(scores, lambda z: F.exp(z - F.array_max(scores)))
    share = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    mine = inputs.select(F.col("_keep_flow_id").alias("flow_id"), F.get(F.array(*[F.lit(c) for c in bundle.classes]), (F.array_position(parts, F.array_max(parts)) - 1).cast("int")).alias("_class"), (F.array_max(parts) / share).alias("_confidence"))
    both = detector.detect(given).join(mine, "flow_id")
    return both.agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(F.col("predicted_class") != F.col("_class")).alias("other_class"),
        F.count_if(F.abs(F.col("confidence") - F.col("_confidence")) > 1e-9).alias("other_confidence"), F.max("defaulted_raw").cast("bigint").alias("inputs_defaulted"),
        F.count_if(F.col("scored_at").isNull()).alias("without_time"),
    )


def stream_alerts(spark, d):
    """The alert stream over the events file: same rows as ``throttle_alerts``."""
    from tidewatch.plans.live import replay_events

    return replay_events(spark, d, _scratch(spark), ONE_DAY, 5).select("flow_id", "throttle_key", "count_in_window")


# ---- models -----------------------------------------------------------------------------------


def rf_importance(spark, d):
    scores = se.forest_importance(indexed(spark, d), RANKED, "label_index", trees=20, depth=6)
    return se.top_features(spark.createDataFrame(list(scores.items()), "feature string, score double"), 20)


def rfe_rank(spark, d):
    scores = se.eliminate_features(indexed(spark, d), RANKED, "label_index", 6, trees=10, depth=5)
    return se.top_features(spark.createDataFrame(list(scores.items()), "feature string, score double"), 20)


def pca_projection(spark, d):
    df = engineered(spark, d)
    return pr.pca_projection(df, RANKED, ["flow_id", "label"])[0]


MODEL_INPUTS = ["duration", "protocol_type", "flag", "src_bytes", "dst_bytes", "wrong_fragment", "num_failed_logins", "count",
                "serror_rate", "rerror_rate", "same_srv_rate", "num_compromised", "is_guest_login"]


def model_flows(spark, d) -> DataFrame:
    return flows(spark, d).select("flow_id", "ts_us", "stream_key", *MODEL_INPUTS, "label")


def _one_model(spark, d, root):
    from tidewatch.plans.training import QUICK_MODELS, train_plan

    models = {"logistic_regression": QUICK_MODELS["logistic_regression"]}
    return train_plan(spark, model_flows(spark, d), root, models=models, folds=2, top_k=10, method="correlation")


def train_compare(spark, d):
    from tidewatch.plans.training import QUICK_MODELS, train_plan

    return train_plan(spark, model_flows(spark, d), None, models=QUICK_MODELS, folds=2, top_k=10)["comparison"]


def evaluate_saved(spark, d):
    from tidewatch.plans.training import evaluate_plan

    root = _scratch(spark)
    _one_model(spark, d, root)
    return evaluate_plan(spark, model_flows(spark, d), root)["metrics"]


def registry_list(spark, d):
    from tidewatch.sources.registry import ModelRegistry

    root = _scratch(spark)
    _one_model(spark, d, root)
    return ModelRegistry(spark, root).list_models()


NAMES = [
    "engineer_features", "zero_filled_inputs", "duration_band_counts", "class_distribution", "class_counts_pct", "column_quality",
    "most_missing", "duplicate_count", "duplicate_lineitems", "describe_numeric", "describe_lineitem", "clean_rows",
    "constant_columns", "nonfinite_to_null", "numeric_coercion", "record_violations", "flow_contract_violations",
    "quarantine_counts", "binary_labels", "byte_cap", "unknown_labels", "medians", "modes", "category_levels",
    "impute_median", "one_hot", "standard_scale", "minmax_scale", "encoded_matrix", "label_encode", "stratified_split",
    "split_sizes", "sample_random", "sample_per_class", "sample_class_mix", "shuffle_flows", "kfold_assign", "kfold_null_labels",
    "train_clean_rows", "weight_shares",
    "correlation_pairs", "correlation_lineitem", "drop_correlated", "corr_score", "mutual_info_binned", "topk_features",
    "select_features", "confusion_matrix", "confusion_normalised", "headline_metrics", "per_class_report", "auc_ovr",
    "auc_macro", "roc_points", "roc_corners", "label_metrics", "hit_rate", "balanced_weights", "feature_by_class_percentiles",
    "histogram_by_class", "softmax_scores", "detect_rows", "batch_summary", "severity_grade", "alert_messages",
    "severity_counts", "recent_alerts", "minimum_severity", "alert_counters", "throttle_alerts", "throttle_decisions",
    "suppressed_totals", "alerts_sent", "rolling_stats", "rolling_class_counts", "trending_class", "lifetime_stats",
    "running_totals", "rolling_per_row", "micro_batches", "csv_round_trip", "parquet_built_once",
    "report_read_back", "selection_read_back", "alerts_json_lines", "target_contract", "split_single_row_class",
    "saved_model_scores", "stream_alerts", "rf_importance", "rfe_rank", "pca_projection",
    "train_compare", "evaluate_saved", "registry_list",
]


def all_queries():
    return {name: globals()[name] for name in NAMES}
