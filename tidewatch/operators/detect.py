"""Scoring tables of flows."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.functions.columns import SUMMARY_FIELDS
from tidewatch.functions.flow_features import derived_names, engineer
from tidewatch.functions.scoring import best_class, computed_once, flow_summary, is_attack, probability_map
from tidewatch.operators.encode import decode_label
from tidewatch.operators.train import FEATURES, scored

THRESHOLD = 0.7


def shape_detections(
    df: DataFrame, classes: list[str], probabilities: Column, predicted: Column | None = None,
    threshold: float = THRESHOLD, keep=(), raw_columns: list[str] | None = None,
) -> DataFrame:
    """Result columns of scored rows: class, confidence, attack flag, probability map, flow summary."""
    summary = flow_summary([c for c in SUMMARY_FIELDS if c in (raw_columns if raw_columns is not None else df.columns)])
    once = computed_once(df.withColumn("_summary", summary), [*keep, "_summary"], {
        "_p": probabilities, **({} if predicted is None else {"_label": predicted})})
    label = best_class(F.col("_p"), classes) if predicted is None else F.col("_label")
    named = computed_once(once, [*keep, "_summary", "_p"], {"predicted_class": label, "confidence": F.array_max("_p")})
    return named.select(
        *keep, "predicted_class", "confidence",
        is_attack(F.col("predicted_class"), F.col("confidence"), threshold).alias("is_attack"),
        probability_map(F.col("_p"), classes).alias("class_probabilities"),
        F.col("_summary").alias("flow_summary"),
    )


class Detector:
    """Scores flow tables with a saved model bundle, as one lazy plan.

    Absent inputs get their learned defaults first; features are derived after that, so those whose
    sources the flow has replace their defaults.
    """

    def __init__(self, bundle, threshold: float = THRESHOLD, derive: bool = True, fill_missing: bool = True):
        self.bundle, self.threshold, self.derive, self.fill_missing = bundle, threshold, derive, fill_missing

    def defaulted(self, columns: list[str]) -> tuple[int, int]:
        """(all model inputs absent from the flow, those among them that cannot be derived either)."""
        encoder = self.bundle.encoder
        if encoder is None:
            return 0, 0
        absent = [c for c in encoder.state.defaults if c not in columns]
        derived = set(derived_names(columns)) if self.derive else set()
        return len(absent), len([c for c in absent if c not in derived])

    def prepare(self, df: DataFrame, keep=()) -> DataFrame:
        encoder, wanted = self.bundle.encoder, self.bundle.features
        held = df.withColumns({f"_keep_{c}": F.col(c) for c in keep})
        if encoder is not None and self.fill_missing:
            held = encoder.fill_defaults(held)
        if self.derive:
            held = engineer(held, untouched=[f"_keep_{c}" for c in keep])
        if encoder is not None:
            unknown = [c for c in wanted if c not in encoder.state.features]
            if unknown:
                raise FlowDataError(f"missing model feature(s): {', '.join(unknown)}")
            held = encoder.transform_features(held, keep=[f"_keep_{c}" for c in keep], columns=wanted)
        absent = [c for c in wanted if c not in held.columns]
        if absent:
            raise FlowDataError(f"missing model feature(s): {', '.join(absent)}")
        return held

    def detect(self, df: DataFrame, keep=("flow_id", "ts_us")) -> DataFrame:
        """Detections with the ``keep`` columns of the input in front."""
        carried = list(dict.fromkeys([*[c for c in keep if c in df.columns], *[c for c in SUMMARY_FIELDS if c in df.columns]]))
        ready = self.prepare(df, carried)
        vectors = VectorAssembler(inputCols=self.bundle.features, outputCol=FEATURES).transform(ready) \
            .select(*[F.col(f"_keep_{c}").alias(c) for c in carried], FEATURES)
        out = scored(self.bundle.model, vectors)
        classes = self.bundle.classes
        label = decode_label(F.col("prediction"), classes)
        if "probabilities" in out.columns:
            shaped = shape_detections(
                out, classes, F.col("probabilities"), label, self.threshold, [c for c in keep if c in df.columns],
                [c for c in carried if c in SUMMARY_FIELDS],
            )
        else:
            shaped = out.select(
                *[c for c in keep if c in df.columns], label.alias("predicted_class"), F.lit(1.0).alias("confidence"),
                flow_summary([c for c in carried if c in SUMMARY_FIELDS]).alias("flow_summary"),
            ).withColumn("is_attack", is_attack(F.col("predicted_class"), F.col("confidence"), self.threshold)) \
                .withColumn("class_probabilities", F.create_map(F.col("predicted_class"), F.lit(1.0)))
        every, raw = self.defaulted(df.columns)
        # One instant per query, the time of scoring; ``ts_us`` stays the time of the flow.
        return shaped.withColumn("defaulted_features", F.lit(every)).withColumn("defaulted_raw", F.lit(raw)) \
            .withColumn("scored_at", F.current_timestamp())

