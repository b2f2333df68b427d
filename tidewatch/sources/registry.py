"""Versioned models: an MLlib model, its encoder and one registry row per saved version."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.operators.encode import EncoderModel
from tidewatch.session import path_exists

ENTRIES = (
    "model_name string, version string, created_at string, feature_names array<string>, class_names array<string>, "
    "metrics map<string,double>, hyperparameters map<string,string>, is_best boolean, path string"
)


@dataclass
class ModelBundle:
    model: PipelineModel
    encoder: EncoderModel | None
    model_name: str
    version: str
    features: list[str]
    classes: list[str]
    metrics: dict[str, float]


class ModelRegistry:
    """Entries are appended; the newest entry marked best is what ``load()`` returns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.table = f"{self.root}/entries"

    def save(
        self, model, name: str, features: list[str], classes: list[str], metrics: dict | None = None,
        encoder: EncoderModel | None = None, params: dict | None = None, as_best: bool = False,
    ) -> str:
        if not features or not classes:
            raise FlowDataError("a model needs its feature names and class names")
        now = datetime.now(timezone.utc)
        version = now.strftime("%Y%m%d%H%M%S")
        path = f"{self.root}/{name}_{version}"
        if path_exists(self.spark, path):  # a second save within the same second
            version = now.strftime("%Y%m%d%H%M%S%f")
            path = f"{self.root}/{name}_{version}"
        PipelineModel(stages=[model]).write().save(f"{path}/model")
        if encoder is not None:
            encoder.save(self.spark, f"{path}/encoder")
        row = (
            name, version, now.isoformat(), list(features), list(classes),
            {k: float(v) for k, v in (metrics or {}).items()}, {k: str(v) for k, v in (params or {}).items()}, as_best, path,
        )
        self.spark.createDataFrame([row], ENTRIES).coalesce(1).write.mode("append").json(self.table)
        return path

    def list_models(self) -> DataFrame:
        if not path_exists(self.spark, self.table):
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).json(self.table).orderBy("model_name", "version")

    def best(self) -> DataFrame:
        return self.list_models().filter("is_best").orderBy(F.desc("created_at")).limit(1)

    def load(self, path: str | None = None) -> ModelBundle:
        rows = (self.best() if path is None else self.list_models().filter(F.col("path") == path.rstrip("/"))).head(1)
        if not rows:
            raise FlowDataError(f"no model registered at {path or self.root}")
        entry = rows[0]
        encoder = EncoderModel.load(self.spark, f"{entry['path']}/encoder") if path_exists(self.spark, f"{entry['path']}/encoder") else None
        return ModelBundle(
            PipelineModel.load(f"{entry['path']}/model"), encoder, entry["model_name"], entry["version"],
            list(entry["feature_names"]), list(entry["class_names"]), dict(entry["metrics"] or {}),
        )
