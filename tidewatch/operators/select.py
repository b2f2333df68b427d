"""Feature ranking and pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.errors import FlowDataError, check_positive, need_columns
from tidewatch.operators.gram import pearson
from tidewatch.operators.profile import correlation_matrix
from tidewatch.operators.quantiles import exact_quantiles
from tidewatch.session import settle

METHODS = ("mutual_info", "correlation", "importance", "rfe")


@dataclass
class Selection:
    method: str
    selected: list[str]
    scores: dict[str, float]

    def to_table(self, spark: SparkSession) -> DataFrame:
        """``(method, feature, score, rank, selected)``."""
        ranked = sorted(self.scores.items(), key=lambda kv: (-kv[1], kv[0]))
        rows = [(self.method, f, float(s), i + 1, f in self.selected) for i, (f, s) in enumerate(ranked)]
        return spark.createDataFrame(rows, "method string, feature string, score double, rank int, selected boolean")


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    return correlation_matrix(df, columns).filter(F.abs("r") > threshold)


def drop_correlated(df: DataFrame, columns: list[str], threshold: float = 0.95) -> list[str]:
    """Columns left after removing each one that any earlier column explains, kept or not."""
    if len(columns) < 2:
        return list(columns)
    gone = {r["column_j"] for r in correlated_pairs(df, columns, threshold).select("column_j").collect()}
    return [c for c in columns if c not in gone]


def correlation_scores(df: DataFrame, columns: list[str], target_index: str) -> DataFrame:
    """``(feature, score)``: absolute Pearson r with the class index; 0 where undefined."""
    against = pearson(df, [target_index, *columns]).filter("i = 0")
    return against.select(F.col("column_j").alias("feature"), F.coalesce(F.abs("r"), F.lit(0.0)).alias("score"))


def bin_counts(df: DataFrame, edges: dict[str, list[float]], target: str) -> DataFrame:
    """``(feature, bin, class, n)``: rows by class and by how many of a feature's rising ``edges`` lie below its value, none below null.

    Values stay in their columns: a task adds up its batches and hands on one row per feature, bin and class.
    """
    columns = list(edges)
    # NaN is greater than all others, so it lies below nothing.
    cuts = [np.array([e for e in edges[c] if e == e], float) for c in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            classes = [*coded.dictionary.to_pylist(), None]
            at = coded.indices.fill_null(len(classes) - 1).to_numpy(zero_copy_only=False)
            for c, own in enumerate(cuts):
                side = batch.column(c + 1)
                place = np.searchsorted(own, side.to_numpy(zero_copy_only=False).astype(float), side="left")
                if side.null_count:
                    place[side.is_null().to_numpy(zero_copy_only=False)] = 0
                sums = np.bincount(at * (len(own) + 1) + place, minlength=len(classes) * (len(own) + 1))
                for k in np.flatnonzero(sums).tolist():
                    key = (c, k % (len(own) + 1), classes[k // (len(own) + 1)])
                    found[key] = found.get(key, 0) + int(sums[k])
        at, place, classes = (list(side) for side in zip(*found)) if found else ([], [], [])
        arrays = [pa.array([columns[c] for c in at], pa.string()), pa.array(place, pa.int32()), pa.array(classes, kind), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "bin", "class", "n"])

    values = df.select(F.col(target).alias("class"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    kind = to_arrow_type(values.schema["class"].dataType)
    name = values.schema["class"].dataType.simpleString()
    return values.mapInArrow(work, f"feature string, bin int, class {name}, n long").groupBy("feature", "bin", "class").agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """``(feature, score)``: mutual information in nats between quantile-binned features and the class.

    A binned estimate stands in for the nearest-neighbour one, which needs all pairwise distances.
    It needs the bin edges and one count per (feature, bin, class).
    """
    edges: dict[str, list[float]] = {c: [] for c in columns}
    probs = [i / bins for i in range(1, bins)]
    for r in exact_quantiles(df, columns, probs).orderBy("column", "prob").collect():
        if r["value"] is not None and r["value"] not in edges[r["column"]]:
            edges[r["column"]].append(r["value"])
    # Features x bins x classes rows, read three times.
    counts = settle(bin_counts(df, edges, target))
    by_bin = counts.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"), F.collect_list(F.struct("class", "n")).alias("_l"))
    by_class = counts.groupBy("feature", "class").agg(F.sum("n").alias("n_class"))
    total = counts.groupBy("feature").agg(F.sum("n").alias("n_all"))
    joined = by_bin.select("feature", "bin", "n_bin", F.explode("_l").alias("_x")).select("feature", "n_bin", "_x.*") \
        .join(by_class, ["feature", "class"]).join(total, "feature")
    n, nb, nc, na = (F.col(c).cast("double") for c in ("n", "n_bin", "n_class", "n_all"))
    return joined.groupBy("feature").agg(F.greatest(F.sum(n / na * F.ln(n * na / (nb * nc))), F.lit(0.0)).alias("score"))


def forest_importance(
    df: DataFrame, columns: list[str], target_index: str, trees: int = 120, depth: int = 16, seed: int = 42
) -> dict[str, float]:
    data = VectorAssembler(inputCols=columns, outputCol="_v").transform(df).select("_v", F.col(target_index).alias("_y"))
    model = RandomForestClassifier(
        featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(data)
    return {c: float(s) for c, s in zip(columns, model.featureImportances.toArray())}


def eliminate_features(
    df: DataFrame, columns: list[str], target_index: str, keep: int, step: float = 0.2,
    trees: int = 80, depth: int = 12, seed: int = 42,
) -> dict[str, float]:
    """Recursive elimination: drop the weakest fifth of the original columns each round; score 1/rank."""
    kept, rounds = list(columns), []
    drop_each = max(1, int(step * len(columns)))
    while len(kept) > keep:
        weight = forest_importance(df, kept, target_index, trees, depth, seed)
        out = sorted(kept, key=lambda c: (weight[c], c))[: min(drop_each, len(kept) - keep)]
        rounds.append(out)
        kept = [c for c in kept if c not in out]
    scores = {c: 1.0 for c in kept}
    for rank, out in enumerate(reversed(rounds), start=2):
        scores.update({c: 1.0 / rank for c in out})
    return scores


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best ``(feature, score)`` rows, ties by name."""
    check_positive(k, "top_k")
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def select_features(
    df: DataFrame, columns: list[str], target: str, method: str = "mutual_info", top_k: int = 30,
    threshold: float = 0.95, seed: int = 42, trees: int | None = None, depth: int | None = None,
) -> Selection:
    """Prune correlated columns, score the rest, keep the best ``top_k``.

    ``target`` is the class index column.
    """
    check_positive(top_k, "top_k")
    if method not in METHODS:
        raise FlowDataError(f"unknown selection method {method!r}; choose one of {', '.join(METHODS)}")
    need_columns(df, [*columns, target])
    left = drop_correlated(df, columns, threshold)
    if not left:
        raise FlowDataError("no numeric feature is left after pruning")
    k = min(top_k, len(left))
    size = {name: v for name, v in (("trees", trees), ("depth", depth)) if v is not None}
    if method == "mutual_info":
        scores = {r["feature"]: r["score"] for r in mutual_information(df, left, target).collect()}
    elif method == "correlation":
        scores = {r["feature"]: r["score"] for r in correlation_scores(df, left, target).collect()}
    elif method == "importance":
        scores = forest_importance(df, left, target, seed=seed, **size)
    else:
        scores = eliminate_features(df, left, target, k, seed=seed, **size)
    ranked = sorted(scores, key=lambda c: (-scores[c], c))
    return Selection(method, ranked[:k], scores)
