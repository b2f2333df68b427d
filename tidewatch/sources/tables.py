"""Reading and writing flow tables, selections and report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import FlowDataError
from tidewatch.functions.numbers import missing_to_null
from tidewatch.operators.quality import check_table, trim_names
from tidewatch.operators.select import Selection
from tidewatch.session import path_exists

SUFFIXES = (".csv", ".parquet")


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def read_flows(spark: SparkSession, path: str, target: str = "label", schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV or Parquet flow table with trimmed names and null as its only missing marker.

    Give a ``schema`` for large CSV files: inferring one reads them twice.
    """
    if _suffix(path) not in SUFFIXES:
        raise FlowDataError(f"unsupported file type {_suffix(path)!r}; expected one of {', '.join(SUFFIXES)}")
    if not path_exists(spark, path):
        raise FlowDataError(f"no such path: {path}")
    if _suffix(path) == ".parquet":
        df = spark.read.parquet(path)
    elif schema is not None:
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    return missing_to_null(check_table(trim_names(df), [target]))


def write_flows(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet for a ``.parquet`` path, CSV for any other."""
    if _suffix(path) == ".parquet":
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).csv(path, header=True)
    return path


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], target: str = "label") -> DataFrame:
    """Read the table at ``path``; build, write and read it back where there is none."""
    if not path_exists(spark, path):
        write_flows(build(), path)
    return read_flows(spark, path, target)


def write_selection(spark: SparkSession, selection: Selection, path: str) -> None:
    rows = [(selection.method, selection.selected, {k: float(v) for k, v in selection.scores.items()})]
    spark.createDataFrame(rows, _SELECTION).coalesce(1).write.mode("overwrite").json(path)


_SELECTION = "method string, selected array<string>, scores map<string,double>"


def read_selection(spark: SparkSession, path: str) -> Selection:
    """A written selection; absent keys take defaults."""
    if not path_exists(spark, path):
        raise FlowDataError(f"no such path: {path}")
    row = spark.read.schema(_SELECTION).json(path).select(
        F.coalesce("method", F.lit("unknown")), F.coalesce("selected", F.array().cast("array<string>")),
        F.coalesce("scores", F.create_map().cast("map<string,double>")),
    ).first()
    if row is None:
        raise FlowDataError(f"nothing to read in {path}")
    return Selection(row[0], list(row[1]), dict(row[2]))


def write_report(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> dict[str, str]:
    """Write each small report table below ``folder``; returns the paths."""
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder}/{name}"
        table.coalesce(1).write.mode("overwrite").format(fmt).save(paths[name])
    return paths
