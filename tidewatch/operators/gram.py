"""Sums over all pairs of columns, each pair over the rows where both are known, in one read of the table.

A task turns every Arrow batch into a matrix of values and a matrix of what is known; products of the two
give all pairwise sums at once. A task hands on one row per pair, however many rows it read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import listed_side

#: Rows looked at for a value near each column's mean; any value gives the same sums up to rounding.
ORIGIN_ROWS = 1_000

_SUMS = ("n", "x", "y", "xx", "yy", "xy")
_LOWS, _HIGHS = ("x_low", "y_low"), ("x_high", "y_high")
_MOMENTS = ", ".join(f"{name} double" for name in (*_SUMS, *_LOWS, *_HIGHS))


def _origins(df: DataFrame, columns: list[str]) -> list[float]:
    """A value of each column, from its first rows; 0 where they hold none. Sums of differences from it keep their digits."""
    known = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in columns]
    row = df.limit(ORIGIN_ROWS).agg(*[F.first(v, ignorenulls=True).alias(f"o{i}") for i, v in enumerate(known)]).first()
    return [row[i] if row[i] is not None else 0.0 for i in range(len(columns))]


def _task(origins: list[float]):
    """The function that turns a task's batches into one row per pair of columns."""
    p = len(origins)
    left, right = (np.array(side, dtype=np.int32) for side in zip(*combinations(range(p), 2)))

    def moments(batches):
        # [i, j] holds the measure of column i over the rows where i and j are known; sums[3] the products.
        sums = np.zeros((4, p, p))
        low, high = np.full((p, p), np.inf), np.full((p, p), -np.inf)
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - origins
            known = np.isfinite(values)
            there = known.astype(float)
            held = np.where(known, values, 0.0)
            sums += (there.T @ there, held.T @ there, (held * held).T @ there, held.T @ held)
            values[~known] = np.nan
            for j in range(p):
                rows = values if known[:, j].all() else values[known[:, j]]
                low[:, j] = np.minimum(low[:, j], np.fmin.reduce(rows, axis=0, initial=np.inf))
                high[:, j] = np.maximum(high[:, j], np.fmax.reduce(rows, axis=0, initial=-np.inf))
        ij, ji = (left, right), (right, left)
        found = (sums[0][ij], sums[1][ij], sums[1][ji], sums[2][ij], sums[2][ji], sums[3][ij], low[ij], low[ji], high[ij], high[ji])
        yield pa.RecordBatch.from_arrays(
            [pa.array(left), pa.array(right), *map(pa.array, found)], names=["i", "j", *_SUMS, *_LOWS, *_HIGHS])

    return moments


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy, x_low, y_low, x_high, y_high)`` for i < j, over rows where both are known.

    Sums and bounds are of differences from a fixed value per column. Nulls, NaN and infinities are unknown. A task
    keeps six numbers per pair of columns: the work grows with rows, the memory only with columns squared.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    parts = doubles.mapInArrow(_task(_origins(doubles, doubles.columns)), f"i int, j int, {_MOMENTS}")
    return parts.groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in _LOWS], *[F.max(c).alias(c) for c in _HIGHS])


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, column_i, column_j, n, r)`` for i < j; null r where a side does not vary over the rows where both are known."""
    spark = df.sparkSession
    pairs = [(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)]
    schema = "i int, j int, column_i string, column_j string"
    if not pairs:
        return spark.createDataFrame([], f"{schema}, n bigint, r double")
    spread = lambda square, total: F.col(square) - F.col(total) * F.col(total) / F.col("n")
    shared = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    r = F.try_divide(shared, F.sqrt(spread("xx", "x")) * F.sqrt(spread("yy", "y")))
    varies = (F.col("x_low") < F.col("x_high")) & (F.col("y_low") < F.col("y_high"))
    moments = pair_moments(df, columns).select(
        "i", "j", F.col("n").cast("bigint").alias("n"),
        F.when(varies & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    return listed_side(spark, pairs, schema).join(moments, ["i", "j"], "left").select(
        "i", "j", "column_i", "column_j", F.coalesce("n", F.lit(0)).alias("n"), "r")
