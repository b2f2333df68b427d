"""Exact interpolated quantiles of many columns at once, with or without groups.

Without groups the ranks are found by the leading bits of the values: tasks count the values of all columns by a prefix
that keeps their order, sums over the prefixes tell in which one a rank lies, and only values with such a prefix are
counted again by more bits, until it is known to be of one value. Values stay in their columns and only counts travel.

With groups mergeable sketches bracket each quantile, one aggregate counts what lies below each bracket, and only the
few values inside the brackets leave their rows, equal ones as one. Ranking those gives the exact order statistics.
There values travel in long form, a row per column and value.

Both plans have the same size for one column and for a thousand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError
from tidewatch.session import listed_side, settle, small_side

#: A sketch is off by one in so many ranks at most.
_ACCURACY = 10_000
#: How far a bracket reaches to both sides, as a share of the ranks: the first that spans three ranks, else everything.
_REACH = [2.0 / _ACCURACY, 100.0 / _ACCURACY]
#: The first prefix leaves so many bits out: sign, exponent and eight bits of the fraction stay, 256 cells to a factor of two.
_FIRST_SHIFT = 44
#: A cell of at most so many rows is counted by whole values next, another one by so many more bits.
_CELL_ROWS, _STEP_BITS = 1 << 20, 18
#: A task holds at most twice as many counts.
_HELD = 1 << 19
_MAGNITUDE = np.int64((1 << 63) - 1)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; one zero, and one NaN above all."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _MAGNITUDE)


def _value(code: int) -> float:
    bits = np.array([code], np.int64)
    return float((bits ^ ((bits >> 63) & _MAGNITUDE)).view(np.float64)[0])


def _cells(df: DataFrame, columns: list[str], shift: int, above: int = 0, tops: dict[int, np.ndarray] | None = None) -> DataFrame:
    """``(_c, _cell, _n, _least, _most)``: values by column and leading bits, and the bounds of a cell as whole numbers; with ``tops``
    only values whose bits over ``above`` are listed for their column."""
    names = ["_c", "_cell", "_n", "_least", "_most"]

    def merged(cells: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
        """Cells in order, equal ones as one."""
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[at], np.add.reduceat(n, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in columns]
        size = 0

        def merge() -> int:
            for c, parts in enumerate(held):
                if len(parts) > 1:
                    every = [np.concatenate(side) for side in zip(*parts)]
                    order = np.argsort(every[0], kind="stable")
                    held[c] = [merged(*(side[order] for side in every))]
            return sum(len(part[0]) for parts in held for part in parts)

        def rows() -> pa.RecordBatch:
            found = [(np.full(len(part[0]), c, np.int32), *part) for c, parts in enumerate(held) for part in parts]
            found = found or [(np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 4)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], names)

        for batch in batches:
            for c in range(len(columns)) if tops is None else tops:
                codes = _ordered(batch.column(c).drop_null().to_numpy(zero_copy_only=False))
                if tops is not None:
                    codes = codes[np.isin(codes >> above, tops[c])]
                if len(codes):
                    codes.sort()
                    held[c].append(merged(codes >> shift, np.ones(len(codes), np.int64), codes, codes))
                    size += len(held[c][-1][0])
            if size > 2 * _HELD and (size := merge()) > _HELD:
                yield rows()
                held, size = [[] for _ in columns], 0
        merge()
        yield rows()

    values = df.select(*[F.col(name).cast("double").alias(f"_{c}") for c, name in enumerate(columns)])
    counts = values.mapInArrow(work, "_c int, _cell long, _n long, _least long, _most long")
    return settle(counts.groupBy("_c", "_cell").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most")))


def _plain_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    spark, shift, above = df.sparkSession, _FIRST_SHIFT, 0
    cells = _cells(df, columns, shift)
    total = {r["_c"]: r["_n"] for r in cells.groupBy("_c").agg(F.sum("_n").alias("_n")).collect()}
    places = {(c, p): p * (n - 1) for c, n in total.items() for p in map(float, probs)}
    # Rank of a column -> the prefix it lies under and its rank there, until the prefix is of one value.
    under = {(c, rank): (0, rank) for (c, _), place in places.items() for rank in (math.floor(place), math.ceil(place))}
    values: dict[tuple[int, int], float] = {}
    while under:
        top = F.shiftright("_cell", above - shift) if above else F.lit(0).cast("bigint")
        wanted = listed_side(spark, [(c, rank, *at) for (c, rank), at in under.items()], "_c int, _rank bigint, _top bigint, _inner bigint")
        upto = F.sum("_n").over(Window.partitionBy("_c", "_top").orderBy("_cell"))
        found = cells.withColumn("_top", top).withColumn("_upto", upto).join(wanted, ["_c", "_top"]).filter(
            (F.col("_upto") > F.col("_inner")) & (F.col("_upto") - F.col("_n") <= F.col("_inner"))
        ).select("_c", "_rank", "_cell", (F.col("_inner") - F.col("_upto") + F.col("_n")).alias("_inner"), "_n", "_least", "_most").collect()
        values |= {(r["_c"], r["_rank"]): _value(r["_least"]) for r in found if r["_least"] == r["_most"]}
        found = [r for r in found if r["_least"] != r["_most"]]
        under = {(r["_c"], r["_rank"]): (r["_cell"], r["_inner"]) for r in found}
        if under:
            tops = {c: np.unique([cell for (own, _), (cell, _) in under.items() if own == c]) for c in {c for c, _ in under}}
            above, shift = shift, (0 if max(r["_n"] for r in found) <= _CELL_ROWS else max(0, shift - _STEP_BITS))
            cells = _cells(df, columns, shift, above, tops)

    def quantile(c: int, p: float) -> float | None:
        if c not in total:
            return None
        place = places[c, p]
        low, high = (values[c, rank] for rank in (math.floor(place), math.ceil(place)))
        share = place - math.floor(place)
        return low if low == high else (1.0 - share) * low + share * high

    rows = [(name, p, quantile(c, p)) for c, name in enumerate(columns) for p in map(float, probs)]
    return spark.createDataFrame(rows, "column string, prob double, value double")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Rows ``(*by, column, prob, value)``; a column without values gives null. Rows with a null group are left out."""
    if not columns or not probs:
        raise FlowDataError("quantiles need columns and probabilities")
    if not by:
        return _plain_quantiles(df, columns, probs)
    for key in by:
        df = df.filter(F.col(key).isNotNull())
    long = df.select(*[F.col(key).alias(f"_by{i}") for i, key in enumerate(by)], F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("_c", "_v"))
    group = [f"_by{i}" for i in range(len(by))] + ["_c"]
    size = len(probs)
    edges = [min(1.0, max(0.0, p + side * reach)) for side in (-1, 1) for reach in _REACH for p in probs]
    sketch = long.groupBy(*group).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), _ACCURACY).alias("_e"))

    def edge(k, side: int, endless: float):
        near, far = (F.element_at("_e", k + 1 + (2 * side + step) * size) for step in (0, 1))
        return F.when(F.col("_n") >= 3 / _REACH[0], near).when(F.col("_n") >= 3 / _REACH[1], far).otherwise(F.lit(endless))

    # NaN is greater than all others.
    cells = settle(sketch.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select(
        *group, "_n", "_k", edge(F.col("_k"), 0, float("-inf")).alias("_low"), edge(F.col("_k"), 1, float("nan")).alias("_high")
    ))
    ranges = cells.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_k", "_low", "_high"))).alias("_ranges"))
    met = long.filter(F.col("_v").isNotNull()).join(small_side(ranges), group).select(*group, "_v", F.explode("_ranges").alias("_r"))
    # What is below a bracket becomes one row per cell, what is above it none.
    inside = met.filter(F.col("_v") <= F.col("_r._high")).groupBy(
        *group, F.col("_r._k").alias("_k"), F.when(F.col("_v") >= F.col("_r._low"), F.col("_v")).alias("_v")
    ).agg(F.count(F.lit(1)).alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*group, "_k").orderBy(F.col("_v").asc_nulls_first()))
    placed = inside.withColumn("_last", upto).withColumn("_first", F.col("_last") - F.col("_m")).filter(F.col("_v").isNotNull())
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k") + 1) * (F.col("_n") - 1)
    joined = placed.join(cells.select(*group, "_k", "_n"), [*group, "_k"]).withColumn("_at", place)
    at_rank = lambda rank: F.max(F.when((F.col("_first") <= rank) & (F.col("_last") > rank), F.col("_v")))
    found = joined.groupBy(*group, "_k").agg(at_rank(F.floor("_at")).alias("_a"), at_rank(F.ceil("_at")).alias("_b"))
    base = cells.select(*group, "_n", "_k")
    share = place - F.floor(place)
    value = F.when(F.col("_n") == 0, F.lit(None)).when(
        F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket"))
    ).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.lit(1.0) - share) * F.col("_a") + share * F.col("_b"))
    return base.join(found, [*group, "_k"], "left").select(
        *[F.col(f"_by{i}").alias(key) for i, key in enumerate(by)],
        F.element_at(F.array(*map(F.lit, columns)), F.col("_c") + 1).alias("column"),
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_k") + 1).alias("prob"), value.alias("value"),
    )


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median per column; 0.0 where a column has no value."""
    found = {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}
    return {c: float(found[c]) if found.get(c) is not None else 0.0 for c in columns}
