"""Ordered operators that hold for any key distribution.

A window over one huge group would put that group into one task. Here rows are range-partitioned on
the full order (which ends in a unique column, so no single value can fill a partition), settled
once, and each partition's position or running sum is shifted by the total of those before it. The
shift table has one row per partition (and group met in it), never one per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle, small_side

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def ordered_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range order, with its settled partition number and place in that partition.

    The rows are read twice, once to sample the ranges and once to spread them, so what may be an
    expensive plan is settled first.
    """
    numbered = (
        settle(df).repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return settle(
        numbered.withColumn("_part", F.shiftright("_id", _POSITION_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_id")
    )


def row_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """Number all rows 0.. in ``order`` (a unique order)."""
    parts = ordered_parts(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parts.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    # One row per partition of the settled table: bounded by the partition count.
    return (
        parts.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums within ``group``, in ``order`` (unique within the group)."""
    staged = df.withColumns({f"_in_{name}": value for name, value in sums.items()})
    parts = ordered_parts(staged, [*group, *order])
    within = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy(*group, "_part").agg(
        *[F.sum(f"_in_{name}").alias(f"_total_{name}") for name in sums]
    ).select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_total_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    local = parts.withColumns({f"_sum_{name}": F.sum(f"_in_{name}").over(within) for name in sums})
    keys = [*group, "_part"]
    right = small_side(shifts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                     *[f"_before_{name}" for name in sums]))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & local[k].eqNullSafe(right[f"_k{i}"])
    return local.join(right, match).select(
        *df.columns, *[(F.col(f"_sum_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums]
    )


def rolling_rows(df: DataFrame, order: list[str], size: int, aggregates: dict, block: int = 100_000) -> DataFrame:
    """Aggregates over the last ``size`` rows up to each row, in a unique ``order``.

    Rows are cut into equal blocks by position; each block borrows the last ``size - 1`` rows of the
    one before, so all windows are of bounded, even size. ``aggregates`` maps a name to a function
    from a window to a column.
    """
    block = max(block, size)
    indexed = row_index(df, order, "_row")
    own = F.floor(F.col("_row") / block).cast("bigint")
    lends = F.col("_row") % block >= block - (size - 1)
    copies = indexed.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(lends, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    frame = Window.partitionBy("_block").orderBy("_row").rowsBetween(-(size - 1), 0)
    return (
        copies.withColumns({name: make(frame) for name, make in aggregates.items()})
        .filter(F.col("_block") == F.col("_own"))
        .drop("_row", "_own", "_block")
    )
