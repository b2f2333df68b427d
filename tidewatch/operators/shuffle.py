"""A seeded shuffle of a whole table: every row has an exact place, and written files follow the places.

Rows go by ``md5(seed:id)``. Counts of hash prefixes, at most 65,536 of them, give each prefix its place among
the rows and its output partition, so the rows travel once, to partitions that are fixed numbers (nothing is
sampled, so a lost task comes out the same again), and are sorted there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.errors import FlowDataError, check_positive, need_columns
from tidewatch.operators.sampling import row_hash

#: Rows an output partition is filled up to, at the next hash prefix.
ROWS_PER_PART = 1_000_000

_DIGITS = 4


def shuffled(df: DataFrame, id_column: str, seed: int = 42, name: str = "place", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``df`` with ``name``, each row's place from 0, in partitions that hold the places in order.

    The same rows and seed give the same places, however the rows lie. Rows that share an id stay together, by the
    hash of their columns (maps apart); rows without an id count as one id. Rows equal in all of that are interchangeable.
    """
    check_positive(rows_per_part, "rows_per_part")
    need_columns(df, [id_column])
    if taken := sorted({name, "_h", "_cell", "_part", "_first"} & set(df.columns)):
        raise FlowDataError(f"the table already has columns named {', '.join(taken)}")
    key = F.coalesce(row_hash(id_column, seed), F.md5(F.lit(f"{seed}")))
    cell = F.conv(F.substring(key, 1, _DIGITS), 16, 10).cast("int")
    counts = df.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per prefix: at most 16 ** _DIGITS, read once here so that the number of partitions is known.
    placed = starts.select("_cell", "_start", F.floor(F.col("_start") / rows_per_part).alias("_step")).orderBy("_cell").collect()
    table, part, step, first = [], -1, None, 0
    for row in placed:
        if row["_step"] != step:
            part, step, first = part + 1, row["_step"], row["_start"]
        table.append((row["_cell"], part, first))
    cells = F.broadcast(df.sparkSession.createDataFrame(table, "_cell int, _part int, _first bigint"))
    spread = (
        df.withColumn("_h", key).withColumn("_cell", cell).join(cells, "_cell").drop("_cell")
        .repartitionById(max(part + 1, 1), "_part")
    )
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    order = Window.partitionBy("_part").orderBy("_h", tie)
    return spread.withColumn(name, F.col("_first") + F.row_number().over(order) - 1).select(*df.columns, name)
