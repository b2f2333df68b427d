"""Score curves of many classes from a histogram of score cells, not from a total order of rows x classes.

A mergeable sketch per class cuts the scores where their weight is even, and every stretch is cut again into equal
widths, so that cells stay small as the table grows. One aggregate counts positives and negatives per cell; sums over
cells replace the order of rows. Inside a cell that holds positives only, or negatives only, no order matters: only rows
of *mixed* cells travel again, equal scores as one row, and are ordered cell by cell.

Rows without a truth take no part. A null score is below every number, NaN above.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

#: Shares of even weight per class (one cut more; a power of two less one, for the halving), and the least number of equal
#: widths between two cuts.
CUTS, LEAST_WIDTHS = 254, 16
#: Rows that a cell holds on average at most.
CELL_ROWS = 1_000_000
#: The sketch is off by one in so many ranks at most.
_ACCURACY = 10_000
#: A list of cells (three integers each) is broadcast up to this length.
_LISTED_CELLS = 1 << 18

KEYS = ["_c", "_cell", "_width"]


@dataclass
class ScoreCells:
    """``counts``: a settled row per cell with ``_pos, _neg, _least`` (score), ``_pos_below, _neg_below`` (cells under it) and
    the class's ``_all_pos, _all_neg``. ``entries``: a row ``(_c, _cell, _width, _score, _hit)`` per row and class."""

    names: list[str]
    counts: DataFrame
    entries: DataFrame

    def name(self) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in self.names]), F.col("_c") + 1).alias("class")

    def groups(self, mixed_only: bool) -> DataFrame:
        """``(*KEYS, _score, _pos, _neg)`` per distinct score, of all cells or of those with both sides."""
        mixed = self.counts.filter((F.col("_pos") > 0) & (F.col("_neg") > 0)).select(*KEYS)
        listed = mixed_only and mixed.count() <= _LISTED_CELLS
        entries = self.entries.join(F.broadcast(mixed), KEYS, "left_semi") if listed else self.entries
        groups = entries.groupBy(*KEYS, "_score").agg(
            F.count_if("_hit").alias("_pos"), F.count_if(~F.col("_hit")).alias("_neg")
        )
        # A list too long to send meets rows whose equal scores are already one.
        return groups.join(mixed, KEYS, "left_semi") if mixed_only and not listed else groups


def score_cells(df: DataFrame, truth: str, scores: dict[str, Column], cell_rows: int = CELL_ROWS) -> ScoreCells:
    names = list(scores)
    which = F.coalesce(*[F.when(F.col(truth) == name, F.lit(i)) for i, name in enumerate(names)], F.lit(-1))
    # Adding zero makes one zero of two. Scores may be costly and are read three times, so they are written once, narrow.
    narrow = settle(df.filter(F.col(truth).isNotNull()).select(
        which.alias("_truth"), F.array(*[value.cast("double") + F.lit(0.0) for value in scores.values()]).alias("_scores")
    ))
    long = narrow.select("_truth", F.posexplode("_scores").alias("_c", "_score")).select(
        "_c", "_score", (F.col("_truth") == F.col("_c")).alias("_hit")
    )
    number = F.when(~F.isnan("_score"), F.col("_score"))
    sketch = {r["_c"]: r for r in long.groupBy("_c").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx(number, F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), _ACCURACY).alias("cuts"),
    ).collect()}  # one row per class
    cuts = [sorted(set(sketch[c]["cuts"] or [])) if c in sketch else [] for c in range(len(names))]
    widths = [max(LEAST_WIDTHS, -(-sketch[c]["n"] // (CUTS * cell_rows))) if c in sketch else 1 for c in range(len(names))]
    entries = _placed(long, cuts, widths)
    counts = entries.groupBy(*KEYS).agg(
        F.count_if("_hit").alias("_pos"), F.count_if(~F.col("_hit")).alias("_neg"), F.min("_score").alias("_least")
    )
    # A row per cell: 4,064 per class up to four thousand million rows, then one per million rows.
    every = Window.partitionBy("_c")
    below = every.orderBy("_cell", "_width").rowsBetween(Window.unboundedPreceding, -1)
    return ScoreCells(names, settle(counts.select(
        "*",
        *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in ("_pos", "_neg")],
        *[F.sum(c).over(every).alias(f"_all{c}") for c in ("_pos", "_neg")],
    )), entries)


def _placed(entries: DataFrame, cuts: list[list[float]], widths: list[int]) -> DataFrame:
    """Add ``_cell``, how many cuts of its class a score has reached (-1 for null), and ``_width``, which of the equal widths
    between two cuts it lies in; each step of that keeps the order of scores.

    The search by halving is one fold; written as a chain of projections the queries took three times as long.
    """
    most = CUTS + 1
    filled = np.full((len(cuts), most), np.nan)  # NaN is above every number
    for c, own in enumerate(cuts):
        filled[c, :len(own)] = own
    table = F.lit(filled.ravel())  # one literal, however many cuts
    cut = lambda i: F.get(table, F.col("_c") * most + i)
    steps = F.lit(np.array([1 << k for k in reversed(range(most.bit_length()))], dtype="int32"))
    entries = entries.withColumn("_cell", F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(cut(at + step - 1) <= F.col("_score"), at + step).otherwise(at)
    ))
    low, high = cut(F.col("_cell") - 1), cut(F.col("_cell"))
    parts = F.get(F.lit(np.array(widths, dtype="int32")), F.col("_c"))
    share = (F.col("_score") - low) / (high - low)
    inner = F.col("_cell").between(1, CUTS) & ((high - low) < F.lit(float("inf")))
    width = F.when(inner, F.least(F.floor(share * parts).cast("int"), parts - 1)).otherwise(F.lit(0))
    return entries.select(
        "_c", F.when(F.col("_score").isNull(), F.lit(-1)).otherwise(F.col("_cell")).alias("_cell"), width.alias("_width"), "_score", "_hit"
    )


def auc_table(cells: ScoreCells) -> DataFrame:
    """``(class, auc)`` one against the rest; tied scores count half; null where a side is empty."""
    within = Window.partitionBy(*KEYS).orderBy("_score").rowsBetween(Window.unboundedPreceding, 0)
    wins = F.col("_pos").cast("double") * (F.col("_upto") - F.col("_neg") / 2.0)
    inside = cells.groups(mixed_only=True).withColumn("_upto", F.sum("_neg").over(within)).select(
        "_c", wins.alias("_wins"), F.lit(0).cast("bigint").alias("_pos"), F.lit(0).cast("bigint").alias("_neg")
    )
    across = cells.counts.select("_c", (F.col("_pos").cast("double") * F.col("_neg_below")).alias("_wins"), "_pos", "_neg")
    return across.unionByName(inside).groupBy("_c").agg(
        F.try_divide(F.sum("_wins"), F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("auc")
    ).select(cells.name(), "auc")


def roc_table(cells: ScoreCells, corners: bool = False) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` by falling threshold, from (0, 0); classes without positives are left out.

    A point per distinct score, or with ``corners`` only those where the curve turns, which draw the same curve: pure cells
    are straight, so they are one step and their rows never travel.
    """
    groups = cells.groups(mixed_only=corners)
    if corners:
        pure = cells.counts.filter((F.col("_pos") == 0) | (F.col("_neg") == 0))
        groups = settle(groups.unionByName(pure.select(*KEYS, F.col("_least").alias("_score"), "_pos", "_neg")))
    sums = [*KEYS, "_pos_below", "_neg_below", "_all_pos", "_all_neg"]
    frame = Window.partitionBy(*KEYS).orderBy(F.desc("_score"))
    above = frame.rowsBetween(Window.unboundedPreceding, -1)
    counts = cells.counts.withColumnsRenamed({"_pos": "_cell_pos", "_neg": "_cell_neg"})
    if corners:
        # The step after a cell's last one is the first of the next cell down.
        first = groups.groupBy(*KEYS).agg(F.max(F.struct("_score", "_pos", "_neg")).alias("_first"))
        down = Window.partitionBy("_c").orderBy(F.desc("_cell"), F.desc("_width"))
        counts = counts.join(first, KEYS).withColumn("_next_cell", F.lead("_first").over(down))
        sums = [*sums, "_next_cell"]
    counts = counts.filter("_all_pos > 0").select(*sums, "_cell_pos", "_cell_neg")
    placed = groups.select(
        "*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_pos", "_neg")],
        *([F.lead(F.struct("_score", "_pos", "_neg")).over(frame).alias("_next")] if corners else []),
    ).join(F.broadcast(counts) if counts.count() <= _LISTED_CELLS else counts, KEYS)
    if corners:
        after = F.coalesce("_next", "_next_cell")
        wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  a product of two counts may pass 64 bits
        straight = wide(F.col("_pos")) * wide(after["_neg"]) == wide(F.col("_neg")) * wide(after["_pos"])
        placed = placed.filter(after.isNull() | ~straight)

    def rate(side: str) -> Column:
        higher = F.col(f"_all{side}") - F.col(f"{side}_below") - F.col(f"_cell{side}")
        reached = (higher + F.col(f"{side}_above") + F.col(side)).cast("double")
        return F.coalesce(F.try_divide(reached, F.col(f"_all{side}").cast("double")), F.lit(0.0))

    points = placed.select(cells.name(), F.col("_score").alias("threshold"), rate("_neg").alias("fpr"), rate("_pos").alias("tpr"))
    origin = cells.counts.filter("_all_pos > 0").select("_c").distinct().select(
        cells.name(), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)
