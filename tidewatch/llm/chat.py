"""Chat formatting with cumulative-snapshot collapse; DataFrame functions only.

Chat logs often hold a conversation once per turn, each time a turn longer. A rolling hash of each
conversation's turns names every prefix. A conversation whose last prefix another one also has, and goes
on from, is a snapshot of it; of equal conversations the smallest id stays. Anti-joins take the snapshots
out and only the maximal conversations are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

#: Rendered turns per output row, so that one endless conversation is no single row.
TURNS_PER_PART = 1_000


def prefixes(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns in order with ``pos``, ``h1``, ``h2`` (hashes of all turns so far, each with its place) and ``is_last``.

    Two 64-bit hashes per turn and place are xored along the conversation, so the window only streams.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    again = F.row_number().over(order) > 1
    for name in ("turn", "role", "text"):
        again = again & F.lag(name).over(order).eqNullSafe(F.col(name))
    rows = rows.withColumn("again", again).where(~F.col("again")).drop("again")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long")).withColumn("is_last", F.lead(F.lit(1)).over(order).isNull())
    # A null role or text is told from an empty one by the flags.
    place = [F.col("pos"), F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.lit("\x1f"), F.col("text")]
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), *place)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows


def maximal(rows: DataFrame) -> DataFrame:
    """``conv``, ``n_turns`` of the conversations that are no prefix of a longer one and no repeat of a smaller id."""
    ends = rows.where("is_last").select("conv", F.col("pos").alias("n_turns"), "pos", "h1", "h2")
    seen = rows.groupBy("pos", "h1", "h2").agg(
        F.max(~F.col("is_last")).alias("goes_on"), F.min(F.when(F.col("is_last"), F.struct(F.col("conv").isNull().alias("no_id"), "conv"))).alias("first")
    )
    longer = seen.where("goes_on").select("pos", "h1", "h2")
    heads = seen.where("first is not null").select("first.conv")
    whole = ends.join(longer, ["pos", "h1", "h2"], "left_anti")
    return whole.join(heads, whole.conv.eqNullSafe(heads.conv), "left_semi").select("conv", "n_turns")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat markup; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", turns_per_part: int = TURNS_PER_PART
) -> DataFrame:
    """One row ``conv``, ``part``, ``n_turns``, ``text`` per maximal conversation and ``turns_per_part`` turns of it.

    Equal rows count once. Turns with one number are ordered by role and text, null turn numbers come first.
    Rows without a conversation id form one conversation, the last in the order of ids. Empty texts are
    turns. An empty table gives an empty one.
    """
    rows = written(prefixes(turns, conv_col, turn_col, role_col, text_col))
    best = maximal(rows)
    kept = rows.join(best.withColumnRenamed("conv", "_conv"), rows.conv.eqNullSafe(F.col("_conv")))
    parts = kept.groupBy("conv", F.floor((F.col("pos") - 1) / turns_per_part).cast("int").alias("part"), "n_turns").agg(
        F.array_sort(F.collect_list(F.struct("pos", render(F.col("role"), F.col("text")).alias("line")))).alias("lines")
    )
    return parts.select("conv", "part", "n_turns", F.concat_ws("", F.transform("lines", lambda x: x.line)).alias("text"))
