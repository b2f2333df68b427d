"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Each source's documents are hashed into blocks of about ``BLOCK_DOCS`` documents and a source's quota is a
number of blocks: whole passes over all of them and one pass over a part. A binary tree over the output
shards hands every node's quotas on: the left child draws half of the node's blocks, source by source, by
the hypergeometric law. Each shard then takes its own range of the source's permuted blocks, so ranges are
disjoint, and shuffles its rows. The remainder below a block is taken document by document from the block
that follows, each that still fits, so a source's taken words miss its target by less than the smallest
document left out there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import SPACE, written

#: Weights by rank of the source, repeating; no document is taken more often than MOST times.
WEIGHTS, MOST = (1, 2, 3), 3
#: Expected documents of a block, depth of the tree (2 ** LEVELS output shards), and seed.
BLOCK_DOCS, LEVELS, SEED = 256, 4, 42


def uniform(*parts: Column | str | int) -> Column:
    """A repeatable number in (0, 1) from a hash of ``parts``."""
    return (F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11).cast("double") + 0.5) / float(1 << 53)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null; the keys stay once. Names, not references, tell the sides apart: one may stem from the other."""
    for key in keys:
        right = right.withColumnRenamed(key, f"_right_{key}")
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(right, on, how).drop(*[f"_right_{key}" for key in keys])


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``source``, ``size`` and ``twin``, which tells equal ids apart by their order of hash."""
    size = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``): weighted shares of the total, at most MOST times a source's size, the excess reshared.

    Sources rank by code point, null last. With shares proportional to a level, sources fill up in the order
    of room per weight; the level is read off where what is left fits the weights that are left. The table
    has one row per source, so its one-task windows see no documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    room = MOST * F.col("source_size").cast("double")
    ranked = sources.withColumn("weight", weight).withColumn("room", room).withColumn("fill", F.col("room") / F.col("weight"))
    before = Window.orderBy("fill", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # Once one source does not fill up at its level none after it does, and the level stays.
    found = ranked.withColumn("level", level).withColumn("free", F.col("level") <= F.col("fill"))
    final = F.coalesce(F.min(F.when(F.col("free"), F.struct("fill", "level"))).over(whole).getField("level"), F.lit(0.0))
    open_at = F.coalesce(F.min(F.when(F.col("free"), F.col("fill"))).over(whole), F.lit(float("inf")))
    target = F.when(F.col("fill") < open_at, F.col("room")).otherwise(F.least("room", final * F.col("weight")))
    return found.select("source", "source_size", "n_docs", target.alias("target"))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` balls out of ``total`` are of the ``good`` ones, by inverting the law at ``u``.

    Steps outward from the mode over ten deviations each way, so the work grows with the root of the counts.
    """
    low, high = F.greatest(F.lit(0.0), drawn - (total - good)), F.least(drawn, good)
    p = good / F.greatest(total, F.lit(1.0))
    mode = F.least(F.greatest(F.floor((drawn + 1) * (good + 1) / (total + 2)).cast("double"), low), high)
    reach = F.ceil(10 * F.sqrt(F.greatest(drawn * p * (1 - p), F.lit(0.0))) + 10).cast("double")
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def ratio(k: Column) -> Column:
        """p(k + 1) / p(k)"""
        return (good - k) * (drawn - k) / ((k + 1) * (total - good - drawn + k + 1))

    def weights(ks: Column, step) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<struct<k:double,w:double>>").alias("all"))
        return F.aggregate(
            ks, start, lambda acc, k: F.struct((acc.w * step(k)).alias("w"), F.concat(acc["all"], F.array(F.struct(k.cast("double").alias("k"), (acc.w * step(k)).alias("w")))).alias("all")), lambda acc: acc["all"]
        )

    empty = F.array().cast("array<double>")
    up = F.when(last > mode, F.transform(F.sequence((mode + 1).cast("long"), last.cast("long")), lambda k: k.cast("double"))).otherwise(empty)
    down = F.when(first < mode, F.transform(F.sequence((mode - 1).cast("long"), first.cast("long"), F.lit(-1).cast("long")), lambda k: k.cast("double"))).otherwise(empty)
    own = F.array(F.struct(mode.alias("k"), F.lit(1.0).alias("w")))
    law = F.concat(F.reverse(weights(down, lambda k: 1 / ratio(k))), own, weights(up, lambda k: ratio(k - 1)))
    mass = F.aggregate(law, F.lit(0.0), lambda acc, x: acc + x.w)
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("k"))
    found = F.aggregate(law, state, lambda acc, x: F.struct((acc["sum"] + x.w).alias("sum"), F.when(acc.k.isNull() & (acc["sum"] + x.w >= u * mass), x.k).otherwise(acc.k).alias("k")), lambda acc: acc.k)
    return F.coalesce(found, mode)


def splitting_tree(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """Deals each source's ``blocks`` out to 2 ** levels shards: ``source``, ``shard``, ``n``, ``before`` (blocks of lower shards).

    One row per node and source. Within a node the sources follow one another: each draws from what the
    sources before it have left. That chain is a fold over the node's sources, a catalogue and no documents.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.struct(F.col("source").isNull().alias("last"), "source", F.col("blocks").cast("double").alias("n")).alias("x"))
    nodes = nodes.groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    for level in range(levels):
        total = F.aggregate("xs", F.lit(0.0), lambda acc, x: acc + x.n)

        def turn(acc: Column, x: Column) -> Column:
            u = uniform(seed, level, "node", F.coalesce(x.source, F.lit("")), x["last"].cast("int"))  # noqa: B023
            drawn = hypergeometric(acc.total, x.n, acc.draw, u)
            return F.struct((acc.total - x.n).alias("total"), (acc.draw - drawn).alias("draw"), F.concat(acc.out, F.array(drawn)).alias("out"))

        start = F.struct(total.alias("total"), F.floor((total + F.col("node") % 2) / 2).cast("double").alias("draw"), F.array().cast("array<double>").alias("out"))
        left = F.aggregate("xs", start, turn, lambda acc: acc.out)
        split = nodes.withColumn("left", left)
        side = lambda child: F.transform("xs", lambda x, i: F.struct(x["last"].alias("last"), x.source.alias("source"), (F.get("left", i) if child == 0 else x.n - F.get("left", i)).alias("n")))
        nodes = written(split.select(F.explode(F.array(*[F.struct((F.col("node") * 2 + c).alias("node"), side(c).alias("xs")) for c in (0, 1)])).alias("c")).select("c.node", "c.xs"))
    flat = nodes.select(F.col("node").alias("shard"), F.explode("xs").alias("x")).select("shard", "x.source", F.col("x.n").cast("long").alias("n"))
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return flat.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """One row ``id``, ``text_hash``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``shards`` (array, the shard of each copy) per row of ``docs``.

    A null text has size 0; a null source is a source of its own, last in order; repeated rows are
    documents of their own. Documents of size 0 add no words and come along with their block. If all sizes
    are 0 nothing is taken. An empty table gives an empty one.
    """
    sized = written(_sized(docs, id_col, text_col, source_col))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sources).select(
        "source", "source_size", "target",
        F.ceil(F.col("n_docs") / BLOCK_DOCS).alias("n_blocks"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
    ).withColumn("passes", F.floor(F.col("rate") + 1e-12).cast("long"))
    plan = written(plan.withColumn("part", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0))))
    # Blocks in permuted order and how far into them the part reaches.
    keyed = matched(sized, plan.select("source", "n_blocks"), ["source"])
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "text_hash"), F.col("n_blocks")))
    keyed = written(keyed.withColumn("order", F.xxhash64(F.lit(seed + 1), "id", "text_hash")))
    blocks = keyed.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    along = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "source", "block"), "block")
    blocks = blocks.withColumn("place", F.row_number().over(along) - 1).withColumn("till", F.sum("block_size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = matched(blocks, plan, ["source"])
    start = F.col("till") - F.col("block_size")
    blocks = written(
        blocks.withColumn("need", F.greatest(F.lit(0.0), F.least(F.col("block_size").cast("double"), F.col("part") - start))).select(
            "source", "block", "place", "block_size", "need", "source_size", "target", "passes", (F.col("need") > 0).alias("partly")
        )
    )
    quotas = blocks.groupBy("source").agg((F.count(F.lit(1)) * F.max("passes") + F.count_if("partly")).alias("blocks"))
    tree = splitting_tree(quotas, levels, seed)
    # Draw k of a block (passes over all blocks, then the part) has a place in its source's sequence; the shard holds a range of them.
    many = Window.partitionBy("source")
    draws = blocks.withColumn("in_source", F.count(F.lit(1)).over(many)).select(
        "source", "block", F.posexplode(F.filter(F.array(*[F.when(F.lit(k) < F.col("passes") + F.col("partly").cast("int"), k * F.col("in_source") + F.col("place")) for k in range(MOST)]), lambda at: at.isNotNull())).alias("draw", "at")
    )
    draws = matched(draws, tree, ["source"]).where("at >= before and at < before + n")
    shards = draws.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("draw", "shard"))).alias("shards"))
    blocks = matched(blocks, shards, ["source", "block"], "left")
    # In the block that the part ends in, the smaller side (taken or left out) is filled in permuted order by every document that still fits.
    blocks = blocks.withColumn("leave", F.col("need") > F.col("block_size") / 2)
    room = F.when(F.col("leave"), F.col("block_size") - F.col("need")).otherwise(F.col("need"))
    edge = blocks.where("partly and need < block_size").select("source", "block", room.alias("need"))
    inside = matched(keyed, edge, ["source", "block"])
    inside = inside.groupBy("source", "block", "order").agg(F.sum("size").alias("size"), F.first("need").alias("need"))
    inside = inside.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("order", "size"))).alias("xs"), F.first("need").alias("need"))
    begin = F.struct(F.col("need").alias("room"), F.array().cast("array<bigint>").alias("out"))

    def fill(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc.room
        return F.struct((acc.room - F.when(fits, x["size"]).otherwise(0)).alias("room"), F.when(fits, F.concat(acc.out, F.array(x.order))).otherwise(acc.out).alias("out"))

    chosen = inside.select("source", "block", F.aggregate("xs", begin, fill, lambda acc: acc.out).alias("chosen"))
    blocks = matched(blocks, chosen, ["source", "block"], "left")
    rows = matched(keyed, blocks, ["source", "block"])
    extra = F.when(F.col("partly") & (F.col("chosen").isNull() | (F.array_contains("chosen", F.col("order")) != F.col("leave"))), 1).otherwise(0)
    copies = (F.col("passes") + extra).cast("int")
    return rows.withColumn("copies", F.when(F.col("target") > 0, copies).otherwise(0)).select(
        "id", "text_hash", "source", "size", "source_size", "target", "copies", F.transform(F.slice(F.coalesce("shards", F.array().cast(dict(blocks.dtypes)["shards"])), 1, F.col("copies")), lambda s: s.shard).alias("shards")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, levels: int = LEVELS) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, by shard and in hashed order within it."""
    taken = mixed(docs, id_col, text_col, source_col, seed, levels).where(F.size("shards") > 0)
    taken = taken.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("shards").alias("_shards")).dropDuplicates(["_id", "_hash"])
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_hash"))
    out = docs.join(taken.hint("merge"), same).select(*[docs[c] for c in docs.columns], F.posexplode("_shards").alias("_copy", "_shard"), "_hash")
    out = out.withColumn("_order", F.xxhash64(F.lit(seed + 3), "_hash", F.col(id_col), "_copy"))
    return out.repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order").select(*docs.columns)
