"""Helpers of the training-data operators: words, written tables, sorted group streams, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_folder

#: ASCII white space; everything between is a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def written(df: DataFrame) -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read again.

    Cuts the lineage, so that a lost executor costs a read and not the work before it, and lets several
    later steps share the rows. Unlike ``checkpoint()`` the plan runs once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def forget(df: DataFrame) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``u``, ``v`` long): one row ``node``, ``component`` per node that has an edge.

    Large-star and small-star turns until the edges stand still: each turn hangs neighbours below the
    smallest one they know. Minima are aggregated before the shuffle and the joins are plain inner joins
    that adaptive execution splits, so a hub with a third of all edges is no single task. Loops and
    nulls are ignored; an empty table gives an empty one.
    """
    now = written(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        after = written(small.distinct())
        before, now = now, after
        forget(before)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def one_each(docs: DataFrame, classes: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row for each connected component of ``classes``: ``node``, ``rep`` (its smallest ``id`` and ``hash`` of a text); ``edges`` tie nodes.

    The row is that of the smallest id and text hash, so unlike texts that share an id are not taken for one; of rows
    with one id and text one stays, whatever the order of tasks. Rows whose id is null are all kept.
    """
    linked = components(edges)
    found = classes.join(linked, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("rep").alias("rep"))
    found = found.select(F.col("rep.id").alias("_rep_id"), F.col("rep.hash").alias("_rep_hash"))
    own = F.xxhash64(docs[text_col].cast("string"))
    kept = docs.join(found.hint("merge"), (docs[id_col].cast("long") == F.col("_rep_id")) & (own == F.col("_rep_hash")))
    order = Window.partitionBy("_rep_id", "_rep_hash").orderBy(F.xxhash64(*[docs[c] for c in docs.columns if c != text_col]))
    kept = kept.withColumn("_rep_place", F.row_number().over(order)).where("_rep_place = 1").select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by ``keys`` (long columns without nulls): tables of one or more complete groups.

    A group may span batches; only the last, still open one is carried over.
    """
    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([batch])
        cols = [part[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if rest and any(rest[-1][k][-1].as_py() != part[k][0].as_py() for k in keys):
            yield pa.concat_tables(rest).combine_chunks()
            rest = []
        if len(cut):
            yield pa.concat_tables([*rest, part.slice(0, int(cut[-1]))]).combine_chunks()
            rest = [part.slice(int(cut[-1]))]
        else:
            rest.append(part)
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


#: Bits of a page of a ``bit_filter``.
PAGE_BITS = 15


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2 ** bits bits for the column ``h`` (long): the top bits of a hash name its bit.

    Its size is fixed whatever the number of rows: with many it lets more pass by chance, never less. Pages of
    it are put together by the executors, so the driver receives the bits and not the rows.
    """

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for page in np.unique(cells >> PAGE_BITS).tolist():
                own = held.setdefault(page, np.zeros(1 << PAGE_BITS, bool))
                own[cells[cells >> PAGE_BITS == page] & ((1 << PAGE_BITS) - 1)] = True
        for page, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["page", "own"])

    cells = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("cell")).distinct()
    found = cells.repartition(F.shiftright("cell", PAGE_BITS)).sortWithinPartitions("cell").mapInArrow(pages, "page long, own binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for page, own in found:
        out[page << (PAGE_BITS - 3) : (page + 1) << (PAGE_BITS - 3)] = np.frombuffer(own, np.uint8)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which unsigned 64-bit ``hashes`` pass a ``bit_filter``."""
    cells = hashes >> np.uint64(64 - bits)
    return (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cells & np.uint64(7)).astype(np.uint8))) & 1 == 1
