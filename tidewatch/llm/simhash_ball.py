"""Near copies by SimHash, found by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius. Two fingerprints within the radius have a
variant in common, and every two that meet on a variant are within it, so a variant's members need only
be tied to the smallest of them. A variant is shared by at most 65 fingerprints (radius 2), so no key
is hot once equal fingerprints are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import components, one_each, written

WORDS_PER_SHINGLE = 3
RADIUS = 2
SEED = 42


def fingerprint(raw: bytes | None, shingle: int = WORDS_PER_SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed long, of UTF-8 text: A-Z lowered, words between ASCII white space."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (starts[len(words) - n + 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for low in range(0, n, 65_536):
        hashes = [xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(first[low : low + 65_536], last[low : low + 65_536])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS_PER_SHINGLE) -> DataFrame:
    """One row ``id``, ``fp`` (long) per row of ``docs``. Null and empty texts have fingerprint zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(work, "id long, fp long")


def ball_edges(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u``, ``v`` that tie together all distinct ``fp`` at most ``radius`` (even) bits apart."""
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # A fixed number of partitions: each grows by the number of variants, which adaptive merging does not foresee.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    variants = prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])).alias("variant"))
    met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant"))).where("fp != least")
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius).select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row ``id``, ``fp``, ``component`` per row of ``docs``: the smallest id reachable over fingerprints at most ``radius`` bits apart.

    Repeated rows share a fingerprint and so a component; a null id takes part but is never the smallest,
    and a component without any id is null. An empty table gives an empty one.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    linked = written(components(ball_edges(classes.select("fp"), radius)))
    in_links = classes.join(linked, F.col("fp") == F.col("node"), "left")
    smallest = in_links.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = in_links.select("fp", "rep", "component").join(smallest, "component", "left").select("fp", F.coalesce("least", "rep").alias("component"))
    return prints.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id and, within it, text hash. Rows whose id is null are all kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], ["id", "hash", "node"])

    texts = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"), F.xxhash64(F.col(text_col).cast("string")).alias("hash")
    )
    classes = written(texts.mapInArrow(work, "id long, hash long, node long").groupBy("node").agg(F.min(F.struct("id", "hash")).alias("rep")))
    return one_each(docs, classes, ball_edges(classes.select(F.col("node").alias("fp")), radius), id_col, text_col)
