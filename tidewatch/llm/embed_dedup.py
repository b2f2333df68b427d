"""Near copies among embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is rotated by three rounds of random signs and a Hadamard transform; its hash is the nearest of the
axes and their opposites. ``HASHES`` such hashes make a bucket of a table, and each vector also enters the
next likeliest buckets. Pairs that share a bucket are checked by their cosine in double precision.

A pair is counted in its first common bucket only, so no pair list is ever built: a bucket hands on, per
vector, how many links it counted and the smallest id it is tied to. Large buckets are cut into blocks, and
each pair of blocks is a task's work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, runs, written

COSINE = 0.95
#: Tables, hashes per bucket, buckets entered per table, vectors per block, seed.
TABLES, HASHES, PROBES, BLOCK, SEED = 8, 2, 3, 256, 42
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers of unit rows, shape (rows, tables * probes); a table's buckets are next to each other.

    A probe changes one of the hashes to its second nearest axis, the one that loses least first.
    """
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    flat = np.zeros((n, d))
    flat[:, :dim] = x
    signs = np.random.default_rng([seed, d]).choice([-1.0, 1.0], size=(tables, hashes, ROUNDS, d))
    rows, out = np.arange(n), []
    for t in range(tables):
        codes, losses = [], []
        for h in range(hashes):
            y = flat
            for r in range(ROUNDS):
                y = hadamard(y * signs[t, h, r])
            size = np.abs(y)
            two = np.argpartition(-size, 1, axis=1)[:, :2]
            two = np.take_along_axis(two, np.argsort(-np.take_along_axis(size, two, 1), axis=1, kind="stable"), 1)
            codes.append(two + d * (np.take_along_axis(y, two, 1) < 0))
            best = np.take_along_axis(size, two, 1)
            losses.append(best[:, 0] - best[:, 1])
        loss = np.stack(losses, 1)
        turned = np.argsort(loss, axis=1, kind="stable")
        for p in range(probes):
            number = np.full(n, t, np.int64)
            for h in range(hashes):
                # Probe 0 is home; probe p turns the hash with the p-th smallest loss.
                other = (turned[:, p - 1] == h).astype(int) if p else np.zeros(n, int)
                number = number * (2 * d) + codes[h][rows, other]
            out.append(number)
    return np.stack(out, 1)


def _norm(batch: pa.Array) -> np.ndarray:
    flat = np.asarray(batch.flatten().to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(batch), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within equal ``group`` (sorted): all of a block, or of one block against the other."""
    left, right = [], []
    shift = 1
    while shift < len(group):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            break
        a, b = same, same + shift
        cross = (side[a] == 2) | (side[a] != side[b])
        left.append(a[cross])
        right.append(b[cross])
        shift += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _counted(block: pa.Table, cosine: float, tables: int, probes: int) -> pa.RecordBatch | None:
    """Links and ties of whole (bucket, block, block) groups."""
    number = block["bucket"].to_numpy()
    group = np.cumsum(np.append(True, (number[1:] != number[:-1]) | (block["lo"].to_numpy()[1:] != block["lo"].to_numpy()[:-1]) | (block["hi"].to_numpy()[1:] != block["hi"].to_numpy()[:-1])))
    ids, weight, side = block["rep"].to_numpy(), block["w"].to_numpy(), block["side"].to_numpy()
    x = _norm(block["vec"].combine_chunks())
    own = np.asarray(block["buckets"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(ids), tables, probes)
    add, ties = np.zeros(len(ids), np.int64), []
    left, right = _pairs(group, side)
    for low in range(0, len(left), 1 << 17):
        a, b = left[low : low + (1 << 17)], right[low : low + (1 << 17)]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[near], b[near]
        here = number[a]
        first = np.full(len(a), np.iinfo(np.int64).max)
        for t in range(tables):
            for p in range(probes):
                common = (own[a, t, p][:, None] == own[b, t]).any(axis=1)
                np.minimum(first, np.where(common, own[a, t, p], first), out=first)
        a, b = a[first == here], b[first == here]
        np.add.at(add, a, weight[b])
        np.add.at(add, b, weight[a])
        ties.append(np.stack([a, b], 1))
    tie = np.concatenate(ties) if ties else np.empty((0, 2), np.int64)
    if not len(tie):
        return None
    root = ids.copy()
    while True:
        low = np.minimum(root[tie[:, 0]], root[tie[:, 1]])
        new = root.copy()
        np.minimum.at(new, tie[:, 0], low)
        np.minimum.at(new, tie[:, 1], low)
        if (new == root).all():
            break
        root = new
    used = np.flatnonzero(add)
    return pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(add[used]), pa.array(root[used])], ["rep", "add", "root"])


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE,
    tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """One row ``id``, ``n_links``, ``component``, ``kept`` per row of ``vectors``.

    Equal vectors are one class: they link to each other and share their links, so copies are not expanded.
    Vectors that are null, empty, zero or hold nulls or non-finite numbers, and rows without an id, link with
    nothing (``component`` is the own id). Vectors of different length never link. Repeated rows are vectors
    of their own. An empty table gives an empty one.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    usable = F.exists("vec", lambda v: (v != 0) & v.isNotNull()) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & usable, F.lit(False)))
    kind = "double" if "double" in dict(rows.dtypes)["vec"] else "float"
    rows = written(rows.withColumn("vec", F.when(F.col("ok"), F.col("vec").cast(f"array<{kind}>"))).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_json("vec"), 256))))
    classes = rows.where("ok").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("w"), F.first("vec").alias("vec"))
    # Classes are numbered, since rows of one id may hold different vectors.
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vec").value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for low in range(0, part.num_rows, 4096):
                    some = part.slice(low, 4096)
                    own = buckets(_norm(some.column("vec")), tables, hashes, probes, seed)
                    # The length is part of the bucket's number, above what tables and hashes use.
                    own = own + (np.int64(size) << np.int64(46))
                    lists = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([some.column("rep"), some.column("w"), some.column("vec"), lists], ["rep", "w", "vec", "buckets"])

    found = written(classes.select("rep", "w", "vec").mapInArrow(hashed, f"rep long, w long, vec array<{kind}>, buckets array<long>"))
    sizes = found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where("count > 1")
    members = found.select("rep", "w", "vec", "buckets", F.explode("buckets").alias("bucket")).join(sizes, "bucket")
    blocks = F.ceil(F.col("count") / block).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # ``side`` 2 marks a block met with itself: there all pairs count, else only pairs across.
    members = members.select(
        "rep", "w", "vec", "buckets", "bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["bucket", "lo", "hi"]):
            # The length is in the bucket's number, so parts of one length hold whole groups.
            sizes = pc.list_value_length(part["vec"])
            for size in pc.unique(sizes):
                counted = _counted(part.filter(pc.equal(sizes, size)), cosine, tables, probes)
                if counted is not None:
                    yield counted

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    linked = written(dealt.mapInArrow(work, "rep long, add long, root long"))
    links = linked.groupBy("rep").agg(F.sum("add").alias("add"))
    tied = components(linked.where("rep != root").select(F.col("rep").alias("u"), F.col("root").alias("v")).distinct())
    out = classes.select("key", "rep", "w", "least").join(links, "rep", "left").join(tied.withColumnRenamed("node", "rep"), "rep", "left")
    out = written(out.select("key", "least", F.coalesce("component", "rep").alias("class"), (F.col("w") - 1 + F.coalesce("add", F.lit(0))).alias("n_links")))
    smallest = out.groupBy("class").agg(F.min("least").alias("component"))
    named = out.join(smallest, "class").select("key", "n_links", "component")
    whole = rows.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component", "id")
    return whole.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
