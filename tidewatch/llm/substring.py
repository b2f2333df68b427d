"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the word group of ``GRAM`` words in it with the
smallest rank; consecutive windows that share the minimiser travel as one packed string to the minimiser's
bucket, where sorting brings equal windows together and counts them exactly, text against text. A window
that another document with a smaller id also starts is marked, and its words are removed.

Windows can only be equal if their minimisers are, so minimisers are counted first and super-k-mers whose
minimiser is alone stay at home; a fixed-size filter says which.

The rank puts the few groups that are frequent in the corpus last, so that only windows made of nothing else
meet in a frequent group's bucket. Such windows are copies of each other and collapse before the shuffle.
Any rank gives the same result; it only decides who meets where.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bit_filter, forget, passes, runs, written

WINDOW, GRAM = 50, 6
#: Word groups with at least one in so many of all occurrences rank last: at most that many, whatever the corpus' size.
FREQUENT_ONE_IN = 1 << 16
#: Windows cut at a time from a long text (their places fit PLACE_BITS), packed strings put together before they are handed on.
WINDOWS_AT_ONCE, PLACE_BITS, STRINGS_AT_ONCE = 1 << 18, 20, 20_000
#: Bits of the filter of repeated minimisers.
MINIMISER_BITS = 25
MULTIPLIERS = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, 65)]


def group_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """A hash per group of ``gram`` consecutive words."""
    own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    n = len(words) - gram + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(gram):
        mixed += own[k : k + n] * MULTIPLIERS[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks to both sides."""
    n = len(values) - width + 1
    full = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def super_kmers(words: list[bytes], window: int, gram: int, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets, first windows, numbers of windows of the runs of windows with one minimiser. ``last``: sorted hashes that rank last.

    A key of rank and place gives minimum and place at once; equal ranks go to the first place, which is the
    same in equal windows.
    """
    n = len(words) - window + 1
    if n <= 0:
        return
    hashes = group_hashes(words, gram)
    rank = hashes >> np.uint64(1)
    if len(last):
        at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
        rank = rank | ((last[at] == hashes).astype(np.uint64) << np.uint64(63))
    rank = rank >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    inside = window - gram + 1
    for low in range(0, n, WINDOWS_AT_ONCE):
        part = rank[low : min(n, low + WINDOWS_AT_ONCE) + inside - 1]
        key = sliding_least(part | np.arange(len(part), dtype=np.uint64), inside)
        place = (key & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + low
        starts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        yield hashes[place[starts]], starts + low, np.diff(np.append(starts, len(place)))


def _frequent(texts: DataFrame, window: int, gram: int) -> np.ndarray:
    """Hashes of groups that make up one in FREQUENT_ONE_IN of all: a group that frequent in the corpus is so in some task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kept, counts = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
        parts: list[np.ndarray] = []
        held = 0

        def fold() -> None:
            nonlocal kept, counts, parts, held
            new, many = np.unique(np.concatenate(parts), return_counts=True)
            both, at = np.unique(np.concatenate([kept, new]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([counts, many]), len(both)).astype(np.int64)
            enough = sums >= max(2, total // (4 * FREQUENT_ONE_IN))
            kept, counts, parts, held = both[enough], sums[enough], [], 0

        for batch in batches:
            for value in batch.column(0):
                words = (value.as_py() or b"").split()
                if len(words) >= window:
                    for low in range(0, len(words) - gram + 1, WINDOWS_AT_ONCE):
                        parts.append(group_hashes(words[low : low + WINDOWS_AT_ONCE + gram - 1], gram))
                        total, held = total + len(parts[-1]), held + len(parts[-1])
                        if held >= 4 * WINDOWS_AT_ONCE:
                            fold()
        if parts:
            fold()
        most = counts >= total // (2 * FREQUENT_ONE_IN)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept[most].view(np.int64), 0)), pa.array(np.append(counts[most], 0)), pa.array([0] * int(most.sum()) + [total], pa.int64())], ["h", "n", "total"])

    found = written(texts.select("raw").mapInArrow(work, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = found.agg(F.sum("total")).first()[0] or 0
    often = found.where((F.col("n") * FREQUENT_ONE_IN >= total) & (F.col("n") > 1))
    found_often = np.sort(np.array([r.h for r in often.select("h").collect()], np.int64).view(np.uint64))
    forget(found)
    return found_often


#: What ``pack`` hands on: a string (first four) or a place (last four).
_PACKED = {
    "bucket": pa.int64(), "text": pa.binary(), "first": pa.int64(), "most": pa.int64(), "digest": pa.binary(), "id": pa.int64(), "hash": pa.int64(), "at": pa.int64(),
}


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def repeated_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``id``, ``hash`` and ``marks``: array of (first window, smallest id per window) where a window's words also start in a smaller id.

    ``texts`` has ``id``, ``raw`` and ``hash`` of ``raw``: places belong to a text, and rows that share an id may have several.
    """
    last = _frequent(texts, window, gram)

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for value in batch.column(1):
                for own, _, _ in super_kmers((value.as_py() or b"").split(), window, gram, last):
                    parts.append(own)
                    held += len(own)
            if held >= WINDOWS_AT_ONCE:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    twice = texts.mapInArrow(minimisers, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    shared = bit_filter(twice, MINIMISER_BITS)

    def pieces(words: list[bytes]) -> Iterator[tuple[int, bytes, int]]:
        """Bucket, packed string, first window of the super-k-mers that may hold a repeat."""
        flat, ends = b"", None
        for own, at, n in super_kmers(words, window, gram, last):
            found = np.flatnonzero(passes(shared, own, MINIMISER_BITS))
            if len(found):
                if ends is None:
                    flat = b" ".join(words)
                    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                begin = np.where(at[found] > 0, ends[at[found] - 1], 0).tolist()
                end = (ends[at[found] + n[found] + window - 2] - 1).tolist()
                for bucket, first, a, b in zip(own[found].view(np.int64).tolist(), at[found].tolist(), begin, end):
                    yield bucket, flat[a:b], first

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings for the buckets, equal ones of a task as one, and beside them where each stands in which text."""
        seen: dict[tuple[int, bytes], tuple[int, int]] = {}
        digests: list[bytes] = []
        ids: list[int] = []
        hashes: list[int] = []
        at: list[int] = []

        def out(columns: list, names: list[str]) -> pa.RecordBatch:
            own = dict(zip(names, columns))
            return pa.RecordBatch.from_arrays([pa.array(own[n], t) if n in own else pa.nulls(len(columns[0]), t) for n, t in _PACKED.items()], list(_PACKED))

        def strings() -> pa.RecordBatch:
            return out([*zip(*seen), *zip(*seen.values())], ["bucket", "text", "first", "most"])

        for batch in batches:
            for doc, value, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for bucket, text, first in pieces((value.as_py() or b"").split()):
                    low, high = seen.get((bucket, text), (doc, doc))
                    seen[bucket, text] = min(low, doc), max(high, doc)
                    digests.append(_digest(text))
                    ids.append(doc)
                    hashes.append(own)
                    at.append(first)
                    if len(seen) >= STRINGS_AT_ONCE:
                        yield strings()
                        seen = {}
                    if len(at) >= STRINGS_AT_ONCE:
                        yield out([digests, ids, hashes, at], ["digest", "id", "hash", "at"])
                        digests, ids, hashes, at = [], [], [], []
        if seen:
            yield strings()
        if at:
            yield out([digests, ids, hashes, at], ["digest", "id", "hash", "at"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["bucket"]):
            buckets = block["bucket"].to_numpy()
            ends = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) + 1
            found: list[tuple[bytes, list[int]]] = []
            first, most = block["first"].to_pylist(), block["most"].to_pylist()
            start = 0
            for end in ends.tolist():
                if end - start > 1 or most[start] > first[start]:
                    found += _bucket(block["text"].slice(start, end - start).to_pylist(), first[start:end], most[start:end], window)
                start = end
            for low in range(0, len(found), STRINGS_AT_ONCE):
                digests, least = zip(*found[low : low + STRINGS_AT_ONCE])
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(least, pa.list_(pa.int64()))], ["digest", "least"])

    packed = written(texts.mapInArrow(pack, "bucket long, text binary, first long, most long, digest binary, id long, hash long, at long"))
    # Equal strings of a task are already one row; dealt by bucket, the rest meet without a second shuffle.
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    strings = packed.where("text is not null").repartition(parts, "bucket").groupBy("bucket", "text").agg(F.min("first").alias("first"), F.max("most").alias("most"))
    least = written(strings.sortWithinPartitions("bucket").mapInArrow(count, "digest binary, least array<long>"))
    places = packed.where("digest is not null").select("digest", "id", "hash", "at")
    hits = places.join(least, "digest").where(F.exists("least", lambda x: x < F.col("id")))
    return hits.groupBy("id", "hash").agg(F.collect_list(F.struct("at", "least")).alias("marks"))


def _bucket(texts: list[bytes], first: list[int], most: list[int], window: int) -> list[tuple[bytes, list[int]]]:
    """Smallest ids of the windows of a bucket's strings, of the strings in which some window has a smaller id than some document of the string."""
    rows = []
    for k, text in enumerate(texts):
        words = text.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        begins = [0, *ends]
        for j in range(len(words) - window + 1):
            rows.append((text[begins[j] : ends[j + window - 1] - 1], k, j))
    rows.sort(key=lambda r: r[0])
    least: list[list[int]] = [[0] * (text.count(b" ") + 2 - window) for text in texts]
    for _, same in groupby(rows, key=lambda r: r[0]):
        same = list(same)
        small = min(first[k] for _, k, _ in same)
        for _, k, j in same:
            least[k][j] = small
    return [(_digest(text), least[k]) for k, text in enumerate(texts) if min(least[k]) < most[k]]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row ``id``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space) per row of ``docs``.

    Null texts have no words; texts shorter than a window lose none. Rows that share an id are one document
    to each other: what only they share stays, and each loses the words of its own text only. A row whose id is null has no smaller id than itself and is not
    smaller than any: it keeps all its words and takes none away. An empty table gives an empty one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).withColumn("hash", F.xxhash64("raw"))
    marks = repeated_windows(texts.where("id is not null and raw is not null"), window, gram)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                n_words, n_removed, kept = [], [], []
                for doc, value, mark in zip(part.column(0).to_pylist(), part.column(1), part.column(2)):
                    words = (value.as_py() or b"").split()
                    gone = np.zeros(len(words) + 1, np.int32)
                    for m in mark.as_py() or ():
                        for j, small in enumerate(m["least"]):
                            if small < doc:
                                gone[m["at"] + j] += 1
                                gone[m["at"] + j + window] -= 1
                    covered = np.cumsum(gone[:-1]) > 0
                    left = [words[k] for k in np.flatnonzero(~covered).tolist()] if covered.any() else words
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    joined = texts.join(marks.hint("merge"), ["id", "hash"], "left").select("id", "raw", "marks")
    return joined.mapInArrow(work, "id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
