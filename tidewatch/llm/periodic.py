"""Runs of repeating words, found from minimisers at several scales.

A run is a stretch of consecutive words that repeats itself: smallest period ``q``, at least ``LEAST_REPEATS``
times ``q`` and ``LEAST_WORDS`` words long, and no neighbouring word carries the period on.

Periods up to ``SHORT`` are found by comparing the text with itself at each lag. A longer period lies in one
scale ``(2 ** (k - 1), 2 ** k]``. There every group of ``2 ** k`` words has a hash, and a window of
``2 ** (k - 1)`` groups names its least. Such a window shifted by one period holds the same groups, so in a
run some least group comes back one period later; the group is as long as the period, so it cannot come back
sooner. Hence each run has two equal least groups, next to each other among the equal ones, whose distance is its
period. These pairs are seeds; they are extended word by word to both sides, so a hash never decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.substring import sliding_least

LEAST_REPEATS, LEAST_WORDS = 4, 6
#: Longest period that is found by comparing at its lag; a power of two.
SHORT = 8
#: Words compared in the first step of an extension; each further step compares twice as many.
FIRST_STEP = 64
FACTOR, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

Run = tuple[int, int, int]  # start, length, period


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * SPREAD
    return x ^ (x >> np.uint64(29))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of ``a`` and ``b`` agree."""
    at, step, n = 0, FIRST_STEP, min(len(a), len(b))
    while at < n:
        end = min(n, at + step)
        differ = np.flatnonzero(a[at:end] != b[at:end])
        if len(differ):
            return at + int(differ[0])
        at, step = end, step * 2
    return n


def _short_runs(codes: np.ndarray) -> Iterator[Run]:
    for lag in range(1, SHORT + 1):
        need = max(LEAST_WORDS, LEAST_REPEATS * lag)
        if need > len(codes):
            return
        same = np.zeros(len(codes) - lag + 2, np.int8)
        same[1:-1] = codes[lag:] == codes[:-lag]
        turns = np.flatnonzero(np.diff(same))
        begin, end = turns[::2], turns[1::2]
        for k in np.flatnonzero(end - begin + lag >= need).tolist():
            yield int(begin[k]), int(end[k] - begin[k]) + lag, lag


def _seeds(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Lag and place of equal least groups, by lag and place within a scale."""
    hashes, size = _mixed((codes.astype(np.uint64) + np.uint64(1)) * FACTOR), 1
    place_bits = np.uint64(len(codes).bit_length())
    while LEAST_REPEATS * (size + 1) <= len(codes):
        # From groups of ``size`` words to groups of twice as many.
        hashes, size = _mixed(hashes[:-size] * FACTOR + hashes[size:]), size * 2
        window = size // 2
        if window < SHORT or len(hashes) < window:
            continue
        key = hashes >> place_bits << place_bits | np.arange(len(hashes), dtype=np.uint64)
        least = np.unique(sliding_least(key, window) & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        own = hashes[least]
        order = np.argsort(own, kind="stable")
        at, own = least[order], own[order]
        lag = np.diff(at)
        found = np.flatnonzero((own[1:] == own[:-1]) & (lag > window) & (lag <= size))
        yield from sorted(zip(lag[found].tolist(), at[found].tolist()))


def _long_runs(codes: np.ndarray) -> Iterator[Run]:
    last, covered = 0, 0
    for lag, at in _seeds(codes):
        if lag == last and at + lag < covered:
            continue
        behind = _agreeing(codes[:at][::-1], codes[: at + lag][::-1])
        start = at - behind
        length = lag + behind + _agreeing(codes[at:], codes[at + lag :])
        last, covered = lag, start + length
        if length >= LEAST_REPEATS * lag:
            yield start, length, lag


def find_runs(codes: np.ndarray) -> list[Run]:
    """All runs of the words ``codes`` (a number per different word), by start and period.

    A stretch that was found at a multiple of its period was found at its period too; the smallest is kept.
    """
    smallest: dict[tuple[int, int], int] = {}
    for found in (_short_runs, _long_runs):
        for start, length, period in found(codes):
            smallest[start, length] = min(period, smallest.get((start, length), period))
    return sorted(((start, length, period) for (start, length), period in smallest.items()), key=lambda r: (r[0], r[2]))


def best_run(runs: list[Run]) -> Run | None:
    """The run with the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def plant_runs(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words``, from some place on repeated with some period in a tenth of the ids, as the query's contract states it; a null id plants none."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None
) -> DataFrame:
    """One row ``id``, ``n_words``, ``runs`` (structs start, length, period in words), ``best`` (struct or null), ``collapsed`` per row of ``docs``.

    ``collapsed`` holds the words that are in no run or among the first period of every run that holds them, joined by one
    space. Words lie between ASCII white space; ``prepare`` may change the words of an id before. Null and empty texts
    have no words, no runs and an empty text; repeated rows give a row each; equally strong runs are all listed; an empty
    table gives an empty one. Only id and text are read, so other columns may have any names. A text is one row
    and is handled as a whole, in memory proportional to it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                n_words, runs, best, collapsed = [], [], [], []
                for doc, value in zip(part.column(0).to_pylist(), part.column(1)):
                    words = (value.as_py() or b"").split()
                    if prepare is not None:
                        words = prepare(doc, words)
                    found = find_runs(_numbers(words)) if len(words) >= LEAST_WORDS else []
                    if found:
                        edges = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in found:
                            edges[start + period] += 1
                            edges[start + length] -= 1
                        words_left = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                    else:
                        words_left = words
                    n_words.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    top = best_run(found)
                    best.append(None if top is None else dict(zip(("start", "length", "period"), top)))
                    collapsed.append(b" ".join(words_left))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(best, _RUN), pa.array(collapsed, pa.binary())],
                    ["id", "n_words", "runs", "best", "collapsed"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    run = "struct<start: long, length: long, period: long>"
    found = texts.mapInArrow(work, f"id long, n_words long, runs array<{run}>, best {run}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
