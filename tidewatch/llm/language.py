"""Language of a text by a convolutional network over its bytes.

The network reads windows of ``WINDOW`` bytes: a vector per byte, filters of several widths, the largest
answer of each filter in the window, softmax. It is trained here in numpy on labelled texts and then applied to
all windows of every text in batches; a text's language has the greatest mean log probability over its windows.

Filters of two bytes and more are applied as sums of table rows: a pair of bytes names a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, DIMENSIONS = 24, 8
#: Windows overlap so far that every group of bytes a filter reads is in one.
STRIDE = WINDOW - max(WIDTHS) + 1
#: Bounds of the training sample: labelled rows over all languages, windows of one row.
TRAIN_ROWS, TRAIN_WINDOWS = 8_000, 3
STEPS, BATCH, RATE = 500, 128, 0.01
#: Windows that go through the network at a time.
WINDOWS_AT_ONCE = 128
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids whose labels are never read; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class ByteNetwork:
    """Byte vectors, filters per width, and a softmax layer over the largest answer of each filter."""

    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.parts: dict[str, np.ndarray] = {
            "bytes": draw.normal(0, 0.5, (256, DIMENSIONS)), "out": draw.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes),
        }
        for w in WIDTHS:
            self.parts[f"filter{w}"] = draw.normal(0, (w * DIMENSIONS) ** -0.5, (w, DIMENSIONS, FILTERS))
            self.parts[f"shift{w}"] = np.zeros(FILTERS)

    def rows(self, width: int) -> np.ndarray:
        """The share of each byte at each place of a filter in its answer: (place, byte, filter)."""
        return np.einsum("bd,wdf->wbf", self.parts["bytes"], self.parts[f"filter{width}"]).astype(np.float32)

    def _slope(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy on windows ``x`` with classes ``y``; only the largest answers pass it on."""
        n, slope = len(x), {name: np.zeros_like(part) for name, part in self.parts.items()}
        tables, tops, places = {}, [], []
        for w in WIDTHS:
            tables[w] = self.rows(w)
            answer = tables[w][0][x[:, : WINDOW - w + 1]]
            for j in range(1, w):
                answer += tables[w][j][x[:, j : WINDOW - w + 1 + j]]
            place = answer.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(answer, place[:, None, :], 1)[:, 0] + self.parts[f"shift{w}"])
        pooled = np.concatenate(tops, axis=1)
        active = np.maximum(pooled, 0)
        p = _softmax(active @ self.parts["out"] + self.parts["bias"])
        p[np.arange(n), y] -= 1
        p /= n
        slope["out"], slope["bias"] = active.T @ p, p.sum(axis=0)
        back = (p @ self.parts["out"].T) * (pooled > 0)
        column = np.arange(FILTERS)
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            slope[f"shift{w}"] = own.sum(axis=0)
            for j in range(w):
                cells = x[np.arange(n)[:, None], places[k] + j].astype(np.int64) * FILTERS + column
                table = np.bincount(cells.ravel(), own.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                slope[f"filter{w}"][j] = self.parts["bytes"].T @ table
                slope["bytes"] += table @ self.parts[f"filter{w}"][j].T
        return slope

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam steps on random windows, classes alike often; half of the windows are cut short, as short texts are."""
        draw = np.random.default_rng(seed)
        of_class = [np.flatnonzero(y == c) for c in range(len(self.parts["bias"]))]
        first = {name: np.zeros_like(part) for name, part in self.parts.items()}
        second = {name: np.zeros_like(part) for name, part in self.parts.items()}
        for step in range(1, steps + 1):
            chosen = np.array([own[draw.integers(len(own))] for own in (of_class[c] for c in draw.integers(len(of_class), size=BATCH))])
            part = x[chosen].copy()
            short = draw.integers(6, WINDOW, BATCH // 2)
            part[: BATCH // 2][np.arange(WINDOW) >= short[:, None]] = 0
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for name, slope in self._slope(part, y[chosen]).items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.999 * second[name] + 0.001 * slope * slope
                self.parts[name] -= rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Reader:
    """A trained network as tables over pairs of bytes."""

    def __init__(self, network: ByteNetwork):
        self.tables = []
        for w in WIDTHS:
            own = network.rows(w)
            pairs = [(own[j][:, None, :] + own[j + 1][None, :, :]).reshape(65_536, FILTERS) for j in range(0, w - 1, 2)]
            singles = [own[w - 1]] if w % 2 else []
            self.tables.append((w, pairs, singles, network.parts[f"shift{w}"].astype(np.float32)))
        self.out, self.bias = network.parts["out"].astype(np.float32), network.parts["bias"].astype(np.float32)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages per window (rows of WINDOW bytes)."""
        out = []
        for low in range(0, len(x), WINDOWS_AT_ONCE):
            part = x[low : low + WINDOWS_AT_ONCE]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            tops = []
            for w, pairs, singles, shift in self.tables:
                n = WINDOW - w + 1
                answer = pairs[0][pair[:, :n]]
                for j, table in enumerate(pairs[1:], 1):
                    answer += table[pair[:, 2 * j : 2 * j + n]]
                for table in singles:
                    answer += table[part[:, w - 1 : w - 1 + n]]
                tops.append(answer.max(axis=1) + shift)
            z = np.maximum(np.concatenate(tops, axis=1), 0) @ self.out + self.bias
            z = (z - z.max(axis=1, keepdims=True)).astype(np.float64)
            out.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
        return np.concatenate(out)


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text as rows, A-Z lowered, the last one filled with zeros."""
    own = np.frombuffer(raw.lower(), np.uint8)
    n = max(1, -(-(len(own) - WINDOW) // STRIDE) + 1)
    full = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    full[: len(own)] = own
    return np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE]


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int) -> DataFrame:
    """``lang``, ``window``: up to TRAIN_WINDOWS windows, evenly spaced, of at most ``train_rows`` labelled texts with letters, languages alike often."""
    taught = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col).cast("long")) & F.col(text_col).cast("string").rlike(r"\p{L}"))
    taught = taught.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    counts = {r.lang: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return taught.select("lang", F.lit(None).cast("binary").alias("window")).limit(0)
    quota = max(1, train_rows // len(counts))
    # Twice the quota by hash, so that few rows are ranked, then the quota exactly.
    hashed = F.xxhash64(F.lit("taught"), "id", "raw")
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, (2 * quota + 100) / n))]), F.col("lang"))
    near = taught.where(F.pmod(hashed, F.lit(1 << 30)) < share * (1 << 30)).withColumn("_h", hashed)
    few = near.withColumn("_place", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "id"))).where(F.col("_place") <= quota)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = windows_of(value.as_py())
                for k in np.unique(np.linspace(0, len(rows) - 1, TRAIN_WINDOWS).astype(int)).tolist():
                    langs.append(lang)
                    parts.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "window"])

    return few.select("lang", "raw").mapInArrow(cut, "lang string, window binary")


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, steps: int = STEPS
) -> tuple[list[str], ByteNetwork | None]:
    """The languages in code point order and the network; no network without labelled texts."""
    sample = sorted((r.lang, bytes(r.window)) for r in training_windows(docs, id_col, text_col, lang_col, train_rows).collect())
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return [], None
    x = np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(-1, WINDOW)
    network = ByteNetwork(len(langs))
    network.train(x, np.array([langs.index(lang) for lang, _ in sample]), steps)
    return langs, network


def predict_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row ``id``, ``held_out``, ``lang_pred``, ``score`` per row of ``docs``.

    The network learns from ``lang_col`` of at most ``train_rows`` rows whose id is not held out and is not null, whose language
    is known and whose text has a letter; languages take part alike often. It reads whole texts and nothing else. Null texts
    and texts without a letter are ``und`` with score 0, as is everything where there is nothing to learn from; with one
    language all the others are that one. Ties go to the language first in code point order. Repeated rows are judged each;
    an empty table gives an empty one; other columns may have any names.
    """
    langs, network = train(docs, id_col, text_col, lang_col, train_rows)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.when(text.rlike(r"\p{L}"), text.cast("binary")).alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None if network is None else Reader(network)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                names, scores = [], []
                for value in part.column(1):
                    raw = value.as_py()
                    if raw is None or reader is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    rows = windows_of(raw)
                    weight = np.full(len(rows), 1.0)
                    weight[-1] = max(1, len(raw) - (len(rows) - 1) * STRIDE) / WINDOW
                    mean = (reader.log_probabilities(rows) * weight[:, None]).sum(axis=0) / weight.sum()
                    p = np.exp(mean - mean.max())
                    best = int(p.argmax())
                    names.append(langs[best])
                    scores.append(float(p[best] / p.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return texts.mapInArrow(work, "id long, lang_pred string, score double").select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
