"""Quality by hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams: one of trusted texts, one of the whole raw corpus. A document's
score is its mean log-likelihood ratio per n-gram, so length does not count. The threshold is a fixed rule
on the scores of all labelled texts; every document is judged by it, none is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written
from tidewatch.operators.ordering import running_sums

#: n-gram length in bytes, number of hash cells (fixed, so the model has a fixed size) and smoothing per cell.
GRAM, CELLS, SMOOTH = 4, 1 << 16, 0.5
#: Share of trusted texts that the threshold may cost at most.
TRUSTED_LOSS = 0.002
#: Hash multiplier (odd).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUED = bytes(range(0x80, 0xC0))
BYTES_AT_ONCE = 1 << 20


def grams(raw: bytes) -> Iterator[np.ndarray]:
    """Cells of the n-grams of a text, in pieces; white space runs count as one space, ends are spaces too."""
    flat = b" " + b" ".join(raw.split()) + b" "
    for low in range(0, max(0, len(flat) - GRAM + 1), BYTES_AT_ONCE):
        part = np.frombuffer(flat, np.uint8)[low : low + BYTES_AT_ONCE + GRAM - 1].astype(np.uint64)
        code = np.zeros(len(part) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            code = (code << np.uint64(8)) | part[k : k + len(code)]
        yield ((code * MULTIPLIER) >> np.uint64(48)).astype(np.int64)


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, SPACES + CONTINUED))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 4:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        if len(number) < n:
            _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
            _, at, many = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
            found = np.flatnonzero(many[at] > 1)
            marked = np.zeros(n, bool)
            for k in range(3):
                marked[found + k] = True
            repeated = int(marked.sum())
    return n, chars, symbols, dup, repeated


def llr_table(texts: DataFrame) -> np.ndarray:
    """log p(cell | trusted) - log p(cell | raw corpus), smoothed; ``CELLS`` doubles whatever the corpus' size.

    ``texts`` has ``raw`` (binary) and ``trusted`` (boolean); all rows count for the raw corpus. Each task sums
    its own rows before the shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            for value, trusted in zip(batch.column(0), batch.column(1).to_pylist()):
                for cells in grams(value.as_py()):
                    own = np.bincount(cells, minlength=CELLS)
                    total[0] += own
                    if trusted:
                        total[1] += own
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[0, used]), pa.array(total[1, used])], ["cell", "n", "trusted"])

    sums = texts.select("raw", "trusted").mapInArrow(work, "cell long, n long, trusted long").groupBy("cell").agg(F.sum("n"), F.sum("trusted"))
    counts = np.zeros((2, CELLS))
    for cell, n, trusted in sums.collect():
        counts[:, cell] = n, trusted
    logs = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * CELLS)
    return logs[1] - logs[0]


def score(raw: bytes, table: np.ndarray) -> float:
    """Mean log-likelihood ratio of a text's n-grams, 0 for none."""
    total, n = 0.0, 0
    for cells in grams(raw):
        total += float(table[cells].sum())
        n += len(cells)
    return total / n if n else 0.0


def threshold(labelled: DataFrame) -> float:
    """The middle of the widest gap with the best balanced accuracy between trusted and rejected texts, lowered where it would cost more than TRUSTED_LOSS of the trusted.

    ``labelled`` has a row ``score``, ``mark`` (1 trusted, 0 rejected) per labelled text, all of which count: equal scores
    become one row before the shuffle, sums up to each score give what every cut gains. Without rejected texts it is the
    loss bound alone; without trusted ones nothing is cut.
    """
    cells = written(labelled.groupBy("score").agg(F.count_if(F.col("mark") == 1).alias("good"), F.count_if(F.col("mark") == 0).alias("bad")))
    n_good, n_bad = (n or 0 for n in cells.agg(F.sum("good"), F.sum("bad")).first())
    if not n_good:
        return float("-inf")
    placed = written(running_sums(cells, [], ["score"], {"good_upto": F.col("good"), "bad_upto": F.col("bad"), "place": F.lit(1)}))
    bound = F.min(F.when(F.col("good_upto") > int(TRUSTED_LOSS * n_good), F.col("score")))
    if not n_bad:
        return float(placed.agg(bound).first()[0])
    earlier = placed.select((F.col("place") + 1).alias("place"), F.col("score").alias("before"))
    gain = (F.col("bad_upto") - F.col("bad")) / n_bad - (F.col("good_upto") - F.col("good")) / n_good
    gap = F.coalesce(F.col("score") - F.col("before"), F.lit(0.0))
    middle = F.coalesce((F.col("score") + F.col("before")) / 2, F.col("score"))
    found = placed.join(earlier.hint("merge"), "place", "left").agg(bound, F.max(F.struct(gain.alias("gain"), gap.alias("gap"), middle.alias("middle")))).first()
    return float(min(found[0], found[1]["middle"]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, the base counts, ``base_failed``, ``score``, ``cut``, ``kept``, and ``hash`` of its text if asked.

    ``labels`` names trusted (1) and rejected (0) ids; other values and null are no labels, and an id labelled
    both ways counts as rejected. Trusted texts are all of the labelled ones, the raw corpus all of ``docs``;
    the cut is set on all labelled texts that the base rules let pass.
    Null texts count as empty: no words, so ``base_failed``. Repeated rows are judged each. Without trusted
    texts the cut is minus infinity, and only the base rules reject. Empty tables give empty ones.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"), *([F.xxhash64(F.col(text_col).cast("string")).alias("hash")] if with_hash else []))
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("mark"))
    )
    # One plan at every size: labels grow with the corpus, so the side is never broadcast.
    marked = texts.join(marks.hint("merge"), "id", "left").select("raw", F.coalesce(F.col("mark") == 1, F.lit(False)).alias("trusted"))
    table = llr_table(marked)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*base_counts(raw), score(raw, table)) for raw in (v.as_py() for v in batch.column(1))]
            columns = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, *([batch.column(2)] if with_hash else [])], names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", *(["hash"] if with_hash else [])]
    kinds = ["long"] * 6 + ["double", "long"]
    # Scores are few bytes a text and read twice: for the cut and for the verdict.
    found = written(texts.mapInArrow(work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cut = threshold(found.where(~failed).join(marks.hint("merge"), "id").select("score", "mark"))
    return found.withColumn("base_failed", failed).withColumn("cut", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("cut")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns; each row goes by the verdict on its own text, whatever its id."""
    good = judge(docs, labels, id_col, text_col, with_hash=True).where("kept").select(F.col("id").alias("_good"), F.col("hash").alias("_hash")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(F.col("_good")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_hash"))
    return docs.join(good.hint("merge"), same, "left_semi")
