"""Toxicity by weak supervision.

Labelled training texts only suggest the voters: words and word beginnings that toxic texts hold far more
often, dealt out to lexicon voters, and pattern voters on how many and how dense they are. A generative
model of one hidden label explains the votes of all documents: by expectation maximisation it estimates each
voter's hit and false-alarm rate, and from what the label leaves unexplained the voters' correlations, which
discount voters that repeat each other. Its posteriors are the labels that a linear classifier learns; true
labels of the training part set the scale of its score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows teach words, classifier and scale; those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Signs kept, least evidence for one (log-likelihood ratio in nats, so that chance brings few among 10^5 words), least
#: ratio of rates, lexicon voters, lengths of word beginnings.
SIGNS, EVIDENCE, RATIO, LEXICONS, BEGINNINGS = 256, 12.0, 8.0, 10, (4, 5, 6)
#: Pattern voters: this many different signs; one sign in so many words.
MANY, DENSE_ONE_IN = 2, 100
CUT = 0.3
TOKEN = re.compile(r"[^\W_]+")
WORDS_KEPT = 200_000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def signs_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


class Signs:
    """Finds the chosen signs in texts; remembers words within a bound."""

    def __init__(self, chosen: list[str]):
        self.number = {s: k for k, s in enumerate(chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def find(self, text: str) -> tuple[Counter, int]:
        """How often each sign occurs, and the number of words."""
        words = TOKEN.findall(text.lower())
        hits: Counter = Counter()
        known = self.known
        for word in words:
            found = known.get(word)
            if found is None:
                if len(known) >= WORDS_KEPT:
                    known.clear()
                found = known[word] = tuple(self.number[s] for s in signs_of(word) if s in self.number)
            if found:
                hits.update(found)
        return hits, len(words)


def votes(hits: Counter, n_words: int) -> int:
    """The votes as bits: lexicons, then patterns. A voter that doesn't fire abstains."""
    code = 0
    for k in hits:
        code |= 1 << (k % LEXICONS)
    if len(hits) >= MANY:
        code |= 1 << LEXICONS
    if hits and sum(hits.values()) * DENSE_ONE_IN >= n_words:
        code |= 1 << (LEXICONS + 1)
    return code


def choose_signs(counts: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The SIGNS rows of ``sign``, ``toxic``, ``clean`` with the most evidence for toxicity, ties by name."""
    toxic, n, q = F.col("toxic").cast("double"), (F.col("toxic") + F.col("clean")).cast("double"), n_toxic / (n_toxic + n_clean)
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    evidence = part(toxic, q) + part(n - toxic, 1 - q)
    ratio = ((toxic + 0.5) / (n_toxic + 1)) / ((n - toxic + 0.5) / (n_clean + 1))
    good = counts.where((F.col("sign") != "") & (ratio >= RATIO) & (evidence >= EVIDENCE))
    return [r.sign for r in good.orderBy(evidence.desc(), "sign").limit(SIGNS).collect()]


class LabelModel:
    """Hidden label, voters' rates and pairwise correlations, from counts of vote patterns."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, n_voters: int, prior: float, turns: int = 100):
        votes = (codes[:, None] >> np.arange(n_voters)) & 1
        share = counts / counts.sum()
        self.n_voters, self.prior, self.weight = n_voters, min(max(prior, 1e-4), 0.5), np.ones(n_voters)
        self.rates = np.stack([np.full(n_voters, 0.05), np.full(n_voters, 0.5)])
        for _ in range(turns):
            p = self._posterior(votes)
            for label, q in ((0, 1 - p), (1, p)):
                self.rates[label] = np.clip((share * q) @ votes / max((share * q).sum(), 1e-12), 1e-4, 1 - 1e-4)
            self.prior = float(np.clip((share * p).sum(), 1e-4, 0.5))
        p = self._posterior(votes)
        residual = np.zeros((n_voters, n_voters))
        for label, q in ((0, 1 - p), (1, p)):
            off = (votes - self.rates[label]) / np.sqrt(self.rates[label] * (1 - self.rates[label]))
            residual += np.einsum("n,ni,nj->ij", share * q, off, off)
        np.fill_diagonal(residual, 0.0)
        self.correlations = np.clip(residual, -1, 1)
        self.weight = 1 / (1 + np.clip(self.correlations, 0, None).sum(axis=0))

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = votes * np.log(self.rates[1] / self.rates[0]) + (1 - votes) * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + ratio @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        return self._posterior((codes[:, None] >> np.arange(self.n_voters)) & 1)


def _row(hits: Counter, n_words: int) -> dict[int, float]:
    """Inputs of the linear classifier: log counts of the signs, their number, their density, and a constant."""
    row = {k: math.log1p(c) for k, c in hits.items()}
    row[SIGNS] = math.log1p(len(hits))
    row[SIGNS + 1] = math.log1p(100 * sum(hits.values()) / max(n_words, 1))
    row[SIGNS + 2] = 1.0
    return row


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, turns: int = 25) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row ``id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``.

    Labels are learned only from ids outside the held-out quarter; an id with both labels counts as toxic,
    other values and nulls are no labels. Null and empty texts get the score of a text without signs. Without
    toxic and clean training texts there is nothing to learn and every score is the toxic share (0 if there
    are no labels). Repeated rows are scored each; empty tables give empty ones.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("y")).where(~held_out(F.col("id")))
    )
    few = marks.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    # At most train_rows rows of an id and a label.
    taught = texts.join(F.broadcast(few), "id").select("y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = {s for word in set(TOKEN.findall(text.as_py().lower())) for s in signs_of(word)}
                sums[y].update(own)
                sums[y][""] += 1
        names = sorted(set(sums[0]) | set(sums[1]))
        for low in range(0, len(names), 10_000):
            part = names[low : low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([sums[1][s] for s in part], pa.int64()), pa.array([sums[0][s] for s in part], pa.int64())], ["sign", "toxic", "clean"])

    counted = taught.mapInArrow(count, "sign string, toxic long, clean long").groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = F.max(F.when(F.col("sign") == "", F.col("toxic"))), F.max(F.when(F.col("sign") == "", F.col("clean")))
    counted = counted.persist()
    n_toxic, n_clean = (x or 0 for x in counted.agg(total[0].alias("a"), total[1].alias("b")).first())
    chosen = choose_signs(counted, n_toxic, n_clean) if n_toxic and n_clean else []
    counted.unpersist()
    if not n_toxic or not n_clean or not chosen:
        flat = n_toxic / (n_toxic + n_clean) if n_toxic + n_clean else 0.0
        return texts.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), F.lit(flat).alias("score"), F.lit(int(flat >= CUT)).alias("predicted"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, seen = Signs(chosen), Counter()
        for batch in batches:
            seen.update(votes(*finder.find(text.as_py())) for text in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    # At most 2 ** (number of voters) rows, whatever the corpus' size.
    found = texts.select("text").mapInArrow(patterns, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    model = LabelModel(np.array([r.code for r in found]), np.array([r.n for r in found], float), LEXICONS + 2, n_toxic / (n_toxic + n_clean))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Signs(chosen)
        for batch in batches:
            keys, values, codes = [], [], []
            for text in batch.column(1):
                hits, n = finder.find(text.as_py())
                row = _row(hits, n)
                keys.append(list(row))
                values.append(list(row.values()))
                codes.append(votes(hits, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64()), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["y", "code", "keys", "values"])

    sample = taught.mapInArrow(rows, "y int, code long, keys array<int>, values array<double>").collect()
    sample.sort(key=lambda r: (r.code, r.y, r.keys, r["values"]))
    x = np.zeros((len(sample), SIGNS + 3))
    for k, r in enumerate(sample):
        x[k, r.keys] = r["values"]
    soft = model.posterior(np.array([r.code for r in sample]))
    w = logistic(x, soft, ridge=1.0)
    z = x @ w
    scale = logistic(np.stack([z, np.ones(len(z))], 1), np.array([r.y for r in sample], float), ridge=1e-2)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Signs(chosen)
        for batch in batches:
            out = []
            for text in batch.column(1):
                own = sum(w[k] * v for k, v in _row(*finder.find(text.as_py())).items())
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, scale[0] * own + scale[1])))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "score"])

    out = texts.mapInArrow(scored, "id long, score double")
    return out.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
