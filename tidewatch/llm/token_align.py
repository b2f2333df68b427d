"""Alignment of two tokenizers' tokens over the same bytes.

A text is tokenised fully by both. Where a token of each ends at the same byte and the next ones both begin with a space
there is an anchor; anchors cut a text into windows, pairs of token-id tuples that come back all over the corpus. A window
is aligned once and remembered by its ids: its groups between shared ends and its links, the pairs of tokens
that overlap in bytes. A text's groups and links are those of its windows one after another.

Texts travel in blocks. A block names its different id pairs once, so what is counted over the corpus and what
comes back are the pairs of blocks, not those of texts; a pair is one row of a block however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm.bpe import PIECES, _byte_chars
from tidewatch.llm.common import written

#: Texts are tokenised so many at a time; a block is closed once it holds so many characters.
BLOCK_CHARS, TEXTS_AT_ONCE = 4 << 20, 200
#: Words and windows that a worker remembers before it forgets, between blocks only; new words that are encoded at a time.
KEPT, WORDS_AT_ONCE = 500_000, 10_000
#: Words from this length on go to the library that merges long pieces fast.
LONG_PIECE = 1_000
#: A space beside another white space; texts without it can be cut before every space.
BLANKS = re.compile(r" \s")
SPACE_MARK = "▁"
#: B ids are below this.
B_IDS = 1 << 24


class ByteLevel:
    """Encoder for a byte-level vocabulary file (``tokenizers`` JSON); strings of added tokens are plain text to it.

    The merge rule needs only the order of ids, so the ranks are the ids; a file in which later merges make smaller ids, and
    texts with a very long piece, are left to the ``tokenizers`` library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte, vocab = _byte_chars(), spec["model"]["vocab"]
        self.token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}
        special = {t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {i: b for i, b in self.token_bytes.items() if i not in special}
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.fast = None
        if made == sorted(set(made)) and len(set(self.token_bytes.values())) == len(self.token_bytes) == len(made) + 256:
            self.fast = tiktoken.Encoding("byte_level", pat_str=PIECES, mergeable_ranks={b: i for i, b in self.token_bytes.items()}, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None:
            words = text.split()
            inked = sum(map(len, words))
            if len(text) - inked < len(words) + LONG_PIECE and max(map(len, words), default=0) < LONG_PIECE:
                return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Encoder for a sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.token_bytes = {
            i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)
        }
        #: Whether no piece goes on over a space, so that words are merged apart.
        self.by_word = not any(a != SPACE_MARK and b == SPACE_MARK for p in pieces for a, b in zip(p, p[1:]))

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


def _by_id(token_bytes: dict[int, bytes], measure) -> np.ndarray:
    out = np.zeros(max(token_bytes) + 1, np.int64)
    for i, b in token_bytes.items():
        out[i] = measure(b)
    return out


class Windows:
    """Windows that are remembered by their ids: text of the groups, counts, and linked id pairs."""

    def __init__(self):
        self.numbers: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[bytes] = []
        #: Tokens of A and of B, groups and links of each window (four columns); all windows' linked pairs (as A id * B_IDS + B id).
        self.counts: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        self.pairs: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, keys: list[tuple[bytes, bytes]], length_a: np.ndarray, length_b: np.ndarray, names: list[bytes]) -> None:
        """Align new windows: groups between shared ends, links between tokens whose bytes overlap.

        The windows stand behind each other. Ends of either side cut their bytes into stretches, and each stretch belongs to one
        token of each side, so it is one link; a stretch whose end both sides share ends a group.
        """
        a, b = (np.frombuffer(b"".join(x), np.int32) for x in zip(*keys))
        ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
        is_a, is_b = np.zeros(int(ends_a[-1]) + 1, bool), np.zeros(int(ends_a[-1]) + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        stretch = np.flatnonzero(is_a | is_b)
        on_a, on_b = np.searchsorted(ends_a, stretch), np.searchsorted(ends_b, stretch)
        self.pairs.append(a[on_a].astype(np.int64) * B_IDS + b[on_b])
        shared = is_a[stretch] & is_b[stretch]
        group_a, group_b = on_a[shared] + 1, on_b[shared] + 1
        last = np.cumsum(np.array([(len(x), len(y)) for x, y in keys]) // 4, axis=0)
        n_groups = np.searchsorted(group_a, last[:, 0], side="right")
        n_links = np.searchsorted(stretch, ends_a[last[:, 0] - 1], side="right")
        self.counts.append(np.diff(np.column_stack([last, n_groups, n_links]), axis=0, prepend=0))
        # Each token is written with the sign behind it; a group's A tokens stand before its B tokens.
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[group_a - 1], sign_b[group_b - 1], sign_b[last[:, 1] - 1] = 1, 2, 3
        of_a, of_b = np.searchsorted(group_a, np.arange(len(a)), side="right"), np.searchsorted(group_b, np.arange(len(b)), side="right")
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        written = list(map(names.__getitem__, np.concatenate([a * 4 + sign_a, b * 4 + sign_b])[order].tolist()))
        flat, ends = b"".join(written), np.cumsum(np.fromiter(map(len, written), np.int64, len(written)))[last.sum(axis=1) - 1].tolist()
        first = len(self.texts)
        self.numbers.update(zip(keys, range(first, first + len(keys))))
        self.texts += [flat[low:high] for low, high in zip([0, *ends], ends)]


class Aligner:
    """Both encoders and what a worker remembers of words and windows."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.length_a, self.length_b = _by_id(self.a.token_bytes, len), _by_id(self.b.token_bytes, len)
        self.spaced_a = _by_id(self.a.token_bytes, lambda x: x[:1] == b" ").astype(bool)
        self.spaced_b = _by_id(self.b.token_bytes, lambda x: x[:1] == b" ").astype(bool)
        self.names = [f"{i}{sign}".encode() for i in range(max(len(self.length_a), len(self.length_b))) for sign in (",", "|", ";", "")]
        self.words: dict[str, int | None] = {}
        self.windows = Windows()

    def tidy(self) -> None:
        """Forget when too much is remembered; between blocks only."""
        if len(self.windows.texts) > KEPT or len(self.words) > KEPT:
            self.words, self.windows = {}, Windows()

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """All tokens of a text; None where they do not spell a space and the text."""
        a, b = self.a.encode(" " + text), self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.a.token_bytes.__getitem__, a)) != whole or b"".join(map(self.b.token_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int32), np.array(b, np.int32)

    def anchored(self, a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
        """Id tuples of the windows of a text, from anchor to anchor, and where they end in bytes."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at = np.zeros(int(ends_a[-1]) + 1, np.int32)
        at[ends_b] = np.arange(1, len(b) + 1)
        # The number of B tokens that end where an A token ends, 0 if none does.
        met = at[ends_a]
        anchor = met > 0
        anchor[:-1] &= self.spaced_a[a[1:]] & self.spaced_b[b[np.minimum(met[:-1], len(b) - 1)]]
        high_a, high_b = ((np.flatnonzero(anchor) + 1) * 4).tolist(), (met[anchor] * 4).tolist()
        raw_a, raw_b = a.tobytes(), b.tobytes()
        parts_a = [raw_a[low:high] for low, high in zip([0, *high_a], high_a)]
        parts_b = [raw_b[low:high] for low, high in zip([0, *high_b], high_b)]
        return list(zip(parts_a, parts_b)), ends_a[anchor]

    def _numbered(self, keys: list[tuple[bytes, bytes]]) -> list[int]:
        numbers = self.windows.numbers
        new = [k for k in dict.fromkeys(keys) if k not in numbers]
        if new:
            self.windows.add(new, self.length_a, self.length_b, self.names)
        return list(map(numbers.__getitem__, keys))

    def _learn(self, words: list[str]) -> None:
        """Window of each new word, as in a text of all of them; None for a word that is not just one window there."""
        text = " ".join(words)
        a, parts = self.a.encode(" " + text), self.b.library.encode(words, num_threads=1)
        b = list(chain.from_iterable(parts))
        whole = (" " + text).encode()
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)))
        if b"".join(map(self.a.token_bytes.__getitem__, a)) == whole == b"".join(map(self.b.token_bytes.__getitem__, b)):
            # Each word's own pieces end where it does, so these are also the pieces of the whole.
            sizes = np.append(0, np.cumsum(self.length_b[b]))[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
            keys, cuts = self.anchored(np.array(a, np.int32), np.array(b, np.int32))
            if np.array_equal(sizes, ends) and np.array_equal(cuts, ends):
                self.words.update(zip(words, self._numbered(keys)))
                return
        if len(words) == 1:
            self.words[words[0]] = None
            return
        half = len(words) // 2
        self._learn(words[:half])
        self._learn(words[half:])

    def cut(self, texts: list[str]) -> list[list[int] | None]:
        """Numbers of each text's windows; None for a text without tokens.

        In a text whose spaces stand alone every space begins a token of both, and what follows it is merged apart
        from the rest, so the windows of a word are those it has anywhere and are remembered with it. Other texts, and those
        with a word that is not one window, are encoded in one go and cut at their anchors.
        """
        split = [
            text.split(" ") if text and self.b.by_word and not text.endswith(" ") and not text[0].isspace() and not BLANKS.search(text) else None
            for text in texts
        ]
        new = [w for w in set().union(*(words for words in split if words)) if w not in self.words]
        for low in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[low : low + WORDS_AT_ONCE])
        out: list[list[int] | None] = []
        for text, words in zip(texts, split):
            found = None if words is None else list(map(self.words.__getitem__, words))
            if text and (found is None or None in found):
                tokens = self.tokens(text)
                found = None if tokens is None else self._numbered(self.anchored(*tokens)[0])
            out.append(found)
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


#: A block's texts (``links``: pairs of a place in the block's list and a count, packed) and, in a row without ``n_a``, its list of id pairs.
_BLOCK = "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, a array<int>, b array<int>, n array<int>"
_BLOCK_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()),
]
_NAMES = [part.split(" ")[0] for part in _BLOCK.split(", ")]
def _linked(pairs: np.ndarray, counts: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's id pairs, and per text and pair: text, place of the pair, links.

    ``sizes``: windows per text; ``own``: their numbers; ``counts``: links of each window that is known; ``pairs``: these links.
    """
    starts = np.cumsum(counts) - counts

    def spread(which: np.ndarray) -> np.ndarray:
        """Places of the links of these windows."""
        many = counts[which]
        return np.arange(int(many.sum())) + np.repeat(starts[which] - np.cumsum(many) + many, many)

    used = np.zeros(len(counts), bool)
    used[own] = True
    seen = spread(np.flatnonzero(used))
    listed, number = np.unique(pairs[seen], return_inverse=True)
    place = np.zeros(len(pairs), np.int64)
    place[seen] = number
    cells = np.repeat(np.repeat(np.arange(len(sizes)) * len(listed), sizes), counts[own]) + place[spread(own)]
    cells.sort()
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    links = np.diff(np.append(first, len(cells)))
    cells = cells[first]
    return listed, cells // len(listed), cells % len(listed), links


def _blocks(texts: DataFrame, a_path: str, b_path: str, digest: bool) -> DataFrame:
    def rows(own: Aligner, number: int, ids: list, found: list[list[int] | None]) -> Iterator[pa.RecordBatch]:
        known = own.windows
        known.pairs, known.counts = [np.concatenate(known.pairs)], [np.concatenate(known.counts)]
        groups = [None if f is None else b";".join(map(known.texts.__getitem__, f)) for f in found]
        if digest:
            groups = [None if g is None else hashlib.sha256(g).hexdigest() for g in groups]
        sizes = np.fromiter((0 if f is None else len(f) for f in found), np.int64, len(found))
        windows = np.fromiter(chain.from_iterable(f for f in found if f is not None), np.int64, int(sizes.sum()))
        totals = np.zeros((len(windows) + 1, 4), np.int64)
        np.cumsum(known.counts[0][windows], axis=0, out=totals[1:])
        totals = np.diff(totals[np.append(0, np.cumsum(sizes))], axis=0)
        packed, listed = [b""] * len(ids), ()
        if len(windows):
            pairs, text, place, links = _linked(known.pairs[0], known.counts[0][:, 3], sizes, windows)
            cuts = np.searchsorted(text, np.arange(len(ids) + 1))
            both = np.column_stack([place, links]).astype("<i4")
            packed = [both[cuts[k] : cuts[k + 1]].tobytes() for k in range(len(ids))]
            listed = ((pairs // B_IDS).astype(np.int32), (pairs % B_IDS).astype(np.int32), np.bincount(place, minlength=len(pairs)).astype(np.int32))
        columns = [[number] * len(ids), ids, *totals.T, groups, packed]
        arrays = [pa.array(x, t) for x, t in zip(columns, _BLOCK_TYPES)] + [pa.nulls(len(ids), t) for t in _BLOCK_TYPES[8:]]
        yield pa.RecordBatch.from_arrays(arrays, _NAMES)
        if listed:
            arrays = [pa.array([number])] + [pa.nulls(1, t) for t in _BLOCK_TYPES[1:8]] + [pa.array([x], t) for x, t in zip(listed, _BLOCK_TYPES[8:])]
            yield pa.RecordBatch.from_arrays(arrays, _NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        found: list[list[int] | None] = []
        size = 0
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(low, TEXTS_AT_ONCE)
                values = [value or "" for value in part.column(1).to_pylist()]
                ids += part.column(0).to_pylist()
                found += own.cut(values)
                size += sum(map(len, values)) + 100 * len(values)
                if size >= BLOCK_CHARS:
                    yield from rows(own, number, ids, found)
                    ids, found, size, number = [], [], 0, number + 1
                    own.tidy()
        if ids:
            yield from rows(own, number, ids, found)
            own.tidy()

    return texts.mapInArrow(work, _BLOCK)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups`` per row of ``docs``.

    ``a_path`` names a byte-level vocabulary that encodes a space and the text, ``b_path`` a sentencepiece model that puts the
    space itself. ``groups`` writes the token ids between shared ends as ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is the SHA-256 of
    that. A pair of ids counts the rows of ``docs`` that hold it linked; ``count_sum`` adds that number over a text's
    links, ``n_best`` counts the links whose number no other pair with the same A id exceeds.

    Null and empty texts and those whose tokens do not spell a space and the text have no tokens: zeros and an empty ``groups``. Repeated
    rows count each; null ids take part; an empty table gives an empty one; other columns may have any names.
    A text is one row and is held whole, in memory proportional to it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = written(_blocks(texts, a_path, b_path, digest))
    listed = found.where("n is not null").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "_p"))
    pairs = listed.select("of", "place", "_p.a", "_p.b", "_p.n")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # At most as many rows per A id as there are B ids, whatever the corpus' size.
    counts = written(counts)
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(best, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    weights = pairs.select("of", "place", "a", "b").join(counts, ["a", "b"]).select("of", "place", "count", "best")

    def weigh(rows: pa.Table, weights: pa.Table) -> pa.Table:
        count, best = np.zeros(weights.num_rows, np.int64), np.zeros(weights.num_rows, bool)
        place = weights["place"].to_numpy()
        count[place], best[place] = weights["count"].to_numpy(), weights["best"].to_numpy()
        sums, bests = [], []
        for value in rows["links"]:
            own = np.frombuffer(value.as_py(), "<i4").reshape(-1, 2)
            sums.append(int((count[own[:, 0]] * own[:, 1]).sum()))
            bests.append(int(own[best[own[:, 0]], 1].sum()))
        return rows.drop_columns(["block", "links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    rows = found.where("links is not null").select("block", "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("groups", F.lit("")).alias("groups"), "links")
    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(weights.groupBy("of")).applyInArrow(weigh, schema)
