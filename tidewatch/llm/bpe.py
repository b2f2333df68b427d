"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Byte-pair encoding has this property: the tokens of a prefix are the tokens of a shorter prefix and one
more. So for every prefix the one right last token is stored: of the vocabulary's tokens that end there
(matches of an Aho-Corasick automaton: at each place it gives the same tokens as a suffix automaton
would, and there is a compiled one in pyahocorasick) it is the one that may follow the last token of the prefix before it.
Following these pointers back gives the ids. The vocabulary is given, never trained.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies cut text before merging.
PIECES = r"'(?:[smtd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"
#: Code points that this Python's ``regex`` counts as letters or numbers and the vocabulary's Unicode (16) does not.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: A sign that is neither letter nor number nor space; it stands in for those while a text is cut.
STAND_IN = "\u2603"
#: A space and a further white space: texts without these can be cut before every space.
WIDE = [" " + c for c in "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + [f" {chr(c)}" for c in range(0x2000, 0x200B)]
#: Bounds of what a worker remembers: words (as packed ids), pieces, the length of both, and token pairs. Each is kept twice
#: at most, see ``Recent``; workers outlive their task, so this memory stands beside that of later stages.
WORDS_KEPT, PIECES_KEPT, PIECE_CHARS, PAIRS_KEPT = 300_000, 100_000, 48, 200_000
#: Pieces that a text is cut into at a time.
CHUNK = 100_000


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Recent:
    """A bounded memory of what was met lately: once ``new`` holds ``most`` keys it becomes ``old``, and what was ``old`` is forgotten.

    Callers look into ``new`` themselves, that being fast; frequent keys come back from ``old`` before they are lost.
    """

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def again(self, key):
        """The value of a key that ``new`` lacks, None if ``old`` lacks it too."""
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Codec:
    """Encoder and decoder for a byte-level vocabulary file (``tokenizers`` JSON with a BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, to_byte = spec["model"]["vocab"], _byte_chars()
        self.token_bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.merge_rank.setdefault(pair, k)
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: text.encode() for text, i in self.special.items()}
        self.cut = regex.compile(PIECES)
        self.later = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER) + "]")
        self.cut_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.base = max(self.token_bytes) + 1
        self.ends = ahocorasick.Automaton()
        for i in self.rank:
            if self._builds(i):
                self.ends.add_word(self.token_bytes[i].decode("latin-1"), (i, len(self.token_bytes[i])))
        self.ends.make_automaton()
        self.words, self.known, self.pairs = Recent(WORDS_KEPT), Recent(PIECES_KEPT), Recent(PAIRS_KEPT)

    def _builds(self, token: int) -> bool:
        """Whether merging the token's own bytes gives this token."""
        pair = self.parts.get(token)
        return pair is None and len(self.token_bytes[token]) == 1 or pair is not None and self._fits(*pair, self.rank[token])

    def _fits(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether ``left`` and ``right`` stay apart side by side.

        Undoes the merges of both sides, latest first. Two neighbours of some moment would have merged if
        their pair comes before the merge that took one of them in; at the same rank the left one wins.
        """
        while True:
            if self.merge_rank.get((left, right), limit) < limit:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.parts[left][1]
            else:
                limit, right = b + 1, self.parts[right][0]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece."""
        if (ids := self.known.new.get(text)) is not None or (ids := self.known.again(text)) is not None:
            return ids
        raw = text.encode().decode("latin-1")
        last, size = [-1] * len(raw), [0] * len(raw)
        pairs, base = self.pairs, self.base
        for end, (token, length) in self.ends.iter(raw):
            if last[end] >= 0:
                continue
            if end >= length:
                before = last[end - length]
                pair = before * base + token
                fits = pairs.new.get(pair)
                if fits is None and (fits := pairs.again(pair)) is None:
                    fits = self._fits(before, token)
                    pairs.keep(pair, fits)
                if not fits:
                    continue
            last[end], size[end] = token, length
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        found = tuple(reversed(ids))
        if len(text) <= PIECE_CHARS:
            self.known.keep(text, found)
        return found

    def _cut(self, text: str) -> Iterator[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later.search(text):
                return (text[slice(*m.span())] for m in self.cut.finditer(self.later.sub(STAND_IN, text)))
        if len(text) <= 20 * CHUNK:
            return iter(self.cut.findall(text))
        return (m.group() for m in self.cut.finditer(text))

    def _pieces(self, text: str, out: list[int]) -> None:
        known, pieces = self.known, self._cut(text)
        while part := list(islice(pieces, CHUNK)):
            found = list(map(known.new.get, part))
            if None in found:
                found = [self.piece(p) if ids is None else ids for p, ids in zip(part, found)]
            out.extend(chain.from_iterable(found))

    def _word(self, text: str) -> bytes:
        """Packed ids of a space and what follows it up to the next space."""
        if (kept := self.words.again(text)) is not None:
            return kept
        ids: list[int] = []
        self._pieces(" " + text, ids)
        found = pack(ids)
        if len(text) <= PIECE_CHARS:
            self.words.keep(text, found)
        return found

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        ids: list[int] = []
        if len(text) > 20 * CHUNK or text.endswith(" ") or any(w in text for w in WIDE):
            self._pieces(text, ids)
            out.append(pack(ids))
            return
        first, *rest = text.split(" ")
        self._pieces(first, ids)
        out.append(pack(ids))
        found = list(map(self.words.new.get, rest))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(rest, found)]
        out += found

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; the strings of added tokens in it are those tokens."""
        out: list[bytes] = []
        at = 0
        if self.cut_special is not None:
            for m in self.cut_special.finditer(text):
                self._ordinary(text[at : m.start()], out)
                out.append(pack([self.special[m.group()]]))
                at = m.end()
        self._ordinary(text[at:] if at else text, out)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return unpack(self.packed(text))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``id``, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit), ``decoded`` per row of ``docs``.

    ``path`` names the vocabulary file on every executor. Null texts count as empty and give no ids and an
    empty text; repeated rows are encoded each; an empty table gives an empty one. Only the id and the text
    are read, so other columns may have any names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                counts, packed, texts = [], [], []
                for value in part.column(1):
                    packed.append(own.packed(value.as_py() or ""))
                    ids = unpack(packed[-1])
                    counts.append(len(ids))
                    texts.append(own.decode(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        work, "id long, n_tokens long, ids binary, decoded string"
    )
