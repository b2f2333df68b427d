"""Personal data: exact patterns, and terms that give the found persons away.

E-mail addresses, IP addresses, card and phone numbers are protected entities; so is the group each belongs to (mail
domain, address or number without its last part), which repeats where single entities do not. The corpus says how
strongly a term reveals an entity: with document counts n, the pointwise mutual information of term t and entity
e against the information that e itself carries,

    disclosure(t, e) = (1 - CHANCE ^ n(t, e)) log(N n(t, e) / (n(t) n(e))) / log(N / n(e)),

where the quotient is 1 if t never occurs without e, and the factor smooths it: the fewer documents show both, the less
it counts. A document shows both wherever in it they stand. Terms at or above a threshold for some entity are
generalised (numbers, to their form) or removed (words), wherever they stand in any text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bit_filter, written

KINDS = ["email", "ip", "card", "phone", "term"]
#: Smoothing, the weight of chance in one shared document; disclosure threshold.
CHANCE, DISCLOSED = 0.4, 0.8
#: Cells of the fixed-size filter of candidate terms.
FILTER_BITS = 22
#: Terms whose counts a task sums up before it hands them on.
TERMS_AT_ONCE = 200_000

EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
NUMBER = re.compile(r"[0-9][0-9.,:/-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Before an @ the pattern can only begin where the run of its characters begins: runs are walked once.
    done = 0
    for m in EMAIL_END.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in EMAIL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the patterns, by start, then kind. Code points, end exclusive."""
    found = []
    if "@" in text:
        found += [(a, b, "email", text[a:b].lower()) for a, b in _emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            parts = m.group().split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                found.append((*m.span(), "ip", ".".join(p.lstrip("0") or "0" for p in parts)))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card", digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 9 <= len(digits) <= 15:
                found.append((*m.span(), "phone", "+" + digits))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def term_of(word: str) -> str | None:
    """A word without the signs around it, lowered; None for words of fewer than three letters or digits."""
    m = TERM.search(word)
    return m.group().lower() if m and m.end() - m.start() >= 3 else None


def generalised(term: str) -> str:
    """What is left of a disclosing term: the form of a number, nothing of a word."""
    return re.sub("[0-9]", "0", term) if NUMBER.fullmatch(term) else ""


def groups(kind: str, entity: str) -> list[str]:
    """Names of what a term can reveal: the entity, and its mail domain, address without the last part or number without the last four digits."""
    group = {"email": lambda: "@" + entity.rpartition("@")[2], "ip": lambda: entity.rpartition(".")[0] + ".*"}.get(kind, lambda: entity[:-4] + "*")()
    return [f"{kind}:{entity}", f"{kind}:{group}"]


def free_words(text: str, spans: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, str]]:
    """(start, word) of the words outside all spans (by start)."""
    k, done = 0, 0
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            done = max(done, spans[k][1])
            k += 1
        if m.start() >= done:
            yield m.start(), m.group()


def company(text: str, spans: list[tuple[int, int, str, str]]) -> list[str]:
    """The different terms of a text with entities, outside all of them."""
    return sorted({term_of(w) for w in {w for _, w in free_words(text, spans)}} - {None}) if spans else []


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entity", pa.string())])


def _cell(term: str) -> int:
    return xxhash.xxh64_intdigest(term, 42) >> (64 - FILTER_BITS)


def wanted_terms(packed: np.ndarray) -> Callable[[str], str | None]:
    """``term_of`` for words whose terms pass the filter, None for the others; remembers a bounded number of words."""
    own = np.unpackbits(packed).view(bool)
    known: dict[str, str | None] = {}

    def find(word: str) -> str | None:
        if word in known:
            return known[word]
        term = term_of(word)
        if term is not None and not own[_cell(term)]:
            term = None
        if len(known) >= TERMS_AT_ONCE:
            known.clear()
        known[word] = term
        return term

    return find


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosed: float = DISCLOSED) -> DataFrame:
    """Pairs ``term``, ``entity`` at or above the threshold. ``found``: rows with ``spans``, ``entities`` and ``terms``; ``docs``: all texts (``text``), for the counts."""
    sure = 1 - F.pow(F.lit(CHANCE), F.col("n_both"))
    n = docs.count()
    own = F.log(n / F.col("n_entity"))
    # 0 where all documents show the entity: then a term tells nothing.
    share = lambda n_term: F.when(own > 0, sure * F.log(n * F.col("n_both") / (F.col(n_term) * F.col("n_entity"))) / own).otherwise(0.0)
    pairs = found.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    # The quotient is 1 at most: pairs whose factor is below the threshold cannot reach it, whatever the other counts.
    together = pairs.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_both")).where(sure >= disclosed)
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # A term stands in at least the documents with entities that show it: pairs that this count puts below the threshold
    # stay below it with all documents counted, so only the others are looked for in all texts.
    least = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    together = written(together.join(least, "term").join(entities, "entity").where(share("n_least") >= disclosed).drop("n_least"))
    # The filter has a fixed size whatever the number of candidates; what passes it by chance falls out of the join.
    packed = bit_filter(together.select(F.xxhash64("term").alias("h")), FILTER_BITS)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = wanted_terms(packed)
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for value in batch.column(0):
                words = {w.decode() for w in (value.as_py() or b"").split()} if packed.any() else ()
                terms = {term for word in words if (term := find(word)) is not None}
                sums.update(terms)
            if len(sums) >= TERMS_AT_ONCE:
                yield out()
                sums = Counter()
        if sums:
            yield out()

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(seen, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return together.join(counts, "term").select("term", "entity", share("n_term").alias("disclosure")).where(F.col("disclosure") >= disclosed)


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``id``, ``hash`` and ``terms``, the spans of all occurrences of ``terms`` (``term``) outside entities, of the texts in ``docs`` (``id``, ``text``, ``hash``) that have any."""
    terms = written(terms)
    # The filter has a fixed size whatever the number of terms; what passes it by chance falls out of the join.
    packed = bit_filter(terms.select(F.xxhash64("term").alias("h")), FILTER_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = wanted_terms(packed)
        for batch in batches:
            at, begins, ends, found = [], [], [], []
            for k, value in enumerate(batch.column(1) if packed.any() else ()):
                text = value.as_py()
                if not any(find(w) is not None for w in {w.decode() for w in text.encode().split()}):
                    continue
                for start, word in free_words(text, base_spans(text)):
                    if (term := find(word)) is not None:
                        inner = TERM.search(word)
                        at.append(k)
                        begins.append(start + inner.start())
                        ends.append(start + inner.end())
                        found.append(term)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string())], ["id", "hash", "start", "end", "term"])

    hits = docs.select("id", "text", "hash").mapInArrow(places, "id long, hash long, start int, end int, term string").join(terms, "term")
    return hits.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "end", F.lit("term").alias("kind"), F.col("term").alias("entity"))).alias("terms"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosed: float = DISCLOSED, with_text: bool = False) -> DataFrame:
    """One row ``row``, ``id``, ``spans`` (array of ``start``, ``end``, ``kind``, ``entity`` by start, then kind), with the text if asked, per row of ``docs``.

    Null texts count as empty and have no spans; repeated rows are documents of their own, in the counts too.
    Spans of different kinds may overlap; a kind's own do not. ``term`` spans stand wherever the term does, also
    in texts without the entity that it reveals, but not inside other spans. An empty table gives an empty one.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, entities, terms = [], [], []
            for value in batch.column(2):
                text = value.as_py()
                own = base_spans(text)
                spans.append([dict(zip(("start", "end", "kind", "entity"), s)) for s in own])
                entities.append(sorted({g for _, _, kind, entity in own for g in groups(kind, entity)}))
                terms.append(company(text, own))
            names = ["row", "id", "hash", "spans", "entities", "terms"]
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(spans, pa.list_(SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))]
            if with_text:
                arrays, names = [*arrays, batch.column(2)], [*names, "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    shape = "row long, id long, hash long, spans array<struct<start:int,end:int,kind:string,entity:string>>, entities array<string>, terms array<string>"
    found = written(texts.mapInArrow(scan, shape + (", text string" if with_text else "")))
    terms = term_places(texts, disclosing_terms(found, texts, disclosed).select("term").distinct())
    # By id and text: the places of a text are the same in each of its rows, and row numbers need not be in a second reading.
    terms = terms.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("terms").alias("_terms"))
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat("spans", F.coalesce("_terms", F.array().cast("array<struct<start:int,end:int,kind:string,entity:string>>")))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(s.start, F.array_position(order, s.kind).alias("rank"), s.end, s.kind, s.entity)))
    spans = F.transform(ranked, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s.entity.alias("entity")))
    out = found.drop("terms").join(terms, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").withColumn("spans", spans)
    return out.select("row", "id", "spans", *(["text"] if with_text else []))


def sanitised(text: str, spans: list[dict]) -> str:
    """The text with patterns replaced by their kind and terms generalised or removed; overlapping spans become one."""
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], generalised(s["entity"]) if s["kind"] == "term" else f"[{s['kind'].upper()}]"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with sanitised texts, and their length in ``length_col`` where there is such a column.

    Null texts stay null and rows are neither lost nor repeated: only texts with a span are touched, by id and text.
    """
    found = personal_data(docs, id_col, text_col, with_text=True).where(F.size("spans") > 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [sanitised(text.as_py(), spans.as_py()) for text, spans in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(new, pa.string())], ["_id", "_hash", "_new"])

    changed = found.select("id", "text", "spans", F.xxhash64("text").alias("hash")).mapInArrow(work, "_id long, _hash long, _new string").dropDuplicates(["_id", "_hash"])
    same = docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_hash"))
    text = F.coalesce("_new", docs[text_col])
    columns = [text.alias(c) if c == text_col else F.when(F.col("_new").isNotNull(), F.length("_new").cast(dict(docs.dtypes)[c])).otherwise(docs[c]).alias(c) if c == length_col else docs[c] for c in docs.columns]
    return docs.join(changed.hint("merge"), same, "left").select(*columns)
