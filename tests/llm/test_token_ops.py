"""Runs of words, languages and token alignment against plain versions, and their odd inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, language, periodic, token_align
from tidewatch.llm.queries import llm_queries, vocabulary
from tests.conftest import SMALL
from tests.llm.test_text_ops import DOCS, ODD, docs_of, small, texts_of, words

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


# Runs


def plain_runs(codes):
    n, found = len(codes), {}
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and codes[end] == codes[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q):
                found.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(draw):
    codes = []
    for _ in range(draw.randint(1, 4)):
        letters, q = draw.choice([1, 2, 2, 3, 50]), draw.choice([1, 2, 3, 7, 8, 9, 12, 16, 17, 25, 31, 32, 33, 40, 64, 65])
        base = [draw.randrange(letters) for _ in range(q)]
        codes += [base[i % q] for i in range(int(q * draw.choice([1, 2, 3.9, 4, 4.1, 5, 9])))]
        codes += [draw.randrange(letters) for _ in range(draw.choice([0, 0, 1, 7]))]
    return codes


def test_runs_equal_plain_version():
    draw = random.Random(5)
    total = 0
    for _ in range(400):
        codes = repetitive(draw)
        want = plain_runs(codes)
        total += len(want)
        assert periodic.find_runs(np.array(codes)) == want, codes
    assert total > 1000


def test_long_period_in_a_long_text():
    draw = random.Random(1)
    base = [draw.randrange(10**6) for _ in range(20_000)]
    codes = np.array([-1, -2] + base * 5 + base[:77] + [-3])
    assert periodic.find_runs(codes) == [(2, 100_077, 20_000)]
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_best_run_compares_exactly():
    assert periodic.best_run([]) is None
    assert periodic.best_run([(0, 3 * 10**17 + 1, 10**17), (5, 3 * 10**17 + 2, 10**17)]) == (5, 3 * 10**17 + 2, 10**17)
    assert periodic.best_run([(0, 8, 2), (1, 16, 4), (9, 4, 1)]) == (0, 8, 2)


def plain_collapse(doc_id, text):
    w = words(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        len(runs), *((top[0] + (1000 * top[0][1] // top[0][2],)) if top else (None,) * 4),
        digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_query_equals_plain_version(spark):
    short = {i: t for i, t in texts_of(small(spark)).items() if len(words(t)) < 700}
    assert len(short) > 100
    found = {r.doc_id: tuple(r)[1:] for r in llm_queries()["op11_periodic"](spark, SMALL).collect()}
    assert set(found) == set(texts_of(small(spark)))
    assert {i: found[i] for i in short} == {i: plain_collapse(i, t) for i, t in short.items()}


def test_runs_odd_texts(spark):
    found = periodic.collapse_runs(docs_of(spark, ODD)).orderBy("id").collect()
    assert [r.n_words for r in found] == [len(words(t)) for t in ODD]
    assert [tuple(x) for x in found[-1].runs] == [(0, 6000, 2)] and found[-1].collapsed == "a b"
    assert all(r.runs == [] and r.best is None and r.collapsed == " ".join(words(t)) for r, t in zip(found[:-1], ODD[:-1]))
    twice = periodic.collapse_runs(docs_of(spark, ["x " * 9, "x " * 9, None], [None, None, 3]), prepare=periodic.plant_runs).collect()
    assert sorted((r.id is None, r.collapsed) for r in twice) == [(False, ""), (True, "x"), (True, "x")]
    assert periodic.collapse_runs(spark.createDataFrame([], DOCS)).count() == 0


# Language


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.predict_language(docs).alias("f").join(docs.alias("d"), F.col("f.id") == F.col("d.doc_id"))
    rows = found.select("held_out", "lang_pred", "score", "lang", "id", F.length("text").alias("n")).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.n >= 30]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_language_never_learns_from_held_out_labels(spark):
    docs = small(spark)
    turned = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = (language.train(d, train_rows=200, steps=20)[1].parts for d in (docs, turned))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_language_slopes_equal_differences():
    draw = np.random.default_rng(3)
    network = language.ByteNetwork(3)
    x, y = draw.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    loss = lambda: -language.Reader(network).log_probabilities(x)[np.arange(5), y].mean()
    slope = network._slope(x, y)
    for name, part in network.parts.items():
        at = np.unravel_index(np.abs(slope[name]).argmax(), part.shape)
        part[at] += 1e-3
        up = loss()
        part[at] -= 2e-3
        down = loss()
        part[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(slope[name][at], rel=0.1, abs=2e-3), name


def test_windows_hold_every_group_of_bytes():
    for n in (0, 1, 127, 128, 129, 252, 253, 254, 1000):
        raw = bytes(k % 251 + 1 for k in range(n))
        rows = language.windows_of(raw)
        seen = {bytes(r[k : k + 4]) for r in rows for k in range(language.WINDOW - 3)}
        assert rows.shape[1] == language.WINDOW and all(raw[k : k + 4] in seen for k in range(n - 3))


def test_language_odd_texts(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", None, "", " 12 34 !", "ß", "the " * 40_000, "und die"]
    rows = [(i, t, lang, None, 0) for i, (t, lang) in enumerate(zip(texts, ["en", "de", "en", "de", "en", None, "en", "de"]))]
    docs = spark.createDataFrame(rows + [(None, "the end", "xx", None, 0)] * 2, DOCS).selectExpr("*", "1 as id", "'x' as raw", "2 as score")
    found = language.predict_language(docs).collect()
    assert len(found) == 10
    by_id = {r.id: r for r in found}
    assert [by_id[k].lang_pred for k in (2, 3, 4)] == ["und"] * 3 and by_id[2].score == 0.0
    assert by_id[6].lang_pred in ("en", "de") and not by_id[None].held_out and by_id[None].lang_pred != "xx"
    nothing = language.predict_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.predict_language(spark.createDataFrame([], DOCS)).count() == 0


# Alignment


def plain_alignment(texts):
    al = token_align.Aligner(A, B)
    out, counts = {}, Counter()
    for i, text in texts.items():
        a, b = al.a.library.encode(" " + (text or ""), add_special_tokens=False).ids, al.b.library.encode(text or "")
        own_a, own_b = [al.a.token_bytes[k] for k in a], [al.b.token_bytes[k] for k in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(own_a) != whole or b"".join(own_b) != whole:
            out[i] = (0, 0, 0, [], "")
            continue
        at_a = [k for k, t in enumerate(own_a) for _ in t]
        at_b = [k for k, t in enumerate(own_b) for _ in t]
        links = [(a[x], b[y]) for x, y in dict.fromkeys(zip(at_a, at_b))]
        groups, low_a, low_b = [], 0, 0
        for k in range(len(whole)):
            if k + 1 == len(whole) or at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]:
                groups.append(",".join(map(str, a[low_a : at_a[k] + 1])) + "|" + ",".join(map(str, b[low_b : at_b[k] + 1])))
                low_a, low_b = at_a[k] + 1, at_b[k] + 1
        out[i] = (len(a), len(b), len(groups), links, ";".join(groups))
        counts.update(set(links))
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return {
        i: (n_a, n_b, n_groups, len(links), text, sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links))
        for i, (n_a, n_b, n_groups, links, text) in out.items()
    }


TOKENS = [
    *ODD, "  two  spaces ", " lead", "trail ", "tab\there", "line\n\n next", "<|endoftext|> <s> </s>", "a▁b c", "▁", "café café", "　wide　", "nul\x00 byte",
    "퟿  \U0010ffff", "don't we'll I'M", "x" * 3000 + " y", " " * 2500 + "y", "1234567 3.14", "日本語 テキスト", "🙂🙂 🙂", "the cat", "the cat", "ﬁne ½",
]


def test_alignment_equals_plain_version(spark):
    texts = texts_of(small(spark)) | {10**6 + k: t for k, t in enumerate(TOKENS)}
    docs = small(spark).unionByName(docs_of(spark, TOKENS).select(*small(spark).columns).withColumn("doc_id", F.col("doc_id") + 10**6))
    want = plain_alignment(texts)
    found = {r.id: tuple(r)[1:] for r in token_align.align_tokens(docs.withColumn("block", F.lit(1)).withColumn("a", F.lit(2)), A, B).collect()}
    assert found == want
    assert token_align.align_tokens(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_alignment_forgets_and_cuts_blocks(spark, monkeypatch):
    texts = dict(list(texts_of(small(spark)).items())[:60]) | {10**6 + k: t for k, t in enumerate(TOKENS)}
    own = token_align.Aligner(A, B)
    monkeypatch.setattr(token_align, "KEPT", 500)
    want = plain_alignment(texts)
    for i, text in texts.items():
        windows = own.cut([text or ""])[0]
        got = b";".join(own.windows.texts[k] for k in windows).decode() if windows else ""
        assert got == want[i][4]
        own.tidy()
    assert len(own.words) < 3000


def test_fast_encoder_equals_library():
    own = token_align.ByteLevel(A)
    assert own.fast is not None
    draw = random.Random(2)
    marks = ["\n", " ", "  ", "\t", "é", "—", "日", "🙂", "'s", "12", "A", "z", " ", "­", "́", "ᛮ"]
    for text in TOKENS + ["".join(draw.choice(marks) for _ in range(60)) for _ in range(300)]:
        text = " " + (text or "")
        assert own.encode(text) == own.library.encode(text, add_special_tokens=False).ids, text


def test_alignment_query_digests(spark):
    found = {r.doc_id: r for r in llm_queries()["op13_align"](spark, SMALL).collect()}
    want = plain_alignment(texts_of(small(spark)))
    assert set(found) == set(want)
    for i, (n_a, n_b, n_groups, n_links, text, n_best, count_sum) in want.items():
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, n_best, count_sum)
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if n_a else "")


def test_codec_remembers_little_and_encodes_the_same(monkeypatch):
    rng = random.Random(5)
    rare = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(3000)]
    texts = [" ".join(["a", "common", *rare[k : k + 20], "common,"]) for k in range(0, len(rare), 20)] + ["", " ", "x" * 100, "á é \U0001f600"]
    want = [bpe.Codec(vocabulary()).packed(t) for t in texts[:3]] + [bpe.Codec(vocabulary()).packed(t) for t in texts[-4:]]
    for name, most in (("WORDS_KEPT", 300), ("PIECES_KEPT", 100), ("PAIRS_KEPT", 200)):
        monkeypatch.setattr(bpe, name, most)
    own = bpe.Codec(vocabulary())
    met = own.packed(texts[0])
    first = own.words.new["common"]
    every = [met, *map(own.packed, texts[1:])]
    assert [*every[:3], *every[-4:]] == want
    assert all(len(m.new) <= m.most and len(m.old) <= m.most for m in (own.words, own.known, own.pairs))
    # What is frequent outlasts a full table: it is the very object made for the first text.
    assert (own.words.new.get("common") or own.words.old.get("common")) is first
    # Entries of a worker, new and old, are about half of the 2,200,000 held before.
    monkeypatch.undo()
    assert 2 * (bpe.WORDS_KEPT + bpe.PIECES_KEPT + bpe.PAIRS_KEPT) <= 1_200_000
