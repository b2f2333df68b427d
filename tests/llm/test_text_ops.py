"""Quality, SimHash, personal data, substrings and encoding against plain versions, and their odd inputs."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import pii, quality_llr, simhash_ball, substring
from tidewatch.llm.bpe import Codec, encode_decode
from tidewatch.llm.queries import vocabulary
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "one two", "ü ñ — 日本", "a b", "x" * 5000, "a b " * 3000]


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts))]
    # Extra columns with names that the operators use themselves.
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as id", "'c' as kept", "2 as size", "'r' as raw", "3 as component", "'t' as _text")


def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# SimHash


def plain_print(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_plain_version(spark):
    docs = small(spark)
    prints = {i: plain_print(t) for i, t in texts_of(docs).items()}
    found = {r.id: (r.fp % (1 << 64), r.component) for r in simhash_ball.near_copies(docs).collect()}
    want = plain_components(prints)
    assert found == {i: (prints[i], want[i]) for i in prints}


def test_simhash_links_chains_over_two_bits(spark):
    prints = {1: 0, 2: 0b11, 3: 0b1111, 4: 0b1111111, 5: 1 << 63, 6: (1 << 63) | 1 << 40}
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    edges = simhash_ball.ball_edges(spark.createDataFrame(signed, "id long, fp long"))
    from tidewatch.llm.common import components

    found = {r.node % (1 << 64): r.component for r in components(edges).collect()}
    want = plain_components(prints)
    for a in prints:
        for b in prints:
            assert (want[a] == want[b]) == (a == b or found.get(prints[a], -a) == found.get(prints[b], -b))


def test_simhash_odd_texts(spark):
    docs = docs_of(spark, [*ODD, "one", None], [*range(len(ODD)), 20, None])
    found = {r.id: r.component for r in simhash_ball.near_copies(docs).collect()}
    assert found[20] == 3 and found[None] == 0 and found[1] == found[2] == 0
    kept = simhash_ball.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in {found[i] for i in found if i is not None} | {None})
    assert simhash_ball.keep_one(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    docs = small(spark)
    prints = {i: plain_print(t) for i, t in texts_of(docs).items()}
    kept = corpus_pipeline.near_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(plain_components(prints).values()))
    odd = docs_of(spark, ["one two three four", "ONE  two three\nfour", "", None, "one two", "one two"], [4, 3, 2, 1, None, None])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_copies(spark, odd, SMALL).collect()) == [(False, 1), (False, 3), (True, 0), (True, 0)]
    assert corpus_pipeline.near_copies(spark, docs.limit(0), SMALL).count() == 0


# Quality


def plain_base(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {x for x in three if three.count(x) > 1} if len(three) < 3000 else {x for x, n in Counter(three).items() if n > 1}
    marked = {j for k, x in enumerate(three) if x in many for j in range(k, k + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked)


@pytest.mark.parametrize("text", [*ODD, "a\nb\na\n \n \na", "a b c a b c", "a a a a", "#*$ | <x> é%\r\n#*$ | <x> é%"])
def test_base_counts(text):
    assert quality_llr.base_counts((text or "").encode()) == plain_base(text)


def test_quality_keeps_good_and_drops_junk(spark):
    random.seed(5)
    vocab = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(500)]
    good = [" ".join(random.choices(vocab, k=80)) + "." for _ in range(120)]
    junk = [" ".join(w + random.choice(["***", "$$$", "&&&"]) for w in random.choices(vocab, k=80)) for _ in range(60)]
    docs = docs_of(spark, good + junk + ODD)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 180, 2)] + [(0, 1, 0), (500, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = {r.id: r for r in quality_llr.judge(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(found[i].kept for i in range(120)) and not any(found[i].kept for i in range(120, 180))
    assert all(found[180 + k].base_failed for k in range(len(ODD)))
    kept = quality_llr.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 120
    assert quality_llr.judge(docs.limit(0), labels).count() == 0
    none = quality_llr.judge(docs, labels.limit(0))
    assert none.where("kept").count() == 180


def test_quality_score_is_the_mean_ratio(spark):
    docs = small(spark).limit(60)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {r.doc_id for r in labels.where("quality = 0").collect()}
    counts = np.zeros((2, quality_llr.CELLS))
    own = {}
    for i, text in texts_of(docs).items():
        flat = b" " + b" ".join((text or "").encode().split()) + b" "
        cells = [(int.from_bytes(flat[k : k + 4], "big") * int(quality_llr.MULTIPLIER) % (1 << 64)) >> 48 for k in range(len(flat) - 3)]
        own[i] = cells
        for c in cells:
            counts[0, c] += 1
            counts[1, c] += i in good
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * quality_llr.CELLS)
    for r in quality_llr.judge(docs, labels).collect():
        want = np.mean([logs[1, c] - logs[0, c] for c in own[r.id]]) if own[r.id] else 0.0
        assert r.score == pytest.approx(want, abs=1e-9)


def plain_threshold(scores, trusted):
    good, bad = np.sort(scores[trusted]), np.sort(scores[~trusted])
    if not len(good):
        return float("-inf")
    bound = good[int(quality_llr.TRUSTED_LOSS * len(good))]
    if not len(bad):
        return float(bound)
    cuts = np.unique(scores)
    gain = np.searchsorted(bad, cuts) / len(bad) - np.searchsorted(good, cuts) / len(good)
    middles = [(cuts[k] - cuts[k - 1], (cuts[k] + cuts[k - 1]) / 2) if k else (0.0, cuts[0]) for k in np.flatnonzero(gain == gain.max())]
    return float(min(bound, max(middles)[1]))


def test_quality_threshold_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    for good, bad, digits in ((0, 5, 12), (1, 1, 12), (600, 0, 12), (3000, 2000, 12), (3000, 2000, 1), (1500, 1, 0)):
        scores = np.round(np.concatenate([rng.normal(1, 1, good), rng.normal(-1, 1, bad)]), digits) + 0.0
        trusted = np.arange(good + bad) < good
        rows = spark.createDataFrame([(float(s), int(t)) for s, t in zip(scores, trusted)], "score double, mark int")
        assert quality_llr.threshold(rows) == plain_threshold(scores, trusted), (good, bad, digits)


def test_quality_cut_counts_every_labelled_text(spark):
    n = 20_000
    word = F.concat(F.substring(F.md5(F.concat_ws(":", "id", "w")), 1, 5), F.when(F.col("id") % 2 == 1, "").when(F.col("w") % 5 == 0, "***").otherwise(""))
    docs = spark.range(2 * n).withColumn("w", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("word", word)
    docs = docs.groupBy(F.col("id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x.word), " ").alias("text")).cache()
    # Three quarters are trusted, odd-looking ones too, and none rejected: the cut is the loss bound among 30,000 scores.
    labels = docs.where("doc_id % 4 != 2").select("doc_id", F.lit(1).alias("quality"))
    rows = quality_llr.judge(docs, labels).join(labels, F.col("id") == F.col("doc_id")).select("score", "cut", "quality", "base_failed").toPandas()
    assert len(rows) == 1.5 * n and not rows.base_failed.any()
    cut = plain_threshold(rows.score.to_numpy(), (rows.quality == 1).to_numpy())
    assert set(rows.cut) == {cut}
    # The pipeline's stage goes by the same cut; texts without a label are below it or not like any other.
    lost = {r.doc_id for r in docs.select("doc_id").subtract(quality_llr.keep_good(docs, labels).select("doc_id")).collect()}
    assert len([i for i in lost if i % 4 != 2]) == int((rows.score < cut).sum()) == int(quality_llr.TRUSTED_LOSS * len(rows))


def test_stages_keep_unlike_texts_of_one_id_and_null_ids(spark):
    random.seed(8)
    vocab = ["".join(random.choices("abcdefghij", k=6)) for _ in range(900)]
    good = [" ".join(random.choices(vocab, k=80)) for _ in range(6)]
    docs = docs_of(spark, [*good, "too short"], [1, 2, 2, None, None, 3, 2])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality_llr.keep_good(docs, labels)
    assert sorted(r.text for r in kept.collect()) == sorted(good)
    assert sorted(r.text for r in simhash_ball.keep_one(kept).collect()) == sorted(good)


# Personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((m.start(), n, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_base_spans_equal_plain_regexes():
    random.seed(11)
    for _ in range(20_000):
        text = "".join(random.choices("ab1249.@-+% ()\n_é", k=random.randint(0, 45)))
        assert [s[:3] for s in pii.base_spans(text)] == plain_spans(text), text
    for text in ["1.2.3.4.5.6.7.8", "a@b.c@d.e", "4111 1111 1111 1111", "+1 (377) 555-0271", "a" * 50_000 + "@x", "9" * 50_000, "é ü@x.de"]:
        assert [s[:3] for s in pii.base_spans(text)] == plain_spans(text) or len(text) > 40_000


def test_terms_that_reveal_an_entity(spark):
    texts = [f"please write to Zorblatt the clerk at anna.k@site{7}.example.com now or later" for _ in range(5)]
    texts += ["please write to the clerk at the desk now or later"] * 20 + ODD
    docs = docs_of(spark, texts)
    found = {r.id: r.spans for r in pii.personal_data(docs).collect()}
    assert len(found) == len(texts)
    terms = {texts[i][s.start : s.end] for i, spans in found.items() for s in spans if s.kind == "term"}
    assert terms == {"Zorblatt"}
    assert all([s[:3] for s in map(tuple, found[i]) if s[2] != "term"] == plain_spans(texts[i]) for i in found)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    got = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    want = "please write to  the clerk at [EMAIL] now or later"
    assert got[0] == (want, len(want)) and got[10][0] == texts[10] and got[25][0] is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_disclosure_equals_its_formula(spark):
    texts = ["Quix met bob@a.example.com"] * 4 + ["Quix again", "nothing here", "met them", "met us", "one", "two"]
    docs = docs_of(spark, texts)
    found = pii.personal_data(docs, disclosed=0.5)
    terms = {(r.x.entity) for r in found.select(F.explode("spans").alias("x")).collect() if r.x.kind == "term"}
    share = {"quix": np.log(10 * 4 / (5 * 4)) / np.log(10 / 4), "met": np.log(10 * 4 / (6 * 4)) / np.log(10 / 4)}
    assert terms == {t for t, v in share.items() if v >= 0.5}


def test_terms_of_a_mail_domain_and_of_two_documents(spark):
    filler = [f"plain words number {k} of no meaning" for k in range(60)]
    domain = [f"Quorvex wrote {k} from user{k}@quor.example.com" for k in range(4)]
    pair = [f"text {k} Hapaxo and card 4111 1111 1111 1111" for k in range(2)]
    docs = docs_of(spark, [*domain, *pair, "Solitary met one@else.example.net", *filler])
    terms = {s.entity for r in pii.personal_data(docs).collect() for s in r.spans if s.kind == "term"}
    assert {"quorvex", "hapaxo"} <= terms and not terms & {"solitary", "plain", "words"}


def test_terms_far_from_the_entity_and_in_other_texts(spark):
    far = " ".join(["filler"] * 30)
    texts = [f"Zorblatt, the clerk {far} mail anna.k@site7.example.com {far} signed (Zorblatt)" for _ in range(6)]
    texts += ["a letter by Zorblatt, and no address"] + ["the clerk and mail, signed, no address, a letter by filler"] * 40
    docs = docs_of(spark, texts, [*range(46), None])
    found = sorted(((r.id, r.spans) for r in pii.personal_data(docs).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    marked = [[texts[k][s.start : s.end] for s in spans if s.kind == "term"] for k, (_, spans) in enumerate(found)]
    assert marked == [["Zorblatt"] * 2] * 6 + [["Zorblatt"]] + [[]] * 40
    assert "Zorblatt" not in " ".join(r.text for r in pii.sanitise(docs).collect())


# Substrings


def plain_repeats(docs, window):
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text in docs.items():
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings_equal_plain_version(spark):
    docs = small(spark)
    found = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()}
    assert found == plain_repeats(texts_of(docs), 50)


def test_substrings_few_words_short_windows(spark):
    random.seed(2)
    texts = [" ".join(random.choices("ab", k=random.randint(0, 60))) for _ in range(80)] + [" ".join(["same"] * 40)] * 30 + ODD
    docs = docs_of(spark, texts)
    found = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window=8, gram=2).collect()}
    assert found == plain_repeats(dict(enumerate(texts)), 8)
    twins = docs_of(spark, ["w " * 60, "w " * 60, "w " * 60], [4, 4, None])
    assert all(r.n_removed == 0 for r in substring.remove_repeats(twins).collect())
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_rows_of_one_id_with_unlike_texts(spark):
    shared = " ".join(f"s{k}" for k in range(10))
    long, short = " ".join(f"l{k}" for k in range(60)) + " " + shared, "x y " + shared
    docs = docs_of(spark, [shared, long, short, short, "z " + shared], [1, 7, 7, 7, None])
    found = sorted((r.id or 0, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs, window=8, gram=2).collect())
    assert found == sorted([(1, 10, 0, shared), (7, 70, 10, long.removesuffix(" " + shared)), (7, 12, 10, "x y"), (7, 12, 10, "x y"), (0, 11, 0, "z " + shared)])


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 3, 45, 300):
        assert (substring.sliding_least(values, width) == [values[k : k + width].min() for k in range(300 - width + 1)]).all()


# Encoding


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary())


def test_codec_equals_library(library):
    own = Codec(vocabulary())
    random.seed(9)
    pool = [c for c in map(chr, [*range(0x20, 0x600), *range(0x2000, 0x2070), *range(0x1F600, 0x1F640), 0x3E3C9, 0x323B5, 0x1C89])]
    odd = [" ", "  ", "\n", "\t", "'s", "'re", "'T", "<|endoftext|>", "aaaa", " ", " ", "\x85", "\x1c"]
    for _ in range(6_000):
        text = "".join(random.choice(odd) if random.random() < 0.6 else random.choice(pool) for _ in range(random.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, repr(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
    assert own.decode([237, 231]) == library.decode([237, 231], skip_special_tokens=False)


def test_encode_decode_table(spark, library):
    texts = [*ODD, "It's <|endoftext|> done", "naïve  café\n\n x"]
    docs = docs_of(spark, texts)
    found = {r.id: r for r in encode_decode(docs, vocabulary()).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids) and bytes(found[i]["ids"]) == np.array(ids, "<u4").tobytes() and found[i].decoded == (text or "")
    assert encode_decode(docs.limit(0), vocabulary()).count() == 0


def test_small_vocabulary_merge_order(tmp_path, library):
    # Overlapping merges: the earlier rank, then the left pair, wins.
    shown = {"a": 0, "b": 1, "c": 2}
    merges = [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "a"], ["aa", "aa"]]
    vocab = dict(shown)
    for left, right in merges:
        vocab.setdefault(left + right, len(vocab))
    spec = json.loads(open(vocabulary(), encoding="utf-8").read())
    spec["model"]["vocab"], spec["model"]["merges"], spec["added_tokens"] = vocab, merges, []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    import tokenizers

    lib, own = tokenizers.Tokenizer.from_file(str(path)), Codec(str(path))
    for n in range(3**7):
        text = "".join("abc"[n // 3**k % 3] for k in range(7))
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_query_digest_columns(spark):
    from tidewatch.llm.queries import llm_queries

    texts = texts_of(small(spark))
    for r in llm_queries()["op8_substring"](spark, SMALL).limit(20).collect():
        assert r.n_words == len(words(texts[r.doc_id])) and (r.n_removed or r.kept_sha256 == hashlib.sha256(" ".join(words(texts[r.doc_id])).encode()).hexdigest())
