"""Embeddings, toxicity, URLs, chats, mixing and the pipeline against plain versions, and their odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_text_ops import ODD, docs_of
from tidewatch.llm import chat, embed_dedup, mixing, toxicity, urls
from tidewatch.llm.common import bit_filter, components, passes
from tidewatch.llm.queries import llm_oracles, llm_queries

# Shared helpers


def test_components_of_random_graphs(spark):
    random.seed(4)
    pairs = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(900, k) for k in range(800, 900)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bit_filter_misses_nothing(spark):
    values = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 4000)
    bits = bit_filter(spark.createDataFrame([(int(v),) for v in values[:2000]], "h long"), 20)
    let = passes(bits, values.view(np.uint64), 20)
    assert let[:2000].all() and let[2000:].mean() < 0.01


# Embeddings


def plain_links(rows, cosine):
    ok = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    links = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt(ok[a] @ ok[a]) / np.sqrt(ok[b] @ ok[b]) >= cosine:
                links[a].add(b)
    out = {}
    for k, (i, _) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        out[k] = (i, len(links[k]), min((rows[j][0] for j in reach), default=None) if i is not None else None)
    return sorted((i is None, i or 0, n, c or 0) for i, n, c in out.values())


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for centre in rng.normal(size=(12, 24)):
        rows += [centre + rng.normal(size=24) * s for s in rng.uniform(0, 0.33, 12)]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    rows += [(1000 + k, rows[3][1]) for k in range(40)] + [(2000, [2 * x for x in rows[3][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [1.0, None] * 12), (3004, [float("nan")] * 24), (3005, [float("inf")] * 24), (None, rows[3][1]), (3006, [1.0, 0.0]), (3007, [1.0, 0.1]), (0, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, bucket string, w int")
    found = embed_dedup.near_vectors(df, block=16, tables=16).collect()
    assert sorted((r.id is None, r.id or 0, r.n_links, r.component or 0) for r in found) == plain_links(rows, 0.95)
    assert all(r.kept == (r.id is None or r.id == r.component) for r in found)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_hashing_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = rng.normal(size=a.shape)
    off -= (off * a).sum(1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * off
    x, y = embed_dedup.buckets(a), embed_dedup.buckets(b)
    met = np.zeros(len(a), bool)
    for p in range(x.shape[1]):
        met |= (x[:, p][:, None] == y).any(1)
    assert met.mean() >= 0.95


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(embed_dedup.hadamard(x) @ embed_dedup.hadamard(x).T, x @ x.T)


# Toxicity


def test_toxicity_on_held_out_labels(spark):
    random.seed(6)
    vocab = ["".join(random.choices("abcdefgh", k=random.randint(3, 7))) for _ in range(400)]
    bad = ["zorgfool", "zorglump", "quxhead", "mizzle"]
    texts, truth = [], []
    for k in range(600):
        w = random.choices(vocab, k=60)
        if k % 5 == 0:
            for _ in range(3):
                w[random.randrange(60)] = random.choice(bad).upper() + random.choice(["", "!", ","])
        texts.append(" ".join(w))
        truth.append(int(k % 5 == 0))
    docs = docs_of(spark, texts + ODD)
    labels = spark.createDataFrame([(i, 1, truth[i]) for i in range(600)] + [(None, 1, 1), (5000, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    found = {r.id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(found) == len(texts) + len(ODD)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in found)
    held = [i for i in range(600) if found[i].held_out]
    assert np.mean([found[i].predicted == truth[i] for i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert all(found[600 + k].predicted == 0 for k in range(len(ODD)))
    # Labels of held-out rows are not read: turning them changes nothing.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.id: r.score for r in toxicity.score_toxicity(docs, turned).collect()}
    assert again == {i: r.score for i, r in found.items()}
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_label_model_finds_rates_and_correlations():
    rng = np.random.default_rng(2)
    label = rng.random(40_000) < 0.2
    hit, alarm = np.array([0.7, 0.6, 0.5, 0.4, 0.7]), np.array([0.02, 0.05, 0.01, 0.02, 0.02])
    votes = rng.random((40_000, 5)) < np.where(label[:, None], hit, alarm)
    copied = rng.random(40_000) < 0.6
    votes[copied, 4] = votes[copied, 0]
    codes, counts = np.unique(votes @ (1 << np.arange(5)), return_counts=True)
    model = toxicity.LabelModel(codes, counts.astype(float), 5, 0.5)
    # The pair of copies pulls the hidden label its way; the discount, not the rates, makes up for it.
    assert np.abs(model.rates[1][:4] - hit[:4]).max() < 0.15 and np.abs(model.rates[0][:4] - alarm[:4]).max() < 0.03
    assert model.correlations[0, 4] > 0.03 and model.weight[4] < 1 and (np.diag(model.correlations) == 0).all()
    assert np.mean((model.posterior(votes @ (1 << np.arange(5))) > 0.5) == label) > 0.93


# URLs

CASES = {
    "http://a.EXAMPLE.net/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
    "https://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "https://x.example.com/de/2": ("x.example.com", "/de/2", "example.com/de/", "block"),
    "ftp://q.org/fr/#z": ("q.org", "/fr/", "org/fr/", "allow"),
    "http://a.net": ("a.net", "", None, None),
    "http://a.net?x=/en/": ("a.net", "", None, None),
    "no scheme.net/": ("", "", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
    "x://y://z.net/": ("y:", "//z.net/", None, None),
    "http://ÄB.net/\n": ("Äb.net", "/\n", "net/", "block"),
}


def test_url_rules_and_trees(spark):
    random.seed(3)
    more = [f"http://s{random.randint(0, 9)}.{h}/{p}/{random.randint(0, 10**5)}" for _ in range(150) for h, p in [("example.net", "en"), ("example.com", "de"), ("shop.net", "x"), ("b.org", "fr")]]
    rest = [f"https://w{k}.other.net.invalid/x/{k}" for k in range(20)]
    rows = [*CASES, *more, *rest]
    pages = spark.createDataFrame([(k, u, "<p>", "h", 1.0) for k, u in enumerate(rows)], "page_id long, url string, html string, host string, label double")
    found = {r.id: r for r in urls.judge_urls(pages).collect()}
    assert len(found) == len(rows)
    for k, (host, path, rule, verdict) in enumerate(CASES.values()):
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == (verdict or found[k].verdict) and found[k].verdict in ("allow", "block")
    labelled = [r for r in found.values() if r.rule]
    assert np.mean([(r.score >= 0.5) == (r.verdict == "block") for r in labelled]) > 0.97
    assert urls.judge_urls(pages.limit(0)).count() == 0
    alone = urls.judge_urls(pages.where("url like 'https://w%'"))
    assert {r.verdict for r in alone.collect()} == {"allow"}


def test_entropy_feature(spark):
    row = urls.lexical(spark.createDataFrame([("aabb", "", ""), (None, "", "")], "url string, host string, path string")).collect()
    assert row[0].entropy == pytest.approx(1.0) and row[1].entropy == 0.0


# Chats


def plain_chats(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t, r, x))
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for c in convs:
        convs[c].sort(key=lambda t: (low(t[0]), text(t[1]), text(t[2])))
    turns = {c: [t[1:] for t in v] for c, v in convs.items()}
    rank = lambda c: (c is None, c or 0)
    kept = [c for c, v in turns.items() if not any(d != c and w[: len(v)] == v and (len(w) > len(v) or rank(d) < rank(c)) for d, w in turns.items())]
    return {c: "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{x or ''}<|im_end|>\n" for r, x in turns[c]) for c in kept}


def test_chats_equal_plain_version(spark):
    random.seed(12)
    rows = []
    for c in range(60):
        for t in range(random.randint(1, 5)):
            rows.append((c, t, random.choice(["user", "bot"]), random.choice(["a", "b"])))
    rows += [(100, t, "user", f"m{t}") for t in range(7)] + [(101, t, "user", f"m{t}") for t in range(3)] + [(99, t, "user", f"m{t}") for t in range(7)]
    rows += [(200, 0, None, None), (201, 0, None, ""), (202, 0, "", None), (203, 0, None, None), (None, 0, "user", "lone"), (None, 1, "user", "lone"), (204, None, "user", "x"), (204, None, "user", "y"), (100, 0, "user", "m0"), (205, 1, "a", "b c"), (206, 1, "a b", "c")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "conv_id long, turn long, role string, text string, pos int, h1 string")
    parts = chat.format_chats(df, turns_per_part=2).collect()
    found = {}
    for r in sorted(parts, key=lambda r: r.part):
        found[r.conv] = found.get(r.conv, "") + r.text
    assert found == plain_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


# Mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while over := {s for s in names if s not in full and target[s] > 3 * sizes[s] + 1e-9}:
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        full |= over
        for s in over:
            target[s] = 3 * sizes[s]
        open_ = [s for s in names if s not in full]
        for s in open_:
            target[s] += excess * weight[s] / sum(weight[x] for x in open_)
    return target


def test_targets_equal_stepwise_resharing(spark):
    random.seed(1)
    for _ in range(6):
        sizes = {f"s{k}": random.choice([0, 3, 40, 1000, 20_000]) for k in range(random.randint(1, 9))} | {None: 50}
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        found = {r.source: r.target for r in mixing.targets(df).collect()}
        want = plain_targets(sizes)
        assert found == {s: pytest.approx(want[s], rel=1e-9, abs=1e-6) for s in sizes}


def test_mix_meets_targets(spark):
    random.seed(7)
    texts = ["w " * random.randint(1, 60) for _ in range(1500)] + ODD[:3]
    source = lambda k: None if k % 50 == 0 else "hot" if k % 3 else f"s{k % 5}"
    rows = [(k, t, source(k), "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int")
    found = mixing.mixed(docs, levels=2).collect()
    assert len(found) == len(texts)
    assert sorted((r.id, r.copies, r.shards) for r in found) == sorted((r.id, r.copies, r.shards) for r in mixing.mixed(docs.repartition(7), levels=2).collect())
    sums = {}
    for r in found:
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies and all(0 <= s < 4 for s in r.shards)
        own = sums.setdefault(r.source, [r.source_size, r.target, 0, 0])
        own[2] += r.copies * r.size
        own[3] += r.size
    want = plain_targets({s: v[3] for s, v in sums.items()})
    for s, (size, target, taken, total) in sums.items():
        assert size == total and target == pytest.approx(want[s]) and abs(taken - target) <= 30
    shards = np.bincount([s for r in found for s in r.shards], minlength=4)
    assert shards.min() > 0.3 * shards.max()
    out = mixing.mix(docs, levels=2)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in found)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert all(r.copies == 0 for r in mixing.mixed(docs.where("doc_id >= 1500")).collect())


def test_hypergeometric_law(spark):
    draws = spark.range(4000).select(mixing.hypergeometric(F.lit(60.0), F.lit(20.0), F.lit(30.0), mixing.uniform("id", 1)).alias("k")).collect()
    k = np.array([r.k for r in draws])
    assert abs(k.mean() - 10) < 0.15 and abs(k.var() - 30 * (1 / 3) * (2 / 3) * 30 / 59) < 0.35 and k.min() >= 0 and k.max() <= 20
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(t), F.lit(g), F.lit(d), F.lit(0.5)).alias(n) for n, t, g, d in [("a", 5.0, 5.0, 2.0), ("b", 5.0, 0.0, 2.0), ("c", 0.0, 0.0, 0.0), ("d", 5.0, 3.0, 5.0)]]).first()
    assert tuple(edge) == (2.0, 0.0, 0.0, 3.0)


def test_tree_hands_on_exact_quotas(spark):
    quotas = {"a": 17, "b": 200, None: 3, "c": 0}
    tree = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "source string, blocks long"), levels=3).collect()
    for source, n in quotas.items():
        own = sorted((r.shard, r.n, r.before) for r in tree if r.source == source)
        assert sum(x[1] for x in own) == n and len(own) == 8
        assert all(x[2] == sum(y[1] for y in own[:k]) for k, x in enumerate(own))
    loads = [sum(r.n for r in tree if r.shard == s) for s in range(8)]
    assert max(loads) - min(loads) <= 3


# Pipeline and queries


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        docs.write.mode("overwrite").parquet(path := f"{spark.sparkContext.getCheckpointDir()}/test-{name}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == counts[4]
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, bytes(r["ids"])) for r in whole) == sorted((r.doc_id, r.n_tokens, bytes(r["ids"])) for r in last)


def test_one_query_for_each_operator():
    names = [n for n in llm_queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(llm_oracles()) <= set(names)
