import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics as me

NAMES = ["dos", "normal", "probe", "r2l", "u2r"]
# The published 7,500-flow confusion matrix.
PUBLISHED = [[2250, 0, 0, 0, 0], [0, 3975, 0, 0, 0], [0, 0, 825, 0, 0], [0, 3, 0, 371, 1], [0, 0, 0, 1, 74]]


def _rows(spark, matrix):
    cells = [(NAMES[i], NAMES[j], n) for i, line in enumerate(matrix) for j, n in enumerate(line) if n]
    df = spark.createDataFrame(cells, "truth string, predicted string, n int")
    return df.select("truth", "predicted", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def test_published_figures(spark):
    got = {r["metric"]: r["value"] for r in me.headline_metrics(_rows(spark, PUBLISHED), "truth", "predicted").collect()}
    want = {"accuracy": 0.9993, "precision_macro": 0.9966, "recall_macro": 0.9952, "f1_macro": 0.9959,
            "precision_weighted": 0.9993, "recall_weighted": 0.9993, "f1_weighted": 0.9993}
    assert {k: round(v, 4) for k, v in got.items()} == want
    report = {r["class"]: r for r in me.class_report(_rows(spark, PUBLISHED), "truth", "predicted", NAMES).collect()}
    assert [round(report[c]["f1"], 4) for c in NAMES] == [1.0, 0.9996, 1.0, 0.9933, 0.9867]
    assert report["macro avg"]["support"] == 7500


def test_perfect_and_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b")], "truth string, predicted string")
    got = {r["metric"]: r["value"] for r in me.headline_metrics(df, "truth", "predicted").collect()}
    assert got["accuracy"] == got["f1_macro"] == 1.0
    report = {r["class"]: r for r in me.class_report(df, "truth", "predicted", ["a", "b", "c"]).collect()}
    assert report["macro avg"]["f1"] == pytest.approx(2 / 3)  # the fixed list counts the absent class
    grid = me.confusion(df, "truth", "predicted", ["a", "b", "c"]).collect()
    assert len(grid) == 9 and all(r["share"] == 0.0 for r in grid if r["truth"] == "c")
    assert me.MacroF1(labelCol="truth", predictionCol="predicted").evaluate(df) == 1.0


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(5)
    rows = [(str(c), float(s)) for c, s in zip(rng.choice(["a", "b"], 300), rng.integers(0, 20, 300) / 20)]
    pos, neg = [s for c, s in rows if c == "a"], [s for c, s in rows if c == "b"]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    df = spark.createDataFrame(rows, "truth string, s double")
    got = me.auc_per_class(df, "truth", {"a": F.col("s"), "zzz": F.col("s")}).collect()
    assert {r["class"]: r["auc"] for r in got} == {"a": pytest.approx(want), "zzz": None}
    both = {"b": 1 - F.col("s"), "a": F.col("s")}
    assert me.auc_roc(df, "truth", both, ["b", "a"]).first()[0] == pytest.approx(want)
    assert math.isnan(me.auc_roc(df, "truth", {**both, "z": F.col("s")}, ["b", "a", "z"]).first()[0])
    points = sorted((r["fpr"], r["tpr"]) for r in me.roc_points(df, "truth", {"a": F.col("s"), "zzz": F.col("s")}).collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0) and len(points) == len({s for _, s in rows}) + 1
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(want)


def _curve(rows, name):
    """All points of a plain ROC curve, and those where it turns, from (score, truth) rows."""
    rank = lambda s: -math.inf if s is None else s
    steps = {}
    for score, truth in rows:
        step = steps.setdefault(rank(score), [0, 0])
        step[truth != name] += 1
    order = sorted(steps, key=lambda s: (1, 0.0) if s != s else (0, s), reverse=True)
    total = [sum(v[i] for v in steps.values()) for i in (0, 1)]
    points, turns, seen = [(0.0, 0.0)], [(0.0, 0.0)], [0, 0]
    for i, at in enumerate(order):
        seen = [a + b for a, b in zip(seen, steps[at])]
        points.append((seen[1] / total[1], seen[0] / total[0]))
        if i + 1 == len(order) or steps[at][0] * steps[order[i + 1]][1] != steps[at][1] * steps[order[i + 1]][0]:
            turns.append(points[-1])
    return points, turns


@pytest.mark.parametrize("cell_rows", [1, 1_000_000])
def test_cells_equal_a_plain_curve(spark, cell_rows):
    """Spread over 600 powers of ten, a heavy value, infinities, both zeros, nulls, and stretches of one class alone."""
    rng = np.random.default_rng(11)
    n = 6000
    score = np.where(rng.random(n) < 0.3, 0.25, np.where(rng.random(n) < 0.5, rng.random(n), 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n)))
    score[:6] = [math.inf, -math.inf, math.inf, 0.0, -0.0, 1.7e308]
    truth = np.where((score > 1e100) | (rng.random(n) < 0.2), "a", "b")
    rows = [(None if i % 97 == 0 and i > 6 else float(s), str(t)) for i, (s, t) in enumerate(zip(score, truth))]
    df = spark.createDataFrame([*rows, (0.5, None)], "s double, truth string").repartition(7)
    scores = {"a": F.col("s"), "b": -F.col("s"), "none": F.col("s")}
    order = np.array([-math.inf if s is None else s for s, _ in rows])
    hit = np.array([t == "a" for _, t in rows])
    # -inf and null are two thresholds; rows of the plain form keep them apart only by a value below -inf, so leave -inf out here.
    keep = ~np.isneginf(score)
    assert keep.sum() == n - 1
    plain = [r for r, k in zip(rows, keep) if k]
    exact = df.filter("s is null or s <> double('-Infinity')")
    values, hits = order[keep], hit[keep]
    below = np.sort(values[~hits])
    want = (np.searchsorted(below, values[hits], "left") + np.searchsorted(below, values[hits], "right")).mean() / 2 / len(below)
    got = {r["class"]: r["auc"] for r in me.auc_per_class(exact, "truth", scores, cell_rows).collect()}
    assert got["a"] == pytest.approx(want, rel=1e-12) and got["none"] is None and set(got) == {"a", "b", "none"}
    points, turns = _curve(plain, "a")
    for corners, expected in ((False, points), (True, turns)):
        found = me.roc_points(exact, "truth", {"a": F.col("s"), "none": F.col("s")}, corners, cell_rows).collect()
        assert {r["class"] for r in found} == {"a"}
        assert len(found) == len(expected)
        assert np.allclose(sorted((r["fpr"], r["tpr"]) for r in found), sorted(expected), rtol=0, atol=1e-12)
    assert len(turns) < len(points)
    assert me.auc_per_class(df, "truth", scores, cell_rows).count() == 3  # -inf is a score like others


def test_cells_of_odd_tables(spark):
    empty = spark.createDataFrame([], "s double, truth string")
    assert me.auc_per_class(empty, "truth", {"a": F.col("s")}).collect() == []
    assert me.roc_points(empty, "truth", {"a": F.col("s")}, corners=True).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (None, None)], "s double, truth string")
    assert me.auc_per_class(nulls, "truth", {"a": F.col("s")}).first()["auc"] == 0.5
    odd = spark.createDataFrame([(float("nan"), "a"), (1.0, "b"), (float("nan"), "b")], "s double, truth string")
    assert me.auc_per_class(odd, "truth", {"a": F.col("s")}).first()["auc"] == 0.75  # NaN is above all
    clean = spark.createDataFrame([(0.1 * i, "a" if i > 4 else "b") for i in range(10)], "s double, truth string")
    turns = me.roc_points(clean, "truth", {"a": F.col("s")}, corners=True).collect()
    assert sorted((r["fpr"], r["tpr"]) for r in turns) == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_weights_and_hits(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "a"), ("b", "b")], "label string, p string")
    assert {r["class"]: r["weight"] for r in me.balanced_weights(df).collect()} == {"a": pytest.approx(4 / 6), "b": 2.0}
    assert {r["class"]: (r["hits"], r["n"]) for r in me.hit_rate(df, "label", "p").collect()} == {"a": (2, 3), "b": (1, 1)}
