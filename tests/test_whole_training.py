"""The whole training run: trees grown to purity on the rows' own values, every split
the best there is, a report by class and a saved version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import forest as fo
from flowlens.plans import training
from flowlens.session import scratch_path
from flowlens.sources import bundle as bd


def _fit(spark, x, y, trees=1, group_rows=20_000, ranges=128, depth=None):
    x = np.asarray(x, float).reshape(len(y), -1)
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))],
                               f"id long, {', '.join(f'{n} double' for n in names)}, y int")
    return df, fo.fit(df, names, "y", int(max(y)) + 1, trees, 42, depth, ranges, group_rows)


def _right(df, forest):
    rows = fo.probabilities(forest, df, "p").select("y", "p").collect()
    return np.mean([int(np.argmax(r.p)) == r.y for r in rows])


def test_one_tree_tells_all_values_apart(spark):
    """More values than ranges, and labels that change with every value."""
    y = np.random.default_rng(1).integers(0, 2, 600)
    assert _right(*_fit(spark, np.arange(600), y)) == 1
    assert _right(*_fit(spark, np.arange(600), y, group_rows=100, ranges=4)) == 1


def test_a_tree_is_as_deep_as_its_rows_ask():
    n = 60  # a class a row: all cuts are equal, and the first takes one row off
    x = np.tile(np.arange(n, dtype=np.float32)[:, None], 2)
    tree, probs = fo.grow(x, np.arange(n), np.ones(n), n, None, 42, 0, 0)
    depth, todo = 0, [(0, 0)]
    while todo:
        node, d = todo.pop()
        depth = max(depth, d)
        if tree.feature[node] >= 0:
            todo += [(tree.child[node], d + 1), (tree.child[node] + 1, d + 1)]
    assert (probs.max(1) == 1).all() and len(probs) == n and depth == n - 1
    capped = fo.grow(x, np.arange(n), np.ones(n), n, 2, 42, 0, 0)[1]
    assert len(capped) == 3


def test_a_split_that_gains_nothing_and_drawn_constants_do_not_end_a_tree(spark):
    x = [(a, b) for a in (0, 1) for b in (0, 1)] * 5
    assert _right(*_fit(spark, x, [a ^ b for a, b in x])) == 1
    hidden = np.zeros((40, 30))
    hidden[:, 17] = np.arange(40)
    for rows in (20_000, 8):  # also above the gathered nodes
        assert _right(*_fit(spark, hidden, np.arange(40) % 3, group_rows=rows)) == 1


def _brute(x, y, w, c):
    """(score, cut) of the best splits of one feature."""
    out = []
    values = np.unique(x)
    for a, b in zip(values, values[1:]):
        left = np.bincount(y[x <= a], w[x <= a], c)
        out.append((float(fo.split_score(left, np.bincount(y, w, c))), float(a) / 2 + float(b) / 2))
    return out


def test_running_scores_and_bounds_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n, c = 40, 4
        x, y, w = np.sort(rng.integers(0, 25, n)), rng.integers(0, c, n), rng.integers(1, 4, n).astype(float)
        total, none = np.bincount(y, w, c), np.zeros(n, int)
        score = fo.running_scores(none, none, y, w, total[None])
        last = np.flatnonzero(np.diff(x))
        assert score[last] == pytest.approx([s for s, _ in _brute(x, y, w, c)])
        before, more = rng.integers(0, 9, (1, c)).astype(float), rng.integers(0, 5, (1, c)).astype(float)
        corners = [before[0] + more[0] * [(k >> j) & 1 for j in range(c)] for k in range(1 << c)]
        assert fo.most(before, more)[0] == pytest.approx(max((z ** 2).sum() / max(z.sum(), 1) for z in corners))


@pytest.mark.parametrize("ranges", [2, 5, 128])
def test_large_nodes_get_the_best_split_whatever_the_ranges(spark, ranges):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400).astype(np.float32)
    y = ((x > 0.13) ^ (rng.random(400) < 0.2)).astype(int) + 0
    forest = _fit(spark, x, y, group_rows=399, ranges=ranges)[1]
    top = forest.tops[0]
    best = max(_brute(x, y, np.ones(400), 2))
    assert top.feature[0] == 0 and top.cut[0] == pytest.approx(best[1], abs=1e-12)


def test_the_forest_does_not_change_with_the_ranges(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] + x[:, 1] > 0) + 2 * (x[:, 2] > 1)
    got = []
    for ranges in (3, 128):
        df, forest = _fit(spark, x, y, trees=4, group_rows=120, ranges=ranges)
        got.append({r.id: r.p for r in fo.probabilities(forest, df, "p").select("id", "p").collect()})
    assert got[0] == got[1] and max(len(t.feature) for t in forest.tops) > 3


def test_training_saves_what_it_measured_and_reports_by_class(spark):
    df = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit(1.0).alias("y"),
                                 F.when(F.col("id") % 10 < 5, "calm").when(F.col("id") % 10 < 8, "flood").otherwise("scan").alias("label"))
    root = scratch_path(spark, "t_trained")
    for version in (1, 2):
        r = training.train_pipeline(df, "label", ["x", "y"], ["id"], benign="calm", num_trees=3, root=root)
        assert (r.root, r.version, bd.current_version(spark, root)) == (root, version, version)
    back = bd.load_bundle(spark, root)
    assert back.metrics == r.bundle.metrics == r.metrics.first().asDict()
    assert (back.contract, back.classes, back.scaler) == (["x", "y"], ["calm", "flood", "scan"], r.bundle.scaler)
    report = {x.row: x for x in r.report.collect()}
    assert set(report) == {"calm", "flood", "scan", "accuracy", "macro avg", "weighted avg"}
    pred = r.test_predictions.select("label_idx", "predicted").collect()
    for i, name in enumerate(back.classes):
        assert report[name].support == sum(p.label_idx == i for p in pred)
    assert report["accuracy"].f1 == pytest.approx(r.bundle.metrics["accuracy"])
    assert report["weighted avg"].precision == pytest.approx(r.bundle.metrics["precision"])
    assert bd.current_version(spark, training.train_pipeline(df, "label", ["x", "y"], ["id"], "calm", num_trees=1).root) == 1
