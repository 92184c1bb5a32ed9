"""The forest: bags, splits, subtrees by node size, the same fit however rows are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import forest as fo
from flowlens.session import scratch_path


def _table(spark, n, parts):
    x = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000 for i in range(4)]
    return spark.range(n).repartition(parts).select(
        "id", *[c.alias(f"x{i}") for i, c in enumerate(x)], F.when(x[0] + x[1] > 1, F.when(x[2] > 0.5, 2).otherwise(1)).otherwise(0).alias("y"))


FEATURES = [f"x{i}" for i in range(4)]


def _fit(df, group_rows, trees=8):
    return fo.fit(df, FEATURES, "y", 3, trees, 42, 30, 128, group_rows)


def _probs(forest, df):
    return {r.id: r.p for r in fo.probabilities(forest, df, "p").select("id", "p").collect()}


def test_bags_are_poisson_and_copies_count():
    digest = np.arange(40_000, dtype=np.uint64) * np.uint64(7919)
    for copies in (1, 7, 500):
        w = fo.bag_weights(digest, np.full(len(digest), copies), 3, 42)
        assert w.mean() == pytest.approx(copies, rel=0.02) and w.var() == pytest.approx(copies, rel=0.05)
    a, b = (fo.bag_weights(digest, np.ones(len(digest), np.int64), t, 42) for t in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.03


def test_best_split_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        counts = rng.integers(0, 4, (2, 6, 3)).astype(float)
        counts[1, 0] += counts[0].sum(0)  # the same rows in both features' bins
        counts[1, 1:] = 0
        s, v = np.nonzero(counts.any(2))
        total = counts[0].sum(0)
        gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
        gains = {b: gini(total) - sum(c.sum() / total.sum() * gini(c) for c in (counts[0, :b + 1].sum(0), counts[0, b + 1:].sum(0)))
                 for b in range(5) if counts[0, :b + 1].sum() and counts[0, b + 1:].sum()}
        _, slot, value, left = fo.best_splits(np.zeros(len(s), np.int64), s, v, counts[s, v], total[None])
        if len(slot):
            assert slot[0] == 0 and gains[value[0]] == pytest.approx(max(gains.values()))
            assert (left[0] == counts[0, :value[0] + 1].sum(0)).all()
        else:
            assert max(gains.values(), default=0) < 1e-9


@pytest.mark.parametrize("group_rows", [20_000, 150])
def test_fit_does_not_depend_on_dealing(spark, group_rows):
    seen, unseen = _table(spark, 1500, 2), _table(spark, 2200, 3).where("id >= 1500")
    forest = _fit(seen, group_rows)
    tops = max(len(t.feature) for t in forest.tops)
    assert (tops == 1) == (group_rows == 20_000)
    got = _probs(forest, unseen)
    assert got == _probs(_fit(_table(spark, 1500, 7), group_rows), unseen.repartition(5))
    assert all(sum(p) == pytest.approx(1, abs=1e-5) for p in got.values()) and len(got) == 700
    truth = {r.id: r.y for r in unseen.collect()}
    assert np.mean([np.argmax(p) == truth[i] for i, p in got.items()]) > 0.9
    learnt = _probs(forest, seen)  # grown to purity
    assert np.mean([np.argmax(learnt[r.id]) == r.y for r in seen.collect()]) > 0.98


def test_no_group_holds_more_than_its_rows(spark):
    df = _table(spark, 3000, 2)
    sizes = [len(r.feature) // 4 for r in _fit(df, 200, 3).subtrees.select("feature").collect()]
    assert len(sizes) > 30 and max(sizes) < 400  # a subtree of n rows has fewer than 2 n nodes


def test_saved_forest_scores_alike_and_odd_rows_score(spark):
    df = _table(spark, 400, 2)
    forest = _fit(df, 50, 1)
    path = scratch_path(spark, "t_forest")
    forest.save(path)
    odd = df.unionByName(spark.createDataFrame(
        [(-1, None, float("nan"), float("inf"), -1e300, 0), (-1, 0.1, 0.1, 0.1, 0.1, 0)], df.schema))
    back = fo.load(spark, path)
    assert _probs(back, df) == _probs(forest, df)
    assert fo.probabilities(back, odd, "p").count() == 402
    assert fo.probabilities(back, df.limit(0), "p").count() == 0


def test_rows_that_cannot_be_told_apart_end_in_a_leaf(spark):
    df = spark.range(900).select("id", *[F.lit(1.0).alias(c) for c in FEATURES], (F.col("id") % 3).cast("int").alias("y"))
    got = _probs(_fit(df, 100), df)
    assert len({tuple(p) for p in got.values()}) == 1 and min(got[0]) > 0.25
