"""Invariants: split, quotas, ranks, AUC against MLlib, stream against batch."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from flowlens.operators import evaluation, sampling
from flowlens.plans import fixtures as fx
from tests.conftest import SF_MID, SF_SMALL


def test_split_is_disjoint_complete_and_share_preserving(spark):
    o = fx.table(spark, SF_MID, "orders")
    s = sampling.stratified_split(o, "o_orderpriority", ["o_orderkey"], 0.2).cache()
    assert s.count() == o.count()
    assert s.select("o_orderkey").distinct().count() == o.count()
    shares = s.groupBy("o_orderpriority").agg(F.avg((F.col("split") == "test").cast("double")).alias("t"))
    for r in shares.collect():
        assert abs(r.t - 0.2) < 0.002
    n_test = s.filter("split = 'test'").count()
    assert n_test == -(-o.count() * 2 // 10)


def test_two_level_rank_equals_plain_row_number(spark):
    o = fx.table(spark, SF_MID, "orders")
    ranked, _ = sampling.group_rank(o, "o_orderpriority", ["o_orderkey"], 42, bucket_hex=2)
    digest = F.md5(F.concat_ws("|", F.lit("42"), F.col("o_orderkey").cast("string")))
    plain = o.withColumn("rank", F.row_number().over(
        Window.partitionBy("o_orderpriority").orderBy(digest)).cast("bigint"))
    a = ranked.select("o_orderkey", "rank")
    b = plain.select("o_orderkey", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_adaptive_bucket_depth_keeps_ranks(spark, monkeypatch):
    # a tiny target forces deeper buckets (as a group with a third of a huge
    # table would); the ranks must equal the plain per-group row_number
    o = fx.table(spark, SF_MID, "orders")
    monkeypatch.setattr(sampling, "TARGET_BUCKET_ROWS", 5)
    ranked, sizes = sampling.group_rank(o, "o_orderpriority", ["o_orderkey"], 42, bucket_hex=1)
    digest = F.md5(F.concat_ws("|", F.lit("42"), F.col("o_orderkey").cast("string")))
    plain = o.withColumn("rank", F.row_number().over(
        Window.partitionBy("o_orderpriority").orderBy(digest)).cast("bigint"))
    a = ranked.select("o_orderkey", "rank")
    b = plain.select("o_orderkey", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert sizes.agg(F.sum("group_size")).first()[0] == o.count()
    top, _ = sampling.group_rank(o, "o_orderpriority", ["o_orderkey"], 42, max_rank=3, bucket_hex=1)
    assert sorted(r["rank"] for r in top.collect()) == sorted([1, 2, 3] * 5)


def test_chunked_draws_equal_single_task_draws(spark, monkeypatch):
    o = fx.table(spark, SF_SMALL, "orders")
    quotas = spark.createDataFrame([("1-URGENT", 25), ("5-LOW", 3), ("2-HIGH", 0)], "label string, quota bigint")
    one, _ = sampling.stratified_sample(o, "o_orderpriority", ["o_orderkey"], quotas)
    ref = {(r["o_orderpriority"], r["draw_no"], r["o_orderkey"]) for r in one.collect()}
    monkeypatch.setattr(sampling, "DRAW_CHUNK", 4)
    many, _ = sampling.stratified_sample(o, "o_orderpriority", ["o_orderkey"], quotas)
    got = [(r["o_orderpriority"], r["draw_no"], r["o_orderkey"]) for r in many.collect()]
    assert len(got) == 28 and set(got) == ref


def test_finer_score_ranges_keep_roc_and_auc(spark, monkeypatch):
    pt = fx.probability_table(spark, SF_SMALL)
    auc = {r["class"]: r.auc for r in evaluation.auc_ovr(pt, "actual", "probs").collect()}
    roc = sorted(tuple(r) for r in evaluation.roc_points(pt, "actual", "probs").collect())
    monkeypatch.setattr(evaluation, "RANGE_TARGET_SCORES", 2)
    auc2 = {r["class"]: r.auc for r in evaluation.auc_ovr(pt, "actual", "probs").collect()}
    roc2 = sorted(tuple(r) for r in evaluation.roc_points(pt, "actual", "probs").collect())
    assert auc2.keys() == auc.keys() and all(abs(auc2[k] - auc[k]) < 1e-12 for k in auc)
    assert roc2 == roc


def test_chunked_timeline_ticks_equal_single_sequence(spark, monkeypatch):
    from flowlens.operators import detection
    ev = fx.table(spark, SF_SMALL, "events")

    def run():
        t = detection.intensity_timeline(ev, "user_id", "ts", "event_type", "view", 2 * 86_400_000, 3_600_000)
        return sorted(tuple(r) for r in t.collect())
    whole = run()
    monkeypatch.setattr(detection, "TICK_CHUNK", 7)
    assert run() == whole and len(whole) > 0


def test_quotas_sum_to_n(spark):
    o = fx.table(spark, SF_MID, "orders")
    q = sampling.quota_proportional(o, "o_orderstatus", 777)
    assert q.agg(F.sum("quota")).first()[0] == 777


def test_auc_matches_mllib_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    pt = fx.probability_table(spark, SF_SMALL)
    ours = {r["class"]: r.auc for r in evaluation.auc_ovr(pt, "actual", "probs").collect()}
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", metricName="areaUnderROC", numBins=0)
    from pyspark.ml.functions import array_to_vector
    for c in (0, 3, 7):
        df = pt.select((F.col("actual") == c).cast("double").alias("y"),
                       array_to_vector(F.array(1 - F.col("probs")[c], F.col("probs")[c])).alias("raw"))
        assert ours[c] == pytest.approx(ev.evaluate(df), abs=1e-12)


def test_roc_ends_at_one_one(spark):
    pt = fx.probability_table(spark, SF_SMALL)
    roc = evaluation.roc_points(pt, "actual", "probs")
    ends = roc.groupBy("class").agg(F.max("fpr").alias("f"), F.max("tpr").alias("t")).collect()
    assert all(r.f == 1.0 and r.t == 1.0 for r in ends)


def test_stream_intensity_equals_batch_twin(spark):
    q = E.queries()
    s = q["stream_intensity"](spark, SF_SMALL).filter("kind = 'change'").select("event_id", "previous_level",
                                                                              "level")
    b = q["level_changes"](spark, SF_SMALL).select("event_id", "previous_level", "level")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_sample_library_caps_each_attack_label(spark):
    out = E.queries()["sample_library"](spark, SF_MID)
    counts = {r.event_type: r["count"] for r in out.groupBy("event_type").count().collect()}
    assert counts and all(v == 5 for v in counts.values()) and "view" not in counts


def test_training_pipeline_small(spark):
    from flowlens.plans import training
    from flowlens.plans.catalog.model import EMB_FEATURES, embedding_flows
    r = training.train_pipeline(embedding_flows(spark, SF_SMALL), "label", EMB_FEATURES, ["vec_id"],
                                benign="0", num_trees=10, max_depth=8)
    m = r.bundle.metrics
    assert set(m) == {"accuracy", "precision", "recall", "f1", "fpr", "auc"}
    assert 0.0 <= m["accuracy"] <= 1.0 and 0.0 <= m["auc"] <= 1.0
    assert r.test_predictions.count() == 100
    # the recorded accuracy is the confusion-matrix accuracy of the test predictions
    acc = r.test_predictions.agg(F.avg((F.col("label_idx") == F.col("predicted")).cast("double"))).first()[0]
    assert m["accuracy"] == pytest.approx(acc)
