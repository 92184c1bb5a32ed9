"""Null groups, runs and times; history and streams that start anew."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions.digest import order_digest
from flowlens.operators import detection, sampling
from flowlens.plans.catalog.streaming import _score_events
from flowlens.session import scratch_path
from flowlens.sources import records
from flowlens.streaming import detect

T0 = dt.datetime(2024, 1, 1)


def test_split_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(25)], "id long, label string")
    rows = sampling.stratified_split(df, "label", ["id"]).collect()
    assert sorted(r.id for r in rows) == list(range(25)) and {r.split for r in rows} == {"train", "test"}
    assert sum(r.split == "test" for r in rows) == 5 and any(r.split == "test" for r in rows if r.label is None)


def test_a_null_run_counts_and_a_null_time_has_no_level(spark):
    rows = [(i, None, T0 + dt.timedelta(seconds=i), "DDoS") for i in range(8)] + [
        (20, 1, T0, "DDoS"), (21, 1, None, "DDoS"), (22, None, None, "DDoS")]
    df = spark.createDataFrame(rows, "id long, run long, ts timestamp_ntz, label string")
    out = detection.sliding_attack_count(df, "run", "ts", "label", "BENIGN", 60_000).collect()
    got = {r.id: (r["count"], r.level) for r in out}
    assert len(out) == len(rows) and got[7] == (8, "Medium") and got[0] == (1, "Low") and got[20] == (1, "Low")
    assert got[21] == got[22] == (None, None)
    times = detection.sliding_attack_times(df, "run", "ts", "label", "BENIGN", 60_000, "id")
    changed = detection.level_changes(times, "run", "ms", "id").collect()
    assert [(r.run, r.id, r.previous_level, r.level) for r in changed] == [(None, 5, "Low", "Medium")]


def test_the_place_of_a_null_key_matters(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(order_digest(1, "x", "y", "z")).distinct().count() == 2


def test_runs_never_replace_each_other(spark):
    df = spark.createDataFrame([(i, T0, "DDoS", 9.0) for i in range(5)],
                               "event_id long, ts timestamp_ntz, event_type string, value double")
    first = _score_events(df)
    path = scratch_path(spark, "t_history")
    records.append_history(first, path, "a", 0)
    records.append_history(first, path, "b", 0)
    records.append_history(first, path, "b", 0)  # retried
    assert records.read_history(spark, path).count() == 10
    hist, alerts = scratch_path(spark, "t_h"), scratch_path(spark, "t_a")
    for k in range(2):  # a stream started twice, each time with a new checkpoint and new input
        src = scratch_path(spark, "t_src")
        df.withColumn("event_id", F.col("event_id") + 10 * k).write.parquet(src)
        detect.run_detection_stream(spark.readStream.schema(df.schema).parquet(src), _score_events, hist, alerts,
                                    scratch_path(spark, "t_ck"))
    for path in (hist, alerts):
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_only_an_absent_metric_record_has_defaults(spark):
    path = scratch_path(spark, "t_metrics")
    assert records.read_metrics(spark, path).first().source == "default"
    os.makedirs(path)
    with open(os.path.join(path, "part-0.json.gz"), "w") as broken:
        broken.write("not a gzip file")
    with pytest.raises(Exception):  # noqa: B017 - whatever the reader raises must not become a zero record
        records.read_metrics(spark, path).collect()


def test_draws_of_a_null_label(spark):
    df = spark.createDataFrame([(i, None if i < 10 else "b") for i in range(15)], "id long, label string")
    quotas = spark.createDataFrame([(None, 4), ("b", 3), ("none", 2)], "label string, quota int")
    sample, missing = sampling.stratified_sample(df, "label", ["id"], quotas)
    rows = sample.collect()
    assert sum(r.label is None for r in rows) == 4 and sum(r.label == "b" for r in rows) == 3
    assert [tuple(r) for r in missing.collect()] == [("none", 2)]


@pytest.mark.parametrize("target, copies", [(2_000_000, 1), (3, 1), (3, 7)])
def test_split_by_selection_equals_ranking(spark, monkeypatch, target, copies):
    monkeypatch.setattr(sampling, "TARGET_BUCKET_ROWS", target)
    df = spark.createDataFrame([(i // copies, "abc"[i % 3] if i % 10 else None) for i in range(700)], "id long, label string")
    got = sampling.stratified_split(df, "label", ["id"]).collect()
    quotas = {r.label: r.test_quota for r in sampling.split_quotas(df, "label").collect()}
    for label, quota in quotas.items():
        own = [r for r in got if r.label == label]
        order = sorted(hashlib.md5(f"42|{r.id}".encode()).hexdigest() for r in own)
        test = [hashlib.md5(f"42|{r.id}".encode()).hexdigest() for r in own if r.split == "test"]
        assert sorted(test) == order[:quota]
    assert len(got) == 700 and set(quotas) == {"a", "b", "c", None}


def test_rank_directory_finds_every_rank(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(300)], "id long, label string")
    draws = spark.createDataFrame([(g, r) for g in "ab" for r in (1, 2, 75, 150, 75)], "label string, rank long")
    got = sorted((r.label, r["rank"], r.id) for r in sampling.rows_at(df, "label", ["id"], draws, bucket_hex=4).collect())
    want = []
    for g in "ab":
        ids = sorted((i for i in range(300) if "ab"[i % 2] == g), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        want += [(g, r, ids[r - 1]) for r in (1, 2, 75, 150, 75)]
    assert got == sorted(want)
