"""JSON bodies, header names and label dictionaries that one clean file never shows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import cleaning, detection, labels, profile
from flowlens.session import wide_table_mode
from flowlens.sources import flows

BODIES = {
    '{"features":[1,2,3]}': "ok",
    '{"features":"[1,2,3]"}': "not_list",
    "{'features':[1,2,3]}": "malformed",
    '{"features":[1,2,3]} junk': "malformed",
    '{"features":[1,2,3]},{"a":1}': "malformed",
    "1],[2": "malformed",
    "": "malformed",
    None: "malformed",
    '{"features":[NaN,1,2]}': "ok",
    '{"features":[Infinity,1,2]}': "ok",
    '{"features":[1,2]}': "bad_length",
    '{"features":null}': "not_list",
    '{"features":{"a":1}}': "not_list",
    '{"features":[9],"features":[1,2,3]}': "ok",
    '[{"features":[1,2,3]}]': "missing",
    '{"x":1}': "missing",
    "3": "missing",
}


def test_request_bodies(spark):
    df = spark.createDataFrame([(b,) for b in BODIES], "body string")
    got = {r.body: r.status for r in cleaning.validate_requests(df, "body", 3).collect()}
    assert got == BODIES


def test_dotted_names(spark):
    df = spark.createDataFrame([(1.0, None), (float("inf"), 2.0)], "`len.1` double, b double")
    assert [tuple(r) for r in cleaning.fill_for_scoring(df, ["len.1", "b"]).collect()] == [(1.0, 0.0), (0.0, 2.0)]
    assert [tuple(r) for r in cleaning.align_features(df, ["b", "len.1", "c"]).collect()] == [
        (None, 1.0, 0.0), (2.0, float("inf"), 0.0)]
    assert cleaning.clean_for_training(df).count() == 0
    assert profile.quality_report(df, ["len.1", "b"]).count() == 2


def test_repeated_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Fwd Len, a, Fwd Len,x10,x1,Label\n1,2,3,4,5,Z\n")
    df = flows.read_flows(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Fwd Len", "a", "Fwd Len_1", "x10", "x1", "Label"]
    assert tuple(df.first()) == (1.0, 2.0, 3.0, 4.0, 5.0, "Z")
    (tmp_path / "b.csv").write_text("f0,f1,f2,Label\n1,2,3,Z\n")  # numbers of their own stay
    assert flows.read_flows(spark, str(tmp_path / "b.csv")).columns == ["f0", "f1", "f2", "Label"]


def test_label_dictionary_above_the_broadcast_limit(spark, monkeypatch):
    df = spark.createDataFrame([(c,) for c in "qwertyuiopaq"], "label string")
    monkeypatch.setattr(labels, "MAX_BROADCAST_ROWS", 3)
    got = {r.label: r.label_idx for r in labels.encode_labels(df, "label").collect()}
    assert got == {c: i for i, c in enumerate(sorted(set("qwertyuiopa")))}


def test_constraint_setting_is_restored(spark):
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), wide_table_mode(spark):
        assert spark.conf.get(key) == "false"
        raise ValueError
    assert spark.conf.get(key) == before


def test_correlations_of_many_columns(spark):
    names = [f"f{i}" for i in range(30)]
    df = spark.range(200).select(*((F.rand(i) + F.col("id") * (i % 3)).alias(n) for i, n in enumerate(names)))
    got = {(r.feature_a, r.feature_b): r.pearson for r in profile.feature_correlations(df, names).collect()}
    assert len(got) == 30 * 29 // 2
    for a, b in (("f0", "f29"), ("f1", "f2"), ("f28", "f29")):
        assert got[a, b] == pytest.approx(df.stat.corr(a, b), abs=1e-9)


def test_timeline_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(detection, "TICK_RANGE", 3)
    monkeypatch.setattr(detection, "TICK_CHUNK", 4)
    times = [0, 5, 5, 120, 121, 400, 2000]
    df = spark.createDataFrame([("r", t, "x") for t in times] + [(None, 7, "x")], "run string, t long, label string") \
        .withColumn("ts", F.timestamp_millis("t"))
    out = detection.intensity_timeline(df, "run", "ts", "label", "BENIGN", window_ms=100, tick_ms=10)
    got = {(r.run, r.tick_ms): r["count"] for r in out.collect()}
    want = {("r", k): sum(t <= k <= t + 100 for t in times) for k in range(0, 2111, 10)}
    want |= {(None, k): int(7 <= k <= 107) for k in range(10, 111, 10)}
    assert got == want


def test_correlations_over_common_rows(spark, monkeypatch):
    monkeypatch.setattr(profile, "BLOCK_ROWS", 3)
    big = 1e9
    rows = [(big + i, (i * 7 % 5) * 1.0, None if i % 3 else i * 1.0, 4.0, float("inf") if i == 2 else 1.0 * i, None)
            for i in range(20)]
    names = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    got = {(r.feature_a, r.feature_b): r.pearson for r in profile.feature_correlations(df, names).collect()}
    for i, x in enumerate(names):
        for j in range(i + 1, 6):
            both = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if any(math.isinf(v) for p in both for v in p):
                assert math.isnan(got[x, names[j]])
            elif len(both) < 2 or 3 in (i, j):
                assert got[x, names[j]] is None
            else:
                assert got[x, names[j]] == pytest.approx(float(np.corrcoef(np.array(both).T)[0, 1]), abs=1e-9)
    assert profile.feature_correlations(df.limit(0), names[:2]).collect() == []
    assert profile.feature_correlations(df, names[:1]).count() == 0


def test_a_null_label_has_the_dictionarys_index(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a"), (4, "")], "id int, label string")
    assert {r.id: r.label_idx for r in labels.encode_labels(df, "label").collect()} == {1: 0, 4: 1, 3: 2, 2: 3}
