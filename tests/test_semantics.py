"""Hand-made frames for the behaviours a fresh reader gets wrong."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions.levels import intensity_level, threat_level
from flowlens.operators import cleaning, detection, evaluation, labels, sampling
from flowlens.sources.flows import strip_header_names


def test_threat_level_is_strict(spark):
    df = spark.createDataFrame([("DDoS", 0.9), ("DDoS", 0.90001), ("DDoS", 0.7), ("DDoS", 0.71),
                                ("benign", 0.99), ("Bot", 0.1)], "label string, conf double")
    got = [r[0] for r in df.select(threat_level("label", "conf")).collect()]
    assert got == ["Medium", "High", "Low", "Medium", "None", "Low"]


def test_intensity_level_bounds(spark):
    df = spark.createDataFrame([(c,) for c in [0, 5, 6, 10, 11]], "c int")
    assert [r[0] for r in df.select(intensity_level("c")).collect()] == ["Low", "Low", "Medium", "Medium", "High"]


def test_fpr_is_one_minus_recall_of_first_class(spark):
    # class 0 (alphabetically first, like BENIGN) has recall 3/4 -> FPR 0.25
    rows = [(0, 0), (0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 2)]
    df = spark.createDataFrame(rows, "actual int, predicted int")
    per = evaluation.per_class_metrics(df, "actual", "predicted")
    s = evaluation.summary_metrics(per).first()
    assert s["fpr"] == pytest.approx(0.25)
    assert s["accuracy"] == pytest.approx(5 / 7)


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 1)], "actual int, predicted int")
    per = {r["class"]: r for r in evaluation.per_class_metrics(df, "actual", "predicted").collect()}
    assert per[0]["recall"] == 0.0 and per[1]["precision"] == 0.0 and per[1]["f1"] == 0.0


def test_quota_reweight_truncates_to_4996(spark):
    # The original anomaly-traffic label weights (BENIGN is zeroed).
    weights = [("BENIGN", 4194), ("DoS Hulk", 450), ("PortScan", 291), ("DoS GoldenEye", 14),
               ("FTP-Patator", 14), ("SSH-Patator", 12), ("DoS slowloris", 10), ("DoS Slowhttptest", 10),
               ("Web Attack � Brute Force", 2), ("Bot", 2), ("Web Attack � XSS", 1)]
    df = spark.createDataFrame(weights, "label string, w long")
    q = {r["label"]: r["quota"] for r in
         sampling.quota_reweight(df, "label", "w", 5000, zero_label="BENIGN").collect()}
    assert "BENIGN" not in q
    assert q["DoS Hulk"] == 2791 and q["PortScan"] == 1805 and q["Web Attack � XSS"] == 6
    assert sum(q.values()) == 4996


def test_quota_proportional_half_even_and_remainder(spark):
    # shares 0.5 / 0.25 / 0.25 of N=10 -> 5, 2.5 -> 2, 2.5 -> 2 ; remainder 1 to the largest
    rows = [("a",)] * 2 + [("b",)] + [("c",)]
    q = {r["label"]: r["quota"] for r in
         sampling.quota_proportional(spark.createDataFrame(rows, "label string"), "label", 10).collect()}
    assert q == {"a": 6, "b": 2, "c": 2}


def test_inf_nan_training_drops_scoring_fills(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1.0), (2, inf), (3, -inf), (4, float("nan")), (5, None)],
                               "id int, x double")
    assert [r.id for r in cleaning.clean_for_training(df).collect()] == [1]
    assert [r.id for r in cleaning.drop_missing(df).orderBy("id").collect()] == [1, 2, 3]
    filled = {r.id: r.x for r in cleaning.fill_for_scoring(df, ["x"]).collect()}
    assert filled == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}


def test_coerce_numeric_keeps_inf(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("Infinity",), (None,), ("NaN",)], "v string")
    got = [r.v for r in cleaning.coerce_numeric(df, ["v"]).collect()]
    assert got[:2] == [1.5, 0.0] and math.isinf(got[2]) and got[3:] == [0.0, 0.0]


def test_strip_header_names_dedups_by_position():
    assert strip_header_names([" Label", "Fwd Len", " Fwd Len", "x "]) == ["Label", "Fwd Len", "Fwd Len_1", "x"]


def test_align_features_fills_missing_and_non_numeric(spark):
    df = spark.createDataFrame([(1.0, "2.0", 9.0)], "a double, b string, extra double")
    row = cleaning.align_features(df, ["b", "a", "c"]).first()
    assert row.asDict() == {"b": 0.0, "a": 1.0, "c": 0.0}


def test_resolve_features_errors(spark):
    df = spark.createDataFrame([("x", "y")], "Label string, note string")
    with pytest.raises(ValueError, match="No numeric feature"):
        cleaning.resolve_features(df)
    df2 = spark.createDataFrame([(1.0, 2.0, "a")], "f1 double, f2 double, Class string")
    with pytest.raises(ValueError, match="mismatch"):
        cleaning.resolve_features(df2, contract=["f1", "f2", "f3"])
    out, feats, label = cleaning.resolve_features(df2)
    assert feats == ["f1", "f2"] and label == "Class"


def test_validate_requests_duplicate_keys_last_wins(spark):
    body = '{"features": [1, 2, 3], "features": [' + ",".join(["0"] * 78) + "]}"
    rows = [(body,), ("not json",), ('{"x": 1}',), ('{"features": 5}',), ('{"features": [1, 2]}',),
            ('{"features": [1, "2", null, [4]]}',)]
    df = spark.createDataFrame(rows, "body string")
    got = [r.status for r in cleaning.validate_requests(df, "body", 78).collect()]
    assert got == ["ok", "malformed", "missing", "not_list", "bad_length", "bad_length"]


def test_describe_attack_exact_then_longest_prefix(spark):
    df = spark.createDataFrame([("DDoS",), ("DoS Hulk",), ("ssh-patator",), ("Heartbleed",), ("PortScan",)],
                               "label string")
    got = [r.attack_description for r in labels.describe_attack(df, "label").collect()]
    assert got == ["Distributed Denial of Service", "Denial of Service", "SSH Password Brute Force",
                   "Unknown attack type", "Port Scan Attack"]


def test_sliding_window_is_inclusive_and_level_starts_low(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1, base + dt.timedelta(seconds=s), "Bot") for i, s in enumerate([0, 2, 4, 6, 8, 10, 10, 21])]
    df = spark.createDataFrame(rows, "event_id long, run long, ts timestamp_ntz, label string")
    c = detection.sliding_attack_count(df, "run", "ts", "label", "BENIGN", 10_000)
    counts = {r.event_id: r["count"] for r in c.collect()}
    # t=10 s sees t=0 (exactly W back) and both events at 10 s
    assert counts[5] == 7 and counts[6] == 7 and counts[7] == 1
    ch = detection.level_changes(c, "run", "ms", "event_id").orderBy("ms", "event_id").collect()
    assert [(r.event_id, r.previous_level, r.level) for r in ch] == [(5, "Low", "Medium"), (7, "Medium", "Low")]


def test_split_fails_on_singleton_class(spark):
    df = spark.createDataFrame([(1, "BENIGN"), (2, "BENIGN"), (3, "DDoS")], "k long, Label string")
    with pytest.raises(ValueError, match="least populated class"):
        sampling.stratified_split(df, "Label", ["k"])


def test_stratified_sample_reports_missing_labels(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "k long, label string")
    quotas = spark.createDataFrame([("a", 8), ("zzz", 3)], "label string, quota long")
    sample, missing = sampling.stratified_sample(df, "label", ["k"], quotas)
    assert sample.count() == 8
    assert [(r.label, r.quota) for r in missing.collect()] == [("zzz", 3)]


def test_replay_schedule_clamps_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k long, v double")
    ev, header = sampling.replay_schedule(df, ["k"], ["v"], window_s=0, mode="Medium")
    h = header.first()
    assert h.time_window_seconds == 1 and h.attack_frequency == 1 and h.frequency_level == "Low"
    assert [r.label for r in ev.collect()] == ["ANOMALY"]
    ev2, h2 = sampling.replay_schedule(df, ["k"], ["v"], window_s=10)
    assert ev2.count() == 20 and h2.first().frequency_level == "High"
