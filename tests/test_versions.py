"""Model versions, the publish gate, result rows and requests that cannot be scored."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.operators import model
from flowlens.plans import training
from flowlens.session import create_if_absent, scratch_path
from flowlens.sources import bundle as bd


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, float(i % 7), float(i % 2), "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    return training.train_pipeline(df, "label", ["x", "y"], ["id"], benign="a", num_trees=2, max_depth=3)


def test_a_save_that_dies_leaves_the_version_before(spark, result):
    root = scratch_path(spark, "t_versions")
    assert bd.current_version(spark, root) is None
    with pytest.raises(ValueError):
        bd.load_bundle(spark, root)
    assert bd.save_bundle(spark, root, result.bundle) == 1
    bd.stage_bundle(spark, root, result.bundle)  # died before the manifest
    assert bd.current_version(spark, root) == 1
    open(os.path.join(root, "manifests", "00000002.json"), "w").write('{"folder": "v-')  # died inside the manifest
    assert bd.current_version(spark, root) == 1
    gone = json.load(open(os.path.join(root, "manifests", "00000001.json"))) | {"folder": "v-gone"}
    json.dump(gone, open(os.path.join(root, "manifests", "00000003.json"), "w"))  # its folder never arrived
    assert bd.current_version(spark, root) == 1
    assert bd.save_bundle(spark, root, result.bundle) == 4
    assert bd.current_version(spark, root) == 4 and bd.load_bundle(spark, root).classes == ["a", "b"]
    assert bd.load_bundle(spark, root, 1).contract == ["x", "y"]


def test_a_taken_number_is_never_written_over(spark, result):
    root = scratch_path(spark, "t_versions")
    path = os.path.join(root, "manifests", "00000001.json")
    assert create_if_absent(spark, path, "first") and not create_if_absent(spark, path, "second")
    assert open(path).read() == "first"


def test_a_rejected_model_leaves_the_current_one(spark, result):
    root = scratch_path(spark, "t_versions")
    good = {**result.bundle.metrics, "accuracy": 0.9, "fpr": 0.001}
    for metrics, status, version in ((good, "success", 1), ({**good, "accuracy": 0.8}, "rejected", 1),
                                     ({**good, "fpr": 0.01}, "rejected", 1), ({**good, "accuracy": 0.95}, "success", 2)):
        result.bundle.metrics = metrics
        got = training.publish(spark, root, result)
        assert (got[0], got[2]) == (status, version), got
    result.bundle.metrics = {**good, "accuracy": 0.1}
    assert training.publish(spark, root, result, gate=False)[0] == "success"
    assert bd.stored_metrics(spark, root)["accuracy"] == 0.1


def test_uploads_that_cannot_be_trained_on_give_error_rows(spark):
    root = scratch_path(spark, "t_versions")
    for rows, schema, reason in (([(1.0, 2.0)], "Feature1 double, Feature2 double", "Target column"),
                                 ([(None, "a")], "Feature1 double, Label string", "No data remaining"),
                                 ([(1.0, "a"), (2.0, "b"), (3.0, "a")], "Feature1 double, Label string", "least populated")):
        row = training.retrain_and_publish(root, spark.createDataFrame(rows, schema), None, "Label", None, []).first()
        assert row.status == "error" and reason in row.message and row.version is None, row


def test_every_request_has_a_row(spark, result):
    bodies = ['{"features": [1, 1]}', '{"features": [null, NaN]}', '{"features": [1]}', '{"features": [1], "features": [1, 0]}',
              "", None, "[1, 2]", '{"features": {}}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    b = result.bundle
    rows = {r.id: r for r in model.score_requests(b.model, df, "body", b.contract, b.scaler, b.classes, "a", ["id"]).collect()}
    assert [rows[i].status == "success" for i in range(8)] == [True, True, False, True, False, False, False, False]
    assert [rows[i].error for i in range(8)] == [None, None, "bad_length", None, "malformed", "malformed", "missing", "not_list"]
    for r in rows.values():
        assert (r.predicted_label is None) == (r.confidence is None) == (r.probabilities is None) == (r.status == "error")
        assert (r.message is None) == (r.status == "success")


def test_standardized_features_are_finite(spark, result):
    b = result.bundle
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert model.standardize(df, b.contract, b.scaler).where(F.isnan("x") | F.isnan("y")).count() == 0
