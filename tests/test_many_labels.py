"""Label tables of any size: long forms, refused one-row lists, many classes, staged tables."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from flowlens.operators import labels
from flowlens.plans import training
from tests.conftest import ROOT


def tagged(spark, rows):
    return spark.createDataFrame(rows, "source string, label string")


ROWS = [("a", "x"), ("a", "x"), ("a", None), ("b", "y"), (None, "x"), ("c", None)]


def test_lists_leave_missing_labels_out(spark):
    df = tagged(spark, ROWS)
    got = {r.source: (r.total_counts, r.source_total) for r in labels.label_counts_by_source(df, "source", "label").collect()}
    assert got == {"a": ({"x": 2}, 2), "b": ({"y": 1}, 1), None: ({"x": 1}, 1)}
    assert labels.distinct_labels(df, "label", "x").first().asDict() == {"n_labels": 2, "n_attack_types": 1, "labels": "x,y"}
    old = spark.createDataFrame([("x",)], "label string")
    row = labels.retrain_stats(df, old, "label").first()
    assert (row.total_samples, row.label_distribution, row.unique_labels, row.new_labels, row.new_labels_count) == \
        (6, {"x": 3, "y": 1}, ["x", "y"], ["y"], 1)
    status = {r.label: (r["count"], r.is_new) for r in labels.label_status(df, old, "label").collect()}
    assert status == {"x": (3, False), "y": (1, True), None: (2, False)}
    empty = df.limit(0)
    assert labels.label_counts_by_source(empty, "source", "label").count() == 0
    assert labels.distinct_labels(empty, "label").first().n_labels == 0


def test_a_row_takes_a_bounded_list(spark, monkeypatch):
    monkeypatch.setattr(labels, "MAX_BROADCAST_ROWS", 3)
    many = tagged(spark, [("a", str(k % 4)) for k in range(20)])
    spread = tagged(spark, [(str(k), str(k % 3)) for k in range(20)])  # many entries, few a source
    old = spark.createDataFrame([("0",)], "label string")
    assert labels.label_counts_by_source(spread, "source", "label").count() == 20
    for call in (lambda: labels.label_counts_by_source(many, "source", "label"),
                 lambda: labels.distinct_labels(many, "label"), lambda: labels.retrain_stats(many, old, "label")):
        with pytest.raises(ValueError, match="a row each"):
            call()
    assert labels.source_label_counts(many, "source", "label").count() == 4
    assert labels.label_status(many, old, "label").where("is_new").count() == 3


def test_a_forest_of_more_than_a_hundred_classes(spark):
    df = spark.range(1040).select("id", (F.col("id") % 130).cast("string").alias("label"),
                                  (F.col("id") % 130).cast("double").alias("x"), F.lit(1.0).alias("y"))
    r = training.train_pipeline(df, "label", ["x", "y"], ["id"], benign="0", num_trees=2, max_depth=8)
    assert r.bundle.classes == sorted(str(k) for k in range(130)) and r.split_sizes == (832, 208)
    rows = r.test_predictions.select(F.size("probs").alias("n"), "label", "label_idx").collect()
    assert {x.n for x in rows} == {130} and all(r.bundle.classes[x.label_idx] == x.label for x in rows)


def test_missing_and_many_labels_are_split_by_a_join(spark):
    rows = [(i, None if i % 4 == 0 else f"l{i % 4}", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, x double")
    split, dictionary = training.split_and_encode(df, "label", ["id"])
    assert [(r.label, r.label_idx) for r in dictionary.orderBy("label_idx").collect()] == \
        [(None, 0), ("l1", 1), ("l2", 2), ("l3", 3)]
    got = split.groupBy("label", "label_idx", "split").count().collect()
    assert sorted((r.label or "", r.label_idx, r.split, r["count"]) for r in got) == sorted(
        (name, k, side, n) for k, name in enumerate(["", "l1", "l2", "l3"]) for side, n in (("train", 8), ("test", 2)))


def test_an_application_removes_its_staged_tables(tmp_path):
    code = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false") \\
    .config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
from flowlens.operators._small import materialize
assert materialize(spark.range(3)).count() == 3
assert len(os.listdir({str(tmp_path / "flowlens")!r})) == 1
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    for _ in range(100):  # the JVM ends a moment after its Python
        if not os.listdir(tmp_path / "flowlens"):
            break
        __import__("time").sleep(0.1)
    assert os.listdir(tmp_path / "flowlens") == []
