"""Header names, header catalogue, quarantine and missing-value tokens."""

import gzip
import os

from pyspark.sql import functions as F

from flowlens.session import scratch_path
from flowlens.sources import flows as fl


def _folder(spark, files):
    root = scratch_path(spark, "t_folder")
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return root


def test_names_that_clash():
    assert fl.strip_header_names([" Label", "label", "a", "a_1", "a", "A ", "", ""]) == [
        "Label", "label_1", "a", "a_1", "a_2", "A_3", "", "_1"]


def test_case_only_twins_and_missing_tokens(spark):
    root = _folder(spark, {"one.csv": " Label,label,x.y\nDDoS,1,2\nNA,nan,3\n nan ,4,\n,Infinity,x\n"})
    rows = [tuple(r) for r in fl.read_flows(spark, os.path.join(root, "one.csv")).collect()]
    assert [r[0] for r in rows] == ["DDoS", None, None, None]
    assert [r[2] for r in rows] == [2.0, 3.0, None, None] and rows[3][1] == float("inf")


def test_catalogue_of_faulty_files(spark):
    files = {f"f{i}.csv": f"a,b{i % 2}\n{i},1\n" for i in range(6)}
    files |= {"deep/with space+plus.csv": "﻿a,b0\n7,2\n", "empty.csv": "", "blank.csv": "\n1,2\n", "bin.csv": b"\x00\xff\x01\n",
              "quoted.csv": '"a","x,y"\n8,3\n', "notes.txt": "a,b\n"}
    root = _folder(spark, files)
    catalogue = fl.header_catalogue(spark, root)
    assert catalogue.count() == 11
    bad = {r.source_file: r.problem for r in fl.quarantined(catalogue).collect()}
    assert {k: bad[k] for k in ("empty.csv", "bin.csv")} == {"empty.csv": "empty or unreadable", "bin.csv": "not text"}
    assert set(bad) == {"empty.csv", "bin.csv", "blank.csv"}
    flows = fl.read_flow_folder(spark, root, catalogue=catalogue)
    assert sorted(r.a for r in flows.collect()) == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 7.0, 8.0]
    profile = {r.source_file: (r.rows, r.n_columns, r.column_names) for r in fl.source_profile(flows, "source_file").collect()}
    assert len(profile) == 8 and profile["quoted.csv"] == (1, 2, "a,x,y") and profile["f1.csv"] == (1, 2, "a,b1")


def test_a_long_file_gives_its_first_line_only(spark):
    root = _folder(spark, {"long.csv": "a,b\n" + "1,2\n" * 200_000, "short.csv": "b,a\n1,2\n"})
    heads = {r.source_file: r.header for r in fl.header_catalogue(spark, root).collect()}
    assert heads == {"long.csv": ["a", "b"], "short.csv": ["b", "a"]}


def test_folder_without_flow_files(spark):
    root = _folder(spark, {"notes.txt": "x"})
    assert fl.read_flow_folder(spark, root).count() == 0
    broken = _folder(spark, {"cut.csv": "a\n1\n"})
    with open(os.path.join(broken, "cut.csv.gz"), "wb") as f:
        f.write(gzip.compress(b"a\n2\n")[:-6])  # another extension: not a flow file
    assert [r.a for r in fl.read_flow_folder(spark, broken).collect()] == [1.0]


def test_a_long_table_is_staged_and_catalogued_in_splits(spark):
    root = scratch_path(spark, "t_split")
    rows = spark.range(60_000).repartition(3)
    fl.write_csv(rows.select("id", F.col("id").alias("x")), os.path.join(root, "whole.csv"))
    fl.write_csv_lines(rows.select(F.concat_ws(",", "id", "id").alias("value")), "id, ID", os.path.join(root, "twins.csv"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")  # several splits a file
    try:
        catalogue = fl.header_catalogue(spark, root).collect()
        assert spark.conf.get("spark.sql.files.openCostInBytes") != "65536"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(catalogue) == 6 and {tuple(r.header) for r in catalogue} == {("id", "x"), ("id", " ID")}
    flows = fl.read_flow_folder(spark, root)
    sums = {r.source_dir: (r.n, r.s) for r in flows.groupBy("source_dir").agg(
        F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    assert sums == {k: (60_000, sum(range(60_000))) for k in ("whole.csv", "twins.csv")}
