"""Source and sink queries: each stages driver data through the real format."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from flowlens.operators import cleaning, evaluation, labels, sampling
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register
from flowlens.plans.catalog.evaluation import METRICS_SQL
from flowlens.session import create_if_absent, scratch_path
from flowlens.sources import flows as fl
from flowlens.sources import records

_FLOW_COLS = ["l_orderkey", "l_linenumber", *fx.FLOW_FEATURES, fx.FLOW_LABEL]


def _stage_flow_csv(spark, sf, name, status, drop=(), blank=True):
    """Write one half of lineitem as a flow CSV (header names padded with blanks)."""
    li = fx.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == status)
    cols = [c for c in _FLOW_COLS if c not in drop]
    df = li.select(*[F.col(c).alias(f" {c}" if blank else c) for c in cols])
    df = df.withColumnRenamed(f" {fx.FLOW_LABEL}" if blank else fx.FLOW_LABEL, " Label")
    path = os.path.join(scratch_path(spark, name), f"{name}.csv")
    fl.write_csv(df, path)
    return path


def _flows_sql(where: str = "", tax: str = "l_tax") -> str:
    return (f"SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, "
            f"l_quantity, l_extendedprice, l_discount, {tax} AS l_tax, l_returnflag AS Label FROM lineitem {where}")


@register("read_flows", sql=_flows_sql())
def q_read_flows(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        *[F.col(c).alias(f" {c}") for c in _FLOW_COLS[:-1]], F.col(fx.FLOW_LABEL).alias(" Label"))
    path = scratch_path(spark, "flows") + ".csv"
    fl.write_csv(li, path)
    return fl.read_flows(spark, path)


@register("strip_headers", sql="""
SELECT l_orderkey, l_quantity, l_tax AS l_quantity_1, l_returnflag AS Label FROM lineitem
""")
def q_strip_headers(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias(" l_orderkey"), F.col("l_quantity").alias("l_quantity "),
        F.col("l_tax").alias(" l_quantity"), F.col("l_returnflag").alias(" Label"))
    return fl.strip_headers(li)


def _stage_folder(spark, sf):
    root = scratch_path(spark, "flowdir")
    a = fx.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "F").select(
        *[F.col(c).alias(f" {c}") for c in _FLOW_COLS[:-1]], F.col(fx.FLOW_LABEL).alias(" Label"))
    b = fx.table(spark, sf, "lineitem").filter(F.col("l_linestatus") == "O").select(
        F.col(fx.FLOW_LABEL).alias("Label"), *[F.col(c) for c in reversed(_FLOW_COLS[:-1]) if c != "l_tax"])
    fl.write_csv(a, os.path.join(root, "monday.csv"))
    fl.write_csv(b, os.path.join(root, "tuesday.csv"))
    # a non-CSV file in the folder is ignored
    spark.range(3).select(F.col("id").cast("string").alias("value")).write.mode("overwrite") \
         .text(os.path.join(root, "notes"))
    return root


@register("read_flow_folder", sql=f"""
{_flows_sql("WHERE l_linestatus = 'F'").replace(" FROM lineitem", ", 'monday.csv' AS source_dir FROM lineitem")}
UNION ALL
{_flows_sql("WHERE l_linestatus = 'O'", tax="NULL::DOUBLE").replace(" FROM lineitem", ", 'tuesday.csv' AS source_dir FROM lineitem")}
""")
def q_read_flow_folder(spark, sf):
    df = fl.read_flow_folder(spark, _stage_folder(spark, sf))
    return df.select(*(c for c in _FLOW_COLS[:-1]), "Label", "source_dir")


@register("source_profile", sql=f"""
SELECT 'monday.csv' AS source_dir, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS rows,
       7 AS n_columns, '{",".join(_FLOW_COLS[:-1] + ["Label"])}' AS column_names FROM lineitem
UNION ALL
SELECT 'tuesday.csv', CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT), 6,
       'Label,{",".join(c for c in reversed(_FLOW_COLS[:-1]) if c != "l_tax")}' FROM lineitem
""")
def q_source_profile(spark, sf):
    return fl.source_profile(fl.read_flow_folder(spark, _stage_folder(spark, sf)))


def _stage_week(spark, sf):
    """A folder of flow files, large ones in parts: two headers (one with
    repeated and case-only twin names), missing-value tokens in labels, and
    three files without a readable header."""
    root = scratch_path(spark, "week")
    flows = fx.table(spark, sf, "lineitem").select(*_FLOW_COLS)
    label = F.when(F.col("l_linenumber") == 1, "NA").otherwise(F.col(fx.FLOW_LABEL))
    for name, part in (("monday.csv", F.col("l_linenumber") <= 2), ("friday.csv", F.col("l_linenumber") == 3)):
        fl.write_csv(flows.filter(part).select(F.col("l_orderkey").alias(" key"), F.col("l_tax").alias("x"),
                                               F.col("l_quantity").alias("x_1"), label.alias(" Label")),
                     os.path.join(root, name))
    twin = flows.filter("l_linenumber = 4").select("l_orderkey", "l_tax", "l_quantity", fx.FLOW_LABEL)
    # the header repeats names, which a table cannot
    fl.write_csv_lines(twin.select(F.concat_ws(",", *twin.columns).alias("value")), "key, x,X ,Label",
                       os.path.join(root, "twins.csv"))
    create_if_absent(spark, os.path.join(root, "empty.csv"), "")
    create_if_absent(spark, os.path.join(root, "blank.csv"), " , ,\n1,2,3\n")
    create_if_absent(spark, os.path.join(root, "sub", "binary.csv"), "a\x00b,c\n1,2\n")
    create_if_absent(spark, os.path.join(root, "readme.txt"), "not a flow file")
    return root


@register("folder_quarantine", sql="""
SELECT * FROM (VALUES ('binary.csv', 'not text'), ('blank.csv', 'no header'), ('empty.csv', 'empty or unreadable'))
AS t(source_file, problem)
WHERE (SELECT count(*) FROM lineitem) > 0
""")
def q_folder_quarantine(spark, sf):
    return fl.quarantined(fl.header_catalogue(spark, _stage_week(spark, sf))).select("source_file", "problem")


@register("folder_profile", sql="""
WITH f AS (
  SELECT CASE WHEN l_linenumber <= 2 THEN 'monday.csv' WHEN l_linenumber = 3 THEN 'friday.csv' ELSE 'twins.csv' END AS source_file,
         l_linenumber, l_tax, l_quantity FROM lineitem WHERE l_linenumber <= 4)
SELECT source_file, count(*) AS rows, 4 AS n_columns,
       CASE source_file WHEN 'twins.csv' THEN 'key,x,X_1,Label' ELSE 'key,x,x_1,Label' END AS column_names,
       round(sum(l_tax), 4) AS tax, round(sum(l_quantity), 4) AS quantity,
       count(*) FILTER (l_linenumber = 1) AS missing_labels
FROM f GROUP BY source_file
""")
def q_folder_profile(spark, sf):
    """Rows, columns and sums of every readable file of a folder with faulty files."""
    flows = fl.read_flow_folder(spark, _stage_week(spark, sf))
    # a file in parts is a folder of its name
    flows = flows.withColumn("source_file", F.when(F.col("source_dir").endswith(".csv"), F.col("source_dir"))
                             .otherwise(F.col("source_file")))
    sums = flows.groupBy("source_file").agg(
        F.round(F.sum("x"), 4).alias("tax"), F.round(F.sum("x_1"), 4).alias("quantity"),
        F.count_if(F.col("Label").isNull()).alias("missing_labels"))
    return fl.source_profile(flows, "source_file").join(sums, "source_file")


@register("union_uploads", sql=f"""
{_flows_sql("WHERE l_linestatus = 'F'")}
UNION ALL
{_flows_sql("WHERE l_linestatus = 'O'", tax="NULL::DOUBLE")}
""")
def q_union_uploads(spark, sf):
    up1 = _stage_flow_csv(spark, sf, "upload_a", "F")
    up2 = _stage_flow_csv(spark, sf, "upload_b", "O", drop=("l_tax",), blank=False)
    ignored = scratch_path(spark, "readme") + ".txt"
    return fl.union_uploads(spark, [up1, up2, ignored])


@register("write_samples", sql="""
SELECT o_orderkey, o_orderpriority, draw_no FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS draw_no
  FROM orders) WHERE draw_no <= 1000
""")
def q_write_samples(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    sample = sampling.sample_rows(o, ["o_orderkey"], 1000, fx.SEED).select(
        "o_orderkey", "o_orderpriority", "draw_no")
    path = scratch_path(spark, "normal_traffic") + ".csv"
    fl.write_csv(sample, path)
    return fl.read_flows(spark, path, schema="o_orderkey bigint, o_orderpriority string, draw_no bigint")


@register("append_history", sql=f"""
SELECT event_id AS id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       event_type AS predicted_label, round({fx.CONFIDENCE_SQL}, 6) AS confidence,
       CASE WHEN upper(event_type) = 'VIEW' THEN 'None' WHEN {fx.CONFIDENCE_SQL} > 0.9 THEN 'High'
            WHEN {fx.CONFIDENCE_SQL} > 0.7 THEN 'Medium' ELSE 'Low' END AS threat_level,
       1 AS features_count, strftime(ts, '%Y-%m-%d') AS date
FROM events
""")
def q_append_history(spark, sf):
    d = fx.detections(spark, sf)
    path = scratch_path(spark, "history")
    # two runs that both start at batch 0; the second is retried, which must not duplicate rows
    first = d.filter(F.col("predicted_label") == F.lit(fx.EVENT_BENIGN))
    rest = d.filter(F.col("predicted_label") != F.lit(fx.EVENT_BENIGN))
    records.append_history(first, path, run_id="first", batch_id=0)
    records.append_history(rest, path, run_id="second", batch_id=0)
    records.append_history(rest, path, run_id="second", batch_id=0)
    h = records.read_history(spark, path)
    return h.select("id", "ms", "timestamp", "predicted_label", F.round("confidence", 6).alias("confidence"),
                    "threat_level", "features_count", "date")


COMPACT_BATCHES = 6


@register("history_compaction", sql=f"""
SELECT event_id AS id, (epoch_us(ts) // 1000) AS ms, event_type AS predicted_label, strftime(ts, '%Y-%m-%d') AS date,
       event_id % {COMPACT_BATCHES} AS batch_id, event_id % {COMPACT_BATCHES} < {COMPACT_BATCHES - 1} AS compacted
FROM events
""")
def q_history_compaction(spark, sf):
    """Batches appended one by one, compacted twice in between, the last one replayed."""
    d = fx.detections(spark, sf)
    path = scratch_path(spark, "history")
    for k in range(COMPACT_BATCHES):
        records.append_history(d.filter(F.col("id") % COMPACT_BATCHES == k), path, "run", k)
        if k in (2, COMPACT_BATCHES - 1):
            records.compact_history(spark, path)
            records.vacuum_history(spark, path)
    records.append_history(d.filter(F.col("id") % COMPACT_BATCHES == k), path, "run", k)  # replayed
    open_batches = spark.read.parquet(path).select(F.col("batch_id").alias("open")).distinct()
    h = records.read_history(spark, path)
    return h.join(F.broadcast(open_batches), F.col("batch_id") == F.col("open"), "left").select(
        "id", "ms", "predicted_label", "date", F.col("batch_id").cast("bigint").alias("batch_id"),
        F.col("open").isNull().alias("compacted"))


@register("metrics_io", sql=f"""
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(auc, 6) AS auc, 'stored' AS source FROM ({METRICS_SQL})
UNION ALL SELECT 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 'default'
""")
def q_metrics_io(spark, sf):
    rec = evaluation.metrics_record(fx.probability_table(spark, sf), "actual", "predicted", "probs")
    path = scratch_path(spark, "metrics")
    records.write_metrics(rec, path)
    stored = records.read_metrics(spark, path)
    missing = records.read_metrics(spark, scratch_path(spark, "never_written"))
    out = stored.unionByName(missing)
    return out.select(*[F.round(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1", "fpr", "auc"]],
                      "source")


@register("read_label_counts", sql="""
SELECT d.source AS file, 'Label' AS label_column, CAST(l.toxic AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS count
FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL
""")
def q_read_label_counts(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("label"))
    counts = d.join(lab, "doc_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("count"))
    path = scratch_path(spark, "label_counts")
    records.write_label_counts(counts, path)
    return records.read_label_counts(spark, path)
