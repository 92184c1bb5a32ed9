"""History table, metric records and per-file label-count maps."""

from __future__ import annotations

import json
import os
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timefn import ms_to_text
from flowlens.operators._small import broadcast_checked
from flowlens.session import create_if_absent, file_system

#: Rows of a compacted file, and segments above which they are merged.
SEGMENT_ROWS, MAX_SEGMENTS = 5_000_000, 8

HISTORY_SCHEMA = ("id bigint, ms bigint, timestamp string, predicted_label string, confidence double, "
                  "threat_level string, features_count int")
METRICS_SCHEMA = "accuracy double, precision double, recall double, f1 double, fpr double, auc double"


def append_history(detections: DataFrame, path: str, run_id: str, batch_id: int,
                   extra: tuple[str, ...] = ()) -> None:
    """Append detection records, partitioned by day, run and batch.

    Writing a batch of a run again overwrites only its own partitions (dynamic
    partition overwrite), so a retried micro-batch never duplicates rows.
    Batches of different runs never replace each other.  ``extra`` names
    further columns to keep.
    """
    out = (detections.select("id", "ms", "timestamp", "predicted_label", "confidence", "threat_level",
                             "features_count", *extra)
           .withColumn("date", F.substring(ms_to_text("ms"), 1, 10))
           .withColumn("run_id", F.lit(run_id)).withColumn("batch_id", F.lit(int(batch_id))))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "run_id", "batch_id").parquet(path))


def _history_manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(highest number taken, content of the newest whole compaction manifest)."""
    fs, folder = file_system(spark, os.path.join(path, "_compacted", "manifests"))
    names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
    names = [n for n in names if re.fullmatch(r"\d{8}\.json", n)]
    top = int(names[0][:8]) if names else 0
    for name in names:
        text = "\n".join(r["value"] for r in spark.read.text(os.path.join(path, "_compacted", "manifests", name)).collect())
        try:
            return top, json.loads(text)
        except json.JSONDecodeError:  # its writer died
            continue
    return top, {"segments": [], "settled": {}}


def _settled(spark: SparkSession, manifest: dict) -> DataFrame:
    return broadcast_checked(spark.createDataFrame(list(manifest["settled"].items()), "__run string, __upto bigint"))


def _open_batches(spark: SparkSession, path: str, manifest: dict) -> DataFrame | None:
    """Rows of batches that no segment holds; None if there is no batch at all."""
    fs, root = file_system(spark, path)
    if not fs.exists(root) or not any(f.getPath().getName().startswith("date=") for f in fs.listStatus(root)):
        return None
    raw = spark.read.parquet(path).withColumn("run_id", F.col("run_id").cast("string")) \
        .withColumn("date", F.col("date").cast("string"))
    if not manifest["settled"]:
        return raw
    return raw.join(_settled(spark, manifest), (F.col("run_id") == F.col("__run")) & (F.col("batch_id") <= F.col("__upto")),
                    "left_anti")


def _segments(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    parts = [spark.read.parquet(os.path.join(path, "_compacted", n)) for n in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("date", F.col("date").cast("string"))


def compact_history(spark: SparkSession, path: str, rows_per_file: int = SEGMENT_ROWS,
                    max_segments: int = MAX_SEGMENTS) -> int:
    """Merge the settled batches into one segment; returns the manifest's number.

    Settled are all batches of a run but its newest, the only one that a
    restarted stream may write again.  The segment (a folder by day) is written
    first; a manifest, created only if its number is free, then names the
    segments and, per run, the last batch they hold, so readers see a batch
    either as files or as part of a segment, whenever a writer dies.  Above
    ``max_segments`` the segments are merged as well.  Nothing is deleted here;
    ``vacuum_history`` removes what no reader takes any more.
    """
    number, manifest = _history_manifest(spark, path)
    raw = _open_batches(spark, path, manifest)
    if raw is None:
        return number
    newest = broadcast_checked(raw.groupBy(F.col("run_id").alias("__run")).agg(F.max("batch_id").alias("__newest")))
    rows = raw.join(newest, F.col("run_id") == F.col("__run")).filter(F.col("batch_id") < F.col("__newest")) \
              .drop("__run", "__newest")
    counted = rows.groupBy("run_id").agg(F.max("batch_id").alias("upto"), F.count(F.lit(1)).alias("n")).collect()  # a row a run
    if not counted:
        return number
    merged = len(manifest["segments"]) >= max_segments
    if merged:
        rows = rows.unionByName(_segments(spark, path, manifest["segments"]), allowMissingColumns=True)
    n = rows.count() if merged else sum(r["n"] for r in counted)
    spread = F.pmod(F.xxhash64("run_id", "batch_id", "id"), F.lit(-(-n // rows_per_file)))
    segment = f"s-{uuid.uuid4().hex[:12]}"
    rows.repartition("date", spread).write.partitionBy("date").parquet(os.path.join(path, "_compacted", segment))
    text = json.dumps({"segments": [segment] if merged else [*manifest["segments"], segment],
                       "settled": manifest["settled"] | {r["run_id"]: r["upto"] for r in counted}})
    if not create_if_absent(spark, os.path.join(path, "_compacted", "manifests", f"{number + 1:08d}.json"), text):
        raise RuntimeError(f"another compaction of {path} came first; its manifest stands")
    return number + 1


def vacuum_history(spark: SparkSession, path: str) -> int:
    """Delete batch folders that a segment holds and segments that the newest
    manifest does not name; returns their number.  Not while older readers run."""
    _, manifest = _history_manifest(spark, path)
    fs, root = file_system(spark, path)
    gone = 0
    for run, upto in manifest["settled"].items():
        for f in fs.globStatus(file_system(spark, os.path.join(path, "date=*", f"run_id={run}", "batch_id=*"))[1]):
            if int(f.getPath().getName().partition("=")[2]) <= upto:
                gone += fs.delete(f.getPath(), True)
    for f in fs.globStatus(file_system(spark, os.path.join(path, "_compacted", "s-*"))[1]) or []:
        if manifest["segments"] and f.getPath().getName() not in manifest["segments"]:
            gone += fs.delete(f.getPath(), True)
    return gone


def read_history(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """History rows of segments and open batches; a date list prunes partitions at the scan."""
    _, manifest = _history_manifest(spark, path)
    parts = [_open_batches(spark, path, manifest)]
    if manifest["segments"]:
        parts.append(_segments(spark, path, manifest["segments"]))
    parts = [p for p in parts if p is not None]
    if not parts:
        raise ValueError(f"no history under {path}")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.filter(F.col("date").isin(dates)) if dates else df


def write_metrics(record: DataFrame, path: str) -> None:
    record.select(*[F.col(c).cast("double") for c in
                    ["accuracy", "precision", "recall", "f1", "fpr", "auc"]]) \
          .coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The stored record, or a zero record when none was written yet."""
    try:
        df = spark.read.schema(METRICS_SCHEMA).json(path)
        df.limit(1).collect()
        return df.withColumn("source", F.lit("stored"))
    except AnalysisException as error:  # no record yet -> defaults, like the service
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        zero = [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
        return spark.createDataFrame(zero, METRICS_SCHEMA).withColumn("source", F.lit("default"))


def write_label_counts(counts: DataFrame, path: str, source: str = "source", label: str = "label",
                       count: str = "count", label_column: str = "Label") -> None:
    """Per-source label counts as JSON lines ``{source: {label_column, total_counts}}``."""
    per = counts.groupBy(source).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(label).cast("string"), F.col(count).cast("bigint")))).alias("m"))
    line = F.to_json(F.create_map(F.col(source), F.struct(F.lit(label_column).alias("label_column"),
                                                          F.col("m").alias("total_counts"))))
    per.select(line.alias("value")).write.mode("overwrite").text(path)


def read_label_counts(spark: SparkSession, path: str, whole_document: bool = False) -> DataFrame:
    """Label-count file(s) -> long rows (file, label_column, label, count).

    JSON lines by default; ``whole_document`` reads each (small, pretty
    printed) file as one JSON object.
    """
    from flowlens.operators.labels import read_label_map_json
    text = spark.read.option("wholetext", whole_document).text(path)
    return read_label_map_json(text, "value")
