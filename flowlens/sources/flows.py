"""CSV flow files: single files, folders of files with differing headers, uploads.

Flow files are numeric by contract (every column but the label is a
measurement), so they are read as text without a schema-inference pass and
cast once with ``try_cast``: "Infinity"/"NaN" tokens parse, junk becomes null.
"""

from __future__ import annotations

import csv
import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators._small import materialize
from flowlens.operators.cleaning import find_label_column
from flowlens.session import file_system, scratch_path


# What the original reader takes for a missing value.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip_header_names(names: list[str]) -> list[str]:
    """Trim blanks; a name seen before (without regard to case, as Spark
    resolves names) gets ``_1``, ``_2``..., the first that no column has."""
    given = {str(n).strip().lower() for n in names}
    seen: dict[str, int] = {}
    out = []
    for n in names:
        base = str(n).strip()
        name, k = base, seen.get(base.lower())
        if k is None:
            k = 0
        else:
            k += 1
            while f"{base}_{k}".lower() in given:
                k += 1
            name = f"{base}_{k}"
        seen[base.lower()] = k
        out.append(name)
    return out


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*strip_header_names(df.columns))


def type_flows(df: DataFrame, label: str | None = None, keep_text: list[str] | None = None) -> DataFrame:
    """Text columns -> double except the label (found by name when not given),
    in which a missing-value token is null."""
    label = label or find_label_column(df.columns)
    text = set(keep_text or [])

    def typed(c: str) -> Column:
        if c in text:
            return F.trim(F.col(f"`{c}`"))
        if c == label:
            value = F.trim(F.col(f"`{c}`"))
            return F.when(~value.isin(*MISSING_TOKENS), value)
        return F.col(f"`{c}`").try_cast("double")

    return df.select([typed(c).alias(c) for c in df.columns])


def _read_csv(spark: SparkSession, paths: list[str] | str, schema) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(paths)


def _read_by_place(spark: SparkSession, paths: list[str] | str, names: list[str]) -> DataFrame:
    """Text columns by their place in the line, so no name in a header can
    clash; ``names`` are given after the read."""
    places = T.StructType([T.StructField(f"__c{i}", T.StringType()) for i in range(len(names))])
    return _read_csv(spark, paths, places)


def read_flows(spark: SparkSession, path: str, schema=None, label: str | None = None) -> DataFrame:
    """One CSV (file or folder of parts) -> typed flow table with clean names.

    The header line is read as a row (one line), the rest by place.  With an
    explicit schema the file is read with it (no typing pass).
    """
    if schema is not None:
        return strip_headers(_read_csv(spark, path, schema))
    header = spark.read.option("header", False).csv(path).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = strip_header_names([h or "" for h in header])
    return type_flows(_read_by_place(spark, path, names).toDF(*names), label)


def list_csv_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of ``*.csv`` files under a folder, empty ones too: the file index
    that Spark makes for any scan of it; contents unread."""
    return sorted(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
                  .option("recursiveFileLookup", "true").load(folder).inputFiles())


@contextmanager
def _one_split_a_task(spark: SparkSession) -> Iterator[None]:
    """A scan task per file or per split of a long file.  The setting comes back."""
    split, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get(split))
    try:
        yield
    finally:
        spark.conf.set(cost, before)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        headers, problems = [], []
        for raw in batch.column(0):
            line = raw.as_py().decode(errors="replace")
            names = next(csv.reader([line.removeprefix("\ufeff")]), [])
            broken = "\x00" in line or "\ufffd" in line
            headers.append(names)
            problems.append("not text" if broken else None if any(n.strip() for n in names) else "no header")
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(headers, pa.list_(pa.string())), pa.array(problems, pa.string())],
            names=["path", "header", "problem"])


def _plain_path(c: str) -> Column:
    """A path without the percent codes of a file index (a plus is no blank there)."""
    return F.url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))


def header_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_file, header, problem) of every ``*.csv`` under a folder.

    One distributed job scans the files in splits and keeps each file's first
    line, so a task reads a split and no more.  ``problem`` is null for a readable header; else ``empty or
    unreadable`` (no first line could be read), ``not text`` or ``no header``.
    The result is written once.
    """
    found = spark.createDataFrame([(p,) for p in list_csv_files(spark, folder)], "path string") \
        .select(_plain_path("path").alias("path"))
    lines = (spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true")
             .option("ignoreCorruptFiles", "true").text(folder)
             .select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place")))
    # ids count from 0 in a partition's lower 33 bits, and a partition is one split
    first = lines.where((F.col("place") % (1 << 33) == 0) & (F.col("start") == 0)).select("value", "path")
    heads = first.mapInArrow(_headers, "path string, header array<string>, problem string")
    name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    with _one_split_a_task(spark):
        heads = materialize(heads, "headers").withColumnRenamed("path", "__path")
    # the index writes file:///x where the scan writes file:/x
    listed = found.withColumn("__key", F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"))
    heads = heads.withColumn("__key", F.regexp_replace(_plain_path("__path"), "^([a-z0-9]+):/+", "$1:/"))
    out = listed.join(heads, "__key", "left").select(
        "path", name, "header", F.when(F.col("header").isNull(), F.lit("empty or unreadable"))
        .otherwise(F.col("problem")).alias("problem"))
    return materialize(out, "catalogue")


def quarantined(catalogue: DataFrame) -> DataFrame:
    """The files that cannot be read, with the reason."""
    return catalogue.filter(F.col("problem").isNotNull()).select("path", "source_file", "problem")


def read_flow_folder(spark: SparkSession, folder: str, label: str | None = None,
                     catalogue: DataFrame | None = None) -> DataFrame:
    """All ``*.csv`` under a folder, unioned by (stripped) column name.

    Files are grouped by header so each group is one scan; files without a
    readable header stay out and are listed by ``quarantined``; an empty folder
    gives an empty table.  Adds ``source_file`` and ``source_dir`` (from the
    file metadata) and, per header group, the number and names of its columns.
    """
    catalogue = header_catalogue(spark, folder) if catalogue is None else catalogue
    groups: dict[tuple, list[str]] = {}
    # the driver holds the file list of every scan anyway
    for row in catalogue.filter(F.col("problem").isNull()).orderBy("path").toLocalIterator():
        groups.setdefault(tuple(row["header"]), []).append(row["path"])
    if not groups:
        return spark.createDataFrame([], "source_file string, source_dir string")
    parts = []
    for header, paths in groups.items():
        names = strip_header_names(list(header))
        df = _read_by_place(spark, paths, names)
        meta = F.col("_metadata.file_path")
        df = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names, strict=True)],
                       F.col("_metadata.file_name").alias("source_file"),
                       F.element_at(F.split(meta, "/"), -2).alias("source_dir"))
        df = type_flows(df, label, keep_text=["source_file", "source_dir"])
        df = df.withColumn("n_columns", F.lit(len(names))) \
               .withColumn("column_names", F.lit(",".join(names)))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_uploads(spark: SparkSession, uploads: list[str], label: str | None = None) -> DataFrame:
    """Several uploaded CSVs: only ``.csv`` names, headers stripped before the
    union (so " Label" and "Label" meet), union by name with nulls for
    columns a file lacks."""
    csvs = [u for u in uploads if u.rstrip("/").endswith(".csv")]
    if not csvs:
        raise ValueError("No valid CSV files found")
    parts = [read_flows(spark, u, label=label) for u in csvs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def source_profile(flows: DataFrame, source: str = "source_dir") -> DataFrame:
    """Rows, number of columns and column names per source."""
    # a source is a file (``source_file``) or a folder of parts with one header;
    # of several headers in a folder the widest is shown
    return flows.groupBy(source).agg(F.count(F.lit(1)).alias("rows"),
                                     F.max("n_columns").alias("n_columns"),
                                     F.max_by("column_names", F.struct("n_columns", "column_names")).alias("column_names"))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header (overwrites the target folder)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_csv_lines(lines: DataFrame, header: str, path: str) -> None:
    """Write ready-made CSV lines (column ``value``), a part per partition, each
    behind the given header line: for headers that no table can have."""
    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in itertools.chain([pa.array([header])], (b.column(0) for b in batches)):
            yield pa.RecordBatch.from_arrays([values], names=["value"])

    # as they are: nothing to separate, quote or trim; the CSV writer gives the parts their extension
    plain = {"sep": "\x01", "quote": "", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.select("value").mapInArrow(headed, "value string").write.mode("overwrite").options(**plain).csv(path)
