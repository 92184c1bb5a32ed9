"""Label dictionaries, lookups and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.labels import is_benign
from flowlens.operators._small import MAX_BROADCAST_ROWS, broadcast_checked, materialize_small

# Attack descriptions by upper-case predicted label, as used by
# the sample runner (keys kept verbatim, including the 'INFLITRATION' spelling).
ATTACK_DESCRIPTIONS = {
    "DDOS": "Distributed Denial of Service",
    "DOS": "Denial of Service",
    "PORTSCAN": "Port Scan Attack",
    "BOT": "Botnet Activity",
    "INFLITRATION": "Infiltration Attack",
    "BRUTEFORCE": "Brute Force Attack",
    "SQLINJECTION": "SQL Injection",
    "XSS": "Cross-Site Scripting",
    "FTP-PATATOR": "FTP Password Brute Force",
    "SSH-PATATOR": "SSH Password Brute Force",
}
UNKNOWN_ATTACK = "Unknown attack type"


def label_dictionary(df: DataFrame, label: str, out_label: str = "label",
                     out_index: str = "label_idx") -> DataFrame:
    """Sorted distinct labels -> 0..k-1 (alphabetical, like a label encoder).

    The distinct is a hash aggregate with map-side combine.  Up to
    ``MAX_BROADCAST_ROWS`` labels the numbering is one window and the result
    carries a broadcast hint; more labels are numbered by sorted ranges (each
    range's rows counted first) and meet the rows by a shuffle join.
    """
    distinct = df.select(F.col(label).cast("string").alias(out_label)).distinct()
    distinct, k = materialize_small(distinct)
    order = F.col(out_label).asc_nulls_first()
    if k <= MAX_BROADCAST_ROWS:
        w = Window.orderBy(order)
        return F.broadcast(distinct.withColumn(out_index, (F.row_number().over(w) - 1).cast("int")))
    ranged, _ = materialize_small(distinct.repartitionByRange(-(-k // MAX_BROADCAST_ROWS) + 1, order).select(
        out_label, F.spark_partition_id().alias("__part")))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.join(F.broadcast(offsets), "__part").select(
        out_label, (F.col("__off") + place - 1).cast("int").alias(out_index))


def encode_labels(df: DataFrame, label: str, dictionary: DataFrame | None = None,
                  out: str = "label_idx") -> DataFrame:
    """Attach the dictionary index of each row's label (broadcast equi-join); a
    null label has the index that the dictionary gives it, if any."""
    if dictionary is None:
        d = label_dictionary(df, label)          # broadcast-hinted only when small
    else:                                        # a caller's table: check its size first
        d = broadcast_checked(dictionary)
    d = d.select(F.col("label").alias("__lbl"), F.col("label_idx").alias(out))
    return df.join(d, F.col(label).cast("string").eqNullSafe(F.col("__lbl")), "left").drop("__lbl")


def decode_labels(df: DataFrame, index: str, dictionary: DataFrame,
                  out: str = "label") -> DataFrame:
    d = broadcast_checked(dictionary.select(F.col("label_idx").alias("__idx"), F.col("label").alias(out)))
    return df.join(d, F.col(index) == F.col("__idx"), "left").drop("__idx")


def describe_attack_expr(label) -> Column:
    """Exact key first, else the longest key that prefixes the label."""
    up = F.upper(F.trim(F.col(label) if isinstance(label, str) else label))
    expr = None
    keys = sorted(ATTACK_DESCRIPTIONS, key=lambda k: (-len(k), k))
    for k in ATTACK_DESCRIPTIONS:
        cond = up == F.lit(k)
        expr = F.when(cond, F.lit(ATTACK_DESCRIPTIONS[k])) if expr is None else \
            expr.when(cond, F.lit(ATTACK_DESCRIPTIONS[k]))
    for k in keys:
        expr = expr.when(up.startswith(F.lit(k)), F.lit(ATTACK_DESCRIPTIONS[k]))
    return expr.otherwise(F.lit(UNKNOWN_ATTACK))


def describe_attack(df: DataFrame, label: str, out: str = "attack_description") -> DataFrame:
    return df.withColumn(out, describe_attack_expr(label))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per label, most frequent first (ties by label)."""
    return (df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc("label")))


def label_proportions(df: DataFrame, label: str) -> DataFrame:
    """Share per label; the total is a window over the k-row count table."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return (counts.withColumn("proportion", F.col("count") / total)
                  .orderBy(F.desc("count"), F.asc("label")))


def source_label_counts(df: DataFrame, source: str, label: str) -> DataFrame:
    """Rows per (source, label), a row each; rows without a label do not count."""
    return (df.select(F.col(source).alias("source"), F.col(label).cast("string").alias("label"))
              .where(F.col("label").isNotNull()).groupBy("source", "label").agg(F.count(F.lit(1)).alias("count")))


def _listable(table: DataFrame, per: str | None, long_form: str) -> DataFrame:
    """A label table that is about to be gathered into one row (or one row a
    ``per`` value), written and counted first: more than MAX_BROADCAST_ROWS
    entries for one row are refused, and the caller is sent to the long form."""
    table, n = materialize_small(table)
    if per is not None and n > MAX_BROADCAST_ROWS:
        n = table.groupBy(per).count().agg(F.max("count")).first()[0]
    if n > MAX_BROADCAST_ROWS:
        raise ValueError(f"{n} labels do not fit one row; {long_form} gives them a row each")
    return table


def label_counts_by_source(df: DataFrame, source: str, label: str) -> DataFrame:
    """Per source the map label -> rows, in label order, and the labelled rows.

    ``source_label_counts`` is the long form; a source with more labels than a
    row may hold raises ValueError.  Sources without a labelled row are left out.
    """
    counts = _listable(source_label_counts(df, source, label), "source", "source_label_counts")
    entries = F.array_sort(F.collect_list(F.struct(F.col("label"), F.col("count"))))
    return counts.groupBy("source").agg(
        F.map_from_entries(entries).alias("total_counts"),
        F.sum("count").alias("source_total"))


def label_totals(df: DataFrame, label: str) -> DataFrame:
    """Rows per label and the grand total (rollup; ``is_total`` marks the latter)."""
    return (df.rollup(F.col(label).cast("string").alias("label"))
              .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("gid"))
              .select("label", "count", (F.col("gid") == 1).alias("is_total")))


def distinct_labels(df: DataFrame, label: str, benign: str = "BENIGN") -> DataFrame:
    """One row: number of labels, number of attack types, labels in order
    (a missing label is none).  Raises ValueError where the labels do not fit
    one row; ``label_counts`` is the long form."""
    d = df.select(F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull()).distinct()
    return _listable(d, None, "label_counts").agg(
        F.count("label").alias("n_labels"),
        F.count_if(~is_benign("label", benign)).alias("n_attack_types"),
        F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))


def new_labels(new: DataFrame, old_dictionary: DataFrame, label: str,
               old_label: str = "label") -> DataFrame:
    """Labels of the new data that the current model does not know."""
    n = new.select(F.col(label).cast("string").alias("label")).distinct()
    o = old_dictionary.select(F.col(old_label).cast("string").alias("label")).distinct()
    return n.join(o, "label", "left_anti")


def label_status(new: DataFrame, old_dictionary: DataFrame, label: str,
                 old_label: str = "label") -> DataFrame:
    """Every label of the new data: its rows and whether the current model
    lacks it (``is_new``).  Rows without a label form a row that is not new."""
    counts = new.groupBy(F.col(label).cast("string").alias("label")) \
                .agg(F.count(F.lit(1)).alias("count"))
    old = broadcast_checked(old_dictionary.select(F.col(old_label).cast("string").alias("label"))
                            .distinct().withColumn("__known", F.lit(True)))
    return counts.join(old, "label", "left").select(
        "label", "count", (F.col("__known").isNull() & F.col("label").isNotNull()).alias("is_new"))


def retrain_stats(new: DataFrame, old_dictionary: DataFrame, label: str,
                  old_label: str = "label") -> DataFrame:
    """The retraining statistics record, one row, from ``label_status`` (its
    long form); raises ValueError where the labels do not fit one row.  Rows
    without a label count among the samples only."""
    tagged = _listable(label_status(new, old_dictionary, label, old_label), None, "label_status")
    named = F.col("label").isNotNull()
    return tagged.agg(
        F.sum("count").alias("total_samples"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(named, F.struct("label", "count")))))
         .alias("label_distribution"),
        F.array_sort(F.collect_list("label")).alias("unique_labels"),
        F.array_sort(F.collect_list(F.when(F.col("is_new"), F.col("label"))))
         .alias("new_labels"),
        F.count_if("is_new").alias("new_labels_count"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Largest/smallest class ratio and the majority share, one row."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return counts.agg(
        F.count("label").alias("n_labels"),
        F.max("count").alias("max_count"),
        F.min("count").alias("min_count"),
        (F.max("count") / F.min("count")).alias("imbalance_ratio"),
        (F.max("count") / F.sum("count")).alias("majority_share"),
        F.min_by("label", F.struct(-F.col("count"), F.col("label"))).alias("majority_label"),
        F.min_by("label", F.struct(F.col("count"), F.col("label"))).alias("minority_label"))


def read_label_map_json(df: DataFrame, column: str) -> DataFrame:
    """Nested JSON ``{file: {label_column, total_counts: {label: n}}}`` -> long rows."""
    schema = "map<string, struct<label_column: string, total_counts: map<string, bigint>>>"
    parsed = df.select(F.explode(F.from_json(F.col(column), schema)).alias("file", "info"))
    return parsed.select("file", F.col("info.label_column").alias("label_column"),
                         F.explode("info.total_counts").alias("label", "count"))
