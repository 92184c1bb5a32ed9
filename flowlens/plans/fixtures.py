"""Bindings of the operators to the driver's tables.

No flow dataset ships with the original project, so the operators run on
stand-ins with the same shape (see FIXTURES.md):

* ``lineitem``   labelled numeric flow table (label ``l_returnflag``, benign ``N``)
* ``orders``     keyed labelled table for sampling and splits
* ``events``     time-ordered detections (run ``user_id``, benign ``view``)
* ``embeddings`` feature vectors with a class, and a deterministic
                 class-probability table for evaluation
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.levels import threat_level
from flowlens.functions.timefn import epoch_ms, ms_to_text

FLOW_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLOW_LABEL = "l_returnflag"
FLOW_BENIGN = "N"
EVENT_BENIGN = "view"
N_CLASSES = 10
SEED = 42
# Sliding-window width and timeline tick used on the events table.
INTENSITY_WINDOW_MS = 2 * 24 * 3600 * 1000
TIMELINE_TICK_MS = 6 * 3600 * 1000

# Derived fixtures; the same text is used inside the Spark query and the oracle.
DIRTY_VALUE_SQL = ("CASE WHEN event_id % 97 = 0 THEN CAST('Infinity' AS DOUBLE) "
                   "WHEN event_id % 89 = 0 THEN CAST('-Infinity' AS DOUBLE) "
                   "WHEN event_id % 83 = 0 THEN CAST('NaN' AS DOUBLE) "
                   "WHEN event_id % 79 = 0 THEN NULL ELSE value END")
TEXT_VALUE_SQL = "CASE WHEN event_id % 50 = 0 THEN 'abc' ELSE CAST(value AS STRING) END"
CONFIDENCE_SQL = "value / (value + 10)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *FLOW_FEATURES, FLOW_LABEL)


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "ts", "event_type",
                     F.expr(DIRTY_VALUE_SQL).alias("value"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection records derived from events: one per event, as the scorer writes them."""
    ev = table(spark, sf_dir, "events")
    conf = F.expr(CONFIDENCE_SQL)
    ms = epoch_ms("ts")
    return ev.select(F.col("event_id").alias("id"), "user_id", F.col("ts"), ms.alias("ms"),
                     ms_to_text(ms).alias("timestamp"),
                     F.col("event_type").alias("predicted_label"),
                     conf.alias("confidence"),
                     threat_level(F.col("event_type"), conf, benign=EVENT_BENIGN).alias("threat_level"),
                     F.lit(1).alias("features_count"), "value")


def probability_table(spark: SparkSession, sf_dir: str, offset: int = 0) -> DataFrame:
    """vec_id, actual class, probs (p_i = e_i^4 / sum of 10 e_j^4), predicted.

    ``offset`` picks which 10 embedding entries act as class scores (0 -> the
    first ten); a second offset gives a second "model" on the same rows.
    The sum runs left to right, the same order as the SQL text.
    """
    em = table(spark, sf_dir, "embeddings")
    q = F.transform(F.slice("embedding", offset + 1, N_CLASSES),
                    lambda x: x.cast("double") * x.cast("double") * x.cast("double") * x.cast("double"))
    out = em.select("vec_id", F.col("label").alias("actual"), q.alias("__q"))
    total = F.aggregate("__q", F.lit(0.0), lambda acc, x: acc + x)
    out = out.select("vec_id", "actual", F.transform("__q", lambda x: x / total).alias("probs"))
    return out.withColumn("predicted",
                          (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))


def q_sql(i: int) -> str:
    return f"(CAST(embedding[{i}] AS DOUBLE) * CAST(embedding[{i}] AS DOUBLE) * " \
           f"CAST(embedding[{i}] AS DOUBLE) * CAST(embedding[{i}] AS DOUBLE))"


def probability_sql(offset: int = 0) -> str:
    """DuckDB text of ``probability_table`` (same arithmetic order)."""
    total = " + ".join(q_sql(offset + i) for i in range(1, N_CLASSES + 1))
    total = "(" + total + ")"
    probs = ", ".join(f"{q_sql(offset + i)} / {total}" for i in range(1, N_CLASSES + 1))
    base = f"SELECT vec_id, label AS actual, [{probs}] AS probs FROM embeddings"
    return (f"SELECT vec_id, actual, probs, "
            f"CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted FROM ({base})")
