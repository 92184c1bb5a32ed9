"""Streaming queries: the events table replayed as a file stream, in time order."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from flowlens.functions.levels import threat_level
from flowlens.functions.timefn import epoch_ms, ms_to_text
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register
from flowlens.plans.catalog.detection import NON_BENIGN, W, _level_sql
from flowlens.plans.catalog.model import REQUESTS_SQL, _train, requests
from flowlens.session import scratch_path
from flowlens.sources.bundle import save_bundle
from flowlens.streaming import detect

SLICES = 4
# Events per state partition of the intensity stream.
STATE_ROWS = 1_000_000


def event_slices(spark, sf, slices: int = SLICES) -> tuple[int, int]:
    """(first time, width) in ms of the slices of the events' time span."""
    lo, hi = fx.table(spark, sf, "events").agg(F.min(epoch_ms("ts")), F.max(epoch_ms("ts"))).first()
    return lo, (hi - lo) // slices + 1


def stage_event_stream(spark, sf, slices: int = SLICES, files: int = 1) -> tuple[str, object]:
    """Write events as ``slices`` time-ordered parquet drops (oldest first) of
    ``files`` files; inside a drop, rows are in no order."""
    ev = fx.table(spark, sf, "events")
    lo, width = event_slices(spark, sf, slices)
    root = scratch_path(spark, "event_stream")
    part = F.floor((epoch_ms("ts") - F.lit(lo)) / F.lit(width))
    for k in range(slices):
        ev.filter(part == k).repartition(files, "event_id").write.mode("overwrite").parquet(os.path.join(root, f"drop={k:04d}"))
    return root, ev.schema


def _read_stream(spark, root, schema, files_per_trigger: int = 1):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(root))


def _score_events(stream):
    conf = F.expr(fx.CONFIDENCE_SQL)
    ms = epoch_ms("ts")
    return stream.select(F.col("event_id").alias("id"), ms.alias("ms"), ms_to_text(ms).alias("timestamp"),
                         F.col("event_type").alias("predicted_label"), conf.alias("confidence"),
                         threat_level(F.col("event_type"), conf, benign=fx.EVENT_BENIGN).alias("threat_level"),
                         F.lit(1).alias("features_count"))


def _run_detections(spark, sf):
    root, schema = stage_event_stream(spark, sf)
    hist, alerts, ckpt = (scratch_path(spark, n) for n in ("s_history", "s_alerts", "s_ckpt"))
    detect.run_detection_stream(_read_stream(spark, root, schema), _score_events, hist, alerts, ckpt,
                                benign=fx.EVENT_BENIGN)
    return hist, alerts


_DET_SQL = f"""
SELECT event_id AS id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       event_type AS predicted_label, round({fx.CONFIDENCE_SQL}, 6) AS confidence,
       CASE WHEN upper(event_type) = 'VIEW' THEN 'None' WHEN {fx.CONFIDENCE_SQL} > 0.9 THEN 'High'
            WHEN {fx.CONFIDENCE_SQL} > 0.7 THEN 'Medium' ELSE 'Low' END AS threat_level
FROM events"""


def _det_out(df):
    return df.select("id", "ms", "timestamp", "predicted_label", F.round("confidence", 6).alias("confidence"),
                     "threat_level")


@register("stream_detections", sql=_DET_SQL)
def q_stream_detections(spark, sf):
    hist, _ = _run_detections(spark, sf)
    return _det_out(spark.read.parquet(hist))


@register("stream_alerts", sql=f"SELECT * FROM ({_DET_SQL}) WHERE upper(trim(predicted_label)) <> 'VIEW'")
def q_stream_alerts(spark, sf):
    _, alerts = _run_detections(spark, sf)
    return _det_out(spark.read.parquet(alerts))


@register("window_frequency_stream", sql=f"""
SELECT CAST(floor(ms / 3600000) * 3600000 AS BIGINT) AS window_start_ms,
       CAST(floor(ms / 3600000) * 3600000 + 3600000 AS BIGINT) AS window_end_ms,
       CAST(count(*) AS BIGINT) AS count, {_level_sql('count(*)')} AS level
FROM (SELECT (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN}) GROUP BY 1, 2
""")
def q_window_frequency_stream(spark, sf):
    root, schema = stage_event_stream(spark, sf, files=3)
    out, ckpt = scratch_path(spark, "s_windows"), scratch_path(spark, "s_wckpt")
    _, delay = event_slices(spark, sf)  # a file may be a whole drop behind the newest one
    detect.run_window_counts(_read_stream(spark, root, schema), "ts", "event_type", fx.EVENT_BENIGN,
                             "1 hour", f"{delay} milliseconds", out, ckpt)
    w = detect.latest_window_counts(spark, out)
    from flowlens.functions.levels import intensity_level
    return w.select("window_start_ms", "window_end_ms", "count", intensity_level("count").alias("level"))


def close_event_stream(spark, sf, root: str, behind_ms: int, slices: int = SLICES) -> None:
    """Two more drops of a benign row, so late that everything before it is
    settled: the first moves the watermark, which takes effect with the second."""
    ev = fx.table(spark, sf, "events")
    newest = ev.orderBy(F.desc("ts")).limit(1)
    for k in range(2):
        late = F.col("ts") + F.make_dt_interval(secs=F.lit((behind_ms + k) / 1000))
        newest.withColumn("ts", late.cast(ev.schema["ts"].dataType)).withColumn("event_type", F.lit(fx.EVENT_BENIGN)) \
            .select(*ev.columns).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"drop={slices + k:04d}"))


_RANK_SQL = "CASE level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"


@register("stream_intensity", sql=f"""
WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, min(event_id) AS event_id, count(*) AS n
           FROM events WHERE {NON_BENIGN} GROUP BY 1, 2),
p AS (SELECT user_id, ms, event_id, n FROM e UNION ALL SELECT user_id, ms + {W} + 1, NULL, 0 FROM e),
c AS (SELECT user_id, ms, event_id, n,
             CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W} PRECEDING AND CURRENT ROW) AS BIGINT) AS count,
             CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W} + 1 PRECEDING AND 1 PRECEDING), 0)
                  AS BIGINT) AS earlier FROM p),
l AS (SELECT *, {_level_sql('count')} AS level, {_level_sql('earlier')} AS old FROM c),
v AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY ms), 'Low') AS last FROM l WHERE event_id IS NOT NULL)
SELECT user_id, event_id, ms, count, last AS previous_level, level, 'change' AS kind FROM v WHERE last <> level
UNION ALL
SELECT user_id, NULL, ms, count, old, level, CASE count WHEN 0 THEN 'cleared' ELSE 'decay' END
FROM l WHERE event_id IS NULL AND (count = 0 OR {_RANK_SQL} < {_RANK_SQL.replace('level', 'old')})
""")
def q_stream_intensity(spark, sf):
    root, schema = stage_event_stream(spark, sf, files=2)
    _, delay = event_slices(spark, sf)  # a file may be a whole drop behind the newest one
    close_event_stream(spark, sf, root, W + delay + 1000)
    partitions = 4 + fx.table(spark, sf, "events").count() // STATE_ROWS
    out, ckpt = scratch_path(spark, "s_intensity"), scratch_path(spark, "s_ickpt")
    detect.run_intensity_stream(_read_stream(spark, root, schema), "user_id", "ts", "event_id", "event_type",
                                fx.EVENT_BENIGN, W, out, ckpt, delay, state_partitions=partitions,
                                groups=8 * partitions)
    return spark.read.parquet(out).drop("run_id", "batch_id")


@register("stream_score", sql=f"""
WITH r AS (SELECT *, CASE WHEN vec_id < (SELECT median(vec_id) FROM embeddings) THEN 1 ELSE 2 END AS version FROM ({REQUESTS_SQL}))
SELECT 'history' AS output, id, ms, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS timestamp,
       64 AS features_count, version AS model_version, NULL AS error FROM r WHERE state = 'ok'
UNION ALL
SELECT 'rejects', id, ms, NULL, NULL, NULL, state FROM r WHERE state <> 'ok'
""")
def q_stream_score(spark, sf):
    """Raw bodies in two drops; a new model version is published between them."""
    bundle = _train(spark, sf).bundle
    rows = requests(spark, sf)
    middle = rows.agg(F.median("vec_id")).first()[0]
    src, bundles, hist, alerts, rejects, ckpt = (scratch_path(spark, n) for n in (
        "req_stream", "req_bundles", "e_history", "e_alerts", "e_rejects", "e_ckpt"))
    for k, part in enumerate((F.col("vec_id") < middle, F.col("vec_id") >= middle)):
        rows.filter(part).repartition(2).write.parquet(os.path.join(src, f"drop={k:04d}"))
        save_bundle(spark, bundles, bundle)
        detect.run_request_stream(_read_stream(spark, src, rows.schema), "body", "id", "ts", bundles, hist, alerts,
                                  rejects, ckpt)
    good = spark.read.parquet(hist).select(
        F.lit("history").alias("output"), "id", "ms", "timestamp", "features_count", "model_version",
        F.lit(None).cast("string").alias("error"))
    bad = spark.read.parquet(rejects).select(F.lit("rejects").alias("output"), "id", "ms", "error")
    return good.unionByName(bad, allowMissingColumns=True)
