"""Detection history, alerts and intensity queries over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.levels import intensity_level
from flowlens.functions.timefn import epoch_ms
from flowlens.operators import cleaning, detection
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register

W = fx.INTENSITY_WINDOW_MS
TICK = fx.TIMELINE_TICK_MS
CONF = fx.CONFIDENCE_SQL
NON_BENIGN = "upper(trim(event_type)) <> 'VIEW'"


def _level_sql(c: str) -> str:
    return f"CASE WHEN {c} <= 5 THEN 'Low' WHEN {c} <= 10 THEN 'Medium' ELSE 'High' END"


_THREAT_SQL = (f"CASE WHEN upper(event_type) = 'VIEW' THEN 'None' WHEN {CONF} > 0.9 THEN 'High' "
               f"WHEN {CONF} > 0.7 THEN 'Medium' ELSE 'Low' END")
_HIST_SQL = (f"(SELECT event_id AS id, user_id, (epoch_us(ts) // 1000) AS ms, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, "
             f"event_type AS predicted_label, {CONF} AS confidence, {_THREAT_SQL} AS threat_level FROM events)")


def _hist_out(df):
    return df.select("id", "ms", "timestamp", "type", F.round("confidence", 6).alias("confidence"),
                     "level", *(["threat_level"] if "threat_level" in df.columns else []))


@register("recent_history", sql=f"""
SELECT id, ms, timestamp, predicted_label AS type, round(confidence, 6) AS confidence,
       threat_level AS level, threat_level FROM {_HIST_SQL} ORDER BY ms DESC, id DESC LIMIT 100
""")
def q_recent_history(spark, sf):
    out = detection.recent_history(fx.detections(spark, sf), "ms", "id", 100)
    return _hist_out(out)


@register("recent_alerts", sql=f"""
SELECT id, ms, timestamp, predicted_label AS type, round(confidence, 6) AS confidence, threat_level AS level
FROM {_HIST_SQL} WHERE upper(trim(predicted_label)) <> 'VIEW' ORDER BY ms DESC, id DESC LIMIT 50
""")
def q_recent_alerts(spark, sf):
    out = detection.recent_alerts(fx.detections(spark, sf), "ms", "id", fx.EVENT_BENIGN, 50)
    return _hist_out(out)


@register("recent_alerts_per_user", sql=f"""
SELECT user_id, id, ms, timestamp, type, confidence, level FROM (
  SELECT user_id, id, ms, timestamp, predicted_label AS type, round(confidence, 6) AS confidence,
         threat_level AS level, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, id DESC) AS r
  FROM {_HIST_SQL} WHERE upper(trim(predicted_label)) <> 'VIEW')
WHERE r <= 5
""")
def q_recent_alerts_per_user(spark, sf):
    out = detection.recent_alerts(fx.detections(spark, sf), "ms", "id", fx.EVENT_BENIGN, 5, run="user_id")
    return out.select("user_id", "id", "ms", "timestamp", "type", F.round("confidence", 6).alias("confidence"),
                      "level")


_SLIDING_SQL = f"""
SELECT event_id, user_id, ms,
       count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {W} PRECEDING AND CURRENT ROW) AS count
FROM (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN})"""


@register("sliding_attack_count", sql=f"""
SELECT event_id, user_id, ms, CAST(count AS BIGINT) AS count, {_level_sql('count')} AS level
FROM ({_SLIDING_SQL})
""")
def q_sliding_attack_count(spark, sf):
    ev = fx.table(spark, sf, "events")
    out = detection.sliding_attack_count(ev, "user_id", "ts", "event_type", fx.EVENT_BENIGN, W)
    return out.select("event_id", "user_id", "ms", "count", "level")


@register("sliding_attack_count_global", sql=f"""
SELECT event_id, ms, CAST(count(*) OVER (ORDER BY ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS BIGINT)
       AS count
FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN})
""")
def q_sliding_attack_count_global(spark, sf):
    # one global gauge (no run key): bucketed, so it never collapses to one partition
    ev = fx.table(spark, sf, "events")
    out = detection.sliding_attack_count(ev, None, "ts", "event_type", fx.EVENT_BENIGN, 3600000)
    return out.select("event_id", "ms", "count")


@register("level_changes", sql=f"""
WITH c AS (SELECT *, {_level_sql('count')} AS level FROM ({_SLIDING_SQL})),
l AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY ms, event_id), 'Low') AS previous_level
      FROM c)
SELECT event_id, user_id, ms, CAST(count AS BIGINT) AS count, previous_level, level,
       CASE WHEN (CASE level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END)
               > (CASE previous_level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END)
            THEN 'up' ELSE 'down' END AS direction
FROM l WHERE previous_level <> level
""")
def q_level_changes(spark, sf):
    ev = fx.table(spark, sf, "events")
    by_time = detection.sliding_attack_times(ev, "user_id", "ts", "event_type", fx.EVENT_BENIGN, W, "event_id")
    out = detection.level_changes(by_time, "user_id", "ms", "event_id")
    return out.select("event_id", "user_id", "ms", "count", "previous_level", "level", "direction")


@register("window_frequency", sql=f"""
SELECT CAST(floor(ms / 3600000) * 3600000 AS BIGINT) AS window_start_ms,
       CAST(floor(ms / 3600000) * 3600000 + 3600000 AS BIGINT) AS window_end_ms,
       CAST(count(*) AS BIGINT) AS count, {_level_sql('count(*)')} AS level
FROM (SELECT (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN}) GROUP BY 1, 2
""")
def q_window_frequency(spark, sf):
    ev = fx.table(spark, sf, "events")
    return detection.window_frequency(ev, "ts", "event_type", fx.EVENT_BENIGN, "1 hour")


@register("intensity_level", sql=f"""
SELECT user_id, CAST(floor(ms / 604800000) * 604800000 AS BIGINT) AS window_start_ms,
       CAST(floor(ms / 604800000) * 604800000 + 604800000 AS BIGINT) AS window_end_ms,
       CAST(count(*) AS BIGINT) AS count, {_level_sql('count(*)')} AS level
FROM (SELECT user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN}) GROUP BY 1, 2, 3
""")
def q_intensity_level(spark, sf):
    ev = fx.table(spark, sf, "events")
    return detection.window_frequency(ev, "ts", "event_type", fx.EVENT_BENIGN, "7 days", run="user_id")


@register("intensity_timeline", sql=f"""
WITH ev AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms FROM events WHERE {NON_BENIGN}),
span AS (SELECT user_id, CAST(ceil(min(ms) / {TICK}) AS BIGINT) AS lo,
                CAST(floor((max(ms) + {W}) / {TICK}) AS BIGINT) + 1 AS hi FROM ev GROUP BY 1),
ticks AS (SELECT user_id, unnest(generate_series(lo, hi)) AS tick FROM span),
cov AS (SELECT user_id, unnest(generate_series(CAST(ceil(ms / {TICK}) AS BIGINT),
                                               CAST(floor((ms + {W}) / {TICK}) AS BIGINT))) AS tick FROM ev),
cnt AS (SELECT user_id, tick, count(*) AS n FROM cov GROUP BY ALL)
SELECT t.user_id, t.tick * {TICK} AS tick_ms, CAST(coalesce(n, 0) AS BIGINT) AS count,
       {_level_sql('coalesce(n, 0)')} AS level
FROM ticks t LEFT JOIN cnt ON t.user_id = cnt.user_id AND t.tick = cnt.tick
""")
def q_intensity_timeline(spark, sf):
    ev = fx.table(spark, sf, "events")
    return detection.intensity_timeline(ev, "user_id", "ts", "event_type", fx.EVENT_BENIGN, W, TICK)


@register("live_log", sql=f"""
SELECT id, 'DETECTED: ' || predicted_label AS message,
       '(Conf: ' || printf('%.4f', confidence * 100) || '%)' AS confidence_text,
       CASE WHEN threat_level = 'None' THEN 'success' ELSE 'danger' END AS type
FROM {_HIST_SQL}
""")
def q_live_log(spark, sf):
    out = detection.live_log(fx.detections(spark, sf), "predicted_label", "confidence", "threat_level")
    return out.select("id", "message", "confidence_text", "type")


_CHANGES_SQL = f"""
SELECT event_id, user_id, ms, count, level FROM (
  SELECT *, coalesce(lag(level) OVER (PARTITION BY user_id ORDER BY ms, event_id), 'Low') AS previous_level
  FROM (SELECT *, {_level_sql('count')} AS level FROM ({_SLIDING_SQL})))
WHERE previous_level <> level"""


@register("live_log_events", sql=f"""
SELECT user_id, ms, id, 0 AS entry, 'DETECTED: ' || predicted_label AS message,
       '(Conf: ' || printf('%.4f', confidence * 100) || '%)' AS confidence_text,
       CASE WHEN threat_level = 'None' THEN 'success' ELSE 'danger' END AS type
FROM {_HIST_SQL}
UNION ALL
SELECT user_id, ms, event_id, 1, '[ALERT] Traffic intensity escalated to <b>' || level || '</b> ({W // 1000}s non-BENIGN count='
       || count || ')', NULL, CASE level WHEN 'High' THEN 'danger' ELSE 'info' END
FROM ({_CHANGES_SQL})
""")
def q_live_log_events(spark, sf):
    ev = fx.table(spark, sf, "events")
    times = detection.sliding_attack_times(ev, "user_id", "ts", "event_type", fx.EVENT_BENIGN, W, "event_id")
    changes = detection.level_changes(times, "user_id", "ms", "event_id").withColumnRenamed("event_id", "id")
    return detection.event_log(fx.detections(spark, sf), changes, "user_id", "ms", "id", "predicted_label", "confidence",
                               "threat_level", W // 1000)


@register("display_threat", sql=f"""
WITH c AS (SELECT event_id, user_id, {_THREAT_SQL} AS threat,
                  sum(CASE WHEN {NON_BENIGN} THEN 1 ELSE 0 END) OVER (
                      PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN {W} PRECEDING AND CURRENT ROW)
                  AS active_count
           FROM events)
SELECT event_id, user_id, CAST(active_count AS BIGINT) AS active_count,
       CASE WHEN active_count > 0 THEN {_level_sql('active_count')} ELSE coalesce(threat, 'Idle') END
         AS display_threat
FROM c
""")
def q_display_threat(spark, sf):
    d = fx.detections(spark, sf).select(F.col("id").alias("event_id"), "user_id", "ts",
                                        F.col("predicted_label").alias("event_type"), "threat_level")
    out = detection.display_threat(d, "user_id", "ts", "event_type", fx.EVENT_BENIGN, "threat_level", W)
    return out.select("event_id", "user_id", "active_count", "display_threat")


@register("union_datasets", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag FROM lineitem
""")
def q_union_datasets(spark, sf):
    f = fx.flows(spark, sf)
    li = fx.table(spark, sf, "lineitem").select("l_linestatus")
    base = fx.table(spark, sf, "lineitem")
    original = base.filter(F.col("l_linestatus") == "F").select(*f.columns)
    upload = base.filter(F.col("l_linestatus") == "O").select(*reversed(f.columns))
    return original.unionByName(upload)
