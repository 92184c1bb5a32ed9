"""Seeded sampling, quota and split queries (orders / events)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.digest import draw_rank
from flowlens.functions.numeric import round6
from flowlens.operators import labels, sampling
from flowlens.operators._small import materialize
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register

SAMPLE_N = 5000
QUOTA_N = 1000
REWEIGHT_N = 5000
ZERO_LABEL = "5-LOW"
BOOST_LABEL = "1-URGENT"
BOOST_N = 100
REPLAY_START_MS = 1704067200000  # 2024-01-01 00:00:00 UTC


def _orders(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority",
                                               "o_totalprice")


def _draw_sql(group_sql: str, draw_sql: str, n_sql: str) -> str:
    return (f"1 + (('0x' || substr(md5('42|draw|' || {group_sql} || '|' || {draw_sql}), 1, 15))::BIGINT"
            f" % {n_sql})")


@register("group_rank", sql="""
SELECT o_orderkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey)) AS rank,
       count(*) OVER (PARTITION BY o_orderpriority) AS group_size
FROM orders
""")
def q_group_rank(spark, sf):
    ranked, _ = sampling.group_rank(_orders(spark, sf), "o_orderpriority", ["o_orderkey"], fx.SEED)
    return ranked.select("o_orderkey", "o_orderpriority", "rank", "group_size")


@register("sample_rows", sql=f"""
WITH t AS (SELECT o_orderkey, o_orderpriority,
                  row_number() OVER (ORDER BY md5('42|' || o_orderkey)) AS rank, count(*) OVER () AS n
           FROM orders)
SELECT o_orderkey, o_orderpriority, rank AS draw_no FROM t WHERE n >= {SAMPLE_N} AND rank <= {SAMPLE_N}
UNION ALL
SELECT t.o_orderkey, t.o_orderpriority, d.draw_no
FROM (SELECT i AS draw_no FROM range(1, {SAMPLE_N} + 1) r(i)) d
JOIN t ON t.rank = {_draw_sql("'__all__'", "d.draw_no", "t.n")}
WHERE t.n < {SAMPLE_N}
""")
def q_sample_rows(spark, sf):
    out = sampling.sample_rows(_orders(spark, sf), ["o_orderkey"], SAMPLE_N, fx.SEED)
    return out.select("o_orderkey", "o_orderpriority", "draw_no")


@register("quota_proportional", sql=f"""
WITH c AS (SELECT o_orderpriority AS label, count(*) AS count FROM orders GROUP BY 1),
s AS (SELECT label, count, count / sum(count) OVER () AS share FROM c),
r AS (SELECT *, CAST(round_even(share * {QUOTA_N}, 0) AS BIGINT) AS raw_quota,
             row_number() OVER (ORDER BY count DESC, label) AS top FROM s)
SELECT label, CAST(count AS BIGINT) AS count, round(share, 6) AS share,
       CAST(raw_quota + CASE WHEN top = 1 THEN {QUOTA_N} - sum(raw_quota) OVER () ELSE 0 END AS BIGINT) AS quota
FROM r
""")
def q_quota_proportional(spark, sf):
    out = sampling.quota_proportional(_orders(spark, sf), "o_orderpriority", QUOTA_N)
    return out.withColumn("share", round6("share"))


_REWEIGHT_SQL = f"""
SELECT label, CAST(weight AS DOUBLE) AS weight,
       CAST(floor(weight / sum(weight) OVER () * {float(REWEIGHT_N)}) AS BIGINT) AS quota
FROM (SELECT label, CASE WHEN label = '{ZERO_LABEL}' THEN 0.0 ELSE CAST(n AS DOUBLE) END AS weight
      FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1))
WHERE weight > 0
"""


def _reweight(spark, sf):
    weights = labels.label_counts(_orders(spark, sf), "o_orderpriority")
    return sampling.quota_reweight(weights, "label", "count", REWEIGHT_N, zero_label=ZERO_LABEL)


@register("quota_reweight", sql=_REWEIGHT_SQL)
def q_quota_reweight(spark, sf):
    return _reweight(spark, sf)


def _stratified_sql(quota_sql: str) -> str:
    return f"""
WITH q AS ({quota_sql}),
r AS (SELECT o_orderkey, o_orderpriority,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey)) AS rank,
             count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
s AS (SELECT DISTINCT o_orderpriority AS label, n FROM r),
d0 AS (SELECT q.label, s.n, unnest(generate_series(1, q.quota)) AS draw_no
       FROM q JOIN s ON q.label = s.label WHERE q.quota > 0),
d AS (SELECT label, draw_no, {_draw_sql("label", "draw_no", "n")} AS rank FROM d0)
SELECT r.o_orderkey, r.o_orderpriority, d.draw_no
FROM d JOIN r ON r.o_orderpriority = d.label AND r.rank = d.rank
"""


@register("stratified_sample", sql=_stratified_sql(_REWEIGHT_SQL))
def q_stratified_sample(spark, sf):
    sample, _ = sampling.stratified_sample(_orders(spark, sf), "o_orderpriority", ["o_orderkey"],
                                           _reweight(spark, sf), fx.SEED)
    return sample.select("o_orderkey", "o_orderpriority", "draw_no")


@register("boost_label", sql=_stratified_sql(
    f"SELECT '{BOOST_LABEL}' AS label, {BOOST_N} AS quota"))
def q_boost_label(spark, sf):
    out = sampling.boost_label(_orders(spark, sf), "o_orderpriority", ["o_orderkey"], BOOST_LABEL,
                               BOOST_N, fx.SEED)
    return out.select("o_orderkey", "o_orderpriority", "draw_no")


@register("shuffle_rows", sql="""
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY md5('42|' || o_orderkey)) - 1 AS row_index
FROM orders
""")
def q_shuffle_rows(spark, sf):
    out = sampling.shuffle_rows(_orders(spark, sf), ["o_orderkey"], fx.SEED)
    return out.select("o_orderkey", "o_orderpriority", "row_index")


@register("sample_library", sql="""
SELECT event_id, event_type, user_id, value, rank FROM (
  SELECT event_id, trim(event_type) AS event_type, user_id, value,
         row_number() OVER (PARTITION BY trim(event_type) ORDER BY md5('42|' || event_id)) AS rank
  FROM events WHERE upper(trim(event_type)) <> 'VIEW')
WHERE rank <= 5
""")
def q_sample_library(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    out = sampling.sample_library(ev, "event_type", ["event_id"], fx.EVENT_BENIGN, 5, fx.SEED)
    return out.select("event_id", "event_type", "user_id", "value", "rank")


_SPLIT_QUOTA_SQL = """
WITH c AS (SELECT o_orderstatus AS label, count(*) AS count FROM orders GROUP BY 1),
t AS (SELECT sum(count) AS n, CAST(ceil(0.2::DOUBLE * sum(count)) AS BIGINT) AS n_test FROM c),
a AS (SELECT c.label, c.count, c.count / t.n * (t.n - t.n_test) AS cont, t.n - t.n_test AS n_train FROM c, t),
b AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a),
e AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label) AS ord FROM b)
SELECT label, CAST(count AS BIGINT) AS count,
       CAST(fl + CASE WHEN ord <= need THEN 1 ELSE 0 END AS BIGINT) AS train_quota,
       CAST(count - (fl + CASE WHEN ord <= need THEN 1 ELSE 0 END) AS BIGINT) AS test_quota
FROM e
"""


@register("split_quotas", sql=_SPLIT_QUOTA_SQL)
def q_split_quotas(spark, sf):
    return sampling.split_quotas(_orders(spark, sf), "o_orderstatus", 0.2)


@register("stratified_split", sql=f"""
WITH q AS ({_SPLIT_QUOTA_SQL})
SELECT o.o_orderkey, o.o_orderstatus, CASE WHEN o.rank <= q.test_quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT o_orderkey, o_orderstatus,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) AS rank
      FROM orders) o JOIN q ON q.label = o.o_orderstatus
""")
def q_stratified_split(spark, sf):
    out = sampling.stratified_split(_orders(spark, sf), "o_orderstatus", ["o_orderkey"], 0.2, fx.SEED)
    return out.select("o_orderkey", "o_orderstatus", "split")


@register("replay_schedule", sql=f"""
WITH t AS (SELECT event_id, event_type, value,
                  row_number() OVER (ORDER BY md5('42|' || event_id)) AS rank, count(*) OVER () AS n
           FROM events WHERE upper(trim(event_type)) <> 'VIEW'),
d AS (SELECT i AS at_ms FROM range(0, 10000, 500) r(i))
SELECT d.at_ms, {REPLAY_START_MS} + d.at_ms AS ts, t.event_type AS label, printf('%.6f', t.value) AS features,
       'High' AS mode, 20 AS attack_frequency, 'High' AS frequency_level
FROM d JOIN t ON t.rank = {_draw_sql("'replay'", "d.at_ms", "t.n")}
""")
def q_replay_schedule(spark, sf):
    ev = fx.table(spark, sf, "events").filter(F.upper(F.trim("event_type")) != "VIEW")
    events, header = sampling.replay_schedule(ev, ["event_id"], ["value"], label="event_type",
                                              window_s=10, mode="High", start_ms=REPLAY_START_MS,
                                              seed=fx.SEED)
    h = header.first()  # one row: mode and frequency summary
    return events.select("at_ms", "ts", "label",
                         F.array_join(F.transform("features", lambda x: F.format_string("%.6f", x)), ",")
                         .alias("features"),
                         F.lit(h["mode"]).alias("mode"), F.lit(h["attack_frequency"]).alias("attack_frequency"),
                         F.lit(h["frequency_level"]).alias("frequency_level"))


ATTACH_DRAWS = 3


@register("attach_draw", sql=f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey)) AS rank,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
d AS (SELECT s.label, g.draw_no, {_draw_sql("s.label", "g.draw_no", "s.n")} AS rank
      FROM (SELECT DISTINCT o_orderstatus AS label, n FROM r) s,
           (SELECT i AS draw_no FROM range(1, {ATTACH_DRAWS} + 1) t(i)) g)
SELECT r.o_orderkey, r.o_orderstatus, d.draw_no, d.rank
FROM d JOIN r ON r.o_orderstatus = d.label AND r.rank = d.rank
""")
def q_attach_draw(spark, sf):
    orders, keys = _orders(spark, sf), ["o_orderkey"]
    counts = materialize(sampling.bucket_counts(orders, "o_orderstatus", keys, fx.SEED), "directory")
    draws = (sampling.group_sizes(counts)
             .select(F.col("__g").alias("o_orderstatus"), "group_size",
                     F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(ATTACH_DRAWS).cast("bigint"))).alias("draw_no"))
             .withColumn("rank", draw_rank(fx.SEED, F.col("o_orderstatus"), F.col("draw_no"), F.col("group_size")))
             .drop("group_size"))
    out = sampling.rows_at(orders, "o_orderstatus", keys, draws, fx.SEED, counts)
    return out.select("o_orderkey", "o_orderstatus", "draw_no", "rank")


_NULL_LABEL = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END"
NULL_QUOTA = 40


@register("stratified_sample_null_label", sql=f"""
WITH o AS (SELECT o_orderkey, {_NULL_LABEL} AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || o_orderkey)) AS rank,
             count(*) OVER (PARTITION BY label) AS n FROM o),
d0 AS (SELECT label, n, unnest(generate_series(1, {NULL_QUOTA})) AS draw_no FROM (SELECT DISTINCT label, n FROM r)),
d AS (SELECT *, {_draw_sql("coalesce(label, chr(0))", "draw_no", "n")} AS at FROM d0)
SELECT r.o_orderkey, r.label, d.draw_no FROM d JOIN r ON r.label IS NOT DISTINCT FROM d.label AND r.rank = d.at
""")
def q_stratified_sample_null_label(spark, sf):
    orders = _orders(spark, sf).select("o_orderkey", F.expr(_NULL_LABEL).alias("label"))
    quotas = orders.select("label").distinct().withColumn("quota", F.lit(NULL_QUOTA))
    sample, _ = sampling.stratified_sample(orders, "label", ["o_orderkey"], quotas, fx.SEED)
    return sample.select("o_orderkey", "label", "draw_no")
