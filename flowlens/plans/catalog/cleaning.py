"""Cleaning, projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import cleaning
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register

DIRTY = f"(SELECT event_id, user_id, ts, event_type, {fx.DIRTY_VALUE_SQL} AS value FROM events)"


def _kind(c):
    return (F.when(F.col(c).isNull(), F.lit("null")).when(F.isnan(c), F.lit("nan"))
            .when(F.abs(F.col(c)) == F.lit(float("inf")), F.lit("inf")).otherwise(F.lit("finite")))


_KIND_SQL = ("CASE WHEN {c} IS NULL THEN 'null' WHEN isnan({c}) THEN 'nan' "
             "WHEN isinf({c}) THEN 'inf' ELSE 'finite' END")


@register("inf_to_null", sql=f"""
SELECT event_id,
       CASE WHEN isinf(value) OR isnan(value) THEN NULL ELSE value END AS value,
       {_KIND_SQL.format(c="CASE WHEN isinf(value) THEN NULL ELSE value END")} AS value_kind
FROM {DIRTY}
""")
def q_inf_to_null(spark, sf):
    df = cleaning.inf_to_null(fx.dirty_events(spark, sf).select("event_id", "value"))
    # NaN is kept by the operator; shown as null plus its kind for a stable check.
    return df.select("event_id", F.nanvl("value", F.lit(None).cast("double")).alias("value"),
                     _kind("value").alias("value_kind"))


@register("drop_missing", sql=f"""
SELECT event_id, user_id, event_type, value FROM {DIRTY}
WHERE value IS NOT NULL AND NOT isnan(value)
""")
def q_drop_missing(spark, sf):
    df = fx.dirty_events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return cleaning.drop_missing(df)


@register("clean_for_training", sql=f"""
SELECT event_id, user_id, event_type, value FROM {DIRTY}
WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)
""")
def q_clean_for_training(spark, sf):
    df = fx.dirty_events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return cleaning.clean_for_training(df)


@register("clean_summary", sql=f"""
SELECT CAST(count(*) AS BIGINT) AS rows_before,
       CAST(count(*) FILTER (WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)) AS BIGINT)
         AS rows_after,
       5 AS n_columns
FROM {DIRTY}
""")
def q_clean_summary(spark, sf):
    df = fx.dirty_events(spark, sf).select("event_id", "user_id", "ts", "event_type", "value")
    return cleaning.clean_summary(df)


@register("fill_for_scoring", sql=f"""
SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 0.0 ELSE value END AS value
FROM {DIRTY}
""")
def q_fill_for_scoring(spark, sf):
    return cleaning.fill_for_scoring(fx.dirty_events(spark, sf).select("event_id", "value"), ["value"])


@register("coerce_numeric", sql=f"""
SELECT event_id, coalesce(CASE WHEN isnan(v) THEN NULL ELSE v END, 0.0) AS value_text
FROM (SELECT event_id, TRY_CAST({fx.TEXT_VALUE_SQL.replace('AS STRING', 'AS VARCHAR')} AS DOUBLE) AS v
      FROM events)
""")
def q_coerce_numeric(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", F.expr(fx.TEXT_VALUE_SQL).alias("value_text"))
    return cleaning.coerce_numeric(ev, ["value_text"])


@register("numeric_only", sql="""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem
""")
def q_numeric_only(spark, sf):
    return cleaning.numeric_only(fx.table(spark, sf, "lineitem"))


_CONTRACT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_flow_bytes"]


@register("align_features", sql="""
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, 0.0 AS l_discount, l_tax,
       0.0 AS l_flow_bytes
FROM lineitem
""")
def q_align_features(spark, sf):
    # an upload whose l_discount arrives as text and that lacks l_flow_bytes
    li = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax",
        F.col("l_discount").cast("string").alias("l_discount"), "l_returnflag", "l_shipdate")
    return cleaning.align_features(li, _CONTRACT, keep=["l_orderkey", "l_linenumber"])


@register("resolve_features", sql="""
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag AS label
FROM lineitem
""")
def q_resolve_features(spark, sf):
    li = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", *fx.FLOW_FEATURES, F.col("l_returnflag").alias(" Label "),
        "l_linestatus")
    # the contract names a column that is absent -> fall back to all numeric columns
    out, _, _ = cleaning.resolve_features(li, contract=None)
    return out


@register("common_columns", sql="""
SELECT 'original' AS part, l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'F'
UNION ALL
SELECT 'upload' AS part, l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_linestatus = 'O'
""")
def q_common_columns(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    a = li.filter(F.col("l_linestatus") == "F").select("l_tax", "l_returnflag", "l_quantity", "l_orderkey")
    b = li.filter(F.col("l_linestatus") == "O").select("l_orderkey", "l_discount", "l_quantity", "l_returnflag")
    a2, b2, _ = cleaning.common_columns(a, b)
    return (a2.withColumn("part", F.lit("original"))
              .unionByName(b2.withColumn("part", F.lit("upload"))))


@register("split_xy", sql="""
SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
""")
def q_split_xy(spark, sf):
    x, _ = cleaning.split_xy(fx.flows(spark, sf).drop("l_orderkey", "l_linenumber"), fx.FLOW_LABEL)
    return x


@register("check_feature_count", sql="""
SELECT vec_id, n AS n_features,
       CASE WHEN n = 64 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN n = 64 THEN NULL ELSE 'Feature mismatch. Expected 64, got ' || n || '.' END AS message
FROM (SELECT vec_id, CAST(len(embedding[1:64 - (vec_id % 3)]) AS INTEGER) AS n FROM embeddings)
""")
def q_check_feature_count(spark, sf):
    em = fx.table(spark, sf, "embeddings").select(
        "vec_id", F.expr("slice(embedding, 1, 64 - CAST(vec_id % 3 AS INT))").alias("features"))
    out = cleaning.check_feature_count(em, "features", 64)
    return out.select("vec_id", F.size("features").alias("n_features"), "status", "message")


_REQ_SQL = """
WITH req AS (
  SELECT 'event-' || event_id AS request_id, props AS body FROM events
  UNION ALL
  SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL
  SELECT 'vec-' || vec_id,
         '{"features": [' || array_to_string(list_transform(embedding[1:64 - (vec_id % 2)],
                                                            lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ', ') || ']}'
  FROM embeddings
  UNION ALL
  SELECT 'scalar-' || vec_id, '{"features": ' || vec_id || '}' FROM embeddings
)
SELECT request_id,
       CASE WHEN NOT json_valid(body) THEN 'malformed'
            WHEN json_type(body) <> 'OBJECT' OR json_extract(body, '$.features') IS NULL THEN 'missing'
            WHEN json_type(body, '$.features') <> 'ARRAY' THEN 'not_list'
            WHEN json_array_length(body, '$.features') <> 64 THEN 'bad_length'
            ELSE 'ok' END AS status,
       CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' AND json_type(body, '$.features') = 'ARRAY'
            THEN CAST(json_array_length(body, '$.features') AS INTEGER) END AS n_features
FROM req
"""


def _requests(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("request_id"),
        F.col("props").alias("body"))
    cv = fx.table(spark, sf, "conversations").select(
        F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("request_id"), F.col("text").alias("body"))
    em = fx.table(spark, sf, "embeddings")
    vec = em.select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("request_id"),
        F.to_json(F.struct(F.expr("transform(slice(embedding, 1, 64 - CAST(vec_id % 2 AS INT)), "
                                  "x -> CAST(x AS DOUBLE))").alias("features"))).alias("body"))
    scalar = em.select(F.concat(F.lit("scalar-"), F.col("vec_id").cast("string")).alias("request_id"),
                       F.to_json(F.struct(F.col("vec_id").alias("features"))).alias("body"))
    return ev.unionByName(cv).unionByName(vec).unionByName(scalar)


@register("validate_requests", sql=_REQ_SQL)
def q_validate_requests(spark, sf):
    out = cleaning.validate_requests(_requests(spark, sf), "body", 64)
    n = F.when(F.col("status").isin("ok", "bad_length"),
               F.json_array_length(F.get_json_object("body", "$.features"))).cast("int")
    return out.select("request_id", "status", n.alias("n_features"))


@register("normalize_label", sql="""
SELECT event_id, trim(' ' || event_type || '  ') AS label, upper(trim(' ' || event_type || '  ')) AS label_upper
FROM events
""")
def q_normalize_label(spark, sf):
    ev = fx.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit(" "), F.col("event_type"), F.lit("  ")).alias("label"))
    out = cleaning.normalize_label(ev, "label")
    return out.withColumn("label_upper", F.upper("label"))


@register("attacks_only", sql="""
SELECT event_id, user_id, event_type, value FROM events WHERE upper(trim(event_type)) <> 'VIEW'
""")
def q_attacks_only(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return cleaning.attacks_only(ev, "event_type", fx.EVENT_BENIGN)


@register("benign_only", sql="""
SELECT event_id, user_id, event_type, value FROM events WHERE upper(trim(event_type)) = 'VIEW'
""")
def q_benign_only(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return cleaning.benign_only(ev, "event_type", fx.EVENT_BENIGN)


@register("filter_label", sql="""
SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'
""")
def q_filter_label(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return cleaning.filter_label(ev, "event_type", "purchase")


@register("feature_row_to_array", sql="""
SELECT l_orderkey, l_linenumber,
       array_to_string([printf('%.6f', l_quantity), printf('%.6f', l_extendedprice),
                        printf('%.6f', l_discount), printf('%.6f', l_tax)], ',') AS features
FROM lineitem
""")
def q_feature_row_to_array(spark, sf):
    out = cleaning.feature_row_to_array(fx.flows(spark, sf), fx.FLOW_FEATURES,
                                        keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber",
                      F.array_join(F.transform("features", lambda x: F.format_string("%.6f", x)), ",")
                      .alias("features"))


_ARR_NAMES = [f"f{i}" for i in range(64)]


@register("array_to_columns", sql="SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS f{i}" for i in range(64)) + " FROM embeddings")
def q_array_to_columns(spark, sf):
    em = fx.table(spark, sf, "embeddings")
    out = cleaning.array_to_columns(em, "embedding", _ARR_NAMES, keep=["vec_id"])
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in _ARR_NAMES])


@register("dedup_rows", sql="""
SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem
""")
def q_dedup_rows(spark, sf):
    df = fx.flows(spark, sf).select("l_quantity", "l_discount", "l_tax", fx.FLOW_LABEL)
    return cleaning.dedup_rows(df)
