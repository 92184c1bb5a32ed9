"""Label statistics and dictionary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.numeric import round6
from flowlens.operators import cleaning, labels
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register

_CLEAN_FLOWS_SQL = "(SELECT * FROM lineitem)"


@register("label_counts", sql="""
SELECT l_returnflag AS label, CAST(count(*) AS BIGINT) AS count
FROM lineitem GROUP BY l_returnflag
""")
def q_label_counts(spark, sf):
    flows = cleaning.clean_for_training(fx.flows(spark, sf), fx.FLOW_FEATURES + [fx.FLOW_LABEL])
    return labels.label_counts(flows, fx.FLOW_LABEL)


@register("label_proportions", sql="""
SELECT l_returnflag AS label, CAST(count(*) AS BIGINT) AS count,
       round(count(*) / sum(count(*)) OVER (), 6) AS proportion
FROM lineitem GROUP BY l_returnflag
""")
def q_label_proportions(spark, sf):
    flows = cleaning.clean_for_training(fx.flows(spark, sf), fx.FLOW_FEATURES + [fx.FLOW_LABEL])
    return labels.label_proportions(flows, fx.FLOW_LABEL).withColumn(
        "proportion", round6("proportion"))


@register("encode_labels", sql="""
SELECT e.event_id, e.event_type AS label, CAST(d.label_idx AS INTEGER) AS label_idx
FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label_idx
                    FROM (SELECT DISTINCT event_type FROM events)) d USING (event_type)
""")
def q_encode_labels(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"))
    return labels.encode_labels(ev, "label")


@register("decode_labels", sql="""
SELECT vec_id, CAST(e.label AS INTEGER) AS label_idx, d.label AS label
FROM embeddings e LEFT JOIN (SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS idx
                             FROM (SELECT DISTINCT event_type FROM events)) d ON e.label = d.idx
""")
def q_decode_labels(spark, sf):
    # class ids of the embeddings decoded with the event-type dictionary (ids >= 5 are unknown)
    dictionary = labels.label_dictionary(fx.table(spark, sf, "events"), "event_type")
    em = fx.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("label_idx"))
    return labels.decode_labels(em, "label_idx", dictionary)


def _describe_sql(col: str) -> str:
    up = f"upper(trim({col}))"
    exact = " ".join(f"WHEN {up} = '{k}' THEN '{v}'" for k, v in labels.ATTACK_DESCRIPTIONS.items())
    keys = sorted(labels.ATTACK_DESCRIPTIONS, key=lambda k: (-len(k), k))
    prefix = " ".join(f"WHEN starts_with({up}, '{k}') THEN '{labels.ATTACK_DESCRIPTIONS[k]}'"
                      for k in keys)
    return f"CASE {exact} {prefix} ELSE '{labels.UNKNOWN_ATTACK}' END"


# predicted labels: attack names built from the data (document sources and
# event types), so exact, prefix and unknown matches all occur
_ATTACK_NAMES_SQL = """
SELECT doc_id AS row_id,
       CASE WHEN doc_id % 5 = 0 THEN 'DoS ' || source WHEN doc_id % 5 = 1 THEN 'ddos'
            WHEN doc_id % 5 = 2 THEN ' Bot ' WHEN doc_id % 5 = 3 THEN 'SSH-Patator-' || lang
            ELSE lang END AS predicted_label
FROM documents
"""


@register("describe_attack", sql=f"""
SELECT row_id, predicted_label, {_describe_sql('predicted_label')} AS attack_description
FROM ({_ATTACK_NAMES_SQL})
""")
def q_describe_attack(spark, sf):
    docs = fx.table(spark, sf, "documents")
    name = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("DoS "), F.col("source")))
            .when(F.col("doc_id") % 5 == 1, F.lit("ddos"))
            .when(F.col("doc_id") % 5 == 2, F.lit(" Bot "))
            .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("SSH-Patator-"), F.col("lang")))
            .otherwise(F.col("lang")))
    df = docs.select(F.col("doc_id").alias("row_id"), name.alias("predicted_label"))
    return labels.describe_attack(df, "predicted_label")


_DOC_LABELS = "(SELECT d.source, CAST(l.quality AS VARCHAR) AS label FROM documents d JOIN labels l USING (doc_id))"


@register("label_counts_by_source", sql=f"""
SELECT source, string_agg(label || ':' || n, ',' ORDER BY label) AS total_counts,
       CAST(sum(n) AS BIGINT) AS source_total
FROM (SELECT source, label, count(*) AS n FROM {_DOC_LABELS} GROUP BY ALL) GROUP BY source
""")
def q_label_counts_by_source(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    out = labels.label_counts_by_source(d.join(lab, "doc_id"), "source", "label")
    text = F.array_join(F.transform(F.map_entries("total_counts"),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("source", text.alias("total_counts"), "source_total")


@register("source_label_counts", sql=f"""
SELECT source, label, CAST(count(*) AS BIGINT) AS count FROM {_DOC_LABELS} WHERE label IS NOT NULL GROUP BY ALL
""")
def q_source_label_counts(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "source")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return labels.source_label_counts(d.join(lab, "doc_id"), "source", "label")


@register("label_totals", sql="""
SELECT o_orderpriority AS label, CAST(count(*) AS BIGINT) AS count, false AS is_total
FROM orders GROUP BY 1
UNION ALL SELECT NULL, CAST(count(*) AS BIGINT), true FROM orders
""")
def q_label_totals(spark, sf):
    return labels.label_totals(fx.table(spark, sf, "orders"), "o_orderpriority")


@register("distinct_labels", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_labels,
       CAST(count(*) FILTER (WHERE upper(trim(label)) <> 'VIEW') AS BIGINT) AS n_attack_types,
       string_agg(label, ',' ORDER BY label) AS labels
FROM (SELECT DISTINCT event_type AS label FROM events)
""")
def q_distinct_labels(spark, sf):
    return labels.distinct_labels(fx.table(spark, sf, "events"), "event_type", fx.EVENT_BENIGN)


# "model" labels: roles seen in opening turns; "new data": every turn
@register("new_labels", sql="""
SELECT DISTINCT role AS label FROM conversations
WHERE role NOT IN (SELECT role FROM conversations WHERE turn = 0)
""")
def q_new_labels(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    old = labels.label_dictionary(conv.filter(F.col("turn") == 0), "role")
    return labels.new_labels(conv, old, "role")


@register("retrain_stats", sql="""
WITH c AS (SELECT role AS label, count(*) AS n FROM conversations GROUP BY 1),
     o AS (SELECT DISTINCT role AS label FROM conversations WHERE turn = 0)
SELECT CAST(sum(n) AS BIGINT) AS total_samples,
       string_agg(c.label || ':' || n, ',' ORDER BY c.label) AS label_distribution,
       string_agg(c.label, ',' ORDER BY c.label) AS unique_labels,
       coalesce(string_agg(c.label, ',' ORDER BY c.label) FILTER (WHERE o.label IS NULL), '') AS new_labels,
       CAST(count(*) FILTER (WHERE o.label IS NULL) AS BIGINT) AS new_labels_count
FROM c LEFT JOIN o ON c.label = o.label
""")
def q_retrain_stats(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    old = labels.label_dictionary(conv.filter(F.col("turn") == 0), "role")
    st = labels.retrain_stats(conv, old, "role")
    dist = F.array_join(F.transform(F.map_entries("label_distribution"),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return st.select("total_samples", dist.alias("label_distribution"),
                     F.array_join("unique_labels", ",").alias("unique_labels"),
                     F.array_join("new_labels", ",").alias("new_labels"), "new_labels_count")


@register("label_status", sql="""
WITH o AS (SELECT DISTINCT role FROM conversations WHERE turn = 0)
SELECT role AS label, CAST(count(*) AS BIGINT) AS count, role IS NOT NULL AND role NOT IN (SELECT role FROM o) AS is_new
FROM conversations GROUP BY role
""")
def q_label_status(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    return labels.label_status(conv, labels.label_dictionary(conv.filter(F.col("turn") == 0), "role"), "role")


@register("label_balance", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_labels, CAST(max(n) AS BIGINT) AS max_count,
       CAST(min(n) AS BIGINT) AS min_count,
       round(max(n) / min(n), 6) AS imbalance_ratio, round(max(n) / sum(n), 6) AS majority_share,
       arg_min(label, (-n, label)) AS majority_label, arg_min(label, (n, label)) AS minority_label
FROM (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1)
""")
def q_label_balance(spark, sf):
    lab = fx.table(spark, sf, "labels").select(F.col("quality").cast("string").alias("label"))
    out = labels.label_balance(lab, "label")
    return out.withColumn("imbalance_ratio", round6("imbalance_ratio")) \
              .withColumn("majority_share", round6("majority_share"))
