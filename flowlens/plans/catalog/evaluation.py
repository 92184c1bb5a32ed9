"""Evaluation queries on the deterministic class-probability table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.levels import threat_level
from flowlens.operators import detection, evaluation, labels
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register

P_SQL = fx.probability_sql()
P_OLD_SQL = fx.probability_sql(offset=10)


def _pt(spark, sf, offset=0):
    return fx.probability_table(spark, sf, offset)


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


_CM = f"(SELECT actual, predicted, count(*) AS n FROM ({P_SQL}) GROUP BY ALL)"


def _per_class_sql(p_sql: str) -> str:
    return f"""
WITH cm AS (SELECT actual, predicted, count(*) AS n FROM ({p_sql}) GROUP BY ALL),
a AS (SELECT actual AS class, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
      FROM cm GROUP BY 1),
p AS (SELECT predicted AS class, sum(n) AS predicted_n FROM cm GROUP BY 1),
m AS (SELECT coalesce(a.class, p.class) AS class, CAST(coalesce(support, 0) AS BIGINT) AS support,
             CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(predicted_n, 0) AS BIGINT) AS predicted_n
      FROM a FULL JOIN p ON a.class = p.class),
k AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0.0 ELSE tp / predicted_n END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM m)
SELECT class, precision, recall,
       CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
       support, tp, predicted_n
FROM k"""


PER_CLASS_SQL = _per_class_sql(P_SQL)


def _summary_sql(per_class_sql: str) -> str:
    return f"""
SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
       sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1,
       1.0 - arg_min(recall, class) AS fpr, CAST(min(class) AS VARCHAR) AS benign_class
FROM ({per_class_sql})"""


def _auc_sql(p_sql: str) -> str:
    return f"""
WITH e AS (SELECT actual, unnest(probs) AS score, generate_subscripts(probs, 1) - 1 AS class FROM ({p_sql})),
s AS (SELECT class, score, count(*) FILTER (WHERE actual = class) AS pos,
             count(*) FILTER (WHERE actual <> class) AS neg FROM e GROUP BY ALL),
c AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY class ORDER BY score DESC
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tp_above,
             coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fp_above,
             sum(pos) OVER (PARTITION BY class) AS P, sum(neg) OVER (PARTITION BY class) AS N FROM s)
"""


AUC_SQL = _auc_sql(P_SQL) + """
SELECT class, CASE WHEN max(P) > 0 AND max(N) > 0
                   THEN sum(neg * (tp_above + pos / 2.0)) / (max(P) * max(N)) END AS auc,
       CAST(max(P) AS BIGINT) AS positives, CAST(max(N) AS BIGINT) AS negatives
FROM c GROUP BY class"""


def _metrics_sql(p_sql: str) -> str:
    per = _per_class_sql(p_sql)
    auc = _auc_sql(p_sql) + """
SELECT class, CASE WHEN max(P) > 0 AND max(N) > 0
                   THEN sum(neg * (tp_above + pos / 2.0)) / (max(P) * max(N)) END AS auc
FROM c GROUP BY class"""
    return f"""
SELECT sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
       sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1,
       1.0 - arg_min(recall, pc.class) AS fpr,
       sum(CASE WHEN au.auc IS NOT NULL THEN au.auc * support END)
         / sum(CASE WHEN au.auc IS NOT NULL THEN support END) AS auc
FROM ({per}) pc LEFT JOIN ({auc}) au ON pc.class = au.class"""


METRICS_SQL = _metrics_sql(P_SQL)
METRICS_OLD_SQL = _metrics_sql(P_OLD_SQL)
_M6 = ["accuracy", "precision", "recall", "f1", "fpr", "auc"]


def _round_sql(inner: str, cols: list[str], keep: list[str] | None = None) -> str:
    sel = ", ".join((keep or []) + [f"round({c}, 6) AS {c}" for c in cols])
    return f"SELECT {sel} FROM ({inner})"


@register("confusion_matrix", sql=f"SELECT actual, predicted, CAST(n AS BIGINT) AS count FROM {_CM}")
def q_confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_pt(spark, sf), "actual", "predicted")


@register("per_class_metrics", sql=_round_sql(PER_CLASS_SQL, ["precision", "recall", "f1"],
                                              ["class", "support", "tp", "predicted_n"]))
def q_per_class_metrics(spark, sf):
    return _r(evaluation.per_class_metrics(_pt(spark, sf), "actual", "predicted"),
              ["precision", "recall", "f1"])


def _summary(spark, sf):
    per = evaluation.per_class_metrics(_pt(spark, sf), "actual", "predicted")
    return evaluation.summary_metrics(per)


_SUMMARY_SQL = _summary_sql(PER_CLASS_SQL)


@register("accuracy", sql=f"SELECT round(accuracy, 6) AS accuracy FROM ({_SUMMARY_SQL})")
def q_accuracy(spark, sf):
    return _r(_summary(spark, sf).select("accuracy"), ["accuracy"])


@register("weighted_precision", sql=f"SELECT round(precision, 6) AS precision FROM ({_SUMMARY_SQL})")
def q_weighted_precision(spark, sf):
    return _r(_summary(spark, sf).select("precision"), ["precision"])


@register("weighted_recall", sql=f"SELECT round(recall, 6) AS recall FROM ({_SUMMARY_SQL})")
def q_weighted_recall(spark, sf):
    return _r(_summary(spark, sf).select("recall"), ["recall"])


@register("false_positive_rate", sql=f"SELECT round(fpr, 6) AS fpr, benign_class FROM ({_SUMMARY_SQL})")
def q_false_positive_rate(spark, sf):
    return _r(_summary(spark, sf).select("fpr", "benign_class"), ["fpr"])


@register("classification_report", sql=f"""
WITH pc AS ({PER_CLASS_SQL})
SELECT CAST(class AS VARCHAR) AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM pc
""")
def q_classification_report(spark, sf):
    per = evaluation.per_class_metrics(_pt(spark, sf), "actual", "predicted")
    return _r(evaluation.classification_report(per), ["precision", "recall", "f1"])


@register("roc_points", sql=_auc_sql(P_SQL) + """
SELECT class, round(score, 6) AS threshold, round((fp_above + neg) / N, 6) AS fpr,
       round((tp_above + pos) / P, 6) AS tpr FROM c
UNION ALL
SELECT DISTINCT class, 'Infinity'::DOUBLE, 0.0, 0.0 FROM c
""")
def q_roc_points(spark, sf):
    return _r(evaluation.roc_points(_pt(spark, sf), "actual", "probs"), ["threshold", "fpr", "tpr"])


@register("auc_ovr", sql=_round_sql(AUC_SQL, ["auc"], ["class", "positives", "negatives"]))
def q_auc_ovr(spark, sf):
    return _r(evaluation.auc_ovr(_pt(spark, sf), "actual", "probs"), ["auc"])


@register("auc_weighted", sql=f"""
SELECT round(sum(auc * positives) / sum(positives), 6) AS auc FROM ({AUC_SQL}) WHERE auc IS NOT NULL
""")
def q_auc_weighted(spark, sf):
    return _r(evaluation.auc_weighted(evaluation.auc_ovr(_pt(spark, sf), "actual", "probs")), ["auc"])


# binary view: positive = classes 5..9, score = their summed probability
_BIN_SQL = f"""
SELECT CASE WHEN actual >= 5 THEN 1 ELSE 0 END AS y,
       probs[6] + probs[7] + probs[8] + probs[9] + probs[10] AS score FROM ({P_SQL})"""


@register("auc_binary", sql=f"""
WITH s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
           FROM ({_BIN_SQL}) GROUP BY score),
c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS tp_above, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM s)
SELECT round(sum(neg * (tp_above + pos / 2.0)) / (max(P) * max(N)), 6) AS auc,
       CAST(max(P) AS BIGINT) AS positives, CAST(max(N) AS BIGINT) AS negatives FROM c
""")
def q_auc_binary(spark, sf):
    pt = _pt(spark, sf)
    p = F.col("probs")
    b = pt.select(F.when(F.col("actual") >= 5, 1).otherwise(0).alias("y"),
                  (p[5] + p[6] + p[7] + p[8] + p[9]).alias("score"))
    return _r(evaluation.auc_binary(b, "y", "score", positive=1), ["auc"])


@register("metrics_record", sql=_round_sql(METRICS_SQL, _M6))
def q_metrics_record(spark, sf):
    rec = evaluation.metrics_record(_pt(spark, sf), "actual", "predicted", "probs")
    return _r(rec, _M6)


def _metrics_long_sql(metrics_sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM ({metrics_sql})" for m in _M6)


@register("format_metrics", sql=f"""
SELECT metric, printf('%.4f', value) AS text, printf('%.4f', value * 100) || '%' AS percent
FROM ({_metrics_long_sql(METRICS_SQL)})
""")
def q_format_metrics(spark, sf):
    rec = evaluation.metrics_record(_pt(spark, sf), "actual", "predicted", "probs")
    return evaluation.format_metrics(evaluation.metrics_long(rec))


def _gates_sql() -> str:
    rows = ", ".join(f"('{m}', {a}, {b}, {c}, {str(h).lower()})" for m, a, b, c, h in evaluation.GATES)
    return f"(SELECT * FROM (VALUES {rows}) g(metric, minimum, good, excellent, higher_better))"


@register("grade_metrics", sql=f"""
SELECT l.metric, round(l.value, 6) AS value,
       CASE WHEN l.value IS NULL THEN 'offline'
            WHEN (higher_better AND l.value > excellent) OR (NOT higher_better AND l.value < excellent) THEN 'excellent'
            WHEN (higher_better AND l.value > good) OR (NOT higher_better AND l.value < good) THEN 'good'
            WHEN (higher_better AND l.value > minimum) OR (NOT higher_better AND l.value < minimum) THEN 'minimum'
            ELSE 'below minimum' END AS grade
FROM ({_metrics_long_sql(METRICS_SQL)}) l JOIN {_gates_sql()} g ON l.metric = g.metric
""")
def q_grade_metrics(spark, sf):
    rec = evaluation.metrics_record(_pt(spark, sf), "actual", "predicted", "probs")
    return _r(evaluation.grade_metrics(evaluation.metrics_long(rec)), ["value"])


@register("class_gate", sql=f"""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM ({PER_CLASS_SQL}) WHERE precision <= 0.95 OR recall <= 0.95 OR f1 <= 0.95
""")
def q_class_gate(spark, sf):
    per = evaluation.per_class_metrics(_pt(spark, sf), "actual", "predicted")
    return _r(evaluation.class_gate(per), ["precision", "recall", "f1"])


@register("regression_gate", sql=f"""
SELECT round(o.accuracy, 6) AS old_accuracy, round(n.accuracy, 6) AS new_accuracy, round(n.fpr, 6) AS new_fpr,
       (n.accuracy >= o.accuracy AND n.fpr < 0.01) AS accept
FROM ({METRICS_OLD_SQL}) o, ({METRICS_SQL}) n
""")
def q_regression_gate(spark, sf):
    old = evaluation.metrics_record(_pt(spark, sf, 10), "actual", "predicted", "probs")
    new = evaluation.metrics_record(_pt(spark, sf), "actual", "predicted", "probs")
    return _r(evaluation.regression_gate(old, new), ["old_accuracy", "new_accuracy", "new_fpr"])


@register("top_probabilities", sql=f"""
SELECT vec_id, CAST(position AS INTEGER) AS position, CAST(class_idx AS INTEGER) AS class_idx,
       CAST(class_idx AS VARCHAR) AS label, round(p, 6) AS probability FROM (
  SELECT vec_id, class_idx, p,
         row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_idx) AS position FROM (
    SELECT vec_id, unnest(probs) AS p, generate_subscripts(probs, 1) - 1 AS class_idx FROM ({P_SQL}))
  WHERE p > 0.01)
WHERE position <= 5
""")
def q_top_probabilities(spark, sf):
    names = [str(i) for i in range(fx.N_CLASSES)]
    out = detection.top_probabilities(_pt(spark, sf), "probs", names, keep=["vec_id"])
    return _r(out, ["probability"])


@register("confidence", sql=f"SELECT vec_id, round(list_max(probs), 6) AS confidence FROM ({P_SQL})")
def q_confidence(spark, sf):
    return _r(_pt(spark, sf).select("vec_id", F.array_max("probs").alias("confidence")), ["confidence"])


@register("predict_label", sql=f"""
SELECT vec_id, predicted AS encoded_value, d.label AS predicted_label
FROM ({P_SQL}) p LEFT JOIN (SELECT CAST(label AS VARCHAR) AS label,
                                   CAST(row_number() OVER (ORDER BY CAST(label AS VARCHAR)) - 1 AS INTEGER) AS idx
                            FROM (SELECT DISTINCT label FROM embeddings)) d ON p.predicted = d.idx
""")
def q_predict_label(spark, sf):
    pt = _pt(spark, sf)
    dictionary = labels.label_dictionary(fx.table(spark, sf, "embeddings"), "label")
    out = labels.decode_labels(pt.select("vec_id", F.col("predicted").alias("encoded_value")),
                               "encoded_value", dictionary, out="predicted_label")
    return out.select("vec_id", "encoded_value", "predicted_label")


@register("threat_level", sql=f"""
SELECT event_id, round({fx.CONFIDENCE_SQL}, 6) AS confidence,
       CASE WHEN upper(event_type) = 'VIEW' THEN 'None' WHEN {fx.CONFIDENCE_SQL} > 0.9 THEN 'High'
            WHEN {fx.CONFIDENCE_SQL} > 0.7 THEN 'Medium' ELSE 'Low' END AS threat_level
FROM events
""")
def q_threat_level(spark, sf):
    ev = fx.table(spark, sf, "events")
    conf = F.expr(fx.CONFIDENCE_SQL)
    return ev.select("event_id", F.round(conf, 6).alias("confidence"),
                     threat_level(F.col("event_type"), conf, benign=fx.EVENT_BENIGN).alias("threat_level"))
