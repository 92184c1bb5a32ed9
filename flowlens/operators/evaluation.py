"""Classifier evaluation from a prediction table.

Input rows carry the actual class, the predicted class and (for ROC/AUC) the
vector of class probabilities indexed by class id.  Everything is reduced to
k-row or (k x k)-row tables first; only those are joined.

ROC/AUC are exact: scores are aggregated by (class, score) first, and the
running sums over descending score run per (class, score range) with the
range offsets taken from a small prefix-sum table, so one class never sorts
in a single task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators._small import MAX_BROADCAST_ROWS, materialize, materialize_small

SCORE_RANGES = 1024
# Distinct scores per sorted (class, range) above which the ranges get finer.
RANGE_TARGET_SCORES = 2_000_000
MAX_SCORE_RANGES = 1 << 40

# Acceptance gates per metric (minimum / good / excellent).
# Higher is better except for FPR, where the bound is an upper limit.
GATES = [
    ("accuracy", 0.95, 0.98, 0.99, True),
    ("precision", 0.90, 0.95, 0.98, True),
    ("recall", 0.92, 0.96, 0.99, True),
    ("fpr", 0.05, 0.01, 0.001, False),
    ("auc", 0.90, 0.95, 0.98, True),
]
CLASS_GATE = 0.95          # per-class precision/recall/F1 floor
REGRESSION_MAX_FPR = 0.01  # retrained model must keep FPR below 1 %


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_matrix(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    return (pred.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
                .agg(F.count(F.lit(1)).alias("count")))


def per_class_metrics(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    """precision, recall, F1 and support per class (classes of actual or predicted)."""
    cm = confusion_matrix(pred, actual, predicted)
    cm, _ = materialize_small(cm)
    by_actual = cm.groupBy(F.col("actual").alias("class")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    by_pred = cm.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("predicted_n"))
    m = by_actual.join(by_pred, "class", "full_outer").na.fill(0, ["support", "tp", "predicted_n"])
    p = _safe_div(F.col("tp"), F.col("predicted_n"))
    r = _safe_div(F.col("tp"), F.col("support"))
    return (m.withColumn("precision", p).withColumn("recall", r)
             .withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"),
                                         F.col("precision") + F.col("recall")))
             .select("class", "precision", "recall", "f1", "support", "tp", "predicted_n"))


def summary_metrics(per_class: DataFrame, benign_class=None) -> DataFrame:
    """accuracy, weighted precision/recall/F1, FPR (1 - recall of the benign class)."""
    benign = F.min("class") if benign_class is None else F.lit(benign_class)
    total = F.sum("support")
    fpr_recall = (F.min_by("recall", "class") if benign_class is None else
                  F.max(F.when(F.col("class") == F.lit(benign_class), F.col("recall"))))
    return per_class.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
        (F.lit(1.0) - F.coalesce(fpr_recall, F.lit(0.0))).alias("fpr"),
        benign.cast("string").alias("benign_class"))


def classification_report(per_class: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    rows = per_class.select(F.col("class").cast("string").alias("row"), "precision", "recall",
                            "f1", "support")
    total = F.sum("support")
    tail = per_class.agg(
        (F.sum("tp") / total).alias("accuracy"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("wf"),
        total.alias("n"))
    null = F.lit(None).cast("double")
    extra = tail.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("row"), null.alias("precision"), null.alias("recall"),
                 F.col("accuracy").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")))))
    return rows.unionByName(extra)


def _score_table(pred: DataFrame, actual: str, probs: str) -> DataFrame:
    """(class, score) -> positives, negatives; one row per distinct score."""
    exploded = pred.select(F.col(actual).alias("__y"), F.posexplode(F.col(probs)).alias("class", "score"))
    return exploded.groupBy("class", "score").agg(
        F.count_if(F.col("__y") == F.col("class")).alias("pos"),
        F.count_if(F.col("__y") != F.col("class")).alias("neg"))


def _ranged_cumulative(scores: DataFrame, ranges: int = SCORE_RANGES) -> tuple[DataFrame, DataFrame]:
    """Adds tp_above/fp_above (counts with a strictly higher score) per class.

    Scores are probabilities in [0, 1].  Running sums run per (class, score
    range) with range offsets from a small prefix-sum table.  When one range
    holds more than ``RANGE_TARGET_SCORES`` distinct scores (a confident
    model piles them up near 1), the ranges are made 16x finer until it
    does not; the sums do not change.  Returns (rows, per-class P and N).
    """
    scores = materialize(scores, "score_table")   # read by the offsets and by the running sums
    while True:
        rng = F.least(F.greatest(F.floor(F.col("score") * ranges), F.lit(0)), F.lit(ranges - 1))
        s = scores.withColumn("range", rng.cast("bigint"))
        per_range = s.groupBy("class", "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"),
                                                    F.count(F.lit(1)).alias("rd"))
        desc = Window.partitionBy("class").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy("class")
        offsets = materialize(per_range.select(
            "class", "range", "rd",
            F.coalesce(F.sum("rp").over(desc), F.lit(0)).alias("pos_above_range"),
            F.coalesce(F.sum("rn").over(desc), F.lit(0)).alias("neg_above_range"),
            F.sum("rp").over(whole).alias("P"), F.sum("rn").over(whole).alias("N")), "roc_offsets")
        n, widest = offsets.agg(F.count(F.lit(1)), F.max("rd")).first()
        if not widest or widest <= RANGE_TARGET_SCORES or ranges >= MAX_SCORE_RANGES:
            break
        ranges = min(MAX_SCORE_RANGES, ranges * 16 ** math.ceil(math.log(widest / RANGE_TARGET_SCORES, 16)))
    totals = offsets.select("class", "P", "N").distinct()
    offsets = offsets.drop("rd")
    offsets = F.broadcast(offsets) if n <= MAX_BROADCAST_ROWS else offsets   # at most classes x ranges rows
    within = Window.partitionBy("class", "range").orderBy(F.desc("score")) \
                   .rowsBetween(Window.unboundedPreceding, -1)
    rows = (s.join(offsets, ["class", "range"])
             .withColumn("tp_above", F.col("pos_above_range") + F.coalesce(F.sum("pos").over(within), F.lit(0)))
             .withColumn("fp_above", F.col("neg_above_range") + F.coalesce(F.sum("neg").over(within), F.lit(0))))
    return rows, totals


def roc_points(pred: DataFrame, actual: str, probs: str) -> DataFrame:
    """One-vs-rest ROC per class: a point per distinct threshold plus (0, 0).

    All thresholds are kept (no dropping of collinear points).  The start
    point has threshold +Infinity.
    """
    c, totals = _ranged_cumulative(_score_table(pred, actual, probs))
    pts = c.select("class", F.col("score").alias("threshold"),
                   (F.col("fp_above") + F.col("neg")).alias("fp"),
                   (F.col("tp_above") + F.col("pos")).alias("tp"), "P", "N")
    starts = totals.select(
        "class", F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fp"),
        F.lit(0).cast("bigint").alias("tp"), "P", "N")
    allp = pts.unionByName(starts)
    return allp.select("class", "threshold",
                       F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
                       F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"))


def auc_ovr(pred: DataFrame, actual: str, probs: str) -> DataFrame:
    """Exact trapezoid AUC per class (ties count half); null when P or N is 0."""
    c, _ = _ranged_cumulative(_score_table(pred, actual, probs))
    return c.groupBy("class").agg(
        (F.sum(F.col("neg") * (F.col("tp_above") + F.col("pos") / 2.0))).alias("__area"),
        F.first("P").alias("positives"), F.first("N").alias("negatives")) \
        .select("class", F.when((F.col("positives") > 0) & (F.col("negatives") > 0),
                                F.col("__area") / (F.col("positives") * F.col("negatives"))).alias("auc"),
                "positives", "negatives")


def auc_weighted(auc: DataFrame) -> DataFrame:
    """Support-weighted mean of per-class AUC over classes with a defined AUC."""
    ok = auc.filter(F.col("auc").isNotNull())
    return ok.agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc"))


def auc_binary(pred: DataFrame, actual: str, score: str, positive=1) -> DataFrame:
    """Binary AUC: ``score`` is the probability of the positive class."""
    two = pred.select(F.when(F.col(actual) == F.lit(positive), F.lit(1)).otherwise(F.lit(0)).alias("__y"),
                      F.array(F.lit(1.0) - F.col(score), F.col(score)).alias("__p"))
    return auc_ovr(two, "__y", "__p").filter(F.col("class") == 1).select("auc", "positives", "negatives")


def metrics_record(pred: DataFrame, actual: str, predicted: str, probs: str,
                   benign_class=None) -> DataFrame:
    """accuracy, precision, recall, f1, fpr, auc in one row."""
    per = per_class_metrics(pred, actual, predicted)
    auc = auc_ovr(pred, actual, probs).select("class", F.col("auc").alias("__auc"),
                                              F.col("positives").alias("__pos"))
    joined = per.join(auc, "class", "left")
    total = F.sum("support")
    benign = F.min("class") if benign_class is None else F.lit(benign_class)
    fpr_recall = (F.min_by("recall", "class") if benign_class is None else
                  F.max(F.when(F.col("class") == F.lit(benign_class), F.col("recall"))))
    has_auc = F.col("__auc").isNotNull()
    return joined.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"),
        (F.lit(1.0) - F.coalesce(fpr_recall, F.lit(0.0))).alias("fpr"),
        (F.sum(F.when(has_auc, F.col("__auc") * F.col("support")))
         / F.sum(F.when(has_auc, F.col("support")))).alias("auc"))


def metrics_long(record: DataFrame) -> DataFrame:
    names = ["accuracy", "precision", "recall", "f1", "fpr", "auc"]
    return record.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def format_metrics(long: DataFrame) -> DataFrame:
    """4-decimal text and percent text (x100, 4 decimals); missing -> 'Offline'."""
    v = F.col("value")
    return long.select("metric",
                       F.when(v.isNull(), F.lit("Offline")).otherwise(F.format_string("%.4f", v)).alias("text"),
                       F.when(v.isNull(), F.lit("Offline"))
                        .otherwise(F.concat(F.format_string("%.4f", v * 100), F.lit("%"))).alias("percent"))


def grade_metrics(long: DataFrame) -> DataFrame:
    """Grade each metric against the acceptance gates (broadcast fixed table)."""
    spark = long.sparkSession
    gates = spark.createDataFrame(GATES, "metric string, minimum double, good double, "
                                         "excellent double, higher_better boolean")
    v = F.col("value")
    hb = F.col("higher_better")

    def passes(t):
        return F.when(hb, v > F.col(t)).otherwise(v < F.col(t))

    grade = (F.when(v.isNull(), F.lit("offline"))
             .when(passes("excellent"), F.lit("excellent"))
             .when(passes("good"), F.lit("good"))
             .when(passes("minimum"), F.lit("minimum"))
             .otherwise(F.lit("below minimum")))
    return long.join(F.broadcast(gates), "metric", "inner").select("metric", "value", grade.alias("grade"))


def class_gate(per_class: DataFrame, floor: float = CLASS_GATE) -> DataFrame:
    """Classes whose precision, recall or F1 is at or below the floor."""
    bad = (F.col("precision") <= floor) | (F.col("recall") <= floor) | (F.col("f1") <= floor)
    return per_class.filter(bad).select("class", "precision", "recall", "f1", "support")


def regression_gate(old: DataFrame, new: DataFrame, max_fpr: float = REGRESSION_MAX_FPR) -> DataFrame:
    """Accept a retrained model when accuracy did not drop and FPR stays low.

    ``old``/``new`` are one-row metric records; they are tagged and combined
    with one aggregate (no join needed).
    """
    both = (old.select(F.lit("old").alias("which"), "accuracy", "fpr")
               .unionByName(new.select(F.lit("new").alias("which"), "accuracy", "fpr")))
    agg = both.agg(
        F.max(F.when(F.col("which") == "old", F.col("accuracy"))).alias("old_accuracy"),
        F.max(F.when(F.col("which") == "new", F.col("accuracy"))).alias("new_accuracy"),
        F.max(F.when(F.col("which") == "new", F.col("fpr"))).alias("new_fpr"))
    return agg.withColumn("accept", (F.col("new_accuracy") >= F.col("old_accuracy"))
                          & (F.col("new_fpr") < F.lit(max_fpr)))
