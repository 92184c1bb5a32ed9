"""Model operators: exact standardization, random-forest fit and scoring.

The forest is grown in ``operators/forest.py``; the data flow around it
(cleaning, encoding, splitting, scaling, scoring records) is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.levels import threat_level
from flowlens.functions.numeric import fill_zero  # noqa: F401  (re-exported for callers)
from flowlens.functions.sqltext import double_lit, fill_zero_sql, ident
from flowlens.operators import forest as forests
from flowlens.operators.cleaning import validate_requests
from flowlens.operators.forest import Forest
from flowlens.operators.profile import scaler_fit

# Fixed values of the original forest: 100 trees, seed 42; features per split is
# the square root of the feature count.  Trees are grown to purity (no depth); the
# ranges in which large nodes look for their exact split change no result.
NUM_TREES = 100
SEED = 42
MAX_DEPTH = None
MAX_BINS = 128


def scaler_params(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """feature -> (mean, scale); scale is the population std, or 1 when it is 0.

    One aggregate job; the result has one entry per feature (bounded by the
    feature contract, 78 in the original data).
    """
    rows = scaler_fit(train, features).collect()
    out = {}
    for r in rows:
        std = r["std"] if r["std"] is not None else 0.0
        out[r["feature"]] = (r["mean"] if r["mean"] is not None else 0.0, std if std != 0.0 else 1.0)
    return out


def standardize(df: DataFrame, features: list[str], params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / scale for each feature, as literal expressions (codegen'd)."""
    exprs = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            exprs.append(f"(CAST({ident(c)} AS DOUBLE) - {double_lit(m)}) / {double_lit(s)} AS {ident(c)}")
        else:
            exprs.append(ident(c))
    return df.selectExpr(*exprs)


def train_forest(train: DataFrame, features: list[str], label_idx: str, num_trees: int = NUM_TREES,
                 seed: int = SEED, max_depth: int | None = MAX_DEPTH, max_bins: int = MAX_BINS,
                 n_classes: int | None = None) -> Forest:
    """Fit the forest.  ``n_classes`` names the number of label indices; without
    it the rows tell it."""
    if n_classes is None:
        n_classes = (train.agg(F.max(ident(label_idx))).first()[0] or 0) + 1
    return forests.fit(train, features, label_idx, n_classes, num_trees, seed, max_depth, max_bins)


def predict_probabilities(model: Forest, df: DataFrame, n_classes: int) -> DataFrame:
    """Adds ``probs`` (array<double> of length n_classes) and ``predicted`` (int)."""
    scored = forests.probabilities(model, df, "__prob")
    # a forest trained on fewer classes than the dictionary gives a shorter vector
    padded = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                         lambda i: F.coalesce(F.try_element_at("__prob", i + 1), F.lit(0.0)))
    return (scored.withColumn("probs", padded)
                  .withColumn("predicted", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
                  .drop("__prob"))


def score_flows(model: Forest, df: DataFrame, features: list[str],
                params: dict[str, tuple[float, float]], class_names: list[str],
                benign: str = "BENIGN", keep: list[str] | None = None) -> DataFrame:
    """Prediction records: label, confidence, encoded value, threat level,
    top-5 probabilities above 1 % (ordered) and a timestamp text."""
    clean = df.selectExpr(*[ident(k) for k in (keep or [])], *[f"{fill_zero_sql(c)} AS {ident(c)}" for c in features])
    scaled = standardize(clean, features, params)
    scored = predict_probabilities(model, scaled, len(class_names))
    names = F.array(*[F.lit(n) for n in class_names])
    label = F.element_at(names, F.col("predicted") + 1)
    conf = F.array_max("probs")
    tagged = F.transform(F.col("probs"), lambda p, i: F.struct((-p).alias("neg"), i.alias("idx"),
                                                               p.alias("prob")))
    top = F.slice(F.array_sort(F.filter(tagged, lambda s: s["prob"] > F.lit(0.01))), 1, 5)
    top = F.transform(top, lambda s: F.struct(F.element_at(names, s["idx"] + 1).alias("label"),
                                              s["prob"].alias("prob")))
    return scored.select(
        *[F.col(k) for k in (keep or [])],
        F.lit("success").alias("status"), label.alias("predicted_label"), conf.alias("confidence"),
        F.col("predicted").alias("encoded_value"),
        threat_level(label, conf, benign=benign).alias("threat_level"),
        top.alias("probabilities"), "probs",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


def score_requests(model: Forest, df: DataFrame, body: str, contract: list[str],
                   params: dict[str, tuple[float, float]], class_names: list[str], benign: str = "BENIGN",
                   keep: list[str] | None = None) -> DataFrame:
    """Raw JSON request bodies to prediction records, in one pass.

    Every body gives a row: ``success`` with its prediction, or ``error`` with
    the reason (``error``) and the service's message and no prediction.  Bodies
    are checked by ``validate_requests``; a bad one goes through the model as a
    row of zeros whose outcome is blanked, so no second pass or union is needed.
    """
    keep = keep or []
    checked = validate_requests(df, body, len(contract))
    columns = [F.coalesce(F.try_element_at("features", F.lit(i + 1)), F.lit(0.0)).alias(c) for i, c in enumerate(contract)]
    rows = checked.select(*keep, F.col("status").alias("__status"), F.col("message").alias("__message"), *columns)
    scored = score_flows(model, rows, contract, params, class_names, benign, keep=[*keep, "__status", "__message"])
    ok = F.col("__status") == "ok"
    outcome = ("predicted_label", "confidence", "encoded_value", "threat_level", "probabilities", "timestamp")
    return scored.select(
        *keep, F.when(ok, "success").otherwise("error").alias("status"), F.when(~ok, F.col("__status")).alias("error"),
        F.col("__message").alias("message"), *(F.when(ok, F.col(c)).alias(c) for c in outcome))
