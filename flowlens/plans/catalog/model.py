"""Model queries on ``embeddings`` (64 features, 10 classes; benign = class "0").

Forest predictions depend on the fit, so the oracles cover what does not:
scaling, error rows, versions, splits and result rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import cleaning, model
from flowlens.plans import fixtures as fx
from flowlens.plans import training
from flowlens.plans.catalog import register
from flowlens.session import scratch_path
from flowlens.sources import bundle as bd

EMB_FEATURES = [f"f{i}" for i in range(64)]
BENIGN_CLASS = "0"
REQUEST_START_MS = 1704067200000  # 2024-01-01 00:00:00 UTC


def embedding_flows(spark, sf):
    em = fx.table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("string"))
    return cleaning.array_to_columns(em, "embedding", EMB_FEATURES, keep=["vec_id", "label"])


def _train(spark, sf):
    return training.train_pipeline(embedding_flows(spark, sf), "label", EMB_FEATURES, ["vec_id"],
                                   benign=BENIGN_CLASS, seed=fx.SEED)


@register("standardize", sql=" ".join([
    "SELECT l_orderkey, l_linenumber,",
    ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 "
              f"ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in fx.FLOW_FEATURES),
    "FROM lineitem"]))
def q_standardize(spark, sf):
    flows = fx.flows(spark, sf).drop(fx.FLOW_LABEL)
    params = model.scaler_params(flows, fx.FLOW_FEATURES)
    out = model.standardize(flows, fx.FLOW_FEATURES, params)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in fx.FLOW_FEATURES])


@register("train_forest")
def q_train_forest(spark, sf):
    r = _train(spark, sf)
    return r.test_predictions.select("vec_id", "label_idx", "predicted")


@register("train_pipeline")
def q_train_pipeline(spark, sf):
    """The record kept with the saved version, that version's number and the report by class."""
    r = _train(spark, sf)
    report = r.report.agg(F.sort_array(F.collect_list(F.struct(*r.report.columns))).alias("report"))
    return r.metrics.withColumn("version", F.lit(r.version)).crossJoin(report)


@register("score_flows")
def q_score_flows(spark, sf):
    r = _train(spark, sf)
    rows = embedding_flows(spark, sf)
    b = r.bundle
    out = model.score_flows(b.model, rows, b.contract, b.scaler, b.classes, benign=b.benign, keep=["vec_id"])
    text = F.array_join(F.transform("probabilities", lambda s: F.concat(
        s["label"], F.lit(":"), F.format_string("%.4f", s["prob"]))), ",")
    return out.select("vec_id", "status", "predicted_label", F.round("confidence", 6).alias("confidence"),
                      "encoded_value", "threat_level", text.alias("probabilities"))


REQUESTS_SQL = f"""
  SELECT 'vec-' || vec_id AS id, vec_id, CASE vec_id % 5 WHEN 0 THEN 'malformed' WHEN 1 THEN 'missing'
         WHEN 2 THEN 'not_list' WHEN 3 THEN 'bad_length' ELSE 'ok' END AS state, {REQUEST_START_MS} + vec_id * 1000 AS ms
  FROM embeddings"""


def requests(spark, sf):
    """A JSON body a vector, four in five of them faulty in different ways, a second apart."""
    vector = F.to_json(F.struct(F.transform("embedding", lambda x: x.cast("double")).alias("features")))
    short = F.to_json(F.struct(F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double")).alias("features")))
    kind = F.col("vec_id") % 5
    body = (F.when(kind == 0, F.concat(vector, F.lit("}"))).when(kind == 1, F.lit('{"flow": [1]}'))
            .when(kind == 2, F.lit('{"features": "1, 2"}')).when(kind == 3, short).otherwise(vector))
    return fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("id"), "vec_id",
        F.timestamp_millis(F.lit(REQUEST_START_MS) + F.col("vec_id") * 1000).alias("ts"), body.alias("body"))


_REASON_SQL = """CASE state WHEN 'malformed' THEN 'Malformed JSON.' WHEN 'missing' THEN 'Missing ''features'' in JSON.'
    WHEN 'not_list' THEN '''features'' must be a list.' WHEN 'bad_length' THEN 'Feature mismatch. Expected 64, got 63.' END"""


@register("score_requests", sql=f"""
SELECT id, CASE state WHEN 'ok' THEN 'success' ELSE 'error' END AS status,
       CASE WHEN state <> 'ok' THEN state END AS error, {_REASON_SQL} AS message, state = 'ok' AS predicted
FROM ({REQUESTS_SQL})
""")
def q_score_requests(spark, sf):
    b = _train(spark, sf).bundle
    out = model.score_requests(b.model, requests(spark, sf), "body", b.contract, b.scaler, b.classes, b.benign, ["id"])
    return out.select("id", "status", "error", "message", F.col("predicted_label").isNotNull().alias("predicted"))


_LABELLED = "SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding FROM embeddings"
_TRAIN_SQL = f"""
c AS (SELECT label, count(*) AS n FROM ({_LABELLED}) GROUP BY 1),
t AS (SELECT sum(n) AS n, CAST(ceil(0.2::DOUBLE * sum(n)) AS BIGINT) AS n_test FROM c),
a AS (SELECT c.label, c.n, c.n / t.n * (t.n - t.n_test) AS cont, t.n - t.n_test AS n_train FROM c, t),
q AS (SELECT label, n - CAST(floor(cont) AS BIGINT) - CASE WHEN row_number() OVER (ORDER BY cont - floor(cont) DESC, label)
             <= n_train - sum(floor(cont)) OVER () THEN 1 ELSE 0 END AS test_quota FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id)) AS rank FROM ({_LABELLED})),
train AS (SELECT r.* FROM r JOIN q USING (label) WHERE rank > test_quota)"""


@register("model_bundle_io", sql=f"""
WITH {_TRAIN_SQL},
x AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM train)
SELECT 2 AS version, 'f' || i AS feature, CAST(i AS INT) AS place, round(avg(CAST(v AS DOUBLE)), 6) AS mean,
       round(stddev_pop(CAST(v AS DOUBLE)), 6) AS scale,
       (SELECT string_agg(label, ',' ORDER BY label) FROM c) AS classes, (SELECT count(*) FROM embeddings) AS scored
FROM x GROUP BY i
""")
def q_model_bundle_io(spark, sf):
    """Saved twice and left half-saved once; the newest whole version is read and scores."""
    r = _train(spark, sf)
    root = scratch_path(spark, "bundle")
    for _ in range(2):
        bd.save_bundle(spark, root, r.bundle)
    bd.stage_bundle(spark, root, r.bundle)   # never committed
    version = bd.current_version(spark, root)
    b = bd.load_bundle(spark, root)
    out = model.score_flows(b.model, embedding_flows(spark, sf), b.contract, b.scaler, b.classes, benign=b.benign,
                            keep=["vec_id"])
    scored = out.filter(F.col("predicted_label").isin(b.classes)).count()
    parts = [(version, c, i, *b.scaler[c], ",".join(b.classes), scored) for i, c in enumerate(b.contract)]
    back = spark.createDataFrame(parts, "version int, feature string, place int, mean double, scale double, "
                                        "classes string, scored bigint")
    return back.withColumn("mean", F.round("mean", 6)).withColumn("scale", F.round("scale", 6))


@register("train_supports", sql=f"""
WITH {_TRAIN_SQL}
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_idx, CAST(n - test_quota AS BIGINT) AS train_rows,
       CAST(test_quota AS BIGINT) AS test_rows, round(train.mean_f0, 6) AS train_mean_f0
FROM c JOIN q USING (label)
JOIN (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS mean_f0 FROM train GROUP BY 1) train USING (label)
""")
def q_train_supports(spark, sf):
    """What a training run fits and is measured on, before the forest: rows of each class by side."""
    clean = cleaning.clean_for_training(embedding_flows(spark, sf))
    split, _ = training.split_and_encode(clean, "label", ["vec_id"], seed=fx.SEED)
    train = F.col("split") == "train"
    return split.groupBy("label", "label_idx").agg(
        F.count_if(train).alias("train_rows"), F.count_if(~train).alias("test_rows"),
        F.round(F.avg(F.when(train, F.col("f0"))), 6).alias("train_mean_f0"))


@register("retrain_pipeline", sql="""
WITH u AS (SELECT label, embedding FROM embeddings), o AS (SELECT * FROM u WHERE label < 8),
d AS (SELECT count(*) AS n FROM (SELECT DISTINCT label, embedding FROM u))
SELECT 'success' AS status, 1 AS version, (SELECT count(*) FROM u) + (SELECT count(*) FROM o) AS total_samples,
       '8,9' AS new_labels, 2 AS new_labels_count, n - CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS train_rows,
       CAST(ceil(0.2::DOUBLE * n) AS BIGINT) AS test_rows, true AS measured
FROM d
""")
def q_retrain_pipeline(spark, sf):
    rows = embedding_flows(spark, sf)
    # "original" training table: classes 0..7; the upload brings every class
    # (8 and 9 are new), with blanks in its header names
    original = rows.filter(F.col("label").cast("int") < 8).drop("vec_id")
    upload = rows.drop("vec_id").select(*[F.col(c).alias(f" {c}") for c in EMB_FEATURES],
                                        F.col("label").alias("label "))
    out = training.retrain_and_publish(scratch_path(spark, "retrained"), upload, original, "label", EMB_FEATURES,
                                       [str(i) for i in range(8)], benign=BENIGN_CLASS, seed=fx.SEED)
    told = F.col("message") == F.format_string("Retraining complete. Accuracy: %.4f", "accuracy")
    return out.select("status", "version", "total_samples", F.array_join(F.array_sort("new_labels"), ",").alias("new_labels"),
                      "new_labels_count", "train_rows", "test_rows",
                      (told & F.col("accuracy").between(0, 1) & F.col("fpr").between(0, 1)).alias("measured"))
