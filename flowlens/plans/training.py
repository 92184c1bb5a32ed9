"""Training and retraining flows composed from the operators.

train:   clean -> encode -> stratified split -> scale -> fit -> evaluate
         (record and report by class) -> save a bundle version (``train_pipeline``)
retrain: strip -> label check -> clean new and original -> common columns ->
         union -> encode -> stats -> dedup -> numeric -> align -> split ->
         scale -> fit -> evaluate (``retrain_pipeline``)
publish: regression gate -> new bundle version -> result row (``retrain_and_publish``)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.sqltext import ident
from flowlens.operators import cleaning, evaluation, labels, model, sampling
from flowlens.operators._small import MAX_BROADCAST_ROWS, materialize, materialize_small
from flowlens.session import scratch_path, wide_table_mode
from flowlens.sources import bundle as versions
from flowlens.sources.bundle import Bundle
from flowlens.sources.flows import strip_headers


@dataclass
class TrainResult:
    bundle: Bundle
    metrics: DataFrame      # one-row record
    report: DataFrame       # rows by class, accuracy, macro and weighted averages
    test_predictions: DataFrame
    stats: DataFrame | None = None
    split_sizes: tuple[int, int] = (0, 0)   # train, test
    root: str | None = None                 # where the bundle was saved,
    version: int | None = None              # and as which version


RESULT = ("status string, message string, version int, total_samples bigint, new_labels array<string>, "
          "new_labels_count int, train_rows bigint, test_rows bigint, accuracy double, fpr double")


def split_and_encode(clean: DataFrame, label: str, keys: list[str], test_size: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Split and encode in two passes over ``clean``: (rows with ``split`` and
    ``label_idx``, dictionary of label and label_idx).

    Pass 1 counts rows per (label, digest bucket); that small table gives the
    label dictionary (its distinct labels), the split quotas (its sums) and
    the rank offsets.  Pass 2 splits the rows, which meet the dictionary by a
    join (broadcast where it is small), and the result is written once to the
    shared checkpoint folder: fit, scaler and evaluation reuse it, and a lost
    executor does not replay the scan.  A missing label is a label.
    """
    with wide_table_mode(clean.sparkSession):
        clean = clean.withColumn(label, F.col(label).cast("string"))
        counts, _ = materialize_small(sampling.bucket_counts(clean, label, keys, seed))
        dictionary = materialize(labels.label_dictionary(counts.select("__g"), "__g"), "dictionary")
        split = sampling.stratified_split(clean, label, keys, test_size, seed, counts=counts)
        return materialize(labels.encode_labels(split, label, dictionary), "train_split"), dictionary


def class_list(dictionary: DataFrame) -> list[str]:
    """The dictionary's labels in index order.  A forest keeps a statistic and
    gives a probability for every class, so they must fit a driver list."""
    k = dictionary.count()
    if k > MAX_BROADCAST_ROWS:
        raise ValueError(f"{k} distinct labels: too many classes for one forest")
    return [r["label"] for r in dictionary.orderBy("label_idx").collect()]


def class_report(scored: DataFrame, classes: list[str]) -> DataFrame:
    """The classification report of scored rows, classes by their names."""
    per = evaluation.per_class_metrics(scored, "label_idx", "predicted")
    names = scored.sparkSession.createDataFrame(list(enumerate(classes)), "class int, name string")
    return evaluation.classification_report(per.join(names, "class").withColumn("class", F.col("name")))


def _fit_and_evaluate(split: DataFrame, label: str, features: list[str], classes: list[str],
                      benign: str, seed: int, num_trees: int, max_depth: int | None) -> TrainResult:
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    params = model.scaler_params(train, features)
    forest = model.train_forest(model.standardize(train, features, params), features, "label_idx",
                                num_trees=num_trees, seed=seed, max_depth=max_depth, n_classes=len(classes))
    # forest inference runs once: every metric pass reads the narrow scored table
    scored = model.predict_probabilities(forest, model.standardize(test, features, params), len(classes))
    scored = materialize(scored.drop(*features), "test_scored")
    benign_idx = classes.index(benign) if benign in classes else 0
    metrics = materialize(
        evaluation.metrics_record(scored, "label_idx", "predicted", "probs", benign_class=benign_idx),
        "metrics")
    report = materialize(class_report(scored, classes), "report")
    m = metrics.first().asDict()
    bundle = Bundle(model=forest, contract=list(features), classes=classes, scaler=params, label=label,
                    benign=benign, metrics={k: float(v) if v is not None else None for k, v in m.items()})
    sizes = dict(map(tuple, split.groupBy("split").count().collect()))   # two rows
    return TrainResult(bundle=bundle, metrics=metrics, report=report, test_predictions=scored,
                       split_sizes=(sizes.get("train", 0), sizes.get("test", 0)))


def train_pipeline(df: DataFrame, label: str, features: list[str], keys: list[str],
                   benign: str = "BENIGN", test_size: float = 0.2, seed: int = 42,
                   num_trees: int = model.NUM_TREES, max_depth: int | None = model.MAX_DEPTH,
                   root: str | None = None) -> TrainResult:
    """Train, evaluate and save the model with its scaler, classes, feature
    contract and metrics as the next version under ``root`` (by default a new
    folder that lasts as long as the application)."""
    spark = df.sparkSession
    with wide_table_mode(spark):
        clean = cleaning.clean_for_training(df.select(*(ident(c) for c in [*keys, *features, label])))
        split, dictionary = split_and_encode(clean, label, keys, test_size, seed)
        result = _fit_and_evaluate(split, label, features, class_list(dictionary), benign, seed, num_trees, max_depth)
        result.root = root or scratch_path(spark, "trained")
        result.version = versions.save_bundle(spark, result.root, result.bundle)
        return result


def retrain_pipeline(new: DataFrame, original: DataFrame | None, label: str, contract: list[str] | None,
                     old_classes: list[str], benign: str = "BENIGN", test_size: float = 0.2,
                     seed: int = 42, num_trees: int = model.NUM_TREES,
                     max_depth: int | None = model.MAX_DEPTH) -> TrainResult:
    """Retrain on uploaded rows plus the original table.

    Raises ValueError with the service's messages when the label column is
    missing or nothing is left after cleaning.
    """
    with wide_table_mode(new.sparkSession):
        return _retrain(new, original, label, contract, old_classes, benign, test_size, seed, num_trees, max_depth)


def _retrain(new: DataFrame, original: DataFrame | None, label: str, contract: list[str] | None,
             old_classes: list[str], benign: str, test_size: float, seed: int, num_trees: int,
             max_depth: int | None) -> TrainResult:
    new = strip_headers(new)
    if label not in new.columns:
        raise ValueError(f"Target column '{label}' not found in uploaded CSV. "
                         f"Available columns: {', '.join(new.columns)}")
    new = cleaning.drop_missing(cleaning.inf_to_null(new))          # NaN rows go before projection
    if original is not None:
        original = strip_headers(original)
        if label in original.columns:
            original = cleaning.drop_missing(cleaning.inf_to_null(original))
            o2, n2, _ = cleaning.common_columns(original, new)
            new = o2.unionByName(n2)
    spark = new.sparkSession
    old = spark.createDataFrame([(c,) for c in old_classes], "label string")
    stats = materialize(labels.retrain_stats(new, old, label), "retrain_stats")  # before de-duplication
    total = stats.first()["total_samples"]
    if not total:
        raise ValueError("No data remaining after cleaning. Please check your CSV file.")
    deduped = cleaning.dedup_rows(new)
    features_present = [c for c in cleaning.numeric_columns(deduped) if c != label]
    features = list(contract) if contract else features_present
    aligned = cleaning.align_features(deduped, features, keep=[label])
    keyed = aligned.withColumn("__row_key", F.md5(F.to_json(F.struct(*[F.col(c) for c in aligned.columns]))))
    # the de-duplication is a shuffle: write its result once instead of
    # repeating it in the counting and the splitting pass
    keyed = materialize(keyed, "retrain_rows")
    split, dictionary = split_and_encode(keyed, label, ["__row_key"], test_size, seed)
    result = _fit_and_evaluate(split, label, features, class_list(dictionary), benign, seed, num_trees, max_depth)
    result.stats = stats
    return result


def accepted(old: dict | None, new: dict, max_fpr: float = evaluation.REGRESSION_MAX_FPR) -> bool:
    """The regression gate on stored metric records; a first model has no rival."""
    return old is None or (new["accuracy"] >= old["accuracy"] and new["fpr"] < max_fpr)


def publish(spark: SparkSession, root: str, result: TrainResult, gate: bool = True) -> tuple[str, str, int | None]:
    """(status, message, current version): ``success`` with a new version, or
    ``rejected`` with the version before it still current."""
    metrics = result.bundle.metrics
    # fixed text, equal to the service's
    done = f"Retraining complete. Accuracy: {metrics['accuracy']:.4f}"
    old = versions.stored_metrics(spark, root)
    if gate and not accepted(old, metrics):
        return "rejected", (f"Kept the current model: accuracy {metrics['accuracy']:.4f} against {old['accuracy']:.4f}, "
                            f"false positive rate {metrics['fpr']:.4f}"), versions.current_version(spark, root)
    return "success", done, versions.save_bundle(spark, root, result.bundle)


def retrain_and_publish(root: str, new: DataFrame, original: DataFrame | None, label: str,
                        contract: list[str] | None, old_classes: list[str], benign: str = "BENIGN",
                        gate: bool = True, **fit) -> DataFrame:
    """Retrain, pass the regression gate against the current version, publish,
    and return one result row (``RESULT``).

    An upload that cannot be trained on (no label column, nothing left after
    cleaning, a label with one row) gives an ``error`` row with the reason and
    leaves the current version; other failures raise.
    """
    spark = new.sparkSession
    try:
        result = retrain_pipeline(new, original, label, contract, old_classes, benign, **fit)
    except ValueError as error:
        row = ("error", str(error), versions.current_version(spark, root), None, None, None, None, None, None, None)
        return spark.createDataFrame([row], RESULT)
    status, message, version = publish(spark, root, result, gate)
    stats, metrics = result.stats.first(), result.bundle.metrics
    row = (status, message, version, stats["total_samples"], stats["new_labels"], stats["new_labels_count"],
           *result.split_sizes, metrics["accuracy"], metrics["fpr"])
    return spark.createDataFrame([row], RESULT)
