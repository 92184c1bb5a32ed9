"""Projection, filtering and cleaning operators for flow tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.labels import is_benign
from flowlens.functions.numeric import coerce_double, fill_zero, inf_to_null_expr, is_missing
from flowlens.functions.sqltext import ident, is_infinite_sql

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)

# Fixed value: header names (trimmed, lower case) recognised as the label column.
LABEL_NAMES = ("label", "class", "target", "y")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def _float_columns(df: DataFrame, cols=None) -> list[str]:
    cols = set(cols) if cols is not None else None
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, FLOAT_TYPES) and (cols is None or f.name in cols)]


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+/-Inf -> null in floating columns, one projection (no extra pass)."""
    targets = set(_float_columns(df, cols))
    return df.select([inf_to_null_expr(F.col(ident(c))).alias(c) if c in targets else F.col(ident(c))
                      for c in df.columns])


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows holding null or NaN in any (or the given) column."""
    return df.na.drop(how="any", subset=[ident(c) for c in cols or df.columns])


def clean_for_training(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Training clean-up: rows holding +/-Inf, NaN or null in any column go.

    Same rows as "infinities -> missing, then drop missing", written as one
    filter plus ``na.drop``: no per-column rewrite projection, so wide flow
    tables (78 columns) keep a small plan for the optimizer.
    """
    floats = _float_columns(df, cols)
    out = df
    if floats:
        any_inf = " OR ".join(f"coalesce({is_infinite_sql(c)}, false)" for c in floats)
        out = out.filter(F.expr(f"NOT ({any_inf})"))
    return drop_missing(out, cols)


def clean_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows before/after ``clean_for_training`` in one aggregate pass."""
    cols = cols or df.columns
    floats = set(_float_columns(df, cols))
    bad = F.lit(False)
    for c in cols:
        col = F.col(ident(c))
        cond = (is_missing(col) | (F.abs(col) == F.lit(float("inf")))) if c in floats else col.isNull()
        bad = bad | cond
    return df.agg(F.count(F.lit(1)).alias("rows_before"),
                  F.count_if(~bad).alias("rows_after"),
                  F.lit(len(df.columns)).alias("n_columns"))


def fill_for_scoring(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scoring-time clean-up: Inf/NaN/null -> 0 in the feature columns."""
    targets = set(cols)
    return df.select([fill_zero(F.col(ident(c))).alias(c) if c in targets else F.col(ident(c))
                      for c in df.columns])


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of any type -> double; unparsable/missing -> 0.0, Inf kept."""
    targets = set(cols)
    return df.select([coerce_double(F.col(ident(c))).alias(c) if c in targets else F.col(ident(c))
                      for c in df.columns])


def numeric_only(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Keep numeric columns (plus any named in ``keep``), in table order."""
    keep = set(keep or [])
    nums = set(numeric_columns(df))
    return df.select([ident(c) for c in df.columns if c in nums or c in keep])


def align_features(df: DataFrame, contract: list[str], keep: list[str] | None = None) -> DataFrame:
    """Project to the feature contract: missing -> 0.0, extra dropped, order restored.

    Non-numeric columns named in the contract count as missing (they were
    dropped before re-indexing in the service), so they become 0.0 too.
    """
    nums = set(numeric_columns(df))
    exprs: list[Column] = [F.col(ident(k)) for k in (keep or [])]
    for c in contract:
        exprs.append((F.col(ident(c)).cast("double") if c in nums else F.lit(0.0)).alias(c))
    return df.select(exprs)


def find_label_column(columns: list[str]) -> str | None:
    for c in columns:
        if str(c).strip().lower() in LABEL_NAMES:
            return c
    return None


def resolve_features(df: DataFrame, contract: list[str] | None = None,
                     label_alias: str = "label") -> tuple[DataFrame, list[str], str | None]:
    """Pick label and feature columns from the schema; one projection.

    Features are the contract when all of it is present, else every numeric
    column but the label.  Raises when no feature is left or when the count
    differs from the contract.
    """
    label = find_label_column(df.columns)
    if contract and all(c in df.columns for c in contract):
        features = list(contract)
    else:
        features = [c for c in numeric_columns(df) if c != label]
    if not features:
        raise ValueError("No numeric feature columns found")
    if contract and len(features) != len(contract):
        raise ValueError(f"Feature count mismatch: table has {len(features)} columns, "
                         f"contract expects {len(contract)}")
    exprs = [F.col(ident(c)).cast("double").alias(c) for c in features]
    if label is not None:
        exprs.append(F.col(ident(label)).alias(label_alias))
    return df.select(exprs), features, label


def common_columns(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Project two tables to their shared column names, sorted (stable order)."""
    shared = sorted(set(a.columns) & set(b.columns))
    quoted = [ident(c) for c in shared]
    return a.select(quoted), b.select(quoted), shared


def split_xy(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(label), df.select(label)


def check_feature_count(df: DataFrame, features: str, expected: int) -> DataFrame:
    """Flag vectors of the wrong length; rows are kept, status/message added."""
    n = F.size(F.col(features))
    ok = n == F.lit(expected)
    return (df.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("error")))
              .withColumn("message", F.when(ok, F.lit(None).cast("string")).otherwise(
                  F.format_string(f"Feature mismatch. Expected {expected}, got %d.", n))))


def validate_requests(df: DataFrame, body: str, expected: int) -> DataFrame:
    """Classify raw JSON request bodies; adds ``status``, ``message`` and ``features``.

    malformed   -> body is not valid JSON
    missing     -> valid JSON without a top-level ``features`` key
    not_list    -> ``features`` is not an array
    bad_length  -> array of the wrong length
    ok          -> parsed to array<double>; non-numeric elements become null
    Duplicate keys: the last one wins (``from_json``).  ``NaN`` and
    ``Infinity`` are numbers; single quotes and text behind the value are not
    JSON; a string that holds a list is not a list; a null body is malformed.
    """
    text = F.col(body)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
    # the parser stops at the end of the first value: inside brackets, text
    # behind it is an error or a second element
    inside = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    field = F.from_json(F.concat(F.lit('{"body":'), text, F.lit("}")), "map<string,string>", strict)
    # each parse once per row: the intermediate columns are referenced
    # several times below, so Catalyst keeps them as one projection
    parsed_cols = df.select(
        "*",
        F.coalesce((F.size(inside) == 1) & (F.size(field) == 1), F.lit(False)).alias("__valid"),
        F.coalesce(F.array_contains(F.map_keys(F.from_json(text, "map<string,string>", strict)), "features"),
                   F.lit(False)).alias("__has"),
        F.from_json(text, "features array<string>", strict).getField("features").alias("__raw"))
    parsed_cols = parsed_cols.withColumn("__n", F.when(F.col("__raw").isNotNull(), F.size("__raw")))
    valid, has_features, n = F.col("__valid"), F.col("__has"), F.col("__n")
    status = (F.when(~valid, F.lit("malformed"))
              .when(~has_features, F.lit("missing"))
              .when(n.isNull(), F.lit("not_list"))
              .when(n != F.lit(expected), F.lit("bad_length"))
              .otherwise(F.lit("ok")))
    message = (F.when(~valid, F.lit("Malformed JSON."))
               .when(~has_features, F.lit("Missing 'features' in JSON."))
               .when(n.isNull(), F.lit("'features' must be a list."))
               .when(n != F.lit(expected),
                     F.format_string(f"Feature mismatch. Expected {expected}, got %d.", n))
               .otherwise(F.lit(None).cast("string")))
    features = F.when(F.col("status") == F.lit("ok"),
                      F.transform("__raw", lambda x: x.try_cast("double")))
    return (parsed_cols.withColumn("status", status).withColumn("message", message)
            .withColumn("features", features).drop("__valid", "__has", "__raw", "__n"))


def normalize_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.trim(F.col(label)))


def attacks_only(df: DataFrame, label: str, benign: str = "BENIGN") -> DataFrame:
    return df.filter(~is_benign(label, benign))


def benign_only(df: DataFrame, label: str, benign: str = "BENIGN") -> DataFrame:
    return df.filter(is_benign(label, benign))


def filter_label(df: DataFrame, label: str, value: str) -> DataFrame:
    """Exact label match; raises if the label column is absent."""
    if label not in df.columns:
        raise ValueError("label filter requested but the table has no label column")
    return df.filter(F.col(label) == F.lit(value))


def feature_row_to_array(df: DataFrame, features: list[str], out: str = "features",
                         keep: list[str] | None = None) -> DataFrame:
    """Feature columns -> ordered array<double>; unparsable -> 0.0."""
    arr = F.array(*[coerce_double(F.col(ident(c))) for c in features]).alias(out)
    return df.select(*[F.col(ident(k)) for k in (keep or [])], arr)


def array_to_columns(df: DataFrame, features: str, names: list[str],
                     keep: list[str] | None = None) -> DataFrame:
    """Positional array -> named double columns (missing positions -> null)."""
    arr = ident(features)
    cols = [f"CAST(try_element_at({arr}, {i + 1}) AS DOUBLE) AS {ident(n)}" for i, n in enumerate(names)]
    return df.selectExpr(*[ident(k) for k in (keep or [])], *cols)


def dedup_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Exact duplicate removal (hash aggregate with map-side partial dedup)."""
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()
