"""Column statistics: scaler parameters, data-quality report, correlations.

Each is a single aggregate over the table (map-side partial aggregation, one
shuffle of one row per partition), reshaped to long form afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.numeric import is_infinite
from flowlens.functions.sqltext import ident, string_lit


def _long_form(one_row: DataFrame, features: list[str], stats: list[str]) -> DataFrame:
    """Reshape a 1-row ``{stat}__{i}`` aggregate into (feature, stat...) rows."""
    structs = [f"struct({string_lit(f)} AS feature, {i} AS position, "
               + ", ".join(f"{s}__{i} AS {s}" for s in stats) + ")"
               for i, f in enumerate(features)]
    return one_row.selectExpr(f"inline(array({', '.join(structs)}))")


def scaler_fit(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population std per feature (the scaler's parameters)."""
    aggs = []
    for i, c in enumerate(features):
        x = f"CAST({ident(c)} AS DOUBLE)"
        aggs += [f"avg({x}) AS mean__{i}", f"stddev_pop({x}) AS std__{i}"]
    return _long_form(df.selectExpr(*aggs), features, ["mean", "std"])


def quality_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows, nulls, NaN, +Inf, -Inf, and min/max/mean/std of finite values."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    stats = ["nulls", "nans", "pos_inf", "neg_inf", "min", "max", "mean", "std"]
    for i, c in enumerate(cols):
        x = F.col(ident(c)).cast("double")
        finite = F.when(~(x.isNull() | F.isnan(x) | is_infinite(x)), x)
        aggs += [F.count_if(x.isNull()).alias(f"nulls__{i}"),
                 F.count_if(F.isnan(x)).alias(f"nans__{i}"),
                 F.count_if(x == F.lit(float("inf"))).alias(f"pos_inf__{i}"),
                 F.count_if(x == F.lit(float("-inf"))).alias(f"neg_inf__{i}"),
                 F.min(finite).alias(f"min__{i}"), F.max(finite).alias(f"max__{i}"),
                 F.avg(finite).alias(f"mean__{i}"), F.stddev_pop(finite).alias(f"std__{i}")]
    one = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col("rows"),
                        *[F.col(f"{s}__{i}").alias(s) for s in stats])
               for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*structs)))


#: Rows whose cross products are formed by one matrix multiplication.
BLOCK_ROWS = 4096


def feature_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson correlation of every feature pair (i < j), over the rows that have both.

    A blocked cross-product matrix: every task multiplies its rows' feature
    matrix with itself, block by block, next to a matrix of pairwise presence,
    and emits one row of sums a pair; the sums of all tasks are merged.  Values
    are taken off their means first (one aggregate), so no digits cancel.  A
    pair with a NaN or infinite value in a common row gives NaN; fewer than two
    common rows or a constant column gives null.  An empty table gives no rows.
    """
    k = len(features)
    centre = _finite_means(df, features)
    wide = df.selectExpr(*[f"CAST({ident(c)} AS DOUBLE) AS x{i}" for i, c in enumerate(features)])
    sums = ("n", "bad", "sx", "sy", "sxx", "syy", "sxy")
    i, j = np.triu_indices(k, 1)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(sums), k, k)), 0
        for batch in batches:
            seen += batch.num_rows
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(lo, BLOCK_ROWS)
                there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in rows.columns], 1)
                x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in rows.columns], 1)
                finite = np.isfinite(x)
                x = np.where(there & finite, x - centre, 0.0)
                here, odd = there.astype(float), (there & ~finite).astype(float)
                square, once = (x * x).T @ here, x.T @ here
                either = odd.T @ here
                total += np.stack([here.T @ here, either + either.T, once, once.T, square, square.T, x.T @ x])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                              *(pa.array(t[i, j]) for t in total)], names=["i", "j", *sums])

    if k < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, pearson double")
    parts = wide.mapInArrow(cross, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    found = parts.groupBy("i", "j").agg(*(F.sum(s).alias(s) for s in sums))
    spread = (F.col("n") * F.col("sxx") - F.col("sx") ** 2) * (F.col("n") * F.col("syy") - F.col("sy") ** 2)
    r = F.when(F.col("bad") > 0, float("nan")).when((F.col("n") > 1) & (spread > 0), (
        F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in features])
    return found.select(F.element_at(names, F.col("i") + 1).alias("feature_a"),
                        F.element_at(names, F.col("j") + 1).alias("feature_b"), r.alias("pearson"))


def _finite_means(df: DataFrame, features: list[str]) -> np.ndarray:
    """Means of the finite values, 0 where there are none (one row to the driver)."""
    means = []
    for i, c in enumerate(features):
        x = f"CAST({ident(c)} AS DOUBLE)"
        means.append(f"avg(CASE WHEN abs({x}) < double('Infinity') THEN {x} END) AS m{i}")
    return np.array([0.0 if m is None else m for m in df.selectExpr(*means).first()])
