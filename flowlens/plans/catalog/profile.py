"""Column-statistics queries: scaler parameters, data quality, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import profile
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import register
from flowlens.plans.catalog.cleaning import DIRTY


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("scaler_fit", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS position, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std "
    f"FROM lineitem" for i, c in enumerate(fx.FLOW_FEATURES)))
def q_scaler_fit(spark, sf):
    return _r(profile.scaler_fit(fx.flows(spark, sf), fx.FLOW_FEATURES), ["mean", "std"])


_QR_COLS = ["value", "user_id"]


def _qr_sql(c):
    fin = f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN NULL ELSE {c} END"
    return (f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, "
            f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, "
            f"CAST(count(*) FILTER (WHERE isnan({c})) AS BIGINT) AS nans, "
            f"CAST(count(*) FILTER (WHERE {c} = 'Infinity'::DOUBLE) AS BIGINT) AS pos_inf, "
            f"CAST(count(*) FILTER (WHERE {c} = '-Infinity'::DOUBLE) AS BIGINT) AS neg_inf, "
            f"round(min({fin}), 6) AS min, round(max({fin}), 6) AS max, round(avg({fin}), 6) AS mean, "
            f"round(stddev_pop({fin}), 6) AS std "
            f"FROM (SELECT CAST(value AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id FROM {DIRTY})")


@register("quality_report", sql=" UNION ALL ".join(_qr_sql(c) for c in _QR_COLS))
def q_quality_report(spark, sf):
    df = fx.dirty_events(spark, sf)
    return _r(profile.quality_report(df, _QR_COLS), ["min", "max", "mean", "std"])


_PAIRS = [(a, b) for i, a in enumerate(fx.FLOW_FEATURES) for b in fx.FLOW_FEATURES[i + 1:]]


@register("feature_correlations", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS pearson FROM lineitem"
    for a, b in _PAIRS))
def q_feature_correlations(spark, sf):
    return _r(profile.feature_correlations(fx.flows(spark, sf), fx.FLOW_FEATURES), ["pearson"])
