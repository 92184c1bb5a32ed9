"""Every query with an oracle matches DuckDB on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from flowlens.plans.checks import compare
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck_small, name):
    df = E.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, duck_small, ORACLES[name])
    assert ok, msg


def test_every_query_has_a_callable():
    assert set(ORACLES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert set(df.columns) == {"accuracy", "precision", "recall", "f1", "fpr", "auc"}
