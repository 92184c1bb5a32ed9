"""Size-checked handling of small derived tables (dictionaries, quotas)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import scratch_path

# Largest table ever broadcast by flowlens: dictionaries of labels, quotas,
# per-(group, bucket) counts.  Anything larger joins by shuffle instead.
MAX_BROADCAST_ROWS = 200_000


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a derived table to the shared checkpoint folder and read it back.

    This cuts lineage (a lost executor re-reads the table instead of
    replaying the scan behind it) and computes the table exactly once,
    unlike an eager ``checkpoint()``, which evaluates its plan twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_small(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialize a derived table and count it (parquet footers; no scan).

    The count is the size check that decides whether it may be broadcast.
    """
    df = materialize(df, "small")
    return df, df.count()


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the key columns are the left side's."""
    names = {c: f"__right_{i}" for i, c in enumerate(on)}
    right = right.withColumnsRenamed(names)
    met = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return left.join(right, reduce(Column.__and__, met), how).drop(*names.values())


def broadcast_checked(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Materialize and broadcast when provably small, else leave it to a shuffle join."""
    df, n = materialize_small(df)
    return F.broadcast(df) if n <= max_rows else df
