"""Label text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_label(c) -> Column:
    """Trim surrounding blanks once, at ingest."""
    return F.trim(F.col(c) if isinstance(c, str) else c)


def is_benign(c, benign: str = "BENIGN") -> Column:
    """Case-insensitive match against the benign label, after trimming."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(c)) == F.lit(benign.strip().upper())
