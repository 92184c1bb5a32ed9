"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime.datetime(1970, 1, 1)


def epoch_ms(c) -> Column:
    """Milliseconds since the epoch for TIMESTAMP_NTZ or TIMESTAMP columns.

    NTZ values are taken as UTC wall clock; no session time zone enters.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MILLISECOND", F.lit(_EPOCH).cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def ms_to_text(c) -> Column:
    """Epoch milliseconds -> ``yyyy-MM-dd HH:mm:ss`` text (UTC)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(F.timestamp_millis(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
