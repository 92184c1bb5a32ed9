"""Numeric cleaning expressions: infinities, NaN, nulls and text numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_infinite(c) -> Column:
    """True for +Inf and -Inf (false for NaN and null)."""
    return F.abs(_col(c)) == F.lit(_INF)


def is_missing(c) -> Column:
    """null or NaN: what ``na.drop`` treats as missing for doubles."""
    c = _col(c)
    return c.isNull() | F.isnan(c)


def inf_to_null_expr(c) -> Column:
    """+/-Inf become null, everything else (NaN included) is kept."""
    c = _col(c)
    return F.when(is_infinite(c), F.lit(None).cast("double")).otherwise(c)


def fill_zero(c) -> Column:
    """Scoring-time fill: +/-Inf, NaN and null all become 0.0."""
    c = _col(c).cast("double")
    finite = F.when(~is_infinite(c), c)
    return F.coalesce(F.nanvl(finite, F.lit(None).cast("double")), F.lit(0.0))


def coerce_double(c) -> Column:
    """Text or number -> double; unparsable, NaN and null become 0.0, Inf stays.

    ``try_cast`` keeps ANSI mode from failing the whole job on one bad value.
    """
    parsed = _col(c).try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(None).cast("double")), F.lit(0.0))


def round6(c) -> Column:
    """Round to 6 places; the form every double leaves a query in."""
    return F.round(_col(c), 6)
