"""SQL-text building blocks for wide projections.

A projection over dozens of feature columns built from ``Column`` objects
costs several driver<->JVM calls per column; the same expressions as SQL
text go over in one ``selectExpr`` call.  Catalyst sees the same plan.
"""

from __future__ import annotations

import math


def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def string_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_lit(x: float) -> str:
    """An exact double literal (shortest round-trip text, D suffix)."""
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({x!r}D)"


INF = "CAST('Infinity' AS DOUBLE)"


def is_infinite_sql(c: str) -> str:
    return f"(abs({ident(c)}) = {INF})"


def fill_zero_sql(c: str) -> str:
    """+/-Inf, NaN and null -> 0.0 (the scoring-time fill), as SQL text."""
    x = f"CAST({ident(c)} AS DOUBLE)"
    return (f"coalesce(nanvl(CASE WHEN NOT (abs({x}) = {INF}) THEN {x} END, "
            f"CAST(NULL AS DOUBLE)), 0.0D)")
