"""Result comparison used by the oracle checker and the tests.

Rows are compared as an order-insensitive multiset after sorting columns by
name; doubles are rounded to 6 places, NaN and -0.0 normalised.
"""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if v == 0.0:
            return 0.0
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canonical_rows(records, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


def duckdb_views(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(cols) != sorted(dcols):
        return False, f"columns spark={sorted(cols)} duck={sorted(dcols)}"
    a, b = canonical_rows(srows, cols), canonical_rows(drows, dcols)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"rows spark={len(a)} duck={len(b)}; only spark {list(sa - sb)[:2]}; "
                       f"only duck {list(sb - sa)[:2]}")
    return True, f"{len(a)} rows"
