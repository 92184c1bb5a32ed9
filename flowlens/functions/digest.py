"""Seeded, engine-independent pseudo-random orders and draws.

``md5`` of ``seed|key`` gives the same order in Spark and in any SQL engine,
so samples are reproducible and checkable; it is also independent of the
partitioning, so a lost executor recomputes exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Stands for a null key in the digest.
NULL_KEY = "\x00"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_digest(seed: int | str, *keys) -> Column:
    """Hex md5 of ``seed|k1|k2...``; sort ascending for the seeded order.

    A null key counts as a value of its own, so its place among the keys matters.
    """
    parts = [F.lit(str(seed))] + [F.coalesce(_col(k).cast("string"), F.lit(NULL_KEY)) for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def digest_int(digest: Column, hex_chars: int = 15) -> Column:
    """Leading hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, hex_chars), 16, 10).cast("bigint")


def draw_rank(seed: int | str, group, draw_no, group_size) -> Column:
    """1-based rank of the row picked by draw ``draw_no`` (with replacement)."""
    d = order_digest(seed, F.lit("draw"), group, draw_no)
    return F.pmod(digest_int(d), _col(group_size)) + F.lit(1)
