"""Deterministic hash-based draws.

Random numbers that must be reproducible across engines and across task
retries are derived from ``md5`` of a string key: the first 15 hex digits as an
unsigned 60-bit integer, so a position drawn modulo any table size reaches
every row. The same value is computable in DuckDB as
``('0x' || substr(md5(s), 1, 15))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(1 << 52)


def key_string(*parts) -> Column:
    """``p1|p2|...`` as a string column."""
    cols = []
    for i, p in enumerate(parts):
        if i:
            cols.append(F.lit("|"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def hash60(*parts) -> Column:
    """Unsigned 60-bit integer from md5 of the joined key (BIGINT)."""
    return F.conv(F.substring(F.md5(key_string(*parts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform [0,1) double from the key: 52 bits, so that it stays below 1."""
    return F.conv(F.substring(F.md5(key_string(*parts)), 1, 13), 16, 10).cast("bigint") / F.lit(TWO_52)
