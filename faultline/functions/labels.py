"""Failure label expressions (subtype flags -> type code / name)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import FAILURE_TYPES, FLAG_COLS, LABEL

TYPE_NAMES = [name for _, name, _ in FAILURE_TYPES]


def any_flag(flags=FLAG_COLS) -> Column:
    total = None
    for f in flags:
        total = F.col(f) if total is None else total + F.col(f)
    return total > 0


def labelled_failure(flags=FLAG_COLS) -> Column:
    """Failed AND at least one subtype flag set."""
    return (F.col(LABEL) == 1) & any_flag(flags)


def failure_code(flags=FLAG_COLS) -> Column:
    """First flag at the maximum, as code 0..4 (flags are 0/1, so: first set flag)."""
    expr = None
    for code, f in enumerate(flags):
        cond = F.col(f) == 1
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit(None).cast("int"))


def failure_name(flags=FLAG_COLS, unlabelled: str = "NoLabel") -> Column:
    """Name of the first set flag, ``NoLabel`` when none is set (label not required)."""
    expr = None
    for f, name in zip(flags, TYPE_NAMES):
        cond = F.col(f) == 1
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(unlabelled))


def verdict_text(flag_col, anomaly: str = "ANOMALY", normal: str = "normal") -> Column:
    """Human-readable layer verdict."""
    return F.when(F.coalesce(F.col(flag_col) if isinstance(flag_col, str) else flag_col,
                             F.lit(False)), F.lit(anomaly)).otherwise(F.lit(normal))
