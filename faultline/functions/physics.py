"""Physics features as Column expressions (stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.schema import TYPE_CODES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mechanical_power(rpm="rpm", torque="torque_nm") -> Column:
    """Mechanical power in W: 2*pi*rpm*torque/60 (same operation order as the oracle)."""
    return F.lit(2) * F.pi() * _c(rpm) * _c(torque) / F.lit(60)


def thermal_gap(process="process_temp_k", air="air_temp_k") -> Column:
    """Process minus air temperature, K."""
    return _c(process) - _c(air)


def tool_strain(wear="tool_wear_min", torque="torque_nm") -> Column:
    """Tool wear times torque."""
    return _c(wear) * _c(torque)


def type_code(type_col="type") -> Column:
    """Ordinal code L/M/H -> 0/1/2; anything else -> NULL."""
    t = _c(type_col)
    expr = None
    for name, code in TYPE_CODES.items():
        expr = (F.when(t == name, F.lit(code)) if expr is None
                else expr.when(t == name, F.lit(code)))
    return expr.otherwise(F.lit(None).cast("int"))


def nan_to_null(col) -> Column:
    """NaN -> NULL, so SQL aggregates skip it and comparisons stay false."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)
