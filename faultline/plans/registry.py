"""Query registry: name -> (Spark callable, oracle SQL or None).

Every registered query reads the driver's tables (``events`` -> telemetry) at
the given scale-factor directory and runs over all rows. The oracle SQL is
DuckDB text over the same pre-registered views; ``None`` marks the few
operators that are not SQL-expressible (model training, isolation forest,
oversampling with kNN, streaming) and get a rows-only check plus pytest
properties.
"""

from __future__ import annotations

from collections.abc import Callable

from faultline.schema import FAILURE_TYPES

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load_all():
    # import for side effects: each module registers its queries
    from faultline.plans import q_features, q_stats, q_guard, q_sampling, q_scenarios  # noqa: F401
    from faultline.plans import q_forest, q_models, q_stream, q_tables  # noqa: F401


def queries() -> dict[str, Callable]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ---- SQL fragments shared by the oracle texts -------------------------------
def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FAILURE_DIM_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({c}, {sql_str(n)}, {sql_str(d)})" for c, n, d in FAILURE_TYPES) + ") AS d(code, name, description)"

FAILURE_CODE_SQL = ("CASE WHEN twf = 1 THEN 0 WHEN hdf = 1 THEN 1 WHEN pwf = 1 THEN 2 "
                    "WHEN osf = 1 THEN 3 WHEN rnf = 1 THEN 4 END")
FAILURE_NAME_SQL = ("CASE WHEN twf = 1 THEN 'TWF' WHEN hdf = 1 THEN 'HDF' WHEN pwf = 1 THEN 'PWF' "
                    "WHEN osf = 1 THEN 'OSF' WHEN rnf = 1 THEN 'RNF' ELSE 'NoLabel' END")
TYPE_CODE_SQL = "CASE type WHEN 'L' THEN 0 WHEN 'M' THEN 1 WHEN 'H' THEN 2 END"
