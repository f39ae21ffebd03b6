"""Canonical telemetry schema, input contracts and column-name resolution.

Everything here is driver-side metadata work on ``df.columns`` / ``StructType``:
no job is launched, so contract violations fail before any data is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original tool's for equal results:
# source column names (as they appear in the raw sensor CSV), the failure-type
# codes with their names and descriptions, and the physics-column aliases.
# ---------------------------------------------------------------------------
SOURCE_COLUMNS = {
    "UDI": "unit_id",
    "Product ID": "product_id",
    "Type": "type",
    "Air temperature [K]": "air_temp_k",
    "Process temperature [K]": "process_temp_k",
    "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque_nm",
    "Tool wear [min]": "tool_wear_min",
    "Machine failure": "machine_failure",
    "TWF": "twf",
    "HDF": "hdf",
    "PWF": "pwf",
    "OSF": "osf",
    "RNF": "rnf",
    "Power_W": "power_w",
    "Temp_Diff_K": "temp_diff_k",
    "Strain_Load": "strain_load",
    "Type_encoded": "type_encoded",
}

TYPE_CODES = {"L": 0, "M": 1, "H": 2}

FAILURE_TYPES = [
    (0, "TWF", "Tool Wear Failure: failure due to excessive tool wear causing improper machining."),
    (1, "HDF", "Heat Dissipation Failure: inadequate cooling; process temperature too close to ambient."),
    (2, "PWF", "Power Failure: excessive power output (high speed + high torque) causing failure."),
    (3, "OSF", "Overstrain Failure: worn tool under high torque leading to breakage."),
    (4, "RNF", "Random Failure: unpredictable or sensor/noise-driven failure not explained by physics features."),
]

PHYSICS_ALIASES = {
    "power": ["power_w", "Power_W", "Power"],
    "temp_diff": ["temp_diff_k", "Temp_Diff_K", "Temp_Diff", "Temp_DiffK"],
    "strain": ["strain_load", "Strain_Load", "StrainLoad"],
}
# --- end of fixed values ---------------------------------------------------

KEY = "unit_id"
LABEL = "machine_failure"
FLAG_COLS = ["twf", "hdf", "pwf", "osf", "rnf"]
SENSOR_COLS = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min"]
DERIVED_COLS = ["power_w", "temp_diff_k", "strain_load"]

# Guard features: order matters (it is the order of the fitted bounds table).
GUARD_FEATURES = ["rpm", "torque_nm", "tool_wear_min", "power_w", "temp_diff_k", "strain_load"]
# Detector / diagnoser features: what remains after dropping ids and labels.
MODEL_FEATURES = ["air_temp_k", "process_temp_k", "rpm", "torque_nm", "tool_wear_min",
                  "power_w", "temp_diff_k", "strain_load", "type_encoded"]
# Deep-dive feature set used by the exploratory statistics.
PROFILE_FEATURES = ["power_w", "temp_diff_k", "strain_load", "rpm", "torque_nm",
                    "tool_wear_min", "type_encoded"]
# Identifier / label columns never used as model inputs.
NON_FEATURES = [KEY, "product_id", LABEL, *FLAG_COLS, "type", "machine_id", "ts"]

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("unit_id", T.LongType(), False),
    T.StructField("product_id", T.StringType(), True),
    T.StructField("machine_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("type", T.StringType(), True),
    *[T.StructField(c, T.DoubleType(), True) for c in SENSOR_COLS + DERIVED_COLS],
    T.StructField("machine_failure", T.IntegerType(), True),
    *[T.StructField(c, T.IntegerType(), True) for c in FLAG_COLS],
])

# Schema of the raw sensor CSV, read without inference (everything as string
# first so that bad values become NULL via try_cast, never an exception).
RAW_CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in SOURCE_COLUMNS
                               if c not in ("Power_W", "Temp_Diff_K", "Strain_Load", "Type_encoded")])


class ContractError(ValueError):
    """Raised when an input frame lacks required columns."""

    def __init__(self, missing, available):
        self.missing = list(missing)
        self.available = list(available)
        super().__init__(f"missing required columns {self.missing}; available: {self.available}")


def missing_columns(df_or_cols, required) -> list[str]:
    """Column-set difference: which of ``required`` are absent (order kept)."""
    cols = df_or_cols.columns if isinstance(df_or_cols, DataFrame) else list(df_or_cols)
    present = set(cols)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required) -> DataFrame:
    """Input contract: raise with the missing list before any job runs."""
    missing = missing_columns(df, required)
    if missing:
        raise ContractError(missing, df.columns)
    return df


def resolve_column(df_or_cols, *candidates) -> str | None:
    """First candidate name present in the frame, else None."""
    cols = set(df_or_cols.columns if isinstance(df_or_cols, DataFrame) else df_or_cols)
    for c in candidates:
        if c in cols:
            return c
    return None


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename source-style columns (``Torque [Nm]``) to canonical snake_case."""
    for src, dst in SOURCE_COLUMNS.items():
        if src in df.columns and src != dst:
            df = df.withColumnRenamed(src, dst)
    return df


def feature_columns(df: DataFrame, drop=NON_FEATURES) -> list[str]:
    """Feature list = all columns minus identifiers and labels (schema only)."""
    dropped = set(drop)
    return [c for c in df.columns if c not in dropped]
