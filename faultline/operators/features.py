"""Cleaning, physics features, encodings and label derivation (all narrow ops).

Every function here is a projection or a filter: Catalyst folds them into the
scan stage, pushes filters to parquet and prunes unused columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.labels import failure_code, failure_name, labelled_failure
from faultline.functions.physics import mechanical_power, thermal_gap, tool_strain, type_code
from faultline.schema import (FAILURE_TYPES, FLAG_COLS, KEY, LABEL, SENSOR_COLS, missing_columns,
                              require_columns)

REQUIRED_FOR_FEATURES = ["rpm", "torque_nm", "air_temp_k", "process_temp_k", "tool_wear_min"]


def coerce_numeric(df: DataFrame, cols=SENSOR_COLS) -> DataFrame:
    """Text -> DOUBLE with unparsable values -> NULL (ANSI-safe ``try_cast``); NaN -> NULL."""
    out = []
    for c in df.columns:
        if c in cols:
            v = F.col(c) if dict(df.dtypes)[c] in ("double", "float") else F.expr(f"try_cast(`{c}` AS DOUBLE)")
            out.append(F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def fill_missing(df: DataFrame, cols, value=0) -> DataFrame:
    """Missing -> constant for the given columns."""
    return df.fillna(value, subset=list(cols))


def add_physics(df: DataFrame, overwrite: bool = True) -> DataFrame:
    """Add power_w, temp_diff_k, strain_load computed from the sensors (contract-checked)."""
    require_columns(df, REQUIRED_FOR_FEATURES)
    cols = {
        "power_w": mechanical_power("rpm", "torque_nm"),
        "temp_diff_k": thermal_gap("process_temp_k", "air_temp_k"),
        "strain_load": tool_strain("tool_wear_min", "torque_nm"),
    }
    if not overwrite:
        cols = {k: v for k, v in cols.items() if k not in df.columns}
    return df.withColumns(cols)


def encode_type(df: DataFrame, col: str = "type", out: str = "type_encoded") -> DataFrame:
    """Ordinal-encode the product type L/M/H -> 0/1/2 (unknown -> NULL)."""
    require_columns(df, [col])
    return df.withColumn(out, type_code(col))


def coerce_labels(df: DataFrame) -> DataFrame:
    """Key -> BIGINT, label and subtype flags -> INT (text sources; unparsable -> NULL)."""
    casts = {c: F.expr(f"try_cast(`{c}` AS INT)") for c in [LABEL, *FLAG_COLS] if c in df.columns
             and dict(df.dtypes)[c] == "string"}
    if KEY in df.columns and dict(df.dtypes)[KEY] == "string":
        casts[KEY] = F.expr(f"try_cast(`{KEY}` AS BIGINT)")
    return df.withColumns(casts) if casts else df


def prepare_features(df: DataFrame) -> DataFrame:
    """Coerce + physics + type code: the model-ready telemetry frame."""
    df = coerce_labels(coerce_numeric(df))
    df = add_physics(df)
    if "type" in df.columns:
        df = encode_type(df)
    return df


def add_absent(df: DataFrame, cols, value=0) -> DataFrame:
    """Add each absent column as a constant (0 for flags/model inputs, NULL for EDA)."""
    missing = missing_columns(df, cols)
    if not missing:
        return df
    lit = F.lit(None).cast("double") if value is None else F.lit(value)
    return df.withColumns({c: lit for c in missing})


def align_to(df: DataFrame, expected, keep=(KEY,), fill=0) -> DataFrame:
    """Align to a model's expected columns: add absent as ``fill``, reorder, drop extras."""
    df = add_absent(df, expected, fill)
    keep = [k for k in keep if k in df.columns and k not in expected]
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in expected])


def healthy(df: DataFrame) -> DataFrame:
    return df.filter(F.col(LABEL) == 0)


def failed(df: DataFrame) -> DataFrame:
    return df.filter(F.col(LABEL) == 1)


def labelled_failures(df: DataFrame) -> DataFrame:
    """Failed rows that carry at least one subtype flag (absent flags count as 0)."""
    df = add_absent(df, FLAG_COLS, 0)
    return df.filter(labelled_failure())


def with_failure_code(df: DataFrame, out: str = "failure_type") -> DataFrame:
    df = add_absent(df, FLAG_COLS, 0)
    return df.withColumn(out, failure_code())


def with_failure_name(df: DataFrame, out: str = "failure_type") -> DataFrame:
    """Failure-type name for every row, ``NoLabel`` without a flag (label not required)."""
    df = add_absent(df, FLAG_COLS, 0)
    return df.withColumn(out, failure_name())


def failure_type_dim(spark) -> DataFrame:
    """(code, name, description) dimension — five rows, broadcast in joins."""
    return spark.createDataFrame(FAILURE_TYPES, "code INT, name STRING, description STRING")


def describe_type(df: DataFrame, code_col: str = "failure_type") -> DataFrame:
    """Join a code column to its name/description (the dimension has a fixed size of 5)."""
    dim = F.broadcast(failure_type_dim(df.sparkSession))
    return df.join(dim, df[code_col] == dim["code"], "left").drop("code")


def exclude_values(df: DataFrame, col: str, values) -> DataFrame:
    """Set-membership exclusion (``col NOT IN values``)."""
    return df.filter(~F.col(col).isin(list(values)))


def overstrain_like(df: DataFrame, wear=170, torque=46, strain=11000) -> DataFrame:
    """Overstrain-like subset: wear > 170 AND torque > 46 AND strain > 11000."""
    return df.filter((F.col("tool_wear_min") > wear) & (F.col("torque_nm") > torque)
                     & (F.col("strain_load") > strain))
