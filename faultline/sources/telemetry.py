"""Telemetry sources and sinks.

``telemetry(spark, sf_dir)`` derives the canonical sensor table from the
driver's ``events`` table (FIXTURES.md §3): one telemetry row per event, a
pure projection — no shuffle, only the three columns it needs are scanned.
``read_sensor_csv`` reads the original tool's CSV layout with an explicit
schema (no inference) and renames to canonical names.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.physics import mechanical_power, thermal_gap, tool_strain
from faultline.schema import RAW_CSV_SCHEMA, SENSOR_COLS, SOURCE_COLUMNS, TYPE_CODES, to_canonical

# Fixed generator constants of the test fixture: (multiplier, offset, modulus)
# per uniform stream u1..u6, the type digit rule, and the injected-defect moduli.
UNIFORM_STREAMS = [
    (7919, 104729, 10007),
    (6101, 1299709, 10009),
    (4643, 15485863, 10037),
    (3571, 32452843, 10039),
    (2749, 49979687, 10061),
    (2221, 67867967, 10067),
]
ZERO_WEAR_MOD, NEG_GAP_MOD, POWER_X_MOD, STRAIN_X_MOD = 149, 503, 211, 307
NO_SUBTYPE_MOD, RANDOM_FLAG_MOD = 1103, 997
BAD_TORQUE_MOD, BAD_TYPE_MOD = 401, 599


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _mod(c: Column, m: int) -> Column:
    return c % F.lit(m)


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """Sensor readings derived from an ``events`` frame (columns event_id, user_id, ts)."""
    eid = F.col("event_id")
    u = [(_mod(eid * F.lit(a) + F.lit(b), m)) / F.lit(float(m)) for a, b, m in UNIFORM_STREAMS]
    tk = _mod(eid * F.lit(31) + F.lit(7), 10)
    base = events.select(
        eid.alias("unit_id"), F.col("user_id").alias("machine_id"), F.col("ts"), eid,
        *[x.alias(f"u{i + 1}") for i, x in enumerate(u)], tk.alias("tk"))
    s = base.select(
        "*",
        F.when(F.col("tk") < 6, "L").when(F.col("tk") < 9, "M").otherwise("H").alias("type"),
        (F.lit(295.3) + F.lit(9.2) * F.col("u3")).alias("air_temp_k"),
        (F.lit(15.0) + F.lit(50.0) * (F.col("u1") + F.col("u5")) / F.lit(2)).alias("torque_nm"),
        F.when(_mod(eid, ZERO_WEAR_MOD) == 0, F.lit(0.0))
         .otherwise(F.lit(250.0) * F.col("u4")).alias("tool_wear_min"))
    r = s.select(
        "*",
        F.when(_mod(eid, NEG_GAP_MOD) == 0, F.col("air_temp_k") - F.lit(1.0))
         .otherwise(F.col("air_temp_k") + F.lit(6.6) + F.lit(5.2) * (F.col("u2") + F.col("u6")) / F.lit(2))
         .alias("process_temp_k"),
        (F.lit(1180.0) + (F.lit(65.0) - F.col("torque_nm")) * F.lit(11)
         + F.lit(300.0) * F.col("u2") * F.col("u6")).alias("rpm"))
    f = r.select(
        "*",
        mechanical_power("rpm", "torque_nm").alias("true_power"),
        thermal_gap("process_temp_k", "air_temp_k").alias("temp_diff_k"),
        tool_strain("tool_wear_min", "torque_nm").alias("true_strain"))
    osf_limit = F.when(F.col("type") == "L", 12000).when(F.col("type") == "M", 12500).otherwise(13000)
    lab = f.select(
        "*",
        F.when(_mod(eid, POWER_X_MOD) == 0, F.lit(1.4) * F.col("true_power"))
         .otherwise(F.col("true_power")).alias("power_w"),
        F.when(_mod(eid, STRAIN_X_MOD) == 0, F.lit(3.0) * F.col("true_strain"))
         .otherwise(F.col("true_strain")).alias("strain_load"),
        ((F.col("tool_wear_min") >= 200) & (F.col("tool_wear_min") <= 240) & (F.col("u5") < 0.05))
        .cast("int").alias("twf"),
        ((F.col("temp_diff_k") < 7.4) & (F.col("rpm") < 1450)).cast("int").alias("hdf"),
        ((F.col("true_power") < 3200) | (F.col("true_power") > 9200)).cast("int").alias("pwf"),
        (F.col("true_strain") > osf_limit).cast("int").alias("osf"),
        (_mod(eid, RANDOM_FLAG_MOD) == 0).cast("int").alias("rnf"))
    failed = ((F.col("twf") + F.col("hdf") + F.col("pwf") + F.col("osf")) > 0) | (_mod(eid, NO_SUBTYPE_MOD) == 0)
    return lab.select(
        "unit_id",
        F.concat(F.col("type"), F.col("unit_id").cast("string")).alias("product_id"),
        "machine_id", "ts", "type", "air_temp_k", "process_temp_k", "rpm", "torque_nm",
        "tool_wear_min", "power_w", "temp_diff_k", "strain_load",
        failed.cast("int").alias("machine_failure"), "twf", "hdf", "pwf", "osf", "rnf")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical telemetry table for a scale-factor directory."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return telemetry_from_events(events)


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as an uploaded CSV would arrive: sensors as text, some unparsable."""
    t = telemetry(spark, sf_dir)
    uid = F.col("unit_id")
    cols = []
    for c in t.columns:
        if c in SENSOR_COLS:
            v = F.col(c).cast("string")
            if c == "torque_nm":
                v = F.when(_mod(uid, BAD_TORQUE_MOD) == 0, F.lit("bad")).otherwise(v)
            cols.append(v.alias(c))
        elif c == "type":
            cols.append(F.when(_mod(uid, BAD_TYPE_MOD) == 0, F.lit("X")).otherwise(F.col("type")).alias("type"))
        else:
            cols.append(F.col(c))
    return t.select(*cols)


def read_sensor_csv(spark: SparkSession, path: str, schema=RAW_CSV_SCHEMA) -> DataFrame:
    """Read a sensor CSV with header and an explicit all-string schema, canonical names."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return to_canonical(df)


#: Column of the text of a line that does not fit the schema.
CORRUPT = "_corrupt_record"


def checked_sensor_csv(spark: SparkSession, path: str, schema=RAW_CSV_SCHEMA, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with typed sensors, quarantine) of a sensor CSV.

    The quarantine keeps every column as text with a ``reason``: a line with too
    few or too many fields, sensors that are missing, no number or not finite,
    and unknown types. Both come from one scan's schema; no row is lost.
    """
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(whole).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    df = to_canonical(reader.option("columnPruning", False).csv(path))  # whole lines, or a short one goes unseen
    reasons = []
    for c in SENSOR_COLS:
        value = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        reasons.append(F.when(F.col(c).isNull(), F.lit(f"missing {c}")).when(value.isNull() | F.isnan(value), F.lit(f"no number in {c}"))
                       .when(F.abs(value) == float("inf"), F.lit(f"not finite: {c}")))
    reasons.append(F.when(~F.coalesce(F.col("type").isin(list(TYPE_CODES)), F.lit(False)), F.lit("unknown type")))
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed line")).otherwise(F.concat_ws("; ", *reasons))
    df = df.withColumn("reason", reason)
    accepted = df.filter("reason = ''").drop("reason", CORRUPT).withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in SENSOR_COLS})
    return accepted, df.filter("reason <> ''").withColumnRenamed(CORRUPT, "line")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> str:
    """Write a feature / split / resampled table (parquet by default, CSV with header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def to_source_layout(df: DataFrame) -> DataFrame:
    """Canonical frame -> the original CSV layout (source column names, every value as text)."""
    out = []
    for src, dst in SOURCE_COLUMNS.items():
        if dst in df.columns and src in RAW_CSV_SCHEMA.fieldNames():
            out.append(F.col(dst).cast("string").alias(src))
    return df.select(*out)
