"""Sources, cleaning, physics features, labels (A, B, J operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import features as fe
from faultline.plans.fixture import TELEMETRY_RAW_SQL, with_fixture
from faultline.plans.registry import (FAILURE_CODE_SQL, FAILURE_DIM_SQL, FAILURE_NAME_SQL, TYPE_CODE_SQL,
                                      query)
from faultline.schema import MODEL_FEATURES, SENSOR_COLS
from faultline.session import scratch_path
from faultline.sources.telemetry import (checked_sensor_csv, read_sensor_csv, telemetry, telemetry_raw, to_source_layout,
                                         write_table)

_SENSORS_SQL = ", ".join(f"COALESCE(TRY_CAST({c} AS DOUBLE), 0) AS {c}" for c in SENSOR_COLS)


@query("telemetry", with_fixture("SELECT * FROM telemetry"))
def q_telemetry(spark, sf):
    return telemetry(spark, sf)


@query("coerce_raw", with_fixture(
    f"SELECT unit_id, {_SENSORS_SQL}, {TYPE_CODE_SQL} AS type_encoded FROM raw",
    ("raw", TELEMETRY_RAW_SQL)))
def q_coerce_raw(spark, sf):
    df = fe.coerce_numeric(telemetry_raw(spark, sf))
    df = fe.fill_missing(df, SENSOR_COLS, 0.0)
    df = fe.encode_type(df)
    return df.select("unit_id", *SENSOR_COLS, "type_encoded")


@query("unparsable_counts", with_fixture(
    "SELECT " + ", ".join(f"count(*) - count(TRY_CAST({c} AS DOUBLE)) AS bad_{c}" for c in SENSOR_COLS)
    + f", count(*) - count({TYPE_CODE_SQL}) AS bad_type FROM raw",
    ("raw", TELEMETRY_RAW_SQL)))
def q_unparsable_counts(spark, sf):
    df = fe.encode_type(fe.coerce_numeric(telemetry_raw(spark, sf)))
    return df.agg(*[(F.count(F.lit(1)) - F.count(c)).alias(f"bad_{c}") for c in SENSOR_COLS],
                  (F.count(F.lit(1)) - F.count("type_encoded")).alias("bad_type"))


@query("physics_features", with_fixture(
    "SELECT unit_id, 2 * pi() * rpm * torque_nm / 60 AS power_w, process_temp_k - air_temp_k AS temp_diff_k, "
    "tool_wear_min * torque_nm AS strain_load FROM telemetry"))
def q_physics_features(spark, sf):
    return fe.add_physics(telemetry(spark, sf)).select("unit_id", "power_w", "temp_diff_k", "strain_load")


@query("type_codes", with_fixture(
    f"SELECT unit_id, type, {TYPE_CODE_SQL} AS type_encoded FROM raw", ("raw", TELEMETRY_RAW_SQL)))
def q_type_codes(spark, sf):
    return fe.encode_type(telemetry_raw(spark, sf)).select("unit_id", "type", "type_encoded")


@query("aligned_features", with_fixture(
    "SELECT unit_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_FEATURES[:-1])
    + ", CAST(0 AS DOUBLE) AS type_encoded FROM telemetry"))
def q_aligned_features(spark, sf):
    # telemetry carries no type_encoded column: alignment adds it as 0, in model order
    return fe.align_to(telemetry(spark, sf), MODEL_FEATURES)


@query("healthy_rows", with_fixture(
    "SELECT unit_id, type, rpm, torque_nm, tool_wear_min FROM telemetry WHERE machine_failure = 0"))
def q_healthy_rows(spark, sf):
    return fe.healthy(telemetry(spark, sf)).select("unit_id", "type", "rpm", "torque_nm", "tool_wear_min")


@query("failure_codes", with_fixture(
    f"SELECT unit_id, {FAILURE_CODE_SQL} AS failure_type FROM telemetry "
    "WHERE machine_failure = 1 AND twf + hdf + pwf + osf + rnf > 0"))
def q_failure_codes(spark, sf):
    return fe.with_failure_code(fe.labelled_failures(telemetry(spark, sf))).select("unit_id", "failure_type")


@query("failure_names", with_fixture(f"SELECT unit_id, {FAILURE_NAME_SQL} AS failure_type FROM telemetry"))
def q_failure_names(spark, sf):
    return fe.with_failure_name(telemetry(spark, sf)).select("unit_id", "failure_type")


@query("failure_type_lookup", with_fixture(
    f"SELECT f.unit_id, f.failure_type, d.name, d.description FROM (SELECT unit_id, {FAILURE_CODE_SQL} AS "
    "failure_type FROM telemetry WHERE machine_failure = 1 AND twf + hdf + pwf + osf + rnf > 0) f "
    "LEFT JOIN dim d ON f.failure_type = d.code", ("dim", FAILURE_DIM_SQL)))
def q_failure_type_lookup(spark, sf):
    codes = fe.with_failure_code(fe.labelled_failures(telemetry(spark, sf))).select("unit_id", "failure_type")
    return fe.describe_type(codes)


@query("exclude_types", with_fixture(
    f"SELECT unit_id, failure_type FROM (SELECT unit_id, {FAILURE_NAME_SQL} AS failure_type FROM telemetry) z "
    "WHERE failure_type NOT IN ('PWF', 'NoLabel')"))
def q_exclude_types(spark, sf):
    named = fe.with_failure_name(telemetry(spark, sf)).select("unit_id", "failure_type")
    return fe.exclude_values(named, "failure_type", ["PWF", "NoLabel"])


@query("overstrain_subset", with_fixture(
    "SELECT unit_id, tool_wear_min, torque_nm, strain_load, machine_failure FROM telemetry "
    "WHERE tool_wear_min > 170 AND torque_nm > 46 AND strain_load > 11000"))
def q_overstrain_subset(spark, sf):
    return fe.overstrain_like(telemetry(spark, sf)).select(
        "unit_id", "tool_wear_min", "torque_nm", "strain_load", "machine_failure")


@query("labels_with_features", with_fixture(
    "SELECT p.unit_id, p.power_w, p.temp_diff_k, p.strain_load, l.machine_failure, l.failure_type FROM "
    "(SELECT unit_id, 2 * pi() * rpm * torque_nm / 60 AS power_w, process_temp_k - air_temp_k AS temp_diff_k, "
    "tool_wear_min * torque_nm AS strain_load FROM telemetry) p JOIN "
    f"(SELECT unit_id, machine_failure, {FAILURE_NAME_SQL} AS failure_type FROM telemetry) l "
    "ON p.unit_id = l.unit_id"))
def q_labels_with_features(spark, sf):
    """Keyed join of a feature table with a label table (positional alignment re-expressed)."""
    t = telemetry(spark, sf)
    feats = fe.add_physics(t).select("unit_id", "power_w", "temp_diff_k", "strain_load")
    labs = fe.with_failure_name(t).select("unit_id", "machine_failure", "failure_type")
    return feats.join(labs, "unit_id", "inner")


@query("healthy_failed_union", with_fixture(
    "SELECT unit_id, machine_failure, 'healthy' AS part FROM telemetry WHERE machine_failure = 0 "
    "UNION ALL SELECT unit_id, machine_failure, 'failed' AS part FROM telemetry WHERE machine_failure = 1"))
def q_healthy_failed_union(spark, sf):
    t = telemetry(spark, sf).select("unit_id", "machine_failure")
    return (fe.healthy(t).withColumn("part", F.lit("healthy"))
            .unionByName(fe.failed(t).withColumn("part", F.lit("failed"))))


@query("csv_batch_features", with_fixture(
    f"SELECT unit_id, {TYPE_CODE_SQL} AS type_encoded, 2 * pi() * rpm * torque_nm / 60 AS power_w, "
    "process_temp_k - air_temp_k AS temp_diff_k, tool_wear_min * torque_nm AS strain_load, machine_failure, "
    "twf + hdf + pwf + osf + rnf AS n_flags FROM telemetry"))
def q_csv_batch_features(spark, sf):
    """Telemetry written as the original CSV (text, source names), read back with an explicit schema."""
    path = write_table(to_source_layout(telemetry(spark, sf)), scratch_path(spark, "csv-batch"), fmt="csv")
    df = fe.prepare_features(read_sensor_csv(spark, path))
    return df.select("unit_id", "type_encoded", "power_w", "temp_diff_k", "strain_load", "machine_failure",
                     (F.col("twf") + F.col("hdf") + F.col("pwf") + F.col("osf") + F.col("rnf")).alias("n_flags"))


def _uploaded(spark, sf) -> str:
    """Telemetry as an upload: bad sensor values and types, lines cut off in the middle, an empty and an infinite value."""
    raw = telemetry_raw(spark, sf)
    uid = F.col("unit_id")
    raw = raw.withColumn("rpm", F.when(uid % 809 == 0, F.lit("Infinity")).otherwise(F.col("rpm"))).withColumn("air_temp_k", F.when(uid % 613 == 0, F.lit("")).otherwise(F.col("air_temp_k")))
    source = to_source_layout(raw)
    half = F.concat_ws(",", *[F.col(f"`{c}`") for c in source.columns[:4]])
    line = F.when(F.col("`UDI`").cast("long") % 701 == 0, half).otherwise(F.concat_ws(",", *[F.col(f"`{c}`") for c in source.columns]))
    path = scratch_path(spark, "upload")
    source.select(line.alias("value")).write.text(path)
    return path


_UPLOAD_CTES = [("raw", TELEMETRY_RAW_SQL), ("upload", "SELECT * REPLACE (CASE WHEN unit_id % 809 = 0 THEN 'Infinity' ELSE rpm END AS rpm, "
                "CASE WHEN unit_id % 613 = 0 THEN NULL ELSE air_temp_k END AS air_temp_k) FROM raw"),
                ("judged", "SELECT *, CASE WHEN unit_id % 701 = 0 THEN 'malformed line' ELSE concat_ws('; ', " + ", ".join(
                    f"CASE WHEN {c} IS NULL THEN 'missing {c}' WHEN TRY_CAST({c} AS DOUBLE) IS NULL OR isnan(TRY_CAST({c} AS DOUBLE)) THEN 'no number in {c}' "
                    f"WHEN isinf(TRY_CAST({c} AS DOUBLE)) THEN 'not finite: {c}' END" for c in SENSOR_COLS)
                 + ", CASE WHEN type NOT IN ('L', 'M', 'H') THEN 'unknown type' END) END AS reason FROM upload")]


@query("csv_quarantine", with_fixture("SELECT unit_id, reason FROM judged WHERE reason <> ''", *_UPLOAD_CTES))
def q_csv_quarantine(spark, sf):
    """Rows of an uploaded CSV that cannot be scored, each with the reason."""
    rejected = checked_sensor_csv(spark, _uploaded(spark, sf), header=False)[1]
    return rejected.select(F.col("unit_id").cast("long").alias("unit_id"), "reason")


@query("csv_accepted", with_fixture(
    "SELECT unit_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SENSOR_COLS) + f", {TYPE_CODE_SQL} AS type_encoded FROM judged WHERE reason = ''", *_UPLOAD_CTES))
def q_csv_accepted(spark, sf):
    """The rest of that upload, with numeric sensors."""
    accepted = fe.encode_type(checked_sensor_csv(spark, _uploaded(spark, sf), header=False)[0])
    return accepted.select(F.col("unit_id").cast("long").alias("unit_id"), *SENSOR_COLS, "type_encoded")
