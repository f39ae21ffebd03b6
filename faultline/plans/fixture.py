"""SQL text of the telemetry fixture and its variants (FIXTURES.md §3).

These strings are the *oracle side*: they run unchanged in DuckDB over the
driver's pre-registered ``events`` view. Each oracle query is
``WITH <fixture CTEs> SELECT ...``.
"""

TELEMETRY_SQL = """
WITH u AS (
  SELECT event_id AS unit_id, user_id AS machine_id, ts, event_id,
    ((event_id * 7919 + 104729)   % 10007) / CAST(10007 AS DOUBLE) AS u1,
    ((event_id * 6101 + 1299709)  % 10009) / CAST(10009 AS DOUBLE) AS u2,
    ((event_id * 4643 + 15485863) % 10037) / CAST(10037 AS DOUBLE) AS u3,
    ((event_id * 3571 + 32452843) % 10039) / CAST(10039 AS DOUBLE) AS u4,
    ((event_id * 2749 + 49979687) % 10061) / CAST(10061 AS DOUBLE) AS u5,
    ((event_id * 2221 + 67867967) % 10067) / CAST(10067 AS DOUBLE) AS u6,
    (event_id * 31 + 7) % 10 AS tk
  FROM events),
s AS (
  SELECT *,
    CASE WHEN tk < 6 THEN 'L' WHEN tk < 9 THEN 'M' ELSE 'H' END AS type,
    295.3 + 9.2 * u3 AS air_temp_k,
    15.0 + 50.0 * (u1 + u5) / 2 AS torque_nm,
    CASE WHEN event_id % 149 = 0 THEN CAST(0 AS DOUBLE) ELSE 250.0 * u4 END AS tool_wear_min
  FROM u),
r AS (
  SELECT *,
    CASE WHEN event_id % 503 = 0 THEN air_temp_k - 1.0 ELSE air_temp_k + 6.6 + 5.2 * (u2 + u6) / 2 END AS process_temp_k,
    1180.0 + (65.0 - torque_nm) * 11 + 300.0 * u2 * u6 AS rpm
  FROM s),
f AS (
  SELECT *,
    2 * pi() * rpm * torque_nm / 60 AS true_power,
    process_temp_k - air_temp_k AS temp_diff_k,
    tool_wear_min * torque_nm AS true_strain
  FROM r),
l AS (
  SELECT *,
    CASE WHEN event_id % 211 = 0 THEN 1.4 * true_power ELSE true_power END AS power_w,
    CASE WHEN event_id % 307 = 0 THEN 3.0 * true_strain ELSE true_strain END AS strain_load,
    CAST(tool_wear_min >= 200 AND tool_wear_min <= 240 AND u5 < 0.05 AS INT) AS twf,
    CAST(temp_diff_k < 7.4 AND rpm < 1450 AS INT) AS hdf,
    CAST(true_power < 3200 OR true_power > 9200 AS INT) AS pwf,
    CAST(true_strain > CASE type WHEN 'L' THEN 12000 WHEN 'M' THEN 12500 ELSE 13000 END AS INT) AS osf,
    CAST(event_id % 997 = 0 AS INT) AS rnf
  FROM f)
SELECT unit_id, concat(type, CAST(unit_id AS VARCHAR(20))) AS product_id, machine_id, ts, type,
  air_temp_k, process_temp_k, rpm, torque_nm, tool_wear_min, power_w, temp_diff_k, strain_load,
  CAST(twf + hdf + pwf + osf > 0 OR event_id % 1103 = 0 AS INT) AS machine_failure,
  twf, hdf, pwf, osf, rnf
FROM l
"""

TELEMETRY_RAW_SQL = """
SELECT unit_id, product_id, machine_id, ts,
  CASE WHEN unit_id % 599 = 0 THEN 'X' ELSE type END AS type,
  CAST(air_temp_k AS VARCHAR) AS air_temp_k, CAST(process_temp_k AS VARCHAR) AS process_temp_k,
  CAST(rpm AS VARCHAR) AS rpm,
  CASE WHEN unit_id % 401 = 0 THEN 'bad' ELSE CAST(torque_nm AS VARCHAR) END AS torque_nm,
  CAST(tool_wear_min AS VARCHAR) AS tool_wear_min,
  power_w, temp_diff_k, strain_load, machine_failure, twf, hdf, pwf, osf, rnf
FROM telemetry
"""

# Rule predictions (heat OR overstrain) — deterministic, so SQL-checkable.
TELEMETRY_PRED_SQL = """
SELECT *, CAST(temp_diff_k < 7
   OR (tool_wear_min > 200 AND torque_nm > 45)
   OR (tool_wear_min > 180 AND strain_load > 11000) AS INT) AS pred
FROM telemetry
"""

# Stratified 80/20 split: per-class md5 order, first round(0.2 n_c) are test.
SPLIT_SQL = """
SELECT *, CAST(rk <= round(0.2 * n_class) AS BOOLEAN) AS is_test FROM (
  SELECT *,
    row_number() OVER (PARTITION BY machine_failure
                       ORDER BY md5(concat(CAST(unit_id AS VARCHAR), '|42')), unit_id) AS rk,
    count(*) OVER (PARTITION BY machine_failure) AS n_class
  FROM telemetry) z
"""


def with_fixture(body: str, *extra: tuple[str, str]) -> str:
    """Prefix ``body`` with the telemetry CTE (+ optional named CTEs)."""
    ctes = [f"telemetry AS ({TELEMETRY_SQL})"]
    ctes += [f"{name} AS ({sql})" for name, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body
