"""Scenario queries (H1-H6, W2-W4) over the whole fleet, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import sampling as sm
from faultline.operators import scenario as sc
from faultline.operators import guard as gd
from faultline.operators.rules import heat_rule, overstrain_rule
from faultline.plans.fixture import SPLIT_SQL, with_fixture
from faultline.plans.q_guard import _FIT_SQL, _L1_SQL, _L2_SQL
from faultline.plans.registry import query
from faultline.schema import GUARD_FEATURES
from faultline.sources.telemetry import telemetry

TC = sc.TRAJ_COLS
STEPS = sc.DEFAULT_STEPS


def _d(v):
    return "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v!r} AS DOUBLE)"


def presets_sql(drifts) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{d.name}', {_d(d.wear_rate)}, {_d(d.gap_rate)}, {_d(d.gap_floor)}, {_d(d.power_growth)}, "
        f"{_d(d.strain_growth)}, {_d(d.rpm_growth)}, {_d(d.torque_growth)}, {str(d.power_from_physics).upper()})"
        for d in drifts) + ") AS p(name, wear_rate, gap_rate, gap_floor, power_growth, strain_growth, " \
                           "rpm_growth, torque_growth, power_from_physics)"


PRESETS_SQL = presets_sql(sc.PRESETS)
USER_DRIFT = sc.custom_drift(2.0, 0.8, 3.0, 1.5, 1.0, -1.0, name="user")

START_SQL = ("SELECT machine_id, unit_id AS start_unit_id, " + ", ".join(TC) + " FROM (SELECT *, row_number() "
             "OVER (PARTITION BY machine_id ORDER BY ts DESC, unit_id DESC) AS rn FROM telemetry) z WHERE rn = 1")


def _grow(c, g):
    return f"(s.{c} * pow(1.0 + p.{g}, CAST(st.step AS DOUBLE)))"


_GAP_LIN = "(s.temp_diff_k - p.gap_rate * CAST(st.step AS DOUBLE))"


def traj_sql(steps: int) -> str:
    return f"""
SELECT s.machine_id, s.start_unit_id, p.name AS scenario, st.step,
  {_grow('rpm', 'rpm_growth')} AS rpm, {_grow('torque_nm', 'torque_growth')} AS torque_nm,
  s.tool_wear_min + p.wear_rate * CAST(st.step AS DOUBLE) AS tool_wear_min,
  CASE WHEN p.power_from_physics AND st.step > 0
       THEN {_grow('rpm', 'rpm_growth')} * {_grow('torque_nm', 'torque_growth')} * 2 * pi() / 60
       ELSE {_grow('power_w', 'power_growth')} END AS power_w,
  CASE WHEN st.step = 0 THEN s.temp_diff_k WHEN p.gap_floor IS NULL THEN {_GAP_LIN}
       ELSE greatest({_GAP_LIN}, p.gap_floor) END AS temp_diff_k,
  {_grow('strain_load', 'strain_growth')} AS strain_load
FROM start s CROSS JOIN presets p CROSS JOIN (SELECT CAST(unnest(range(0, {steps})) AS INTEGER) AS step) st"""


TRAJ_SQL = traj_sql(STEPS)

_RULE_SQL = ("COALESCE(temp_diff_k < 7, FALSE) OR COALESCE((tool_wear_min > 200 AND torque_nm > 45) OR "
             "(tool_wear_min > 180 AND strain_load > 11000), FALSE)")
SCEN_CTES = [("start", START_SQL), ("presets", PRESETS_SQL), ("traj", TRAJ_SQL), ("fit", _FIT_SQL),
             ("tscored", f"SELECT t.*, ({_L1_SQL}) AS l1_stats, ({_L2_SQL}) AS l2_physics, ({_RULE_SQL}) AS "
                         f"rule_alert FROM traj t, fit"),
             ("alerts", "SELECT *, l1_stats OR l2_physics OR rule_alert AS alert FROM tscored")]


def trajectories(spark, sf, steps=STEPS):
    t = telemetry(spark, sf)
    return t, sc.project(sc.latest_state(t), sc.PRESETS, steps)


def scored_trajectories(spark, sf):
    """Every projected step scored by the guard (fit on healthy telemetry) and the rules."""
    t, traj = trajectories(spark, sf)
    m = gd.fit_guard(t)
    s = m.transform(traj)
    rule = heat_rule(traj.columns) | overstrain_rule(traj.columns)
    return s.withColumns({"rule_alert": rule, "alert": F.col("anomaly") | rule})


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("latest_state", with_fixture("SELECT * FROM start", ("start", START_SQL)))
def q_latest_state(spark, sf):
    return sc.latest_state(telemetry(spark, sf))


@query("latest_readings", with_fixture(
    "SELECT machine_id, unit_id, recency_rank FROM (SELECT machine_id, unit_id, row_number() OVER "
    "(PARTITION BY machine_id ORDER BY ts DESC, unit_id DESC) AS recency_rank FROM telemetry) z "
    "WHERE recency_rank <= 5"))
def q_latest_readings(spark, sf):
    """Keep the latest 5 readings per machine (salted two-phase top-k)."""
    t = telemetry(spark, sf).select("machine_id", "unit_id", "ts")
    return sc.latest_k(t, 5).select("machine_id", "unit_id", "recency_rank")


@query("drift_trajectories", with_fixture(
    "SELECT machine_id, start_unit_id, scenario, step, " + ", ".join(f"round({c}, 6) AS {c}" for c in TC)
    + " FROM traj", *SCEN_CTES[:3]))
def q_drift_trajectories(spark, sf):
    _, traj = trajectories(spark, sf)
    return traj.select("machine_id", "start_unit_id", "scenario", "step", *_r6(TC))


@query("custom_drift", with_fixture(
    "SELECT machine_id, scenario, step, " + ", ".join(f"round({c}, 6) AS {c}" for c in TC) + " FROM traj",
    ("start", START_SQL), ("presets", presets_sql([USER_DRIFT])), ("traj", traj_sql(30))))
def q_custom_drift(spark, sf):
    """User-rate drift (wear +2/step, gap -0.8 floored 0.5, power +3 %, strain +1.5 %, rpm +1 %, torque -1 %)."""
    t = telemetry(spark, sf)
    traj = sc.project(sc.latest_state(t), [USER_DRIFT], 30)
    return traj.select("machine_id", "scenario", "step", *_r6(TC))


@query("drift_scored", with_fixture(
    "SELECT machine_id, scenario, step, l1_stats, l2_physics, rule_alert, alert FROM alerts", *SCEN_CTES))
def q_drift_scored(spark, sf):
    return scored_trajectories(spark, sf).select("machine_id", "scenario", "step", "l1_stats", "l2_physics",
                                                 "rule_alert", "alert")


@query("drift_run_summary", with_fixture(
    "SELECT machine_id, scenario, min(CASE WHEN alert THEN step END) AS first_alert_step, "
    "count(CASE WHEN alert THEN 1 END) AS n_alert_steps, count(*) AS n_steps FROM alerts GROUP BY 1, 2",
    *SCEN_CTES))
def q_drift_run_summary(spark, sf):
    return sc.run_summary(scored_trajectories(spark, sf), "alert")


@query("drift_compare", with_fixture(
    "SELECT step, " + ", ".join(
        f"round(avg(CASE WHEN scenario = '{d.name}' THEN (CASE WHEN alert THEN 1.0 ELSE 0.0 END) END), 6) "
        f"AS {d.name}" for d in sc.PRESETS) + " FROM alerts GROUP BY step", *SCEN_CTES))
def q_drift_compare(spark, sf):
    """Alert share of the fleet per step, one column per scenario."""
    s = scored_trajectories(spark, sf)
    v = F.round(F.avg(F.when(F.col("alert"), 1.0).otherwise(0.0)), 6)
    return sc.compare_runs(s, v, [d.name for d in sc.PRESETS])


@query("drift_step_pairs", with_fixture(
    "SELECT machine_id, scenario, step, round(power_w, 6) AS power_w, round(prev_power_w, 6) AS prev_power_w, "
    "round(temp_diff_k, 6) AS temp_diff_k, round(prev_temp_diff_k, 6) AS prev_temp_diff_k FROM (SELECT *, "
    "lag(power_w) OVER w AS prev_power_w, lag(temp_diff_k) OVER w AS prev_temp_diff_k FROM traj "
    "WINDOW w AS (PARTITION BY machine_id, scenario ORDER BY step)) z WHERE step > 0", *SCEN_CTES[:3]))
def q_drift_step_pairs(spark, sf):
    _, traj = trajectories(spark, sf)
    p = sc.step_pairs(traj, ("power_w", "temp_diff_k"))
    return p.select("machine_id", "scenario", "step",
                    *_r6(["power_w", "prev_power_w", "temp_diff_k", "prev_temp_diff_k"]))


_CASES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, CAST({w} AS DOUBLE), CAST({t} AS DOUBLE), CAST({s} AS DOUBLE))"
    for i, (w, t, s) in enumerate(sc.STRESS_CASES)) + ") AS c(case_id, wear, torque, strain)"

_GRID_SQL = """
SELECT b.*, c.case_id, c.wear AS tool_wear_min, c.torque AS torque_nm, c.strain AS strain_load
FROM base b CROSS JOIN cases c"""


@query("stress_grid", with_fixture(
    "SELECT case_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in GUARD_FEATURES)
    + f", ({_RULE_SQL}) AS rule_alert, ({_L1_SQL}) AS l1_stats, ({_L2_SQL}) AS l2_physics FROM grid, fit",
    ("split", SPLIT_SQL),
    ("base", "SELECT avg(rpm) AS rpm, avg(power_w) AS power_w, avg(temp_diff_k) AS temp_diff_k FROM split "
             "WHERE is_test"),
    ("cases", _CASES_SQL), ("grid", _GRID_SQL), ("fit", _FIT_SQL)))
def q_stress_grid(spark, sf):
    """Test-population mean row x stress cases, scored by rules and guard."""
    t = telemetry(spark, sf)
    test = sm.train_test(t)[1]
    base = test.agg(*[F.avg(c).alias(c) for c in ("rpm", "power_w", "temp_diff_k")]) \
        .withColumns({c: F.lit(None).cast("double") for c in ("tool_wear_min", "torque_nm", "strain_load")})
    grid = sc.stress_grid(base)
    m = gd.fit_guard(t)
    s = m.transform(grid)
    rule = heat_rule(grid.columns) | overstrain_rule(grid.columns)
    return s.select("case_id", *_r6(GUARD_FEATURES), rule.alias("rule_alert"), "l1_stats", "l2_physics")


@query("stress_grid_fleet", with_fixture(
    "SELECT machine_id, case_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in GUARD_FEATURES)
    + f", ({_RULE_SQL}) AS rule_alert, ({_L1_SQL}) AS l1_stats, ({_L2_SQL}) AS l2_physics FROM grid, fit",
    ("start", START_SQL),
    ("base", "SELECT machine_id, rpm, power_w, temp_diff_k FROM start"),
    ("cases", _CASES_SQL), ("grid", _GRID_SQL), ("fit", _FIT_SQL)))
def q_stress_grid_fleet(spark, sf):
    """Every machine's latest state x stress cases, scored by rules and guard."""
    t = telemetry(spark, sf)
    grid = sc.stress_grid(sc.latest_state(t))
    m = gd.fit_guard(t)
    s = m.transform(grid)
    rule = heat_rule(grid.columns) | overstrain_rule(grid.columns)
    return s.select("machine_id", "case_id", *_r6(GUARD_FEATURES), rule.alias("rule_alert"),
                    "l1_stats", "l2_physics")

