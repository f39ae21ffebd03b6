"""Closed-form drift equals the step-by-step simulation; stress grid and top-k shapes."""
import math

from faultline.operators import scenario as sc


def _simulate(x, d, steps):
    out = [dict(x)]
    for _ in range(1, steps):
        p = dict(out[-1])
        p["tool_wear_min"] += d.wear_rate
        p["temp_diff_k"] -= d.gap_rate
        if d.gap_floor is not None:
            p["temp_diff_k"] = max(p["temp_diff_k"], d.gap_floor)
        p["rpm"] *= 1 + d.rpm_growth
        p["torque_nm"] *= 1 + d.torque_growth
        p["power_w"] = (p["rpm"] * p["torque_nm"] * 2 * math.pi / 60 if d.power_from_physics
                        else p["power_w"] * (1 + d.power_growth))
        p["strain_load"] *= 1 + d.strain_growth
        out.append(p)
    return out


def test_closed_form(spark):
    start = {"rpm": 1500.0, "torque_nm": 40.0, "tool_wear_min": 100.0, "power_w": 6283.0,
             "temp_diff_k": 3.0, "strain_load": 4000.0}
    df = spark.createDataFrame([(7, *start.values())], "machine_id LONG, " + ", ".join(
        f"{k} DOUBLE" for k in start))
    drifts = sc.PRESETS + [sc.custom_drift(2.0, 0.8, 3.0, 1.5, 1.0, -1.0, name="user")]
    got = {(r.scenario, r.step): r for r in sc.project(df, drifts, 20).collect()}
    for d in drifts:
        for i, exp in enumerate(_simulate(start, d, 20)):
            r = got[(d.name, i)]
            for k, v in exp.items():
                assert math.isclose(r[k], v, rel_tol=1e-9, abs_tol=1e-9), (d.name, i, k)


def test_latest_k(spark):
    rows = [(m, u, u * 10) for m in (1, 2) for u in range(m * 100, m * 100 + 40)]
    df = spark.createDataFrame(rows, "machine_id LONG, unit_id LONG, ts LONG")
    got = sc.latest_k(df, 5, salts=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.machine_id, []).append((r.recency_rank, r.unit_id))
    assert sorted(by[1]) == [(i + 1, 139 - i) for i in range(5)]
    assert sorted(by[2]) == [(i + 1, 239 - i) for i in range(5)]


def test_stress_grid(spark):
    base = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "rpm DOUBLE, tool_wear_min DOUBLE, torque_nm DOUBLE, "
                                                         "strain_load DOUBLE")
    g = sc.stress_grid(base).orderBy("case_id").collect()
    assert [(r.tool_wear_min, r.torque_nm, r.strain_load, r.rpm) for r in g][0] == (172.0, 46.0, 11000.0, 1.0)
    assert len(g) == 5
