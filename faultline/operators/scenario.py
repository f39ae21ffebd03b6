"""What-if scenarios: stress grids and drift projections for the whole fleet.

Starting points are per-machine states (the latest reading of every machine,
found with a partial-aggregating ``max_by`` — a machine holding a third of
all rows is still reduced map-side). Trajectories are generated with
``explode`` of literal arrays (scenarios) and ``sequence`` (steps): narrow
operators, no join and no shuffle. Each step has a closed form, so no
iteration over steps is needed:

    additive      x_i = x_0 + r * i
    multiplicative x_i = x_0 * (1 + g)^i
    floored decay  x_i = x_0 (i = 0), max(x_0 - r * i, floor) (i > 0, r >= 0)

Per-run windows (step-over-step pairs, first failing step) partition by
(machine, scenario): every partition has exactly ``steps`` rows.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions.draws import hash60

TRAJ_COLS = ["rpm", "torque_nm", "tool_wear_min", "power_w", "temp_diff_k", "strain_load"]


@dataclass(frozen=True)
class Drift:
    """Per-step drift of the operating point (growth values are fractions per step)."""

    name: str
    wear_rate: float = 0.0
    gap_rate: float = 0.0
    gap_floor: float | None = None
    power_growth: float = 0.0
    strain_growth: float = 0.0
    rpm_growth: float = 0.0
    torque_growth: float = 0.0
    power_from_physics: bool = False


# Fixed preset rates (midpoints of the original simulator's uniform ranges).
PRESETS = [
    Drift("tool_wear", wear_rate=5.0, gap_rate=0.25, power_growth=0.01, strain_growth=0.02),
    Drift("heat", gap_rate=0.65, gap_floor=1.0, power_growth=0.01),
    Drift("overload", rpm_growth=0.02, torque_growth=0.025, strain_growth=0.035, power_from_physics=True),
    Drift("custom", wear_rate=3.0, gap_rate=0.5, gap_floor=0.5, power_growth=0.02, strain_growth=0.02),
]
DEFAULT_STEPS = 20

# Fixed stress cases (wear, torque, strain overrides on the population mean).
STRESS_CASES = [
    (172.0, 46.0, 11000.0),
    (190.0, 52.0, 11500.0),
    (200.0, 55.0, 11800.0),
    (210.0, 60.0, 12500.0),
    (230.0, 70.0, 15000.0),
]


def custom_drift(wear_rate=3.0, temp_decay=0.5, power_pct=2.0, strain_pct=2.0, speed_pct=0.0,
                 torque_pct=0.0, name="custom") -> Drift:
    """User rates in the dashboard's units (percent per step for growth)."""
    if wear_rate < 0 or temp_decay < 0:
        raise ValueError("wear and temperature-decay rates must be >= 0")
    return Drift(name, wear_rate=wear_rate, gap_rate=temp_decay, gap_floor=0.5, power_growth=power_pct / 100,
                 strain_growth=strain_pct / 100, rpm_growth=speed_pct / 100, torque_growth=torque_pct / 100)


def latest_state(df: DataFrame, group: str = "machine_id", order=("ts", "unit_id"), cols=TRAJ_COLS) -> DataFrame:
    """Latest reading per machine (``max_by`` aggregates partially on the map side)."""
    row = F.max_by(F.struct(F.col("unit_id").alias("start_unit_id"), *[F.col(c) for c in cols]),
                   F.struct(*[F.col(o) for o in order]))
    return df.groupBy(group).agg(row.alias("_s")).select(group, "_s.*")


def latest_k(df: DataFrame, k: int = 5, group: str = "machine_id", order=("ts", "unit_id"),
             salts: int = 16, key: str = "unit_id") -> DataFrame:
    """Top-k latest rows per group in two phases (salted, then merged): a hot group is split.

    Phase 1 keeps k rows per (group, salt); phase 2 ranks at most k*salts rows per group.
    """
    desc = [F.col(o).desc() for o in order]
    salted = df.withColumn("_salt", hash60(F.col(key), "salt") % F.lit(salts))
    w1 = Window.partitionBy(group, "_salt").orderBy(*desc)
    pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(group).orderBy(*desc)
    return (pre.withColumn("recency_rank", F.row_number().over(w2).cast("bigint"))
            .filter(F.col("recency_rank") <= k))


def _drift_struct(d: Drift) -> Column:
    v = asdict(d)
    return F.struct(*[(F.lit(v[k]).cast("double") if k not in ("name", "power_from_physics") else F.lit(v[k]))
                      .alias(k) for k in v])


def project(start: DataFrame, drifts=PRESETS, steps: int = DEFAULT_STEPS) -> DataFrame:
    """Trajectory rows (…, scenario, step, rpm, torque_nm, tool_wear_min, power_w, temp_diff_k, strain_load)."""
    if steps < 1:
        raise ValueError("a trajectory has at least one step")
    for d in drifts:
        if d.wear_rate < 0 or d.gap_rate < 0:
            raise ValueError("closed form needs non-negative wear and gap rates")
    keys = [c for c in start.columns if c not in TRAJ_COLS]
    x = start.select(*keys, *[F.col(c).alias(f"{c}_0") for c in TRAJ_COLS],
                     F.explode(F.array(*[_drift_struct(d) for d in drifts])).alias("d"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    i = F.col("step")
    di = i.cast("double")

    def grow(c, g):
        return F.col(f"{c}_0") * F.pow(F.lit(1.0) + F.col(f"d.{g}"), di)

    gap_lin = F.col("temp_diff_k_0") - F.col("d.gap_rate") * di
    gap = F.when(i == 0, F.col("temp_diff_k_0")).when(F.col("d.gap_floor").isNull(), gap_lin) \
        .otherwise(F.greatest(gap_lin, F.col("d.gap_floor")))
    rpm = grow("rpm", "rpm_growth")
    torque = grow("torque_nm", "torque_growth")
    power = F.when(F.col("d.power_from_physics") & (i > 0),
                   rpm * torque * F.lit(2) * F.pi() / F.lit(60)).otherwise(grow("power_w", "power_growth"))
    return x.select(*keys, F.col("d.name").alias("scenario"), "step",
                    rpm.alias("rpm"), torque.alias("torque_nm"),
                    (F.col("tool_wear_min_0") + F.col("d.wear_rate") * di).alias("tool_wear_min"),
                    power.alias("power_w"), gap.alias("temp_diff_k"),
                    grow("strain_load", "strain_growth").alias("strain_load"))


def stress_grid(base: DataFrame, cases=STRESS_CASES) -> DataFrame:
    """Every base row x every override case (wear, torque, strain replaced; others kept)."""
    arr = F.array(*[F.struct(F.lit(i).alias("case_id"), F.lit(w).alias("wear"), F.lit(t).alias("torque"),
                             F.lit(s).alias("strain")) for i, (w, t, s) in enumerate(cases)])
    x = base.select("*", F.explode(arr).alias("c"))
    return x.withColumns({"case_id": F.col("c.case_id"),
                          "tool_wear_min": F.coalesce(F.col("c.wear"), F.col("tool_wear_min")),
                          "torque_nm": F.coalesce(F.col("c.torque"), F.col("torque_nm")),
                          "strain_load": F.coalesce(F.col("c.strain"), F.col("strain_load"))}).drop("c")


def step_pairs(traj: DataFrame, cols=("power_w", "temp_diff_k", "strain_load", "tool_wear_min"),
               run=("machine_id", "scenario")) -> DataFrame:
    """(previous, current) values per step within each run (lag over step)."""
    w = Window.partitionBy(*run).orderBy("step")
    out = traj
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    return out.filter(F.col("step") > 0)


def run_summary(scored: DataFrame, flag: str = "alert", risk: str | None = None,
                run=("machine_id", "scenario")) -> DataFrame:
    """Per run: first flagged step, flagged steps; with a risk column start/peak/final risk."""
    aggs = [F.min(F.when(F.col(flag), F.col("step"))).alias("first_alert_step"),
            F.count(F.when(F.col(flag), 1)).alias("n_alert_steps"),
            F.count(F.lit(1)).alias("n_steps")]
    if risk:
        aggs += [F.min_by(F.col(risk), F.col("step")).alias("start_risk"), F.max(F.col(risk)).alias("peak_risk"),
                 F.max_by(F.col(risk), F.col("step")).alias("final_risk")]
    return scored.groupBy(*run).agg(*aggs)


def compare_runs(scored: DataFrame, value: Column, scenarios, name: str = "v") -> DataFrame:
    """One row per step, one column per scenario (pivot with explicit values: no extra pass)."""
    return (scored.groupBy("step").pivot("scenario", list(scenarios)).agg(value.alias(name))
            .select("step", *[F.col(s).alias(f"{s}") for s in scenarios]))
