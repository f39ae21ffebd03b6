"""Guard (D), rules (F9-F11) and metric (G) queries with oracles.

L1 + L2 are fit on the healthy rows of the whole telemetry table, exactly as
the original guard is trained; the SQL oracle fits the same statistics with
DuckDB aggregates and applies them with a cross join of the one-row fit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import guard as gd
from faultline.operators import metrics as mt
from faultline.operators.rules import heat_rule, overstrain_rule, rule_prediction
from faultline.plans.fixture import SPLIT_SQL, TELEMETRY_PRED_SQL, with_fixture
from faultline.plans.registry import query
from faultline.operators import sampling as sm
from faultline.schema import GUARD_FEATURES, LABEL
from faultline.sources.telemetry import telemetry

EXP_POWER = "(rpm * torque_nm * 2 * pi() / 60)"
EXP_STRAIN = "(torque_nm * tool_wear_min)"


def _nz(x):
    return f"(CASE WHEN {x} = 0 THEN 1e-10 ELSE {x} END)"


PR = f"(power_w / {_nz(EXP_POWER)})"
SR = f"(strain_load / {_nz(EXP_STRAIN)})"

_FIT_SQL = "SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN stddev_samp({f}) = 0 THEN 1e-10 ELSE stddev_samp({f}) END AS s_{f}, "
    f"min({f}) AS mn_{f}, max({f}) AS mx_{f}, quantile_cont({f}, 0.01) AS p01_{f}, "
    f"quantile_cont({f}, 0.99) AS p99_{f}" for f in GUARD_FEATURES) + (
    f", avg({PR}) AS pr_mean, stddev_samp({PR}) AS pr_std, avg({SR}) AS sr_mean, stddev_samp({SR}) AS sr_std "
    "FROM telemetry WHERE machine_failure = 0")

_L1_SQL = " OR ".join(
    f"COALESCE(abs(({f} - m_{f}) / s_{f}) > 3 OR {f} < p01_{f} - 1.5 * (p99_{f} - p01_{f}) "
    f"OR {f} > p99_{f} + 1.5 * (p99_{f} - p01_{f}), FALSE)" for f in GUARD_FEATURES)
_L2_SQL = " OR ".join(f"COALESCE({x}, FALSE)" for x in [
    f"abs({PR} - pr_mean) / greatest(pr_std, 0.01) > 3",
    f"abs(power_w - {EXP_POWER}) / {_nz(EXP_POWER)} > 0.25",
    f"abs({SR} - sr_mean) / greatest(sr_std, 0.01) > 4",
    "temp_diff_k < 0", "temp_diff_k > 25"])

SCORED_CTES = [("fit", _FIT_SQL),
               ("scored", f"SELECT t.*, ({_L1_SQL}) AS l1_stats, ({_L2_SQL}) AS l2_physics FROM telemetry t, fit"),
               ("verdicts", "SELECT *, l1_stats OR l2_physics AS anomaly FROM scored")]


def fitted(spark, sf):
    t = telemetry(spark, sf)
    return t, gd.fit_guard(t)


@query("guard_bounds", with_fixture("\nUNION ALL\n".join(
    f"SELECT {i} AS ordinal, '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std, mn_{f} AS min, "
    f"mx_{f} AS max, round(p01_{f}, 6) AS p01, round(p99_{f}, 6) AS p99, "
    f"round(p01_{f} - 1.5 * (p99_{f} - p01_{f}), 6) AS lo, round(p99_{f} + 1.5 * (p99_{f} - p01_{f}), 6) AS hi FROM fit"
    for i, f in enumerate(GUARD_FEATURES)), *SCORED_CTES[:1]))
def q_guard_bounds(spark, sf):
    _, m = fitted(spark, sf)
    tbl = m.bounds.table(spark)
    return tbl.select("ordinal", "feature", *[F.round(c, 6).alias(c) if c not in ("min", "max") else F.col(c)
                                              for c in ("mean", "std", "min", "max", "p01", "p99", "lo", "hi")])


@query("guard_physics_fit", with_fixture(
    "SELECT round(pr_mean, 6) AS power_ratio_mean, round(pr_std, 6) AS power_ratio_std, "
    "round(sr_mean, 6) AS strain_ratio_mean, round(sr_std, 6) AS strain_ratio_std FROM fit", *SCORED_CTES[:1]))
def q_guard_physics_fit(spark, sf):
    _, m = fitted(spark, sf)
    p = m.physics
    vals = [p.power_ratio_mean, p.power_ratio_std, p.strain_ratio_mean, p.strain_ratio_std]
    df = spark.createDataFrame([tuple(float(v) if v is not None else None for v in vals)],
                               "power_ratio_mean DOUBLE, power_ratio_std DOUBLE, strain_ratio_mean DOUBLE, "
                               "strain_ratio_std DOUBLE")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("guard_verdicts", with_fixture(
    "SELECT unit_id, l1_stats, l2_physics, anomaly FROM verdicts", *SCORED_CTES))
def q_guard_verdicts(spark, sf):
    t, m = fitted(spark, sf)
    return m.transform(t).select("unit_id", "l1_stats", "l2_physics", "anomaly")


@query("guard_zscores", with_fixture(
    "SELECT unit_id, " + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) + 0.0 AS z_{f}" for f in GUARD_FEATURES)
    + " FROM telemetry, fit", *SCORED_CTES[:1]))
def q_guard_zscores(spark, sf):
    t, m = fitted(spark, sf)
    return m.bounds.zscores(t, nd=6)


@query("physics_scores", with_fixture(
    f"SELECT unit_id, 100.0 * (abs(power_w - {EXP_POWER}) / {_nz(EXP_POWER)}) AS power_deviation_pct, "
    f"{EXP_POWER} AS expected_power, power_w AS actual_power FROM telemetry"))
def q_physics_scores(spark, sf):
    t, m = fitted(spark, sf)
    return m.physics.scores(t)


@query("power_violations", with_fixture(
    f"SELECT unit_id, power_w AS actual_power, {EXP_POWER} AS expected_power, "
    f"abs(power_w - {EXP_POWER}) AS power_gap_w FROM verdicts WHERE anomaly AND abs(power_w - {EXP_POWER}) > 1000",
    *SCORED_CTES))
def q_power_violations(spark, sf):
    t, m = fitted(spark, sf)
    return gd.power_violations(m, t)


@query("guard_detailed", with_fixture(
    "SELECT unit_id, CASE WHEN l1_stats THEN -1 ELSE 1 END AS layer1_stats, "
    "CASE WHEN l2_physics THEN -1 ELSE 1 END AS layer2_physics, "
    "CASE WHEN anomaly THEN -1 ELSE 1 END AS final_prediction FROM verdicts", *SCORED_CTES))
def q_guard_detailed(spark, sf):
    t, m = fitted(spark, sf)
    return gd.detailed(m, t)


@query("guard_verdict_labels", with_fixture(
    "SELECT unit_id, CASE WHEN l1_stats THEN 'ANOMALY' ELSE 'normal' END AS layer1, "
    "CASE WHEN l2_physics THEN 'ANOMALY' ELSE 'normal' END AS layer2, "
    "CASE WHEN anomaly THEN 'ANOMALY' ELSE 'OK' END AS verdict FROM verdicts", *SCORED_CTES))
def q_guard_verdict_labels(spark, sf):
    t, m = fitted(spark, sf)
    return gd.verdict_labels(m, t)


@query("detection_report", with_fixture("""
SELECT *, round(100.0 * healthy_flagged / n_healthy, 6) AS false_alarm_pct,
  round(100.0 * failures_detected / n_failed, 6) AS detection_pct,
  CASE WHEN failures_detected / n_failed > 0.7 THEN 'SUCCESS'
       WHEN failures_detected / n_failed > 0.5 THEN 'ACCEPTABLE' ELSE 'WARNING' END AS band
FROM (SELECT count(CASE WHEN machine_failure = 0 THEN 1 END) AS n_healthy,
  count(CASE WHEN machine_failure = 1 THEN 1 END) AS n_failed,
  count(CASE WHEN machine_failure = 0 AND anomaly THEN 1 END) AS healthy_flagged,
  count(CASE WHEN machine_failure = 1 AND anomaly THEN 1 END) AS failures_detected,
  count(CASE WHEN machine_failure = 1 AND l1_stats THEN 1 END) AS failures_l1_stats,
  count(CASE WHEN machine_failure = 0 AND l1_stats THEN 1 END) AS healthy_l1_stats,
  count(CASE WHEN machine_failure = 1 AND l2_physics THEN 1 END) AS failures_l2_physics,
  count(CASE WHEN machine_failure = 0 AND l2_physics THEN 1 END) AS healthy_l2_physics
  FROM verdicts) r""", *SCORED_CTES))
def q_detection_report(spark, sf):
    t, m = fitted(spark, sf)
    return gd.detection_report(m.transform(t))


_CROSSTAB_SQL = """
SELECT *, round(100.0 * failures_caught / (failures_caught + failures_missed), 6) AS detection_pct,
  round(100.0 * n_anomalies / n, 6) AS anomaly_pct
FROM (SELECT count(*) AS n, count(CASE WHEN NOT anomaly THEN 1 END) AS n_normal,
  count(CASE WHEN anomaly THEN 1 END) AS n_anomalies,
  count(CASE WHEN machine_failure = 1 AND anomaly THEN 1 END) AS failures_caught,
  count(CASE WHEN machine_failure = 1 AND NOT anomaly THEN 1 END) AS failures_missed,
  count(CASE WHEN machine_failure <> 1 AND anomaly THEN 1 END) AS false_alarms
  FROM verdicts v JOIN (SELECT unit_id, is_test FROM split) s USING (unit_id) WHERE s.is_test) c"""


@query("guard_crosstab_test", with_fixture(_CROSSTAB_SQL, *SCORED_CTES, ("split", SPLIT_SQL)))
def q_guard_crosstab_test(spark, sf):
    """Guard (fit on all healthy rows) vs labels on the held-out test split."""
    t, m = fitted(spark, sf)
    test = sm.stratified_split(t).filter("is_test")
    return gd.crosstab(m.transform(test))


PROBES_SQL = ("SELECT * FROM (VALUES " + ", ".join("('{}', {}, {}, {}, {}, {}, {})".format(*p) for p in gd.PROBES)
              + ") AS v(name, rpm, torque_nm, tool_wear_min, power_w, temp_diff_k, strain_load)")
PROBE_FLAGS_SQL = f"SELECT name, ({_L1_SQL}) AS l1, ({_L2_SQL}) AS l2 FROM probes, fit"


@query("guard_probes", with_fixture("""
SELECT p.name, CASE WHEN l1 THEN 'ANOMALY' ELSE 'normal' END AS layer1,
  CASE WHEN l2 THEN 'ANOMALY' ELSE 'normal' END AS layer2,
  CASE WHEN l1 OR l2 THEN 'ANOMALY' ELSE 'normal' END AS verdict
FROM (""" + PROBE_FLAGS_SQL + ") p",
    *SCORED_CTES[:1], ("probes", PROBES_SQL)))
def q_guard_probes(spark, sf):
    """Four probe machines with known violations, scored by the guard fit on the table."""
    _, m = fitted(spark, sf)
    return gd.score_probes(m, spark)


# ---------------------------------------------------------------- rules
@query("rule_flags", with_fixture(
    "SELECT unit_id, COALESCE(temp_diff_k < 7, FALSE) AS heat_rule, "
    "COALESCE((tool_wear_min > 200 AND torque_nm > 45) OR (tool_wear_min > 180 AND strain_load > 11000), FALSE) "
    "AS overstrain_rule, CASE WHEN (tool_wear_min > 200 AND torque_nm > 45) OR (tool_wear_min > 180 AND "
    "strain_load > 11000) THEN 3 WHEN temp_diff_k < 7 THEN 1 END AS rule_type FROM telemetry"))
def q_rule_flags(spark, sf):
    t = telemetry(spark, sf)
    heat, osf = heat_rule(t.columns), overstrain_rule(t.columns)
    return t.select("unit_id", heat.alias("heat_rule"), osf.alias("overstrain_rule"),
                    F.when(osf, 3).when(heat, 1).alias("rule_type"))


@query("overstrain_rule_no_torque", with_fixture(
    "SELECT unit_id, COALESCE(tool_wear_min > 200 OR (tool_wear_min > 180 AND strain_load > 11000), FALSE) "
    "AS overstrain_rule FROM telemetry"))
def q_overstrain_rule_no_torque(spark, sf):
    """Overstrain rule on a batch without a torque column (first clause degrades to wear > 200)."""
    t = telemetry(spark, sf).drop("torque_nm")
    return t.select("unit_id", overstrain_rule(t.columns).alias("overstrain_rule"))


# ---------------------------------------------------------------- metrics
_PRED_CTE = ("pred_t", TELEMETRY_PRED_SQL)
_GRID = ("grid", "SELECT a.c AS label, b.c AS pred FROM cls a, cls b")
_CLS = ("cls", "SELECT DISTINCT machine_failure AS c FROM pred_t UNION SELECT DISTINCT pred FROM pred_t")
_CM = ("cm", "SELECT g.label, g.pred, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN "
             "(SELECT machine_failure AS label, pred, count(*) AS n FROM pred_t GROUP BY 1, 2) c "
             "ON g.label = c.label AND g.pred = c.pred")
_PC = ("pc", """
SELECT cls, tp, support, precision, recall,
  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM (SELECT t.cls, t.tp, t.support,
  CASE WHEN p.predicted > 0 THEN t.tp / p.predicted ELSE 0.0 END AS precision,
  CASE WHEN t.support > 0 THEN t.tp / t.support ELSE 0.0 END AS recall
  FROM (SELECT label AS cls, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS tp, sum(n) AS support
        FROM cm GROUP BY 1) t
  JOIN (SELECT pred AS cls, sum(n) AS predicted FROM cm GROUP BY 1) p ON t.cls = p.cls) z""")
_METRIC_CTES = [_PRED_CTE, _CLS, _GRID, _CM, _PC]


def _rule_scored(spark, sf):
    return rule_prediction(telemetry(spark, sf))


@query("confusion_matrix", with_fixture("SELECT label, pred, n FROM cm", *_METRIC_CTES))
def q_confusion_matrix(spark, sf):
    return mt.confusion_long(_rule_scored(spark, sf), LABEL, "pred")


@query("class_report", with_fixture("""
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM pc""", *_METRIC_CTES))
def q_class_report(spark, sf):
    return mt.class_report(_rule_scored(spark, sf), LABEL, "pred")


@query("summary_scores", with_fixture("""
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
  round(COALESCE(max(CASE WHEN cls = 1 THEN f1 END), 0.0), 6) AS f1_binary,
  round(avg(f1), 6) AS f1_macro, round(sum(tp) / sum(support), 6) AS f1_micro FROM pc""", *_METRIC_CTES))
def q_summary_scores(spark, sf):
    return mt.summary_scores(_rule_scored(spark, sf), LABEL, "pred")


@query("false_negatives", with_fixture(
    "SELECT unit_id, power_w, temp_diff_k, strain_load FROM pred_t WHERE machine_failure = 1 AND pred <> 1",
    _PRED_CTE))
def q_false_negatives(spark, sf):
    return mt.false_negatives(_rule_scored(spark, sf), LABEL, "pred").select(
        "unit_id", "power_w", "temp_diff_k", "strain_load")


@query("guard_confusion_matrix", with_fixture(
    "SELECT g.label, g.pred, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM "
    "(SELECT a.c AS label, b.c AS pred FROM (VALUES (0), (1)) a(c), (VALUES (0), (1)) b(c)) g LEFT JOIN "
    "(SELECT machine_failure AS label, CAST(anomaly AS INT) AS pred, count(*) AS n FROM verdicts GROUP BY 1, 2) c "
    "ON g.label = c.label AND g.pred = c.pred", *SCORED_CTES))
def q_guard_confusion_matrix(spark, sf):
    t, m = fitted(spark, sf)
    scored = m.transform(t).withColumn("pred", F.col("anomaly").cast("int"))
    return mt.confusion_long(scored, LABEL, "pred", classes=[0, 1])
