"""Descriptive statistics (C operators) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.labels import failure_name
from faultline.operators import features as fe
from faultline.operators import sampling as sm
from faultline.operators import stats as st
from faultline.operators.rules import rule_prediction
from faultline.plans.fixture import SPLIT_SQL, TELEMETRY_PRED_SQL, with_fixture
from faultline.plans.registry import FAILURE_NAME_SQL, TYPE_CODE_SQL, query
from faultline.schema import MODEL_FEATURES, PROFILE_FEATURES
from faultline.sources.telemetry import telemetry

PHYS = ["power_w", "temp_diff_k", "strain_load"]
ENC_CTE = ("enc", f"SELECT *, {TYPE_CODE_SQL} AS type_encoded, {FAILURE_NAME_SQL} AS failure_type FROM telemetry")


def _enc(spark, sf):
    return fe.encode_type(telemetry(spark, sf)).withColumn("failure_type", failure_name())


def describe_sql(src: str, features, where: str = "TRUE") -> str:
    parts = []
    for f in features:
        x = f"CAST({f} AS DOUBLE)"
        parts.append(
            f"SELECT '{f}' AS feature, count({x}) AS count, round(avg({x}), 6) AS mean, "
            f"round(stddev_samp({x}), 6) AS std, min({x}) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, "
            f"round(quantile_cont({x}, 0.5), 6) AS q50, round(quantile_cont({x}, 0.75), 6) AS q75, "
            f"max({x}) AS max FROM {src} WHERE {where}")
    return "\nUNION ALL\n".join(parts)


@query("class_distribution", with_fixture(
    "SELECT machine_failure, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, "
    "round(count(*) / sum(count(*)) OVER (), 6) AS share FROM telemetry GROUP BY machine_failure"))
def q_class_distribution(spark, sf):
    return st.class_distribution(telemetry(spark, sf))


@query("failure_type_distribution", with_fixture(
    "SELECT failure_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
    "FROM enc GROUP BY failure_type", ENC_CTE))
def q_failure_type_distribution(spark, sf):
    return st.failure_type_distribution(telemetry(spark, sf))


@query("type_summary", with_fixture(
    "SELECT failure_type, " + ", ".join(
        f"count({f}) AS {f}_count, round(avg({f}), 3) AS {f}_mean, round(stddev_samp({f}), 3) AS {f}_std"
        for f in PHYS) + " FROM enc WHERE failure_type <> 'NoLabel' GROUP BY failure_type", ENC_CTE))
def q_type_summary(spark, sf):
    return st.type_summary(telemetry(spark, sf), PHYS, nd=3)


@query("describe_profile", with_fixture(describe_sql("enc", PROFILE_FEATURES), ENC_CTE))
def q_describe_profile(spark, sf):
    return st.describe(_enc(spark, sf), PROFILE_FEATURES)


_QS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _quantile_compare_sql():
    parts = []
    for f in PROFILE_FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        cols = [f"round(quantile_cont(CASE WHEN failure_type = 'PWF' THEN {x} END, {q}), 2) AS subset_q{int(q * 100)}"
                for q in _QS]
        cols += [f"round(quantile_cont({x}, {q}), 2) AS all_q{int(q * 100)}" for q in _QS]
        parts.append(f"SELECT '{f}' AS feature, {', '.join(cols)} FROM enc")
    return "\nUNION ALL\n".join(parts)


@query("pwf_quantile_compare", with_fixture(_quantile_compare_sql(), ENC_CTE))
def q_pwf_quantile_compare(spark, sf):
    df = _enc(spark, sf)
    return st.quantile_compare(df, F.col("failure_type") == "PWF", PROFILE_FEATURES, _QS)


def _cohens_sql():
    parts = []
    for f in PROFILE_FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        a, b = f"CASE WHEN failure_type = 'PWF' THEN {x} END", f"CASE WHEN failure_type <> 'PWF' THEN {x} END"
        parts.append(f"SELECT '{f}' AS feature, count({a}) AS na, count({b}) AS nb, avg({a}) AS ma, avg({b}) AS mb, "
                     f"var_samp({a}) AS va, var_samp({b}) AS vb FROM enc")
    return ("SELECT feature, round(d, 6) AS cohens_d, abs(round(d, 6)) AS abs_d FROM (SELECT feature, "
            "CASE WHEN pooled > 0 THEN (ma - mb) / pooled END AS d FROM (SELECT *, "
            "sqrt(CASE WHEN na + nb - 2 > 0 THEN ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) END) AS pooled "
            "FROM (" + "\nUNION ALL\n".join(parts) + ") s) p) q")


@query("pwf_effect_size", with_fixture(_cohens_sql(), ENC_CTE))
def q_pwf_effect_size(spark, sf):
    return st.cohens_d(_enc(spark, sf), F.col("failure_type") == "PWF", PROFILE_FEATURES)


_TOP = ["power_w", "rpm", "torque_nm"]


@query("pwf_share_above_p75", with_fixture(
    "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, round(t.q, 6) AS q_all, "
        f"round(avg(CASE WHEN e.failure_type = 'PWF' THEN (CASE WHEN e.{f} > t.q THEN 1.0 ELSE 0.0 END) END), 6) "
        f"AS share_subset_above, round(avg(CASE WHEN e.{f} > t.q THEN 1.0 ELSE 0.0 END), 6) AS share_all_above "
        f"FROM enc e, (SELECT quantile_cont({f}, 0.75) AS q FROM enc) t GROUP BY t.q" for f in _TOP), ENC_CTE))
def q_pwf_share_above_p75(spark, sf):
    out = st.share_above_quantile(_enc(spark, sf), F.col("failure_type") == "PWF", _TOP, 0.75)
    return out.withColumn("q_all", F.round("q_all", 6))


@query("pwf_share", with_fixture(
    "SELECT count(*) AS n_all, count(CASE WHEN failure_type = 'PWF' THEN 1 END) AS n_subset, "
    "round(avg(CASE WHEN failure_type = 'PWF' THEN 1.0 ELSE 0.0 END), 6) AS share FROM enc", ENC_CTE))
def q_pwf_share(spark, sf):
    return st.subset_share(_enc(spark, sf), F.col("failure_type") == "PWF")


_TEST_CTE = ("test", "SELECT s.*, " + TYPE_CODE_SQL + " AS type_encoded FROM split s WHERE is_test")


@query("test_mean_std", with_fixture(
    "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, "
        f"round(CASE WHEN stddev_samp({f}) = 0 THEN 1.0 ELSE stddev_samp({f}) END, 6) AS std FROM test"
        for f in MODEL_FEATURES), ("split", SPLIT_SQL), _TEST_CTE))
def q_test_mean_std(spark, sf):
    test = sm.train_test(fe.encode_type(telemetry(spark, sf)))[1]
    return st.mean_std_profile(test, MODEL_FEATURES)


@query("test_zscores", with_fixture(
    "SELECT t.unit_id, " + ", ".join(
        f"round((t.{f} - s.m_{f}) / s.s_{f}, 3) + 0.0 AS z_{f}" for f in MODEL_FEATURES)  # + 0.0: no -0.0
    + " FROM enc t, (SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_samp({f}) = 0 THEN 1.0 ELSE stddev_samp({f}) END AS s_{f}"
        for f in MODEL_FEATURES) + " FROM test) s",
    ("split", SPLIT_SQL), _TEST_CTE, ENC_CTE))
def q_test_zscores(spark, sf):
    """z-scores of every row against the test-split population (3 decimals)."""
    df = fe.encode_type(telemetry(spark, sf))
    test = sm.train_test(df)[1]
    return st.zscores_against(df, test, MODEL_FEATURES, nd=3)


_PRED_CTE = ("pred_t", TELEMETRY_PRED_SQL)


@query("missed_vs_caught", with_fixture(
    "SELECT CASE WHEN pred = 1 THEN 'caught' ELSE 'missed' END AS outcome, count(*) AS n, "
    + ", ".join(f"round(avg({f}), 6) AS avg_{f}" for f in PHYS)
    + " FROM pred_t WHERE machine_failure = 1 GROUP BY 1", _PRED_CTE))
def q_missed_vs_caught(spark, sf):
    return st.missed_vs_caught(rule_prediction(telemetry(spark, sf)))


@query("missed_profile", with_fixture(
    describe_sql("pred_t", PHYS, "machine_failure = 1 AND pred = 0"), _PRED_CTE))
def q_missed_profile(spark, sf):
    return st.missed_profile(rule_prediction(telemetry(spark, sf)))


def _box_sql():
    parts = []
    for f in PHYS:
        parts.append(f"""
SELECT e.failure_type, '{f}' AS feature, round(any_value(q.q1), 6) AS q1, round(any_value(q.med), 6) AS median,
  round(any_value(q.q3), 6) AS q3, round(any_value(q.q3) - any_value(q.q1), 6) AS iqr,
  round(min(CASE WHEN e.{f} >= q.q1 - 1.5 * (q.q3 - q.q1) AND e.{f} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN e.{f} END), 6)
    AS whisker_lo,
  round(max(CASE WHEN e.{f} >= q.q1 - 1.5 * (q.q3 - q.q1) AND e.{f} <= q.q3 + 1.5 * (q.q3 - q.q1) THEN e.{f} END), 6)
    AS whisker_hi,
  count(CASE WHEN NOT (e.{f} >= q.q1 - 1.5 * (q.q3 - q.q1) AND e.{f} <= q.q3 + 1.5 * (q.q3 - q.q1)) THEN 1 END)
    AS n_outliers
FROM lab e JOIN (SELECT failure_type, quantile_cont({f}, 0.25) AS q1, quantile_cont({f}, 0.5) AS med,
  quantile_cont({f}, 0.75) AS q3 FROM lab GROUP BY failure_type) q ON e.failure_type = q.failure_type
GROUP BY e.failure_type""")
    return "\nUNION ALL\n".join(parts)


@query("box_stats", with_fixture(_box_sql(), ENC_CTE,
                                 ("lab", "SELECT * FROM enc WHERE failure_type <> 'NoLabel'")))
def q_box_stats(spark, sf):
    df = _enc(spark, sf).filter(F.col("failure_type") != "NoLabel")
    return st.box_stats(df, "failure_type", PHYS)
