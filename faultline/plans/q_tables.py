"""The statistics over given columns as they are (``events.value``, ``lineitem``), persisted reports, top-up and displayed risk.

``events.value`` has ties and a long tail by event type; ``lineitem`` has a few
discount and tax values, so most of its order statistics are ties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import metrics as mt
from faultline.operators import rules as ru
from faultline.operators import sampling as sm
from faultline.operators import stats as st
from faultline.operators.quantiles import group_quantiles
from faultline.plans.fixture import with_fixture
from faultline.plans.q_guard import _METRIC_CTES
from faultline.plans.q_stats import describe_sql
from faultline.plans.registry import query
from faultline.schema import LABEL
from faultline.session import scratch_path
from faultline.sources.telemetry import read_table, telemetry

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QS = (0.1, 0.25, 0.5, 0.75, 0.9)


@query("lineitem_profile", describe_sql("lineitem", LINE_COLS))
def q_lineitem_profile(spark, sf):
    return st.describe(read_table(spark, sf, "lineitem"), LINE_COLS)


def _quantile_sql(src: str, f: str, where: str, prefix: str) -> str:
    return ", ".join(f"round((SELECT quantile_cont({f}, {q}) FROM {src} WHERE {where}), 6) AS {prefix}{int(round(q * 100))}" for q in QS)


@query("returned_quantile_compare", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, {_quantile_sql('lineitem', f, chr(39).join(['l_returnflag = ', 'R', '']), 'subset_q')}, {_quantile_sql('lineitem', f, 'TRUE', 'all_q')}" for f in LINE_COLS))
def q_returned_quantile_compare(spark, sf):
    """Quantiles of returned lines next to all lines."""
    return st.quantile_compare(read_table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", LINE_COLS, QS, nd=6)


@query("event_value_box", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
           FROM events WHERE event_type IS NOT NULL GROUP BY event_type),
e AS (SELECT events.event_type, value, q1, median, q3, value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1) AS inside
      FROM events JOIN q ON events.event_type = q.event_type)
SELECT event_type, 'value' AS feature, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(any_value(q3) - any_value(q1), 6) AS iqr, round(min(CASE WHEN inside THEN value END), 6) AS whisker_lo,
  round(max(CASE WHEN inside THEN value END), 6) AS whisker_hi, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM e GROUP BY event_type""")
def q_event_value_box(spark, sf):
    return st.box_stats(read_table(spark, sf, "events"), "event_type", ["value"])


SUPPLIER_COLS = ["l_quantity", "l_extendedprice"]


@query("supplier_quartiles", "SELECT l_suppkey, " + ", ".join(
    f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in SUPPLIER_COLS for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    + " FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey")
def q_supplier_quartiles(spark, sf):
    """Quartiles of quantity and price of every supplier: as many groups as suppliers."""
    names = {c: [f"{c}_{n}" for n in ("q1", "median", "q3")] for c in SUPPLIER_COLS}
    found = group_quantiles(read_table(spark, sf, "lineitem"), "l_suppkey", {c: F.col(c) for c in SUPPLIER_COLS}, [0.25, 0.5, 0.75], names)
    return found.select("l_suppkey", *[F.round(n, 6).alias(n) for c in SUPPLIER_COLS for n in names[c]])


@query("supplier_price_box", """
WITH q AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
           FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY l_suppkey),
e AS (SELECT l.l_suppkey, l_extendedprice AS x, q1, median, q3, x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem l JOIN q ON l.l_suppkey = q.l_suppkey)
SELECT l_suppkey, 'l_extendedprice' AS feature, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(any_value(q3) - any_value(q1), 6) AS iqr, round(min(CASE WHEN inside THEN x END), 6) AS whisker_lo,
  round(max(CASE WHEN inside THEN x END), 6) AS whisker_hi, count(CASE WHEN NOT inside THEN 1 END) AS n_outliers
FROM e GROUP BY l_suppkey""")
def q_supplier_price_box(spark, sf):
    """Box statistics of line prices for every supplier."""
    return st.box_stats(read_table(spark, sf, "lineitem"), "l_suppkey", ["l_extendedprice"])


@query("event_purchase_effect", """
WITH s AS (SELECT count(CASE WHEN event_type = 'purchase' THEN value END) AS na, count(CASE WHEN event_type <> 'purchase' THEN value END) AS nb,
  avg(CASE WHEN event_type = 'purchase' THEN value END) AS ma, avg(CASE WHEN event_type <> 'purchase' THEN value END) AS mb,
  var_samp(CASE WHEN event_type = 'purchase' THEN value END) AS va, var_samp(CASE WHEN event_type <> 'purchase' THEN value END) AS vb FROM events)
SELECT 'value' AS feature, round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS cohens_d,
  abs(round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6)) AS abs_d FROM s""")
def q_event_purchase_effect(spark, sf):
    return st.cohens_d(read_table(spark, sf, "events"), F.col("event_type") == "purchase", ["value"])


@query("event_value_zscores", """
SELECT event_id, round((value - (SELECT avg(value) FROM events WHERE event_type = 'view'))
  / (SELECT stddev_samp(value) FROM events WHERE event_type = 'view'), 3) + 0.0 AS z_value FROM events""")
def q_event_value_zscores(spark, sf):
    """Every event against the population of views."""
    events = read_table(spark, sf, "events")
    return st.zscores_against(events, events.filter(F.col("event_type") == "view"), ["value"], nd=3, keep=("event_id",))


@query("report_roundtrip", with_fixture("""
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc""", *_METRIC_CTES))
def q_report_roundtrip(spark, sf):
    """The class report of the rules, written to the shared folder and read again."""
    path = scratch_path(spark, "class-report")
    mt.class_report(ru.rule_prediction(telemetry(spark, sf)), LABEL, "pred").write.parquet(path)
    return spark.read.parquet(path)


@query("displayed_risk", with_fixture("""
SELECT unit_id, heat AS heat_rule, osf_rule AS overstrain_rule, CASE WHEN osf_rule OR heat THEN 1 ELSE 0 END AS final_pred,
  CASE WHEN osf_rule THEN 3 WHEN heat THEN 1 END AS final_type,
  round(CASE WHEN osf_rule THEN greatest(p, 0.75) WHEN heat THEN greatest(p, 0.26) ELSE p END, 6) AS display_prob
FROM (SELECT unit_id, COALESCE(temp_diff_k < 7, FALSE) AS heat, tool_wear_min / 300 AS p,
  COALESCE((tool_wear_min > 200 AND torque_nm > 45) OR (tool_wear_min > 180 AND strain_load > 11000), FALSE) AS osf_rule FROM telemetry) r"""))
def q_displayed_risk(spark, sf):
    """Rule overrides over a wear-based risk (wear / 300): floors, precedence and types."""
    t = telemetry(spark, sf).withColumns({"detector_prob": F.col("tool_wear_min") / 300, "detector_pred": F.lit(0)})
    return ru.apply_overrides(t).select("unit_id", "heat_rule", "overstrain_rule", "final_pred", "final_type", F.round("display_prob", 6).alias("display_prob"))


def _h(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


@query("top_up", f"""
WITH f AS (SELECT event_id AS draw_id, 0 AS is_draw, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS machine_failure, value FROM events),
src AS (SELECT *, md5('0|' || machine_failure || '|' || draw_id) AS k FROM f),
pos AS (SELECT *, row_number() OVER (ORDER BY md5(k || '|43'), k) - 1 AS pos FROM src),
draws AS (SELECT range AS draw_id, {_h("range || '|43'")} % (SELECT count(*) FROM f) AS pos FROM range((SELECT count(*) // 2 FROM f)))
SELECT draw_id, is_draw, machine_failure, value FROM f
UNION ALL SELECT d.draw_id, 2, p.machine_failure, p.value FROM draws d JOIN pos p USING (pos)""")
def q_top_up(spark, sf):
    """``events`` topped up to one and a half times their number."""
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("draw_id"), F.lit(0).alias("is_draw"),
                                               F.when(F.col("event_type") == "error", 1).otherwise(0).alias("machine_failure"), "value")
    n = e.count()
    return sm.top_up(e, n + n // 2)
