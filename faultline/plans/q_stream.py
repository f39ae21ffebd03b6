"""Streaming queries (S1, S2): the stream is the given ``events`` table, telemetry derived on it.

Both return the sink contents as a batch DataFrame, so they are checked like
any other query: S1 must equal the batch guard + rules; S2 equals a batch
GROUP BY over the windows the final watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import guard as gd
from faultline.plans.fixture import with_fixture
from faultline.plans.q_forest import FOREST_CTES, forest_guard
from faultline.plans.q_guard import SCORED_CTES
from faultline.plans.registry import query
from faultline.session import scratch_path
from faultline.sources.telemetry import telemetry
from faultline.streaming import live_sink
from faultline.streaming import telemetry_stream as ts

_RULE_SQL = ("COALESCE(temp_diff_k < 7, FALSE) OR COALESCE((tool_wear_min > 200 AND torque_nm > 45) OR "
             "(tool_wear_min > 180 AND strain_load > 11000), FALSE)")
_ALERTS = ("alerts", f"SELECT *, ({_RULE_SQL}) AS rule_alert, anomaly OR ({_RULE_SQL}) AS alert FROM verdicts")


@query("stream_scoring", with_fixture(
    "SELECT unit_id, l1_stats, l2_physics, anomaly, rule_alert, alert FROM alerts", *SCORED_CTES, _ALERTS))
def q_stream_scoring(spark, sf):
    """Score a telemetry stream with the guard fitted on the batch table ."""
    model = gd.fit_guard(telemetry(spark, sf))
    stream = ts.telemetry_stream(spark, sf)
    out = scratch_path(spark, "stream-scored")
    ts.drain(ts.score(stream, model).select("unit_id", "l1_stats", "l2_physics", "anomaly", "rule_alert",
                                           "alert"), out)
    return spark.read.parquet(out)


@query("stream_alert_windows", with_fixture("""
SELECT machine_id, window_start, window_end, count(*) AS n, CAST(sum(CAST(alert AS INT)) AS BIGINT) AS n_alerts,
  round(sum(CAST(alert AS INT)) / count(*), 6) AS alert_rate
FROM (SELECT *, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end
      FROM alerts) a
WHERE window_end <= (SELECT max(ts) FROM telemetry) - INTERVAL 1 HOUR
GROUP BY machine_id, window_start, window_end""", *SCORED_CTES, _ALERTS))
def q_stream_alert_windows(spark, sf):
    """Daily alert rate per machine; 1-hour watermark; only windows the watermark has closed."""
    model = gd.fit_guard(telemetry(spark, sf))
    stream = ts.telemetry_stream(spark, sf)
    out = scratch_path(spark, "stream-windows")
    ts.drain(ts.alert_windows(ts.score(stream, model)), out)
    return spark.read.parquet(out)


@query("stream_alert_windows_sliding", with_fixture("""
SELECT machine_id, window_start, window_end, count(*) AS n, CAST(sum(CAST(alert AS INT)) AS BIGINT) AS n_alerts,
  round(sum(CAST(alert AS INT)) / count(*), 6) AS alert_rate
FROM (SELECT a.*, b.window_start, b.window_start + INTERVAL 1 DAY AS window_end
      FROM alerts a, LATERAL (SELECT time_bucket(INTERVAL 12 HOUR, a.ts) AS window_start
                              UNION ALL SELECT time_bucket(INTERVAL 12 HOUR, a.ts) - INTERVAL 12 HOUR) b) w
WHERE window_end <= (SELECT max(ts) FROM telemetry) - INTERVAL 1 HOUR
GROUP BY machine_id, window_start, window_end""", *SCORED_CTES, _ALERTS))
def q_stream_alert_windows_sliding(spark, sf):
    """Alert rate per machine over 1-day windows sliding every 12 hours; 1-hour watermark."""
    model = gd.fit_guard(telemetry(spark, sf))
    stream = ts.telemetry_stream(spark, sf)
    out = scratch_path(spark, "stream-sliding")
    ts.drain(ts.alert_windows(ts.score(stream, model), "1 day", slide="12 hours"), out)
    return spark.read.parquet(out)


@query("stream_alert_sessions", with_fixture("""
SELECT machine_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n,
  CAST(sum(CAST(alert AS INT)) AS BIGINT) AS n_alerts, round(sum(CAST(alert AS INT)) / count(*), 6) AS alert_rate
FROM (SELECT *, sum(CASE WHEN prev_ts IS NULL OR ts - prev_ts > INTERVAL 12 HOUR THEN 1 ELSE 0 END)
        OVER (PARTITION BY machine_id ORDER BY ts, unit_id ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, lag(ts) OVER (PARTITION BY machine_id ORDER BY ts, unit_id) AS prev_ts FROM alerts) z) s
GROUP BY machine_id, sid
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM telemetry) - INTERVAL 1 HOUR""", *SCORED_CTES, _ALERTS))
def q_stream_alert_sessions(spark, sf):
    """Alert rate per machine activity session (12-hour inactivity gap); 1-hour watermark."""
    model = gd.fit_guard(telemetry(spark, sf))
    stream = ts.telemetry_stream(spark, sf)
    out = scratch_path(spark, "stream-sessions")
    ts.drain(ts.alert_windows(ts.score(stream, model), session_gap="12 hours"), out)
    return spark.read.parquet(out)


_LIVE = ("live", f"SELECT *, anomaly OR ({_RULE_SQL}) AS alert FROM fverdicts")


def _live(spark, sf) -> str:
    """The stream scored by all three layers and the rules, in the live sink."""
    _, model = forest_guard(spark, sf)
    scored = ts.score(ts.telemetry_stream(spark, sf), model).select("unit_id", "ts", "l1_stats", "l2_physics", "l3_isolation", "anomaly", "anomaly_score", "alert")
    return live_sink.drain(scored, scratch_path(spark, "live"))


@query("stream_live_rows", with_fixture("SELECT unit_id, l1_stats, l2_physics, l3_isolation, anomaly, round(anomaly_score, 6) AS anomaly_score, alert FROM live", *FOREST_CTES, _LIVE))
def q_stream_live_rows(spark, sf):
    """Live scoring with all three layers: what the sink holds after the stream is read."""
    return live_sink.rows(spark, _live(spark, sf)).select("unit_id", "l1_stats", "l2_physics", "l3_isolation", "anomaly", F.round("anomaly_score", 6).alias("anomaly_score"), "alert")


@query("stream_live_metrics", with_fixture("SELECT count(*) AS rows, count(*) FILTER (WHERE alert) AS alerts, 0::BIGINT AS late_rows FROM live", *FOREST_CTES, _LIVE))
def q_stream_live_metrics(spark, sf):
    """Counts that the live sink observed, over all micro-batches."""
    seen = live_sink.metrics(spark, _live(spark, sf))
    return seen.agg(*[F.sum(c).alias(c) for c in ("rows", "alerts", "late_rows")])
