"""Streaming scoring equals batch scoring; windows equal the batch GROUP BY on closed windows."""
from conftest import SF_SMALL
from faultline.operators import guard as gd
from faultline.plans.q_stream import q_stream_alert_windows, q_stream_scoring
from faultline.operators.rules import heat_rule, overstrain_rule
from faultline.sources.telemetry import telemetry


def test_stream_equals_batch(spark):
    t = telemetry(spark, SF_SMALL)
    m = gd.fit_guard(t)
    b = m.transform(t)
    rule = heat_rule(t.columns) | overstrain_rule(t.columns)
    batch = sorted(tuple(r) for r in b.select("unit_id", "anomaly", rule.alias("r")).collect())
    s = q_stream_scoring(spark, SF_SMALL)
    stream = sorted(tuple(r) for r in s.select("unit_id", "anomaly", "rule_alert").collect())
    assert batch == stream


def test_windows_closed_only(spark):
    w = q_stream_alert_windows(spark, SF_SMALL)
    t = telemetry(spark, SF_SMALL)
    mx = t.agg({"ts": "max"}).first()[0]
    assert w.count() > 0
    assert all(r.window_end <= mx for r in w.select("window_end").collect())


def test_a_late_row_is_dropped_and_counted(spark, tmp_path):
    """Files in order of arrival; the last but one holds a row older than the watermark."""
    import datetime as dt
    from faultline.streaming import telemetry_stream as ts
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    files = [[(1, day(1, 3), True), (1, day(1, 9), False)], [(1, day(3, 0), True)], [(1, day(4, 0), False)], [(1, day(1, 5), True), (1, day(5, 0), False)], [(1, day(9, 0), False)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "machine_id LONG, ts TIMESTAMP, alert BOOLEAN").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("machine_id LONG, ts TIMESTAMP, alert BOOLEAN").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ts.alert_windows(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ckpt")) \
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    got = {r.window_start.day: (r.n, r.n_alerts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert dropped == 1 and got == {1: (2, 1), 3: (1, 1), 4: (1, 0), 5: (1, 0)}
