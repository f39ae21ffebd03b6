"""Structured Streaming: score telemetry as it arrives, aggregate alerts per machine.

* ``telemetry_stream`` reads a folder (or file) of ``events`` as a stream and
  derives the sensor readings on it, a pure projection.
* ``score`` applies the batch-fitted guard (L1 + L2, and L3 if fitted) and the
  rules to a stream: no state, the batch expressions.
* ``alert_windows`` is the stateful part: event-time windows per machine with
  a watermark, so state for closed windows is dropped and late rows (older
  than the watermark) are discarded.
* ``drain`` runs a query with ``trigger(availableNow=True)`` into a parquet
  sink with its checkpoint in the shared checkpoint folder (exactly-once file
  sink; a restarted driver resumes from the checkpoint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.guard import GuardModel
from faultline.operators.rules import heat_rule, overstrain_rule
from faultline.sources.telemetry import table_path, telemetry_from_events


def telemetry_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The telemetry of ``events`` as a stream; ``max_files`` per micro-batch (default: all that is there)."""
    reader = spark.readStream.schema(spark.read.parquet(table_path(sf_dir, "events")).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern, because a stream takes a single file only by pattern
    return telemetry_from_events(reader.parquet(table_path(sf_dir, "event[s]")).select("event_id", "user_id", "ts"))


def score(stream: DataFrame, guard: GuardModel) -> DataFrame:
    """Guard layers + rules on each micro-batch (no state)."""
    s = guard.transform(stream)
    rule = heat_rule(stream.columns) | overstrain_rule(stream.columns)
    return s.withColumns({"rule_alert": rule, "alert": F.col("anomaly") | rule})


def alert_windows(scored: DataFrame, window: str = "1 day", delay: str = "1 hour",
                  group: str = "machine_id", ts: str = "ts", slide: str | None = None,
                  session_gap: str | None = None) -> DataFrame:
    """Alert counts and rate per machine per event-time window (watermarked, append mode).

    Tumbling by default; ``slide`` gives sliding windows, ``session_gap`` session windows.
    """
    ev = scored.withColumn("_evt", F.col(ts).cast("timestamp")).withWatermark("_evt", delay)
    if session_gap:
        w = F.session_window("_evt", session_gap)
    else:
        w = F.window("_evt", window, slide) if slide else F.window("_evt", window)
    return (ev.groupBy(w.alias("w"), F.col(group))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alert").cast("int")).alias("n_alerts"))
            .select(group, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n",
                    F.col("n_alerts").cast("bigint").alias("n_alerts"),
                    F.round(F.col("n_alerts") / F.col("n"), 6).alias("alert_rate")))


def drain(df: DataFrame, sink: str, mode: str = "append") -> str:
    """Run a streaming query over everything available, then stop."""
    q = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", sink + "-checkpoint").trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return sink
