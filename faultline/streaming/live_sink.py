"""Live sink of scored telemetry: rows and counts by micro-batch, the same after any repeat.

``foreachBatch`` hands over every micro-batch with its id, and may hand over the
same one again after a failure. Each batch therefore replaces the folders of its
own id: ``rows/batch_id=N`` and ``metrics/batch_id=N``. The counts (rows, alerts,
rows older than the watermark, newest event) are observed while the rows are
written, without another pass. The watermark of a batch is the newest event of
all earlier batches less a delay, read from their metrics, so a repeated batch
counts the same late rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_METRICS = "rows long, alerts long, late_rows long, newest timestamp, batch_id long"


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """A row per micro-batch; empty before the first."""
    try:
        return spark.read.schema(_METRICS).parquet(f"{root}/metrics")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _METRICS)


def rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows, with their ``batch_id``."""
    return spark.read.parquet(f"{root}/rows")


def writer(root: str, delay: str = "1 hour", alert: str = "alert", ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = metrics(spark, root).filter(F.col("batch_id") < batch_id).agg(F.max("newest").alias("at")).first()["at"]
        event = F.col(ts).cast("timestamp")
        late = event < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}") if newest is not None else F.lit(False)
        seen = Observation(f"live-{batch_id}")
        batch = batch.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col(alert), F.lit(False))).alias("alerts"),
                              F.count_if(late).alias("late_rows"), F.max(event).alias("newest"))
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch_id={batch_id}")
        got = seen.get
        spark.createDataFrame([(got["rows"], got["alerts"], got["late_rows"], got["newest"])], _METRICS.rpartition(",")[0]).coalesce(1) \
            .write.mode("overwrite").parquet(f"{root}/metrics/batch_id={batch_id}")
    return write


def drain(stream: DataFrame, root: str, delay: str = "1 hour", alert: str = "alert", ts: str = "ts") -> str:
    """Run the sink over everything available, then stop; a restart goes on behind the last complete batch."""
    q = (stream.writeStream.foreachBatch(writer(root, delay, alert, ts)).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return root
