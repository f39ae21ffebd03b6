"""Running sums in the order of a value, for any number of groups and rows.

The rows are dealt by ranges of (group, value), so a hot group spreads over many
ranges. What lies in earlier ranges of a group is a running sum over a table
with a row per range and group; inside a range a window adds the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.session import scratch_path


def running_sums(df: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """Adds ``<s>_upto`` (sum to this row, itself included) and ``<s>_all`` for each of ``sums``, and ``next``, the next value of ``order``.

    ``order`` must be unique inside a group (aggregate equal values first).
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*groups, order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    over = Window.partitionBy(*groups)
    before = over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part", *groups).agg(F.min(order).alias("first"), *[F.sum(s).alias(f"here_{s}") for s in sums])
    parts = parts.select("part", *groups, F.lead("first").over(over.orderBy("part")).alias("first_after"),
                         *[F.coalesce(F.sum(f"here_{s}").over(before), F.lit(0)).alias(f"before_{s}") for s in sums],
                         *[F.sum(f"here_{s}").over(over).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy("part", *groups).orderBy(order)
    rows = rows.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums} | {"next": F.lead(order).over(inside)}).join(parts, ["part", *groups])
    return rows.select(*df.columns, F.coalesce("next", "first_after").alias("next"),
                       *[c for s in sums for c in ((F.col(f"{s}_upto") + F.col(f"before_{s}")).alias(f"{s}_upto"), F.col(f"{s}_all"))])
