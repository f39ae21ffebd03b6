"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mark, 24)), F.bit_xor(mark)).first())


def star_components(links: DataFrame) -> DataFrame:
    """(u, v) links to (u, root) for every node that is not itself the root, root the smallest node.

    A round joins every node's larger neighbours to its smallest one (large
    star), then its smaller neighbours (small star); minima are pre-aggregated
    before the shuffle, so a hub costs a row per task. Each round is cut with
    checkpoint(). No link or node ever reaches the driver.
    """
    cur = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    cur = cut_lineage(cur)
    before = _state(cur)
    while before[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(cur)
        if now == before:
            break
        before = now
    return cur.select("u", F.col("v").alias("root"))
