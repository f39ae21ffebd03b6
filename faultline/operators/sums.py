"""Sums of small arrays over the partitions of an RDD."""

from __future__ import annotations

#: Tasks that add up the values of many partitions, each the values of some keys.
REDUCERS = 4


def summed(found, add, few: int) -> dict:
    """The sum by key of an RDD of (key, value).

    Up to ``few`` partitions send their values straight to the driver. The values of
    more are added up on the executors, so the driver gets one value a key, however
    many partitions there are.
    """
    if found.getNumPartitions() > few:
        return dict(found.reduceByKey(add, min(found.getNumPartitions(), REDUCERS)).collect())
    total = {}
    for k, v in found.collect():
        total[k] = add(total[k], v) if k in total else v
    return total
