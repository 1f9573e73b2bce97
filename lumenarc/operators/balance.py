"""Rows into partitions of near-equal cost by longest-processing-time scheduling.

Files differ in size by many orders, so partitions of equal row counts leave
the task with the largest films running alone. Rows that cost a fair part of a
partition are scheduled one by one, dearest first; all others in hash buckets,
by the sum of a bucket. The driver sees at most ``2 * SHARE`` items a partition.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A row that costs over ``1 / SHARE`` of a partition's even share is an item of its own; there are SHARE buckets a partition.
SHARE = 16


def schedule(costs: list[float], parts: int) -> list[int]:
    """The part of each item: by falling cost to the part with the least so far. At most 4/3 of the best possible schedule."""
    heap = [(0.0, p) for p in range(parts)]
    found = [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        load, p = heap[0]
        heapq.heapreplace(heap, (load + costs[i], p))
        found[i] = p
    return found


def balanced(rows: DataFrame, cost: str, parts: int, key: str) -> DataFrame:
    """rows dealt out over ``parts`` partitions of near-equal sums of ``cost``, with the number of each as ``part``.

    Rows of one key stay together; null and negative costs count as 0. ``rows``
    is read three times, without other columns than these but for the last.
    """
    spark = rows.sparkSession
    given = rows.withColumn("__cost", F.greatest(F.lit(0), F.coalesce(F.col(cost), F.lit(0))).cast("double")).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(parts * SHARE)).cast("int"))
    total = given.agg(F.sum("__cost")).first()[0] or 0.0
    large = F.col("__cost") * (parts * SHARE) > total
    items = given.filter(large).groupBy(key).agg(F.sum("__cost").alias("c")).orderBy(key).collect()
    sums = given.filter(~large).groupBy("__bucket").agg(F.sum("__cost").alias("c")).orderBy("__bucket").collect()
    found = schedule([r["c"] for r in items] + [r["c"] for r in sums], parts)
    own = spark.createDataFrame([(r[0], p) for r, p in zip(items, found, strict=False)], f"`{key}` {rows.schema[key].dataType.simpleString()}, __own int")
    shared = spark.createDataFrame([(r[0], p) for r, p in zip(sums, found[len(items) :], strict=True)], "__bucket int, __shared int")
    dealt = given.join(F.broadcast(own), key, "left").join(F.broadcast(shared), "__bucket", "left")
    return dealt.withColumn("part", F.coalesce("__own", "__shared", F.lit(0))).drop("__cost", "__bucket", "__own", "__shared").repartitionById(parts, "part")
