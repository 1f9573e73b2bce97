"""Documents into shards of near-equal sizes by longest-processing-time scheduling.

Documents of equal text form a group that stays together; a group's size is the
sum of its documents'. Groups go by falling size to the least-loaded shard,
which a heap gives. Groups that hold over ``1 / LARGE`` of all bytes or rows are
few (at most twice ``LARGE``) and scheduled first, on the driver, by size and
count alone. All others are dealt by their digest into parts; each part keeps
its own heap, which starts with the part's share of the loads so far, so that
every part levels what the large groups left uneven. Parts stream their groups
sorted; a task holds one heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import table
from lumenarc.runtime import Workspace, ship

SHARDS = 8
#: A group with over this part of all bytes or rows is scheduled before the others.
LARGE = 65_536
#: Groups a part has on average; and how often at least the largest of the other groups goes into a shard's share of a part.
#: So there are at most LARGE / (FIT * shards) parts, of which the driver gets one row each.
PART_GROUPS, FIT = 1 << 18, 16
#: Rows a slot range has on average, and ranges of a shard there are at most.
RANGE_ROWS, RANGES = 1 << 16, 1 << 16


class Heap:
    """The shards by their load, the least-loaded on top; of equal ones, shard ``first`` and then those after it."""

    def __init__(self, loads: list[float], first: int = 0):
        self.heap = [(load, (i - first) % len(loads), i) for i, load in enumerate(loads)]
        heapq.heapify(self.heap)

    def place(self, size: int) -> int:
        """The shard of the next group; sizes come in falling order."""
        load, turn, i = self.heap[0]
        heapq.heapreplace(self.heap, (load + size, turn, i))
        return i


def assigned(groups: DataFrame, shards: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """groups(digest, bytes, n), all different, with their shard: (large ones, few; all others)."""
    spark = groups.sparkSession
    count, total, rows = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    is_large = (F.col("bytes") * LARGE > total) | (F.col("n") * LARGE > rows)
    # In a falling order that any run repeats.
    top = groups.filter(is_large).select("digest", "bytes").orderBy(F.desc("bytes"), "digest").collect()
    heap = Heap([0.0] * shards)
    chosen = [heap.place(r["bytes"]) for r in top]
    loads = [float(sum(r["bytes"] for r, s in zip(top, chosen, strict=True) if s == i)) for i in range(shards)]
    large = spark.createDataFrame([(bytes(r["digest"]), s) for r, s in zip(top, chosen, strict=True)], "digest binary, shard int")
    parts = max(1, min(LARGE // (FIT * shards), count // PART_GROUPS))
    small = groups.filter(~is_large).select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part"))
    shares = {r["part"]: r["b"] for r in small.groupBy("part").agg(F.sum("bytes").alias("b")).collect()}
    rest = sum(shares.values())
    starts = {p: [load * b / rest for load in loads] for p, b in shares.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, heap = None, None
        for batch in batches:
            out = []
            for p, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if p != part:
                    part, heap = p, Heap(starts[p], p % shards)
                out.append(heap.place(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], ["digest", "shard"])

    ship(spark)
    sorted_ = small.select("digest", "part", "bytes").repartition("part").sortWithinPartitions("part", F.desc("bytes"), "digest")
    return large, work.save(sorted_.mapInArrow(deal, "digest binary, shard int"), "small")


def numbered(rows: DataFrame, count: int, key: str, name: str, work: Workspace) -> DataFrame:
    """rows, ``count`` of them, with ``name``: their places among those of equal key, gapless from 0.

    Rows are dealt at random over ranges of each key, and a range starts where
    those before it end: no task orders all rows of a key. Saved once dealt, so
    that a task that runs again sees the same ranges.
    """
    ranges = max(1, min(RANGES, count // RANGE_ROWS))
    dealt = work.save(rows.withColumn("__range", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ranges)).cast("int")), "dealt")
    counts = dealt.groupBy(key, "__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("__range")) - F.col("n")
    starts = work.save(counts.select(key, "__range", before.alias("__start")), "starts")
    if ranges <= 1 << 13:
        starts = F.broadcast(starts)
    own = F.row_number().over(Window.partitionBy(key, "__range").orderBy(*rows.columns)) - 1
    return dealt.withColumn("__own", own).join(starts, [key, "__range"]).withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__own", "__start", "__range")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1), text_crc32, shard, slot (gapless from 0 in each shard).

    Equal texts (SHA-256) share a shard; a null text is one with the empty
    text. Rows that repeat an id and a text, and rows without an id, are
    documents of their own. A group larger than a shard's even share has its
    shard's load to itself as far as it goes, and the others level. An empty
    table gives an empty one. Other columns are not looked at.
    """
    work = Workspace(docs.sparkSession, "sharding")
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    thin = work.save(thin, "thin")
    groups = work.save(thin.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    large, small = assigned(groups, shards, work)
    # Rows of large groups meet their shard without a shuffle; no group among the others is hot.
    large = F.broadcast(large)
    found = thin.join(large, "digest").unionByName(thin.join(large, "digest", "left_anti").join(small, "digest"))
    return numbered(found.select("doc_id", "size", "text_crc32", "shard"), thin.count(), "shard", "slot", work)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
