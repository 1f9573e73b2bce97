"""Exact dedup with an extendible-hash index on shared files.

The 64-bit hash of a text is its key. A directory of ``2**depth`` slots maps
the leading bits of a key to a bucket; a bucket with more keys than its
capacity is split on its next bit, and the directory doubles when that bucket
already used all of the directory's bits. Texts are then dealt out by
bucket, key and bytes, and equal ones combined by comparing their bytes; the
different texts of a key (collisions) are chained within its bucket. The
entries are written below ``spark.checkpoint.dir``, and the
rows look their entry up in the same buckets, by key and digest.

A frequent text is one row per map task before it is dealt out; the looking-up
rows of a hot bucket are split over ``SPLIT`` tasks, to each of which a copy of
that bucket's entries goes.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import table
from lumenarc.runtime import Workspace

#: Leading bits of a key that the directory may use: at most 65,536 slots.
MAX_DEPTH = 16
#: Tasks over which the rows that look up a hot bucket are split.
SPLIT = 16


def directory(histogram: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """Slots of the directory, each with its bucket number.

    ``histogram`` has the keys per value of their first ``max_depth`` bits. A
    bucket splits while it has more than ``capacity`` keys and bits are left;
    the slots double whenever a bucket of full depth splits.
    """
    depth, slots, local, counts = 0, [0], {0: 0}, {0: sum(histogram.values())}
    members = {0: dict(histogram)}
    while over := [b for b, n in counts.items() if n > capacity and local[b] < max_depth]:
        for bucket in over:
            if local[bucket] == depth:
                slots = [b for b in slots for _ in range(2)]
                depth += 1
            bit = max_depth - local[bucket] - 1
            new = len(counts)
            ones = {k: n for k, n in members[bucket].items() if k >> bit & 1}
            for k in ones:
                del members[bucket][k]
            members[new] = ones
            local[bucket] = local[new] = local[bucket] + 1
            counts[new] = sum(ones.values())
            counts[bucket] -= counts[new]
            at = depth - local[bucket]
            slots = [new if b == bucket and i >> at & 1 else b for i, b in enumerate(slots)]
    return slots


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory_table(spark, slots: list[int]) -> DataFrame:
    """slot, bucket; made of one literal text, so that it needs no Python worker."""
    text = F.split(F.lit(",".join(map(str, slots))), ",")
    return spark.range(1).select(F.posexplode(text).alias("slot", "b")).select(F.col("slot").cast("long").alias("slot"), F.col("b").cast("int").alias("bucket"))


def dealt(rows: DataFrame, dirs: DataFrame, bits: int) -> DataFrame:
    """rows with the bucket of their key. At most 2**MAX_DEPTH slots are broadcast."""
    return rows.withColumn("slot", prefix(F.col("key"), bits)).join(F.broadcast(dirs), "slot").drop("slot")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int | None = None, work: Workspace | None = None, key=F.xxhash64) -> tuple[DataFrame, DataFrame, int]:
    """The index, one row per different text; its directory (slot, bucket) and the bits that a slot has.

    Columns bucket, key, chain (place among the texts of a key), text_sha256,
    keep_id (largest id; null only if all are null), group_size. A null text
    counts as the empty text; an empty table gives an empty index.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "exact-dedup")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    base = base.withColumn("key", key(F.col("body")))
    keys = base.groupBy("key").agg(F.count("*").alias("n"))
    histogram = {r["p"]: r["n"] for r in keys.groupBy(prefix(F.col("key"), MAX_DEPTH).alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    slots = directory(histogram, capacity or max(1024, total // 4096))
    bits = len(slots).bit_length() - 1
    dirs = work.save(directory_table(spark, slots), "directory")
    # Equal bytes of a bucket's key become one entry, combined before they are dealt out.
    entries = dealt(base, dirs, bits).groupBy("bucket", "key", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = work.save(entries.select("bucket", "key", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
    return work.save(entries.withColumn("chain", chain), "index"), dirs, bits


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int | None = None, key=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of equal texts the row with the largest doc_id stays. Rows that repeat an
    id and its text are alike, so all of them carry ``kept`` = true or none
    does; a row without id stays only if its whole group has none. ``key`` is
    the hash that leads to a bucket; texts that share it are told apart.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    index, dirs, bits = build_index(docs, text, doc_id, capacity, work, key)
    # Hot buckets: those with over a thousandth of all rows, so fewer than a thousand.
    sizes = work.save(index.groupBy("bucket").agg(F.sum("group_size").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.filter(F.col("n") > total / 1000).select("bucket", F.lit(SPLIT).alias("ways")))
    entries = index.join(hot, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(1), F.coalesce("ways", F.lit(1)))))
    entries = entries.select("bucket", "part", F.col("key").alias("k"), F.col("text_sha256").alias("s"), "keep_id", "group_size")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = dealt(rows.select("doc_id", key(F.col("body")).alias("key"), F.sha2("body", 256).alias("text_sha256")), dirs, bits).join(hot, "bucket", "left")
    rows = rows.withColumn("part", F.when(F.col("ways").isNull(), 1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("ways")).cast("int") + 1)).drop("ways")
    found = rows.join(entries, (rows["bucket"] == entries["bucket"]) & (rows["part"] == entries["part"]) & (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("s")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", rows["bucket"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).drop("bucket")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
