"""Equal content: groups, keepers, roles, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions import names


#: Bits of the map of shared sizes: half a megabyte is broadcast, whatever the number of sizes.
SLOTS = 1 << 22


def of_shared_size(files: DataFrame) -> DataFrame:
    """The files whose size another file has too, and a few others whose size falls into the same slot of the map.

    All that are left out have a content of their own, which need not be hashed.
    Sizes are counted without any content, and contents are not shuffled.
    """
    slot = F.pmod(F.xxhash64("size"), F.lit(SLOTS))
    shared = files.groupBy("size").agg(F.count("*").alias("n")).filter("n > 1")
    maps = shared.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("map"))
    bit = F.bitmap_bit_position(slot)
    held = F.conv(F.hex(F.substring("map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = files.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col("bucket"))
    return found.filter(F.getbit(held, (bit % 8).cast("int")) == 1).select(*files.columns)


def content_groups(files: DataFrame, by_ext: bool = False, content: str = "text") -> DataFrame:
    """sha256, size (and ext) of contents that several files have, members and wasted bytes.

    Sizes come first; only contents of a size that several files have are
    hashed. Only (size, hash) is shuffled, combined before; contents never are.
    """
    files = of_shared_size(files)
    keys = ["size", "sha256", *(["ext"] if by_ext else [])]
    hashed = files.withColumn("sha256", F.sha2(F.col(content), 256)).select(*keys)
    groups = hashed.groupBy(*keys).agg(F.count("*").alias("members")).filter("members > 1")
    return groups.withColumn("wasted", F.col("size") * (F.col("members") - 1))


def head_groups(files: DataFrame, head: int, content: str = "text") -> DataFrame:
    """Groups by size and the MD5 of the first ``head`` characters: candidates for equal content."""
    keyed = files.select("size", F.md5(F.substring(F.col(content), 1, head)).alias("head_md5"))
    return keyed.groupBy("size", "head_md5").agg(F.count("*").alias("members")).filter("members > 1")


def keeper_order() -> list[Column]:
    """More accurate date, then shorter name, no album, shorter path, the path."""
    return [F.coalesce("accuracy", F.lit(999)), F.length("name"), (~names.is_year_folder(F.col("folder"))).cast("int"), F.length("path"), F.col("path"), F.col("file_id")]


def keepers(files: DataFrame, dated: DataFrame, content: str = "text") -> DataFrame:
    """sha256, keeper, path: of each content the file that stays; a file without an accuracy comes last."""
    hashed = files.select("file_id", "size", F.sha2(F.col(content), 256).alias("sha256"), "folder", "name", "path")
    ranked = hashed.join(dated.select("file_id", "accuracy"), "file_id", "left")
    # A least value, combined before the shuffle: copies of one content don't meet in one task.
    first = ranked.groupBy("size", "sha256").agg(F.min_by(F.struct("file_id", "path"), F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keeper_order())))).alias("first"))
    return first.select("sha256", F.col("first.file_id").alias("keeper"), "first.path")


def identical(pairs: DataFrame, files: DataFrame, content: str = "text") -> DataFrame:
    """pairs(a, b) of file ids with ``same``: equal sizes and equal contents."""
    sides = [files.select(F.col("file_id").alias(x), F.col("size").alias(f"size_{x}"), F.sha2(F.col(content), 256).alias(f"sha_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", ((F.col("size_a") == F.col("size_b")) & (F.col("sha_a") == F.col("sha_b"))).alias("same"))


def roles(files: DataFrame, content: str = "text") -> DataFrame:
    """file_id, sha256, entity rank, folder rank and role of each file.

    The best-ranked file of a content is primary, the best of each other
    folder secondary, all others are duplicates.
    """
    ranked = files.withColumn("sha256", F.sha2(F.col(content), 256)).select("file_id", "sha256", "ext", "size", "folder", "name", "path")
    order = [(~names.in_year_folder(F.col("path"))).cast("int"), F.length("name"), F.length("path"), F.lower("path"), F.col("file_id")]
    entity = Window.partitionBy("size", "ext", "sha256").orderBy(*order)
    folder = Window.partitionBy("size", "ext", "sha256", "folder").orderBy(*order)
    ranked = ranked.withColumn("entity_rank", F.row_number().over(entity)).withColumn("folder_rank", F.row_number().over(folder))
    role = F.when(F.col("entity_rank") == 1, "primary").when((F.col("folder_rank") == 1), "secondary").otherwise("duplicate")
    # A folder's best file beside the primary in the primary's own folder is the primary itself.
    return ranked.withColumn("role", role)


def duplicate_stats(files: DataFrame, content: str = "text") -> DataFrame:
    groups = files.withColumn("sha256", F.sha2(F.col(content), 256)).groupBy("size", "sha256").agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("total_files"), F.count("*").alias("unique_files"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_files"), F.sum(F.col("size") * (F.col("n") - 1)).alias("wasted_bytes"))


def duplicate_share(stats: DataFrame) -> DataFrame:
    """duplicate_stats with the duplicates' share of all files in hundredths of a percent, 0 of none."""
    share = F.when(F.col("total_files") > 0, F.floor(F.col("duplicate_files") * 10_000 / F.col("total_files") + 0.5)).otherwise(0)
    return stats.withColumn("duplicate_share", share.cast("long"))
