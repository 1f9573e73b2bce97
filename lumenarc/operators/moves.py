"""Move plans: one row per operation that would organise the archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import dates, names

POLICIES = ["shortcut", "reverse-shortcut", "duplicate-copy", "json", "nothing", "ignore"]


def main_directory(taken: Column, division: int, partner_shared: Column | None = None) -> Column:
    """Where photos of a date go; those a partner shared into a tree of their own, if told which."""
    mine = F.concat_ws("/", F.lit("ALL_PHOTOS"), F.when(F.lit(division) > 0, dates.date_folder(taken, division)))
    return mine if partner_shared is None else F.when(partner_shared, F.concat(F.lit("PARTNER_SHARED/"), mine)).otherwise(mine)


def album_directory(album: Column) -> Column:
    """Albums are never divided by date; untitled ones have a tree of their own."""
    top = F.when(names.is_untitled(album), "Untitled Albums/").otherwise("Albums/")
    return F.concat(top, F.when(F.trim(album) == "", album).otherwise(F.trim(album)))


def plan(roles: DataFrame, dated: DataFrame, policy: str, division: int = 2) -> DataFrame:
    """entity (sha256), file_id, op, target for the primary and secondary files of each entity.

    Files in a special folder go to it under every policy. A file in a year
    folder is canonical; others belong to the album their folder names.
    """
    rows = roles.filter("role <> 'duplicate'").join(dated.select("file_id", "taken"), "file_id", "left")
    canonical, special = names.is_canonical(F.col("folder")), names.special_folder(F.col("path"))
    rows = rows.withColumns({"canonical": canonical, "special": special})
    main = main_directory(F.col("taken"), division)
    group = ["size", "ext", "sha256"]
    some = rows.groupBy(*group).agg(F.bool_or("canonical").alias("any_canonical"), F.min(F.when(F.col("canonical"), F.col("entity_rank"))).alias("best_canonical"), F.min(F.when(~F.col("canonical"), F.col("entity_rank"))).alias("best_album"))
    rows = rows.join(some, group)
    album = album_directory(F.col("folder"))
    is_canonical, first = F.col("canonical"), F.col("entity_rank") == F.coalesce("best_canonical", F.lit(1))

    def op(name: str, target: Column) -> Column:
        return F.struct(F.lit(name).alias("op"), target.alias("target"))

    if policy == "shortcut":
        ops = F.array_compact(F.array(F.when(first, op("move", main)), F.when(~is_canonical, op("symlink", album)), F.when(~first & ~is_canonical, op("delete", F.lit(""))), F.when(is_canonical & ~first, op("leave", F.lit("")))))
    elif policy == "reverse-shortcut":
        ops = F.array(F.when(~is_canonical, op("move", album)).when(F.col("best_album").isNotNull(), op("reverse_symlink", main)).otherwise(F.when(F.col("entity_rank") == 1, op("move", main)).otherwise(op("leave", F.lit("")))))
    elif policy == "duplicate-copy":
        ops = F.array_compact(F.array(F.when(is_canonical, op("move", main)).otherwise(op("move", album)), F.when(~F.col("any_canonical") & (F.col("entity_rank") == 1), op("copy", main))))
    elif policy == "json":
        ops = F.array_compact(F.array(F.when(F.col("entity_rank") == 1, op("move", main)).otherwise(op("delete", F.lit(""))), F.when(~is_canonical, op("json_reference", album))))
    elif policy == "nothing":
        ops = F.array(F.when(F.col("entity_rank") == 1, op("move", main)).otherwise(op("delete", F.lit(""))))
    elif policy == "ignore":
        ops = F.array(F.when(is_canonical, op("move", main)).otherwise(op("delete", F.lit(""))))
    else:
        raise ValueError(f"no such policy: {policy}")
    ops = F.when(F.col("special").isNotNull(), F.array(op("move", F.concat(F.lit("Special Folders/"), F.col("special"))))).otherwise(ops)
    return rows.select("sha256", "file_id", F.explode(ops).alias("o")).select("sha256", "file_id", "o.op", "o.target")


def unique_names(files: DataFrame) -> DataFrame:
    """Names that are free in their folder: ``name(n).ext`` from the second on, by file_id."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("folder", F.lower("name")).orderBy("file_id")) - 1
    free = F.when(n == 0, F.col("name")).otherwise(F.concat(names.stem(F.col("name")), F.lit("("), n.cast("string"), F.lit(")."), F.col("ext")))
    return files.select("file_id", "folder", free.alias("unique_name"))
