"""What an export's folders hold: discovery by years and albums, albums of entities, statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import names
from lumenarc.operators.entities import ENTITY

# Policies under which an entity's every file comes out, and those under which its primary alone does.
ALL_FILES, PRIMARY_ONLY = ["shortcut", "reverse-shortcut", "duplicate-copy"], ["json", "nothing"]


def discover(files: DataFrame, root: str, sidecar_fields: DataFrame | None = None) -> DataFrame:
    """Media below the year and album folders that lie directly in ``root``.

    files(file_id, path, ext) give file_id, phase (0 years, 1 albums, which is
    the order they are taken in), album (the folder in ``root``, null for
    years), dir (the file's own folder) and partner_shared. A folder in
    ``root`` is an album if a media file lies in it directly; others, and files
    in ``root`` itself, are left out. A file without a sidecar isn't shared.
    """
    inner = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    media = files.filter(F.col("path").startswith(root.rstrip("/") + "/") & F.col("ext").isin(names.MEDIA_EXTENSIONS))
    parts = media.select("file_id", F.regexp_extract(inner, "^([^/]+)/", 1).alias("top"), names.directory(inner).alias("below"), names.directory(F.col("path")).alias("dir")).filter("top <> ''")
    year = names.is_year_folder(F.col("top"))
    direct = F.col("top") == F.col("below")
    # Nearly all files are known by themselves; only those deeper in an album need to know of the files above.
    known, deeper = parts.filter(year | direct), parts.filter(~year & ~direct)
    albums = parts.filter(~year & direct).select("top").distinct()
    found = known.unionByName(deeper.join(albums, "top", "left_semi"))
    found = found.select("file_id", F.when(year, 0).otherwise(1).alias("phase"), F.when(~year, F.col("top")).alias("album"), "dir")
    if sidecar_fields is None:
        return found.withColumn("partner_shared", F.lit(False))
    shared = sidecar_fields.filter("partner_shared").select("file_id", F.lit(True).alias("shared"))
    return found.join(shared, "file_id", "left").withColumn("partner_shared", F.coalesce("shared", F.lit(False))).drop("shared")


def entity_albums(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """entity columns, album, dir: the albums of each entity's files, each folder once.

    To the albums of ``found`` (file_id, album, dir: what discovery saw) come
    those that files outside year folders show by the folder they lie in.
    """
    shown = files.filter(~names.is_canonical(F.col("folder")) & (F.col("folder") != "")).select(*ENTITY, F.col("folder").alias("album"), names.directory(F.col("path")).alias("dir"))
    if found is not None:
        seen = found.filter("album is not null").select("file_id", "album", "dir")
        shown = shown.unionByName(files.select("file_id", *ENTITY).join(seen, "file_id").select(*ENTITY, "album", "dir"))
    return shown.distinct()


def album_statistics(files: DataFrame, albums: DataFrame) -> DataFrame:
    """One row: entities, those in albums, in year folders only, different albums, entities in several of them."""
    of = albums.groupBy(*ENTITY).agg(F.countDistinct("album").alias("albums"))
    entities = files.groupBy(*ENTITY).agg(F.bool_or(names.in_year_folder(names.directory(F.col("path")))).alias("in_year"))
    n = F.coalesce("albums", F.lit(0))
    counts = entities.join(of, ENTITY, "left").agg(F.count("*").alias("entities"), F.count_if(n > 0).alias("album_entities"), F.count_if((n == 0) & F.col("in_year")).alias("year_only_entities"), F.count_if(n > 1).alias("multi_album_entities"))
    return counts.crossJoin(albums.agg(F.countDistinct("album").alias("different_albums")))  # one row each


def only_in(files: DataFrame, albums: DataFrame, years: bool) -> DataFrame:
    """Entities without any album that lie in a year folder (``years``), or those that an album holds."""
    held = albums.select(*ENTITY).distinct()
    if not years:
        return files.select(*ENTITY).distinct().join(held, ENTITY, "left_semi")
    return files.filter(names.in_year_folder(names.directory(F.col("path")))).select(*ENTITY).distinct().join(held, ENTITY, "left_anti")


def output_count(policy: str) -> Column:
    """How many files come out of rows with a ``role``, as an aggregate; a policy that has no such number is an error."""
    if policy in ALL_FILES:
        return F.count_if(F.col("role") != "duplicate")
    if policy in PRIMARY_ONLY:
        return F.count_if(F.col("role") == "primary")
    raise ValueError(f"no number of output files is defined for {policy}; there is one for {', '.join(ALL_FILES + PRIMARY_ONLY)}")


def output_counts(roles: DataFrame) -> DataFrame:
    """policy, files: the number for each policy that has one, all of one pass."""
    policies = ALL_FILES + PRIMARY_ONLY
    counts = roles.agg(*(output_count(p).alias(p) for p in policies))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("files")) for p in policies))).alias("o")).select("o.*")
