"""Entities: one per content, with its files, albums and best date; statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions import names, repairs

ENTITY = ["size", "ext", "sha256"]


def best_media(roles: DataFrame, dated: DataFrame) -> DataFrame:
    """sha256, ext, best, albums: the file with the most accurate date, then one in an album, then the shorter path, then the lesser path."""
    rows = roles.join(dated.select("file_id", "accuracy"), "file_id")
    album = F.when(~names.is_canonical(F.col("folder")), F.col("folder"))
    order = F.struct("accuracy", names.is_canonical(F.col("folder")).cast("int").alias("no_album"), F.length("path").alias("length"), "path", "file_id")
    return rows.groupBy(*ENTITY).agg(F.min_by("file_id", order).alias("best"), F.countDistinct(album).alias("albums")).select("sha256", "ext", "best", "albums")


def merged(roles: DataFrame, dated: DataFrame) -> DataFrame:
    """One row per entity: its primary file, how many others it has, its albums (in order, parted by |), its best date.

    Only folder names are gathered, each once; an entity has as many files as it may.
    """
    rows = roles.join(dated.select("file_id", "taken", "accuracy"), "file_id")
    album = F.when(~names.is_canonical(F.col("folder")), F.col("folder"))
    of_role = lambda r: F.col("role") == r
    best = F.min_by("taken", F.struct("accuracy", "entity_rank"))
    found = rows.groupBy(*ENTITY).agg(
        F.min(F.when(of_role("primary"), F.col("file_id"))).alias("primary_file"),
        F.count_if(of_role("secondary")).alias("secondaries"),
        F.count_if(of_role("duplicate")).alias("duplicates"),
        F.array_join(F.array_sort(F.collect_set(album)), "|").alias("albums"),
        F.date_format(best, "yyyy-MM-dd HH:mm:ss").alias("taken"),
        F.min("accuracy").alias("accuracy"),
    )
    return found.drop("size").select("sha256", "ext", "primary_file", "secondaries", "duplicates", "albums", "taken", "accuracy")


def grouping_stats(files: DataFrame, content: str = "text") -> DataFrame:
    """How sizes alone divide the files, before any content is hashed, and how many contents there are."""
    contents = files.select("size", F.sha2(F.col(content), 256).alias("sha256")).groupBy("size", "sha256").agg(F.count("*").alias("n"))
    sizes = contents.groupBy("size").agg(F.sum("n").alias("n"), F.count("*").alias("contents"))
    return sizes.agg(F.count("*").alias("size_buckets"), F.count_if(F.col("n") == 1).alias("single_buckets"), F.count_if(F.col("n") > 1).alias("shared_buckets"), F.sum("contents").alias("contents"), F.max("n").alias("largest"))


def collection_stats(roles: DataFrame, dated: DataFrame) -> DataFrame:
    rows = roles.join(dated.select("file_id", "accuracy"), "file_id")
    of = rows.groupBy(*ENTITY).agg(F.count("*").alias("n"), F.bool_or(F.col("accuracy") < 99).alias("dated"), F.bool_or(~names.is_canonical(F.col("folder"))).alias("in_album"))
    return of.agg(F.count("*").alias("entities"), F.count_if("dated").alias("dated"), F.count_if("in_album").alias("in_album"), F.sum(F.col("n") - 1).alias("more_files"))


def album_kinds(files: DataFrame, content: str = "text") -> DataFrame:
    """How many contents are in year folders only, in albums only, in both."""
    canonical = names.is_canonical(F.col("folder"))
    of = files.withColumn("sha256", F.sha2(F.col(content), 256)).groupBy(*ENTITY).agg(F.bool_or(canonical).alias("c"), F.bool_or(~canonical).alias("a"))
    kind = F.when(F.col("c") & F.col("a"), "both").when(F.col("a"), "album only").otherwise("year only")
    return of.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def membership(files: DataFrame) -> DataFrame:
    """file_id, album of each album folder in which, or anywhere below which, a file lies.

    A file's folders (itself and all above) are exploded, so that the prefix
    test is an equi-join.
    """
    albums = files.filter(~names.is_canonical(F.col("folder"))).select(names.directory(F.col("path")).alias("dir"), F.col("folder").alias("album")).distinct()
    parts = F.split(names.directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("file_id", F.explode(above).alias("dir")).join(albums, "dir").select("file_id", "album").distinct()


def extension_fixes(files: DataFrame, skip_jpeg: bool = False) -> DataFrame:
    """file_id, mime, new_name of files(file_id, folder, name, ext, head) whose content is of another type than the name says.

    Left as they are: unknown and TIFF contents (raw formats look like it),
    JPEG ones if asked, edited copies, and files whose new name is taken.
    """
    preferred = F.create_map(*(F.lit(x) for pair in names.PREFERRED_EXTENSION.items() for x in pair))
    synonyms = F.when(F.col("ext") == "jpeg", "jpg").otherwise(F.col("ext"))
    rows = files.withColumn("mime", repairs.type_by_content(F.col("head"))).withColumn("new_ext", F.try_element_at(preferred, F.col("mime")))
    rows = rows.filter(F.col("new_ext").isNotNull() & (F.col("new_ext") != synonyms) & ~names.is_edited(F.col("name")) & ~(F.lit(skip_jpeg) & (F.col("mime") == "image/jpeg")))
    rows = rows.select("file_id", "folder", "mime", F.concat_ws(".", "name", "new_ext").alias("new_name"))
    taken = files.select("folder", F.col("name").alias("new_name"))
    return rows.join(taken, ["folder", "new_name"], "left_anti").select("file_id", "mime", "new_name")


def remaining(entities: DataFrame, merged_away: DataFrame) -> DataFrame:
    """entities(entity, ..) without those that merged_away(entity) names."""
    return entities.join(merged_away.select("entity"), "entity", "left_anti")


def all_files(one: DataFrame, other: DataFrame) -> DataFrame:
    """The files of both lists, each (source, target, link) once."""
    return one.unionByName(other).dropDuplicates(["source", "target", "link"])


def reserved_names(links: DataFrame) -> DataFrame:
    """links(entity, album, file_id, base) with the name each link takes in its album: ``base``, then ``stem(n).ext``."""
    n = F.row_number().over(Window.partitionBy("entity", "album", "base").orderBy("file_id")) - 1
    ext = F.regexp_extract("base", r"^.+(\.[^.]*)$", 1)
    return links.withColumn("link_name", F.when(n == 0, F.col("base")).otherwise(F.concat(names.stem(F.col("base")), F.lit("("), n.cast("string"), F.lit(")"), ext)))
