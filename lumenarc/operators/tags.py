"""What is written into files: tags, their sets and batches, and what comes back as errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions import dates
from lumenarc.runtime import Workspace

# Endings of files that no writer takes, tags of a date, those that a date is read from, extensions that an error's paths may have, and
# files of one batch.
NOT_WRITTEN = ["avi", "mpg", "mpeg", "bmp"]
DATE_TAGS = ["DateTimeOriginal", "DateTimeDigitized", "DateTime"]
XMP_DATES = ["XMP:CreateDate", "XMP:DateTimeOriginal", "XMP:ModifyDate"]
DATE_READ = ["DateTimeOriginal", "DateTime", "CreateDate", "DateCreated", "CreationDate", "MediaCreateDate", "TrackCreateDate", "EncodedDate", "MetadataDate", "ModifyDate"]
ERROR_EXTENSIONS = ["jpg", "jpeg", "png", "heic", "tif", "tiff", "mp4", "mov", "avi", "mpg", "mpeg"]
IMAGE_BATCH, VIDEO_BATCH = 100, 24
PARTS = 16


def unsupported(ext: Column, by_content: Column, by_name: Column) -> Column:
    """AVI, MPEG or BMP for files that no writer takes, by extension or one of two types; else null."""
    either = lambda test: F.coalesce(test(by_content), F.lit(False)) | F.coalesce(test(by_name), F.lit(False))
    return (
        F.when((ext == "avi") | either(lambda m: m == "video/x-msvideo"), "AVI")
        .when(ext.isin("mpg", "mpeg") | either(lambda m: m.contains("mpeg")), "MPEG")
        .when((ext == "bmp") | either(lambda m: m == "image/bmp"), "BMP")
    )


def valid_coordinate(x: Column) -> Column:
    """A number that is there, is one, and is not 0."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (x != 0), F.lit(False))


def read_dates(tags: DataFrame, by: list[str]) -> DataFrame:
    """by, earliest and first of tags(.., tag, value): the earliest usable date of all, and that of the first tag, in order of DATE_READ, that has one.

    Placeholders, sentinels and other tags are no dates; without any, both are null.
    """
    rank = F.array_position(F.array(*map(F.lit, DATE_READ)), F.col("tag"))
    rows = tags.select(*by, F.when(rank > 0, rank).alias("rank"), dates.from_text(F.when(rank > 0, F.col("value"))).alias("taken"))
    return rows.groupBy(*by).agg(F.min("taken").alias("earliest"), F.min_by("taken", F.when(F.col("taken").isNotNull(), F.struct("rank", "taken"))).alias("first"))


def dms(x: Column) -> Column:
    """degrees, minutes and the hundredths of seconds of a coordinate's size; rounding carries over into minutes and degrees."""
    hundredths = F.floor(F.abs(x) * 360_000 + 0.5).cast("long")
    return F.struct(F.floor(hundredths / 360_000).cast("int").alias("degrees"), (F.floor(hundredths / 6_000) % 60).cast("int").alias("minutes"), (hundredths % 6_000).cast("int").alias("seconds"), F.lit(100).alias("per_second"))


def tags_of(taken: Column, method: Column, latitude: Column, longitude: Column) -> Column:
    """Map of tag and text: the date three times, its offset if it is UTC, and a valid position with its directions."""
    clock, utc = dates.exif_clock(taken), method.isin("json", "jsonTryHard")
    offset = [F.when(utc, F.struct(F.lit(t).alias("k"), F.lit('"+00:00"').alias("v"))) for t in ("OffsetTime", "OffsetTimeOriginal", "OffsetTimeDigitized")]
    date = [F.when(clock.isNotNull(), F.struct(F.lit(t).alias("k"), clock.alias("v"))) for t in DATE_TAGS]
    at = valid_coordinate(latitude) & valid_coordinate(longitude)
    place = [
        F.when(at, F.struct(F.lit(tag).alias("k"), value.alias("v")))
        for tag, value in (
            ("GPSLatitude", F.abs(latitude).cast("string")), ("GPSLatitudeRef", F.when(latitude < 0, "S").otherwise("N")),
            ("GPSLongitude", F.abs(longitude).cast("string")), ("GPSLongitudeRef", F.when(longitude < 0, "W").otherwise("E")),
        )
    ]
    return F.map_from_entries(F.array_compact(F.array(*date, *offset, *place)))


def as_xmp(tags: Column) -> Column:
    """A JPEG's tags under their XMP names: the first date there is, for all three, and signed coordinates."""
    date = F.coalesce(*(F.try_element_at(tags, F.lit(t)) for t in DATE_TAGS))

    def signed(tag: str, negative: str) -> Column:
        size = F.regexp_replace(F.try_element_at(tags, F.lit(tag)), '"', "").try_cast("double")
        return F.when(F.upper(F.try_element_at(tags, F.lit(f"{tag}Ref"))) == negative, -size).otherwise(size)

    lat, lon = signed("GPSLatitude", "S"), signed("GPSLongitude", "W")
    plain = F.map_filter(tags, lambda k, v: ~k.isin(*DATE_TAGS) & ~k.startswith("GPSL"))
    new = [F.when(date.isNotNull(), F.struct(F.lit(t).alias("k"), date.alias("v"))) for t in XMP_DATES]
    new += [F.when(lat.isNotNull() & lon.isNotNull(), F.struct(F.lit(t).alias("k"), v.cast("string").alias("v"))) for t, v in (("XMP:GPSLatitude", lat), ("XMP:GPSLongitude", lon))]
    return F.map_concat(plain, F.map_from_entries(F.array_compact(F.array(*new))))


def tag_key(tags: Column) -> Column:
    """``k=v`` of all tags in order, parted by ``;``: equal for equal sets."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def batches(files: DataFrame, by: list[str], is_video: Column, order: str = "file_id") -> DataFrame:
    """files with a batch number per ``by``: at most 100 images or 24 films each.

    Numbers run on over parts of a group, so that one frequent tag set is not
    numbered by one task.
    """
    # Written, as it is used twice and what makes it is dear.
    parted = Workspace(files.sparkSession, "batches").save(files.withColumn("part", F.pmod(F.xxhash64(order), F.lit(PARTS))), "parted")
    sizes = parted.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("start", before).drop("n")
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy(order)) - 1
    cap = F.when(is_video, VIDEO_BATCH).otherwise(IMAGE_BATCH)
    return parted.withColumn("place", place).join(starts, [*by, "part"]).withColumn("batch", F.floor((F.col("place") + F.col("start")) / cap)).drop("part", "place", "start")


def bad_paths(errors: DataFrame, text: str = "error", keep: list[str] | None = None) -> DataFrame:
    """path (and ``keep``), different ones: absolute paths that the lines of error texts name after `` - `` or in quotes, with a known extension."""
    keep = keep or []
    lines = errors.select(*keep, F.explode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("line"))
    path = rf"((?:/|[A-Za-z]:[/\\]).*\.(?:{'|'.join(ERROR_EXTENSIONS)}))"
    found = F.concat(*(F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in (rf"(?i) - {path}\s*$", rf"(?i)'{path}'", rf'(?i)"{path}"')))
    return lines.select(*keep, F.explode(found).alias("path")).distinct()


def touched(marks: DataFrame) -> DataFrame:
    """Files written, by primary and other: of marks(path, is_primary) a file counts once, as primary if any mark says so."""
    once = marks.groupBy("path").agg(F.bool_or("is_primary").alias("is_primary"))
    return once.agg(F.count_if("is_primary").alias("primary_files"), F.count_if(~F.col("is_primary")).alias("other_files"))
