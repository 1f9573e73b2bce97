"""The plan of what is written into the files that came out: natively, or queued as tags for an outside tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import dates, names
from lumenarc.operators import tags

# Extensions that are written natively, and as XMP.
NATIVE, XMP = ["jpg", "jpeg"], ["png"]


def xmp_tags(taken: Column, method: Column, latitude: Column, longitude: Column) -> Column:
    """Map of XMP names: the date three times, with its offset if it is UTC, and signed coordinates."""
    clock = dates.xmp_clock(taken, method)
    place = tags.valid_coordinate(latitude) & tags.valid_coordinate(longitude)
    found = [F.when(taken.isNotNull(), F.struct(F.lit(t).alias("k"), clock.alias("v"))) for t in tags.XMP_DATES]
    found += [F.when(place, F.struct(F.lit(t).alias("k"), x.cast("string").alias("v"))) for t, x in (("XMP:GPSLatitude", latitude), ("XMP:GPSLongitude", longitude))]
    return F.map_from_entries(F.array_compact(F.array(*found)))


def outputs(plan: DataFrame, files: DataFrame, existing: DataFrame, moved: tuple[str, ...] = ("move", "copy")) -> DataFrame:
    """file_id, path of the files of plan(file_id, op, target) that are no links and that existing(path) lists.

    Deleted and left files have no place of their own; links share another's content.
    """
    placed = plan.filter(F.col("op").isin(*moved)).join(files.select("file_id", "name"), "file_id").select("file_id", F.concat_ws("/", "target", "name").alias("path"))
    return placed.join(existing.select("path").distinct(), "path", "left_semi").select("file_id", "path")


def tag_plan(written: DataFrame, entity_of: DataFrame, forced_xmp: DataFrame | None = None) -> DataFrame:
    """What each file of written(file_id, path) gets.

    entity_of(file_id, ext, is_primary, taken, method, latitude, longitude)
    has the date of the file's entity and the position of its primary file.
    ``native``: what the JPEG writer is to write, ``date+gps``, ``date`` or
    ``gps``; ``queued``: the tags for the tool whatever happens; ``fallback``:
    the tags to queue instead should the native write fail; ``skipped``: the
    format, if no writer takes it. forced_xmp(path) are JPEG files that the
    native writer refused before: they are queued under XMP names. Files with
    neither date nor valid position are left out.
    """
    rows = written.join(entity_of, "file_id")
    if forced_xmp is not None:
        rows = rows.join(forced_xmp.select("path", F.lit(True).alias("forced")).distinct(), "path", "left")
    else:
        rows = rows.withColumn("forced", F.lit(None).cast("boolean"))
    dated = F.col("taken").isNotNull()
    placed = tags.valid_coordinate(F.col("latitude")) & tags.valid_coordinate(F.col("longitude"))
    jpeg, utc = F.col("ext").isin(*NATIVE), F.coalesce(F.col("method").isin("json", "jsonTryHard"), F.lit(False))
    native = jpeg & F.col("forced").isNull()
    given = [F.col(c) for c in ("taken", "method", "latitude", "longitude")]
    whole, xmp = tags.tags_of(*given), xmp_tags(*given)
    none = F.lit(None).cast("double")
    # A date in UTC needs its offset beside it, which the native writer doesn't write.
    beside = F.when(dated & utc, tags.tags_of(F.col("taken"), F.col("method"), none, none))
    queued = F.when(native, beside).when(jpeg | F.col("ext").isin(*XMP), xmp).otherwise(whole)
    skipped = F.when(~native, tags.unsupported(F.col("ext"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return rows.filter(dated | placed).select(
        "file_id", "path", "is_primary",
        F.when(native, F.when(dated & placed, "date+gps").when(dated, "date").otherwise("gps")).alias("native"),
        F.when(skipped.isNull(), tags.tag_key(queued)).alias("queued"),
        F.when(native, tags.tag_key(whole)).alias("fallback"),
        skipped.alias("skipped"),
        F.col("ext").isin(names.VIDEO_EXTENSIONS).alias("is_video"),
    )


def after_native(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """file_id, path, is_video, queued: the tool's tags once the native writer is done; failed(file_id) get their fallback."""
    back = failed.select("file_id", F.lit(True).alias("failed")).distinct()
    tags_ = F.when(F.col("failed") & F.col("native").isNotNull(), F.col("fallback")).otherwise(F.col("queued"))
    return plan.join(back, "file_id", "left").select("file_id", "path", "is_video", tags_.alias("queued")).filter("queued is not null")


def written_counts(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: files with a date and with a position written natively, and files queued, of primary and of other files."""
    done = plan.join(failed.select("file_id").distinct(), "file_id", "left_anti").filter("native is not null")
    has = lambda what, primary: F.count_if(F.col("native").contains(what) & (F.col("is_primary") == primary))
    wide = done.agg(has("date", True).alias("dates_primary"), has("date", False).alias("dates_other"), has("gps", True).alias("gps_primary"), has("gps", False).alias("gps_other"))
    return wide.crossJoin(after_native(plan, failed).agg(F.count("*").alias("queued")))  # one row each
