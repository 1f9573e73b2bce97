"""Documents whose fields nobody fixes, as VARIANT: sidecars and dictionaries of dates.

A document is parsed once; fields are taken by path and type, unknown ones stay,
and it is written back without loss. What does not parse is a row with a
null document, never an error of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import dates, names


def parsed(text: Column) -> Column:
    """The document as VARIANT; null for text that is no JSON. What follows the first value is not looked at."""
    return F.try_parse_json(text)


def field(document: Column, path: str, kind: str = "string") -> Column:
    """The value at ``path`` as ``kind``; null if it is missing or of another kind."""
    return F.try_variant_get(document, path, kind)


def documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """path, dir, json_name, modified, body (VARIANT) of each file below ``root`` that is not empty; broken ones have a null body."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    path = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    found = texts.select(path.alias("path"), F.col("_metadata.file_modification_time").alias("modified"), parsed(F.col("value")).alias("body"))
    return found.select("path", names.directory(F.col("path")).alias("dir"), names.base_name(F.col("path")).alias("json_name"), "modified", "body")


def sidecar_fields(sidecars: DataFrame, *keep: str) -> DataFrame:
    """keep, title, taken, latitude, longitude, partner_shared and described of sidecars(.., body VARIANT).

    Times are whole seconds, as text or as numbers. A partner's share is any
    value but null under the origin. ``described``: whether the body is an object.
    """
    body = F.col("body")
    taken = dates.from_epoch(field(body, "$.photoTakenTime.timestamp"))
    partner = F.try_variant_get(body, "$.googlePhotosOrigin.fromPartnerSharing", "variant")
    shared = partner.isNotNull() & ~F.is_variant_null(partner)
    return sidecars.select(*keep, field(body, "$.title").alias("title"), taken.alias("taken"), field(body, "$.geoData.latitude", "double").alias("latitude"), field(body, "$.geoData.longitude", "double").alias("longitude"), shared.alias("partner_shared"), F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False)).alias("described"))


def written(document: Column) -> Column:
    """The document as JSON again, fields in order of their names."""
    return F.to_json(document)


def dictionary(dictionaries: DataFrame) -> DataFrame:
    """path, oldest, entry (VARIANT) of each entry of dictionaries(body VARIANT): objects of path and properties.

    Paths get slashes of one kind; entries that are no objects are skipped.
    """
    entries = dictionaries.select(F.explode(field(F.col("body"), "$", "map<string, variant>")).alias("key", "entry"))
    entries = entries.filter(F.schema_of_variant("entry").startswith("OBJECT"))
    return entries.select(F.replace("key", F.lit("\\"), F.lit("/")).alias("path"), field(F.col("entry"), "$.OldestDate").alias("oldest"), "entry")


def normal_path(path: Column) -> Column:
    """Slashes of one kind, no empty and ``.`` segments, and no segment that a ``..`` takes back."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.when(path.rlike(r"^[/\\]"), "/").otherwise(""), F.array_join(walked, "/"))


def dictionary_dates(files: DataFrame, entries: DataFrame, base: str, resolved: str | None = None) -> DataFrame:
    """file_id, taken, spelling of the first spelling of files(file_id, path) that entries(path, oldest) has with a usable date.

    Spellings: ``given``, ``absolute`` (below ``base`` unless it is so already) and
    ``resolved`` (the column of that name, links followed). An entry whose date
    is missing, no date or a sentinel does not end the search; of repeated
    entries the earliest date counts.
    """
    plain = F.replace("path", F.lit("\\"), F.lit("/"))
    absolute = normal_path(F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), plain)))
    spellings = {"given": plain, "absolute": absolute} | ({"resolved": F.replace(resolved, F.lit("\\"), F.lit("/"))} if resolved else {})
    tried = files.select("file_id", F.posexplode(F.array(*(F.struct(F.lit(n).alias("spelling"), c.alias("path")) for n, c in spellings.items()))).alias("rank", "s")).select("file_id", "rank", "s.*")
    known = entries.withColumn("taken", dates.from_mixed_text(F.trim("oldest"))).filter("taken IS NOT NULL").groupBy("path").agg(F.min("taken").alias("taken"))
    met = tried.join(known, "path").groupBy("file_id").agg(F.min_by(F.struct("taken", "spelling"), "rank").alias("m"))
    return met.select("file_id", "m.*")
