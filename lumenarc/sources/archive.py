"""Where the archive's tables come from.

``scan`` reads a real export; ``files`` and ``sidecars`` derive the same
columns from the given tables, so that queries can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import names


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, folder, name, ext, size (and content) of all files below ``root``; sizes alone read no bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = names.base_name(F.col("path"))
    folder = names.base_name(names.directory(F.col("path")))
    return found.select("path", folder.alias("folder"), base.alias("name"), names.extension(base).alias("ext"), F.col("length").alias("size"), *(["content"] if content else []))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    year = (F.lit(2010) + i % 10).cast("string")
    folder = F.when(i % 3 != 0, F.concat(F.lit("Photos from "), year)).when(i % 9 == 0, F.lit("Archive")).otherwise(F.concat_ws(" ", "lang", "source"))
    ext = F.element_at(F.array(*map(F.lit, ["jpg", "png", "mp4", "txt"])), (i % 4 + 1).cast("int"))
    stamp = F.concat(year, F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("_"), F.lpad((i % 24).cast("string"), 2, "0"), F.lit("3015"))
    name = F.concat(F.lit("IMG_"), F.when(i % 5 == 0, i.cast("string")).otherwise(stamp), F.when(i % 11 == 0, "-edited").otherwise(""), F.lit("."), ext)
    return d.select(i.alias("file_id"), folder.alias("folder"), name.alias("name"), ext.alias("ext"), F.concat(F.lit("Takeout/"), folder, F.lit("/"), name).alias("path"), F.octet_length("text").cast("long").alias("size"), "text")


FILES_SQL = """
f0 AS (SELECT doc_id AS file_id, text, strlen(text) AS size, CAST(2010 + doc_id % 10 AS VARCHAR) AS yr,
    CASE WHEN doc_id % 3 <> 0 THEN 'Photos from ' || CAST(2010 + doc_id % 10 AS VARCHAR) WHEN doc_id % 9 = 0 THEN 'Archive'
         ELSE concat_ws(' ', lang, source) END AS folder,
    (['jpg', 'png', 'mp4', 'txt'])[doc_id % 4 + 1] AS ext FROM documents),
f1 AS (SELECT *, 'IMG_' || CASE WHEN file_id % 5 = 0 THEN CAST(file_id AS VARCHAR) ELSE
    yr || lpad(CAST(file_id % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(file_id % 28 + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(file_id % 24 AS VARCHAR), 2, '0') || '3015' END
    || CASE WHEN file_id % 11 = 0 THEN '-edited' ELSE '' END || '.' || ext AS name FROM f0),
file AS (SELECT file_id, folder, name, ext, 'Takeout/' || folder || '/' || name AS path, size, text FROM f1)
"""


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dir, json_name, body: a sidecar for each labelled document, named in one of six ways."""
    f = files(spark, sf_dir).select("file_id", "folder", "name")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("file_id"), "toxic")
    i = F.col("file_id")
    stem, full = names.stem(F.col("name")), F.concat("name", F.lit(names.SIDECAR_SUFFIX))
    forms = [F.col("name"), full, F.left(full, F.lit(names.NAME_LIMIT - 5)), F.regexp_replace("name", "-edited", ""), stem, F.concat(stem, F.lit(".HEIC"))]
    json_name = F.concat(F.element_at(F.array(*forms), (i % 6 + 1).cast("int")), F.lit(".json"))
    body = F.concat(F.lit('{"title":"'), F.when(i % 4 == 0, F.col("name")).when(i % 4 == 1, F.concat(names.stem(F.col("name")), F.lit(" am See: "), i.cast("string"), F.lit(".jpg"))).when(i % 4 == 2, "").otherwise("Other.jpg"), F.lit('","photoTakenTime":{"timestamp":"'), (i * 86400 + 1300000000).cast("string"), F.lit('"},"geoData":{"latitude":'), (i % 90).cast("string"), F.lit('.25,"longitude":-'), (i % 180).cast("string"), F.lit(".5}"), F.when(F.col("toxic") == 1, ',"googlePhotosOrigin":{"fromPartnerSharing":{}}').otherwise(""), F.lit("}"))
    return f.join(labels, "file_id").select(F.col("folder").alias("dir"), json_name.alias("json_name"), body.alias("body"))


SIDECARS_SQL = """
sidecar AS (SELECT folder AS dir, ([name, name || '.supplemental-metadata', left(name || '.supplemental-metadata', 46), replace(name, '-edited', ''), regexp_replace(name, '\\.[^.]*$', ''), regexp_replace(name, '\\.[^.]*$', '') || '.HEIC'])[file_id % 6 + 1] || '.json' AS json_name,
    '{"title":"' || CASE file_id % 4 WHEN 0 THEN name WHEN 1 THEN regexp_replace(name, '\\.[^.]*$', '') || ' am See: ' || file_id || '.jpg' WHEN 2 THEN '' ELSE 'Other.jpg' END || '","photoTakenTime":{"timestamp":"' || CAST(file_id * 86400 + 1300000000 AS VARCHAR) || '"},"geoData":{"latitude":' || CAST(file_id % 90 AS VARCHAR) || '.25,"longitude":-' || CAST(file_id % 180 AS VARCHAR) || '.5}'
    || CASE WHEN toxic = 1 THEN ',"googlePhotosOrigin":{"fromPartnerSharing":{}}' ELSE '' END || '}' AS body
    FROM file JOIN labels ON doc_id = file_id)
"""


def exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, raw: the date tag of a part of the JPEG files, some of them placeholders."""
    f = files(spark, sf_dir).filter((F.col("ext") == "jpg") & (F.col("file_id") % 7).isin(3, 5)).select("file_id")
    clock = F.date_format(F.timestamp_seconds(F.col("file_id") * 86400 + 1150000000), "yyyy:MM:dd HH:mm:ss")
    return f.select("file_id", F.when(F.col("file_id") % 7 == 5, "0000:00:00 00:00:00").otherwise(clock).alias("raw"))


EXIF_TAG_SQL = "CASE WHEN ext = 'jpg' AND file_id % 7 = 3 THEN make_timestamp((file_id * 86400 + 1150000000) * 1000000) END"
