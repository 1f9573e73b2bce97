"""Registered queries of VARIANT documents and of dictionaries with several spellings of a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.plans.catalogue import TAKEN_SQL, on, text_of
from lumenarc.runtime import Workspace
from lumenarc.sources import loose
from lumenarc.sources.archive import FILES_SQL, SIDECARS_SQL, files, sidecars


def sidecar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of each sidecar, some of them broken, and whether it is the same once written and read again."""
    texts = sidecars(spark, sf_dir).withColumn("text", F.when(F.length("body") % 5 == 0, F.left("body", F.length("body") - 1)).otherwise(F.col("body")))
    read = texts.select("dir", "json_name", "text", loose.parsed(F.col("text")).alias("body"))
    again = loose.written(loose.parsed(loose.written(F.col("body"))))
    found = loose.sidecar_fields(read.withColumn("same", F.coalesce(again == loose.written(F.col("body")), F.lit(True))), "dir", "json_name", "text", "same")
    return found.select("dir", "json_name", F.sha2("text", 256).alias("text_sha256"), "title", text_of("taken").alias("taken"), F.col("latitude").cast("string").alias("latitude"), "partner_shared", "described", "same")


on("sidecar_documents", sidecar_documents, f"""WITH {FILES_SQL}, {SIDECARS_SQL}, b AS (SELECT *, length(body) % 5 = 0 AS broken FROM sidecar)
SELECT dir, json_name, sha256(CASE WHEN broken THEN left(body, len(body) - 1) ELSE body END) AS text_sha256, CASE WHEN NOT broken THEN json_extract_string(body, '$.title') END AS title, CASE WHEN NOT broken THEN strftime({TAKEN_SQL}, '%Y-%m-%d %H:%M:%S') END AS taken,
CASE WHEN NOT broken THEN json_extract_string(body, '$.geoData.latitude') END AS latitude, NOT broken AND json_extract(body, '$.googlePhotosOrigin.fromPartnerSharing') IS NOT NULL AS partner_shared, NOT broken AS described, true AS same FROM b""")


def dated_by_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of outside dictionaries, written as JSON and loaded, that name a file in one of three ways; some have no date."""
    work = Workspace(spark, "dictionary")
    f = files(spark, sf_dir).select("file_id", "path")
    i = F.col("file_id")
    real = F.concat(F.lit("/real/"), i.cast("string"))
    key = F.when(i % 4 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).when(i % 4 == 1, F.concat(F.lit("/in/"), "path")).otherwise(real)
    clock = F.date_format(F.timestamp_seconds(i * 86400 + 1200000000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.when(i % 9 == 0, "0000:00:00").when(i % 9 != 1, clock)
    objects = f.filter(i % 4 < 3).select(F.to_json(F.create_map(key, F.struct(value.alias("OldestDate"), i.alias("Extra")))).alias("value"))
    objects.write.text(f"{work.root}/dictionaries")
    loaded = spark.read.text(f"{work.root}/dictionaries").select(loose.parsed(F.col("value")).alias("body"))
    return loose.dictionary_dates(f.withColumn("real", real), loose.dictionary(loaded), "/in", "real").withColumn("taken", text_of("taken"))


on("date_dictionary_spellings", dated_by_dictionary, f"""WITH {FILES_SQL}, k AS (SELECT CASE file_id % 4 WHEN 0 THEN path WHEN 1 THEN '/in/' || path ELSE '/real/' || file_id END AS key, min(file_id) AS i FROM file WHERE file_id % 4 < 3 AND file_id % 9 > 1 GROUP BY 1),
t AS (SELECT file_id, 0 AS rank, 'given' AS spelling, path AS key FROM file UNION ALL SELECT file_id, 1, 'absolute', '/in/' || path FROM file UNION ALL SELECT file_id, 2, 'resolved', '/real/' || file_id FROM file),
m AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rank) AS n FROM t JOIN k USING (key))
SELECT file_id, strftime(make_timestamp((i * 86400 + 1200000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS taken, spelling FROM m WHERE n = 1""")  # fmt: skip
