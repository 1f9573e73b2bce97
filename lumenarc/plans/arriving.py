"""The registered query of matching while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.plans.catalogue import CANONICAL_SQL, MATCH_SQL, on
from lumenarc.runtime import Workspace
from lumenarc.sources.archive import files, sidecars
from lumenarc.streaming import discovery

#: Files that a batch is written to, and a trigger takes.
BATCHES, FILES = 4, 8


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sidecars dealt over four batches in no common order, matched as a stream up to the last watermark."""
    work = Workspace(spark, "arriving")
    start = F.lit("2020-01-01").cast("timestamp")
    media = files(spark, sf_dir).select("file_id", F.col("folder").alias("dir"), "name").withColumn("at", start + F.make_dt_interval(mins=F.col("file_id") % BATCHES))
    found = sidecars(spark, sf_dir).select("dir", "json_name").withColumn("at", start + F.make_dt_interval(mins=F.pmod(F.crc32(F.col("json_name").cast("binary")), F.lit(BATCHES)).cast("int")))
    rows = discovery.events(media, found).withColumn("batch", F.minute("at"))
    # After all others: moves the watermark so far that no file waits any more. Its dir makes it no one's match.
    last = spark.range(1).select(F.lit("").alias("dir"), F.lit("").alias("root"), (start + F.make_dt_interval(days=F.lit(9))).alias("at"), *(F.lit(None).cast("string").alias(c) for c in ("file_id", "name", "wanted")), F.lit("").alias("json_name"), F.lit(BATCHES).alias("batch"))
    # Made once by all tasks; each batch then copies its part.
    table = work.save(rows, "rows", partition_by="batch").unionByName(last)
    for i in range(BATCHES + 1):
        table.filter(F.col("batch") == i).drop("batch").repartition(1 if i == BATCHES else FILES).write.mode("append").parquet(f"{work.root}/events")
    stream = spark.readStream.schema(table.drop("batch").schema).option("maxFilesPerTrigger", FILES).parquet(f"{work.root}/events")
    matched = discovery.matched(stream, "1 hour")
    query = matched.writeStream.format("parquet").option("checkpointLocation", f"{work.root}/checkpoint").trigger(availableNow=True).outputMode("append").start(f"{work.root}/matched")
    query.awaitTermination()
    return discovery.discovered(spark.read.schema(matched.schema).parquet(f"{work.root}/matched")).withColumn("file_id", F.col("file_id").cast("long"))


on("sidecars_arriving", arriving, MATCH_SQL + f""", k AS (SELECT file_id, folder AS dir, name, json_name, strategy, CASE WHEN folder = 'Archive' THEN 'special' WHEN {CANONICAL_SQL} THEN 'year' ELSE 'album' END AS kind FROM file LEFT JOIN matched USING (file_id))
SELECT *, CAST(CASE kind WHEN 'year' THEN 0 WHEN 'album' THEN 1 ELSE 2 END AS INTEGER) AS phase FROM k""")
