"""Registered queries of dates among many tags, coordinates in parts, and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.operators import content, tags
from lumenarc.plans.catalogue import on, on_files, text_of


def dates_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the earliest and the first usable date of its lines' tags; some lines have a placeholder or a sentinel."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    tag = F.get(F.array(*map(F.lit, tags.DATE_READ)), (F.col("l_linenumber") * 3 % 10).cast("int"))
    value = F.when(F.col("l_partkey") % 5 == 0, "0000:00:00 00:00:00").when(F.col("l_partkey") % 5 == 1, "1970:01:01 00:00:00").otherwise(F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss"))
    each = li.groupBy("l_orderkey", tag.alias("tag")).agg(F.min(value).alias("value"))
    return tags.read_dates(each, ["l_orderkey"]).select("l_orderkey", text_of("earliest").alias("earliest"), text_of("first").alias("first_tag"))


on("dates_of_ten_tags", dates_of_tags, """WITH t AS (SELECT l_orderkey, l_linenumber * 3 % 10 AS rank, min(CASE l_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END) AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, min(v) FILTER (len(v) > 1) AS earliest, arg_min(v, rank) FILTER (len(v) > 1) AS first_tag FROM t GROUP BY l_orderkey""")

on("geo_dms_seconds", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", ((F.col("doc_id") * 7919 % 36_000_000) / 100_000.0 - 180).alias("x")).select("doc_id", tags.dms(F.col("x")).alias("p"), F.when(F.col("x") < 0, "W").otherwise("E").alias("ref")).select("doc_id", "p.*", "ref"),
   """WITH x AS (SELECT doc_id, (doc_id * 7919 % 36000000) / 100000.0 - 180 AS x FROM documents), h AS (SELECT *, CAST(floor(abs(CAST(x AS DOUBLE)) * 360000 + 0.5) AS BIGINT) AS h FROM x)
SELECT doc_id, CAST(h // 360000 AS INT) AS degrees, CAST(h // 6000 % 60 AS INT) AS minutes, CAST(h % 6000 AS INT) AS seconds, 100 AS per_second, CASE WHEN x < 0 THEN 'W' ELSE 'E' END AS ref FROM h""")  # fmt: skip

on_files("duplicate_share", lambda f: content.duplicate_share(content.duplicate_stats(f)), ", g AS (SELECT size, count(*) AS n FROM file GROUP BY size, sha256(text)), t AS (SELECT CAST(sum(n) AS BIGINT) AS total_files, count(*) AS unique_files, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes FROM g) SELECT *, CAST(floor(duplicate_files * 10000 / total_files + 0.5) AS BIGINT) AS duplicate_share FROM t")
