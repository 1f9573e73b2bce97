"""Registered queries of content grouping by refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenarc.operators import balance, refine
from lumenarc.plans.catalogue import on, on_files

# E1: size, extension, signature and hash; every group is sampled
on_files("dup_groups_refined", lambda f: refine.groups(refine.refined(f, refine.OfTable(f), small=0).members), "SELECT size, ext, sha256(text) AS sha256, count(*) AS members, min(file_id) AS first, size * (count(*) - 1) AS wasted FROM file GROUP BY size, ext, sha256(text) HAVING count(*) > 1")
# E2: without the extension; groups of up to three are hashed at once
on_files("dup_groups_sampled", lambda f: refine.groups(refine.refined(f, refine.OfTable(f), by_ext=False).members, by_ext=False), "SELECT size, sha256(text) AS sha256, count(*) AS members, min(file_id) AS first, size * (count(*) - 1) AS wasted FROM file GROUP BY size, sha256(text) HAVING count(*) > 1")

SLICES_SQL = """
b AS (SELECT file_id, size, ext, hex(encode(text)) AS x, sha256(text) AS h FROM file),
g AS (SELECT *, count(*) OVER (PARTITION BY size, ext) AS n, count(*) OVER (PARTITION BY size, ext, h) AS same,
    CASE WHEN size <= 4096 OR ext = 'mp4' THEN '' ELSE substr(x, 2 * (size // 2) + 1, 8192) END AS middle FROM b),
s AS (SELECT *, count(*) OVER (PARTITION BY size, ext, left(x, 8192), middle, right(x, 8192)) AS alike FROM g WHERE n > 3)
"""
on_files(
    "dup_refinement_phases", lambda f: refine.refined(f, refine.OfTable(f)).phases,
    f", {SLICES_SQL} SELECT 'size' AS phase, (SELECT count(*) FROM g) AS files, (SELECT count(*) FROM g WHERE n > 1) AS survivors UNION ALL SELECT 'signature', (SELECT count(*) FROM s), (SELECT count(*) FROM s WHERE alike > 1)"
    " UNION ALL SELECT 'hash', (SELECT count(*) FROM g WHERE n IN (2, 3)) + (SELECT count(*) FROM s WHERE alike > 1), (SELECT count(*) FROM g WHERE same > 1)",
)


# largest first
def dealt_by_size(spark, sf_dir):
    """The fullest of 16 partitions, dealt by size, against the least that any deal could have, and what is in them."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("long").alias("size"))
    loads = balance.balanced(files, "size", 16, "file_id").groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("files"), F.max("size").alias("largest"))
    least = F.greatest(F.sum("size") / 16, F.max("largest"))
    return loads.agg(F.sum("files").alias("files"), F.sum("size").alias("bytes"), (F.max("size") * 3 <= least * 4).alias("within_bound"))


on("files_by_size", dealt_by_size, "SELECT count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, true AS within_bound FROM documents")
