"""Registered queries of staged matching, replacement chains, retries and failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.operators import chains, execute, matching, retry
from lumenarc.plans.catalogue import on

# D2: each file has a name of its own, and a sidecar by one of seven ways


def fix_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), "source")
    k, base = F.col("file_id") % 7, F.concat(F.lit("P"), F.col("file_id").cast("string"), F.lit("q"))
    name = F.when(k == 5, F.concat(base, F.lit("-edi.jpg"))).otherwise(F.concat(base, F.lit(".jpg")))
    folder = F.concat(F.coalesce("source", F.lit("none")), F.when(k.isin(3, 4), "  ").otherwise(""))
    files = d.select("file_id", folder.alias("folder"), name.alias("name"))
    forms = [F.concat("name", F.lit(".json")), F.concat(F.upper("name"), F.lit(".json")), F.concat(F.lower(base), F.lit("  .json")), F.concat("name", F.lit(".json")), F.concat(F.upper("name"), F.lit(".json")), F.concat(base, F.lit(".jpg.json"))]
    sidecars = files.filter(k < 6).select(F.rtrim("folder").alias("dir"), F.get(F.array(*forms), k.cast("int")).alias("json_name"))
    return files, sidecars


FIX_SQL = """
WITH f AS (SELECT doc_id AS file_id, doc_id % 7 AS k, 'P' || doc_id || 'q' AS base, coalesce(source, 'none') || CASE WHEN doc_id % 7 IN (3, 4) THEN '  ' ELSE '' END AS folder,
    'P' || doc_id || 'q' || CASE WHEN doc_id % 7 = 5 THEN '-edi' ELSE '' END || '.jpg' AS name FROM documents),
s AS (SELECT rtrim(folder) AS dir, CASE k WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN lower(base) || '  ' WHEN 3 THEN name WHEN 4 THEN upper(name) ELSE base || '.jpg' END || '.json' AS json_name FROM f WHERE k < 6),
c AS (SELECT file_id, 1 AS r, 'careful' AS stage, dir, json_name FROM f JOIN s ON dir = folder AND json_name = name || '.json'
    UNION ALL SELECT file_id, 2, 'bold', dir, json_name FROM f JOIN s ON dir = folder AND json_name = replace(name, '-edi', '') || '.json'
    UNION ALL SELECT file_id, 4, 'folded', dir, json_name FROM f JOIN s ON dir = folder AND (lower(json_name) = lower(name || '.json') OR lower(rtrim(left(json_name, len(json_name) - 5))) = lower(left(name, len(name) - 4)))
    UNION ALL SELECT file_id, 5, 'trimmed', dir, json_name FROM f JOIN s ON dir <> folder AND dir = rtrim(folder) AND json_name = name || '.json'
    UNION ALL SELECT file_id, 6, 'trimmed folded', dir, json_name FROM f JOIN s ON dir <> folder AND dir = rtrim(folder) AND lower(json_name) = lower(name || '.json'))
SELECT file_id, arg_min(stage, r) AS stage, arg_min(dir, r) AS dir, arg_min(json_name, r) AS json_name FROM c GROUP BY file_id
"""
on("extension_sidecars", lambda s, d: matching.staged_match(*fix_tables(s, d)), FIX_SQL)


def extension_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other file gets another extension; its sidecar goes with it."""
    files, there = fix_tables(spark, sf_dir)
    fixes = files.filter("file_id % 2 = 0").select("file_id", F.concat("name", F.lit(".png")).alias("new_name"))
    return execute.rename_plan(files, fixes, matching.staged_match(files, there), "in")


on("extension_renames", extension_renames, f"""WITH found AS ({FIX_SQL}), g AS (SELECT doc_id AS file_id, coalesce(source, 'none') || CASE WHEN doc_id % 7 IN (3, 4) THEN '  ' ELSE '' END AS folder, 'P' || doc_id || 'q' || CASE WHEN doc_id % 7 = 5 THEN '-edi' ELSE '' END || '.jpg' AS name FROM documents WHERE doc_id % 2 = 0),
o AS (SELECT dir, json_name, min(file_id) AS file_id FROM found WHERE file_id % 2 = 0 GROUP BY dir, json_name)
SELECT CAST(file_id AS VARCHAR) AS op_id, 'in/' || folder || '/' || name AS media, 'in/' || folder || '/' || name || '.png' AS new_media, 'in/' || dir || '/' || json_name AS sidecar FROM g LEFT JOIN o USING (file_id)""")

# D5, E7: chains of eleven entities, each replaced by the one before it


def chain_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source")
    i = F.col("doc_id")
    accuracy = F.when(i % 33 < 11, None).otherwise(i % 4)
    method = F.when(i % 6 != 0, F.concat(F.lit("m"), (i % 9).cast("string")))
    taken = F.when(i % 5 != 0, F.concat(F.lit("t"), i.cast("string")))
    entities = d.select(i.alias("entity"), i.alias("ord"), taken.alias("taken"), accuracy.alias("accuracy"), method.alias("method"), F.when(i % 3 != 0, i % 17 == 1).alias("partner_shared"))
    files = d.select(i.alias("entity"), F.concat(F.lit("f"), (i % 55 % 13).cast("string")).alias("source"), F.lit("").alias("target"), (i % 2 == 0).alias("link"))
    albums = d.filter("lang IS NOT NULL").select(i.alias("entity"), F.col("lang").alias("album"), F.coalesce("source", F.lit("")).alias("dir"))
    return entities, files, albums, d.filter(i % 11 != 0).select(i.alias("old"), (i - 1).alias("new"))


CHAIN_SQL = """
WITH RECURSIVE e AS (SELECT doc_id AS entity, CASE WHEN doc_id % 5 <> 0 THEN 't' || doc_id END AS taken, CASE WHEN doc_id % 33 >= 11 THEN doc_id % 4 END AS accuracy,
    CASE WHEN doc_id % 6 <> 0 THEN 'm' || doc_id % 9 END AS method, doc_id % 3 <> 0 AND doc_id % 17 = 1 AS shared, 'f' || doc_id % 55 % 13 || doc_id % 2 AS file, lang, coalesce(source, '') AS dir FROM documents),
walk(old, now) AS (SELECT entity, entity FROM e UNION ALL SELECT old, now - 1 FROM walk WHERE now % 11 <> 0),
ends AS (SELECT old AS entity, min(now) AS final FROM walk GROUP BY old),
m AS (SELECT final, e.* FROM e JOIN ends USING (entity)),
a AS (SELECT final, lang, count(DISTINCT dir) AS n FROM m WHERE lang IS NOT NULL GROUP BY ALL),
l AS (SELECT final, string_agg(lang || ':' || n, '|' ORDER BY lang || ':' || n) AS albums FROM a GROUP BY final),
x AS (SELECT final AS entity, count(*) - 1 AS merged,
    CASE WHEN count(accuracy) > 0 THEN (array_agg(taken ORDER BY accuracy NULLS LAST, entity DESC))[1] ELSE (array_agg(taken ORDER BY entity) FILTER (taken IS NOT NULL))[1] END AS taken, coalesce(min(accuracy), 99) AS accuracy,
    CASE WHEN count(accuracy) > 0 THEN (array_agg(method ORDER BY accuracy NULLS LAST, entity DESC))[1] ELSE (array_agg(method ORDER BY entity) FILTER (method IS NOT NULL))[1] END AS method,
    bool_or(shared) AS partner_shared, count(DISTINCT file) AS files FROM m GROUP BY final)
SELECT x.*, coalesce(albums, '') AS albums FROM x LEFT JOIN l ON final = entity
"""
on("entity_chains", lambda s, d: chains.merged(*chain_tables(s, d)).withColumn("accuracy", F.coalesce("accuracy", F.lit(99).cast("long"))), CHAIN_SQL)
on("replacement_ends", lambda s, d: chains.resolved(chain_tables(s, d)[3]), "SELECT doc_id AS old, doc_id - doc_id % 11 AS final, false AS cyclic FROM documents WHERE doc_id % 11 <> 0")

# H12, G5: dates are read a batch at a time by a reader that refuses a batch for one bad date in it


def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("op_id"), F.when(F.col("o_orderkey") % 37 == 5, "0000:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd")).alias("payload"))
    batched = rows.withColumn("batch", F.floor(F.col("op_id") / 100))
    return retry.bisected(batched, retry.strict_dates).select("op_id", "batch", "ok")


on("batch_retries", strict_dates, "SELECT o_orderkey AS op_id, CAST(o_orderkey // 100 AS BIGINT) AS batch, o_orderkey % 37 <> 5 AS ok FROM orders")

# E19


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    i = F.col("doc_id")
    op = F.get(F.array(*map(F.lit, ["move", "copy", "symlink"])), (i % 3).cast("int"))
    results = d.select(i.alias("op_id"), op.alias("op"), F.col("lang").isNull().alias("is_album"), (i % 4 == 0).alias("is_primary"), (i % 5 > 1).alias("ok"), F.concat(F.lit("OSError: "), i.cast("string")).alias("error"))
    return chains.first_failures(results, ["op", "is_album", "is_primary"], ["op_id"]).drop("ok")


on("first_failures", failures, """
WITH r AS (SELECT doc_id AS op_id, (['move', 'copy', 'symlink'])[doc_id % 3 + 1] AS op, lang IS NULL AS is_album, doc_id % 4 = 0 AS is_primary, 'OSError: ' || doc_id AS error FROM documents WHERE doc_id % 5 <= 1),
n AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, greatest(0, count(*) OVER (PARTITION BY op, is_album, is_primary) - 5) AS more FROM r WINDOW w AS (PARTITION BY op, is_album, is_primary ORDER BY op_id))
SELECT * FROM n WHERE place <= 5
""")  # fmt: skip
