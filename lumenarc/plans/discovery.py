"""Registered queries of discovery, albums of entities and the whole tag plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import names
from lumenarc.operators import content, discovery, matching, moves, tag_plan, tags
from lumenarc.plans.catalogue import CANONICAL_SQL, LATEST_YEAR, MATCH_SQL, METHOD_SQL, PLACE_SQL, ROLES_SQL, matched, on, on_files, plan_sql, quoted
from lumenarc.runtime import Workspace
from lumenarc.sources.archive import FILES_SQL, exif, files, sidecars

ROOT = "Takeout"

# Discovery


def nested(f: DataFrame) -> DataFrame:
    """The files, some of them deeper in their folder or in the root, and one folder without a media file of its own."""
    i, base = F.col("file_id"), names.base_name(F.col("path"))
    top = F.when(i % 17 == 0, "Only below/x").when(i % 4 == 0, F.concat("folder", F.lit("/sub"))).when(i % 23 == 0, "").otherwise(F.col("folder"))
    return f.withColumn("path", F.concat_ws("/", F.lit(ROOT), F.when(top != "", top), base))


NESTED_SQL = FILES_SQL + """, n0 AS (SELECT file_id, ext, size, text, name, CASE WHEN file_id % 17 = 0 THEN 'Only below/x/' WHEN file_id % 4 = 0 THEN folder || '/sub/' WHEN file_id % 23 = 0 THEN '' ELSE folder || '/' END || name AS inside FROM file),
    n AS (SELECT *, string_split(inside, '/') AS p, regexp_replace('Takeout/' || inside, '/[^/]*$', '') AS dir FROM n0)"""
MEDIA_SQL = f"ext IN ({quoted(names.MEDIA_EXTENSIONS)})"
TOP_YEAR_SQL = "regexp_matches(p[1], '^(Photos from|Fotos del|Fotos von) [0-9]{4}$')"
FOUND_SQL = f""", albums AS (SELECT DISTINCT p[1] AS top FROM n WHERE len(p) = 2 AND {MEDIA_SQL} AND NOT {TOP_YEAR_SQL}),
    found AS (SELECT file_id, CASE WHEN {TOP_YEAR_SQL} THEN 0 ELSE 1 END AS phase, CASE WHEN NOT {TOP_YEAR_SQL} THEN p[1] END AS album, dir
    FROM n WHERE len(p) > 1 AND {MEDIA_SQL} AND ({TOP_YEAR_SQL} OR p[1] IN (SELECT top FROM albums)))"""

on("media_discovery", lambda s, d: discovery.discover(nested(files(s, d)), ROOT, matching.sidecar_fields(matched(s, d))),
   MATCH_SQL + ", " + NESTED_SQL.replace(FILES_SQL, "").lstrip(", ") + FOUND_SQL + ", ps AS (SELECT file_id FROM matched WHERE json_extract(body, '$.googlePhotosOrigin.fromPartnerSharing') IS NOT NULL) SELECT *, file_id IN (SELECT file_id FROM ps) AS partner_shared FROM found")

# Albums of entities


def with_entities(f: DataFrame) -> DataFrame:
    """Contents by their hash, in the nested folders."""
    rows = nested(f).withColumn("sha256", F.sha2("text", 256)).select("file_id", "size", "ext", "sha256", "path")
    return rows.withColumn("folder", names.base_name(names.directory(F.col("path"))))


def albums_of(f: DataFrame) -> DataFrame:
    return discovery.entity_albums(with_entities(f), discovery.discover(nested(f), ROOT))


ALBUMS_SQL = f"WITH {NESTED_SQL}{FOUND_SQL}" + f""", hn AS (SELECT file_id, size, ext, sha256(text) AS sha256, dir, string_split(dir, '/')[-1] AS folder FROM n),
    ea AS (SELECT size, ext, sha256, folder AS album, dir FROM hn WHERE NOT {CANONICAL_SQL} UNION SELECT size, ext, sha256, album, found.dir FROM hn JOIN found USING (file_id) WHERE album IS NOT NULL),
    y AS (SELECT size, ext, sha256, bool_or(regexp_matches(lower(dir), '(^|/) *([0-9]{{4}}|(photos\\s+from|fotos\\s+del|fotos\\s+von)\\s+[0-9]{{4}}) *(/|$)')) AS in_year FROM hn GROUP BY ALL),
    na AS (SELECT size, ext, sha256, count(DISTINCT album) AS albums FROM ea GROUP BY ALL)"""
on("albums_inferred", lambda s, d: albums_of(files(s, d)), ALBUMS_SQL + " SELECT * FROM ea")
on("album_statistics", lambda s, d: discovery.album_statistics(with_entities(files(s, d)), albums_of(files(s, d))), ALBUMS_SQL + " SELECT count(*) AS entities, count(albums) AS album_entities, count(*) FILTER (albums IS NULL AND in_year) AS year_only_entities, count(*) FILTER (albums > 1) AS multi_album_entities, (SELECT count(DISTINCT album) FROM ea) AS different_albums FROM y LEFT JOIN na USING (size, ext, sha256)")
on("year_only_entities", lambda s, d: discovery.only_in(with_entities(files(s, d)), albums_of(files(s, d)), years=True), ALBUMS_SQL + " SELECT size, ext, sha256 FROM y ANTI JOIN na USING (size, ext, sha256) WHERE in_year")
on("album_entities", lambda s, d: discovery.only_in(with_entities(files(s, d)), albums_of(files(s, d)), years=False), ALBUMS_SQL + " SELECT size, ext, sha256 FROM na")
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{p}' AS policy, count(*) FILTER ({'role <> ' + chr(39) + 'duplicate' + chr(39) if p in discovery.ALL_FILES else 'role = ' + chr(39) + 'primary' + chr(39)}) AS files FROM roles" for p in discovery.ALL_FILES + discovery.PRIMARY_ONLY)
on_files("output_counts_of_policies", lambda f: discovery.output_counts(content.roles(f)), ROLES_SQL + COUNTS_SQL)

# The whole tag plan


def tag_plan_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the link policy's files; every 13th is missing, text files count as films that no writer takes, every 5th JPEG was refused before."""
    f, work = files(spark, sf_dir), Workspace(spark, "tag_plan")
    met = work.save(matching.sidecar_match(f, sidecars(spark, sf_dir), tryhard=True), "matched")
    found = work.save(matching.method_dates(f, met, exif(spark, sf_dir), LATEST_YEAR), "dates")
    roles = work.save(content.roles(f), "roles")
    plan = moves.plan(roles, matching.date_waterfall(found), "shortcut")
    path = F.concat_ws("/", "target", "name")
    existing = plan.filter("op = 'move' and file_id % 13 <> 0").join(f.select("file_id", "name"), "file_id").select(path.alias("path"))
    days = matching.entity_dates(roles, found).select("sha256", "ext", "taken", "method")
    careful = met.filter(F.col("strategy").isin([s for s, _ in matching.STRATEGIES[: matching.BASIC]]))
    places = matching.sidecar_fields(careful).select("file_id", "latitude", "longitude")
    primary = roles.filter("role = 'primary'").select("file_id", "sha256", "ext").join(places, "file_id").drop("file_id")
    ext = F.when(F.col("ext") == "txt", "avi").otherwise(F.col("ext")).alias("ext")
    entity_of = roles.join(days, ["sha256", "ext"]).join(primary, ["sha256", "ext"], "left").select("file_id", ext, (F.col("role") == "primary").alias("is_primary"), "taken", "method", "latitude", "longitude")
    written = work.save(tag_plan.outputs(plan, f, existing), "written")
    forced = written.filter("file_id % 5 = 0 and path like '%.jpg'").select("path")
    return work.save(tag_plan.tag_plan(written, entity_of, forced), "plan")


def fails(plan: DataFrame) -> DataFrame:
    return plan.filter("file_id % 6 = 1").select("file_id")


def tag_plan_batches(plan: DataFrame) -> DataFrame:
    left = tag_plan.after_native(plan, fails(plan))
    return tags.batches(left, ["is_video", "queued"], F.col("is_video")).groupBy("is_video", "queued", "batch").agg(F.count("*").alias("files"))


LISTS = {
    "day": "CASE WHEN c IS NULL THEN [] ELSE ['DateTime=' || c, 'DateTimeDigitized=' || c, 'DateTimeOriginal=' || c] END",
    "off": "CASE WHEN utc THEN ['OffsetTime=\"+00:00\"', 'OffsetTimeDigitized=\"+00:00\"', 'OffsetTimeOriginal=\"+00:00\"'] ELSE [] END",
    "gps": "CASE WHEN placed THEN ['GPSLatitude=' || abs(la), 'GPSLatitudeRef=' || CASE WHEN la < 0 THEN 'S' ELSE 'N' END, 'GPSLongitude=' || abs(lo), 'GPSLongitudeRef=' || CASE WHEN lo < 0 THEN 'W' ELSE 'E' END] ELSE [] END",
    "xmp": "CASE WHEN c IS NULL THEN [] ELSE ['XMP:CreateDate=' || c || z, 'XMP:DateTimeOriginal=' || c || z, 'XMP:ModifyDate=' || c || z] END || CASE WHEN placed THEN ['XMP:GPSLatitude=' || la, 'XMP:GPSLongitude=' || lo] ELSE [] END",
}
WHOLE_SQL = f"array_to_string(list_sort({LISTS['day']} || {LISTS['off']} || {LISTS['gps']}), ';')"
TAG_PLAN_SQL = plan_sql("shortcut") + f""", ed AS (SELECT sha256, ext, {", ".join(f'{sql} AS "{m}"' for m, sql in METHOD_SQL.items())} FROM roles JOIN w USING (file_id) WHERE role <> 'duplicate' GROUP BY size, ext, sha256),
    day AS (SELECT sha256, ext, coalesce({", ".join(f'"{m}"' for m in METHOD_SQL)}) AS taken, CASE {" ".join(f"WHEN \"{m}\" IS NOT NULL THEN '{m}'" for m in METHOD_SQL)} ELSE 'none' END AS method FROM ed),
    g AS ({PLACE_SQL}), pg AS (SELECT sha256, ext, la, lo FROM roles JOIN g USING (file_id) WHERE role = 'primary'),
    o4 AS (SELECT file_id, target || '/' || name AS path FROM ops JOIN (SELECT file_id, name FROM file) USING (file_id) WHERE op = 'move'),
    o5 AS (SELECT * FROM o4 WHERE path IN (SELECT path FROM o4 WHERE file_id % 13 <> 0)),
    forced AS (SELECT path FROM o5 WHERE file_id % 5 = 0 AND path LIKE '%.jpg'),
    x AS (SELECT o5.file_id, o5.path, role = 'primary' AS is_primary, CASE r.ext WHEN 'txt' THEN 'avi' ELSE r.ext END AS ext, strftime(taken, '%Y:%m:%d %H:%M:%S') AS c, method IN ('json', 'jsonTryHard') AS utc,
        CASE WHEN method IN ('json', 'jsonTryHard') THEN '+00:00' ELSE '' END AS z, la, lo, coalesce(la <> 0 AND lo <> 0, false) AS placed, o5.path IN (SELECT path FROM forced) AS forced
        FROM o5 JOIN (SELECT file_id, sha256, ext, role FROM roles) r USING (file_id) JOIN day ON day.sha256 = r.sha256 AND day.ext = r.ext LEFT JOIN pg ON pg.sha256 = r.sha256 AND pg.ext = r.ext),
    tp AS (SELECT file_id, path, is_primary, CASE WHEN ext = 'jpg' AND NOT forced THEN CASE WHEN c IS NOT NULL AND placed THEN 'date+gps' WHEN c IS NOT NULL THEN 'date' ELSE 'gps' END END AS native,
        CASE WHEN ext = 'avi' THEN NULL WHEN ext = 'jpg' AND NOT forced THEN CASE WHEN c IS NOT NULL AND utc THEN array_to_string(list_sort({LISTS['day']} || {LISTS['off']}), ';') END
             WHEN ext IN ('jpg', 'png') THEN array_to_string(list_sort({LISTS['xmp']}), ';') ELSE {WHOLE_SQL} END AS queued,
        CASE WHEN ext = 'jpg' AND NOT forced THEN {WHOLE_SQL} END AS fallback, CASE WHEN ext = 'avi' THEN 'AVI' END AS skipped, ext IN ({quoted(names.VIDEO_EXTENSIONS)}) AS is_video FROM x WHERE c IS NOT NULL OR placed),
    tq AS (SELECT file_id, is_video, CASE WHEN native IS NOT NULL AND file_id % 6 = 1 THEN fallback ELSE queued END AS queued FROM tp)"""
on("tag_plan", tag_plan_of, TAG_PLAN_SQL + " SELECT * FROM tp")
on("tag_plan_batches", lambda s, d: tag_plan_batches(tag_plan_of(s, d)), TAG_PLAN_SQL + ", b AS (SELECT is_video, queued, (row_number() OVER (PARTITION BY is_video, queued ORDER BY file_id) - 1) // CASE WHEN is_video THEN 24 ELSE 100 END AS batch FROM tq WHERE queued IS NOT NULL) SELECT is_video, queued, batch, count(*) AS files FROM b GROUP BY ALL")


def written_counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = tag_plan_of(spark, sf_dir)
    return tag_plan.written_counts(plan, fails(plan))


on("tags_written", written_counts_of, TAG_PLAN_SQL + ", dn AS (SELECT * FROM tp WHERE native IS NOT NULL AND file_id % 6 <> 1) SELECT count(*) FILTER (native LIKE 'date%' AND is_primary) AS dates_primary, count(*) FILTER (native LIKE 'date%' AND NOT is_primary) AS dates_other, count(*) FILTER (native LIKE '%gps' AND is_primary) AS gps_primary, count(*) FILTER (native LIKE '%gps' AND NOT is_primary) AS gps_other, (SELECT count(*) FROM tq WHERE queued IS NOT NULL) AS queued FROM dn")
