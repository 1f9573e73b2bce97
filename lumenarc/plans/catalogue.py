"""All registered queries of the archive operators, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import dates, names, repairs
from lumenarc.operators import content, entities, execute, matching, moves, tags
from lumenarc.runtime import Workspace
from lumenarc.sources import zips
from lumenarc.sources.archive import EXIF_TAG_SQL, FILES_SQL, SIDECARS_SQL, exif, files, sidecars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LATEST_YEAR = 2026
FORMAT = "yyyy-MM-dd HH:mm:ss"


def on_files(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(files(spark, sf_dir))
    ORACLES[name] = f"WITH {FILES_SQL}{sql}"


def on(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = build
    ORACLES[name] = sql


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Equal content

on_files("dup_groups_by_content", lambda f: content.content_groups(f), "SELECT size, sha256(text) AS sha256, count(*) AS members, size * (count(*) - 1) AS wasted FROM file GROUP BY size, sha256(text) HAVING count(*) > 1")
on_files("dup_groups_by_content_ext", lambda f: content.content_groups(f, by_ext=True), "SELECT size, sha256(text) AS sha256, ext, count(*) AS members, size * (count(*) - 1) AS wasted FROM file GROUP BY size, sha256(text), ext HAVING count(*) > 1")
on_files("dup_groups_md5_head", lambda f: content.head_groups(f, 1024), "SELECT size, md5(substr(text, 1, 1024)) AS head_md5, count(*) AS members FROM file GROUP BY ALL HAVING count(*) > 1")
on_files("duplicate_stats", content.duplicate_stats, ", g AS (SELECT size, count(*) AS n FROM file GROUP BY size, sha256(text)) SELECT CAST(sum(n) AS BIGINT) AS total_files, count(*) AS unique_files, count(*) FILTER (n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS duplicate_files, CAST(sum(size * (n - 1)) AS BIGINT) AS wasted_bytes FROM g")

YEAR_SQL = "regexp_matches(folder, '^(Photos from|Fotos del|Fotos von) [0-9]{4}$')"
ROLES_SQL = """, ranked AS (SELECT file_id, size, ext, folder, name, path, sha256(text) AS sha256,
    row_number() OVER (PARTITION BY size, ext, sha256(text) ORDER BY CASE WHEN regexp_matches(folder, '^(Photos from|Fotos von|Fotos del) [0-9]{4}$') THEN 0 ELSE 1 END, length(name), length(path), lower(path), file_id) AS entity_rank,
    row_number() OVER (PARTITION BY size, ext, sha256(text), folder ORDER BY length(name), length(path), lower(path), file_id) AS folder_rank FROM file),
roles AS (SELECT *, CASE WHEN entity_rank = 1 THEN 'primary' WHEN folder_rank = 1 THEN 'secondary' ELSE 'duplicate' END AS role FROM ranked)
"""


on_files("entity_file_roles", lambda f: content.roles(f).select("file_id", "sha256", "entity_rank", "folder_rank", "role"), ROLES_SQL + "SELECT file_id, sha256, entity_rank, folder_rank, role FROM roles")
CANONICAL_SQL = "(regexp_matches(folder, '^(19|20)[0-9]{2}$') OR regexp_matches(lower(folder), 'photos\\s+from\\s+(19|20)[0-9]{2}'))"
on_files("entity_role_crosstab", lambda f: content.roles(f).groupBy("role", names.is_canonical(F.col("folder")).alias("canonical")).agg(F.count("*").alias("n")), ROLES_SQL + f"SELECT role, {CANONICAL_SQL} AS canonical, count(*) AS n FROM roles GROUP BY ALL")
on_files("output_counts_by_policy", lambda f: content.roles(f).filter("role <> 'duplicate'").agg(F.count("*").alias("link_or_copy"), F.count_if(F.col("role") == "primary").alias("json_or_nothing")), ROLES_SQL + "SELECT count(*) AS link_or_copy, count(*) FILTER (role = 'primary') AS json_or_nothing FROM roles WHERE role <> 'duplicate'")

# Predicates and names

SPECIAL_SQL = f"list_filter(string_split(lower(path), '/'), lambda x: x IN ({quoted(names.SPECIAL_FOLDERS)}))[1]"
on_files("folder_class", lambda f: f.groupBy("folder").agg(F.count("*").alias("files"), F.bool_or(F.col("ext").isin(names.MEDIA_EXTENSIONS)).alias("has_media")).withColumn("kind", F.when(names.is_year_folder(F.col("folder")), "year").when(F.col("has_media"), "album").otherwise("other")), f"SELECT folder, count(*) AS files, bool_or(ext IN ({quoted(names.MEDIA_EXTENSIONS)})) AS has_media, CASE WHEN {YEAR_SQL} THEN 'year' WHEN bool_or(ext IN ({quoted(names.MEDIA_EXTENSIONS)})) THEN 'album' ELSE 'other' END AS kind FROM file GROUP BY folder")
on_files("canonical_flag", lambda f: f.select("file_id", names.is_canonical(F.col("folder")).alias("canonical"), names.in_year_folder(F.col("path")).alias("in_year_folder")), f"SELECT file_id, {CANONICAL_SQL} AS canonical, regexp_matches(folder, '^(Photos from|Fotos von|Fotos del) [0-9]{{4}}$') AS in_year_folder FROM file")
on_files("special_folder", lambda f: f.select("file_id", names.special_folder(F.col("path")).alias("special")).filter("special is not null"), f"SELECT file_id, upper(substr({SPECIAL_SQL}, 1, 1)) || substr({SPECIAL_SQL}, 2) AS special FROM file WHERE {SPECIAL_SQL} IS NOT NULL")
on_files("photo_video_filter", lambda f: f.filter(F.col("ext").isin(names.MEDIA_EXTENSIONS)).select("file_id", "ext", F.col("ext").isin(names.VIDEO_EXTENSIONS).alias("is_video")), f"SELECT file_id, ext, ext IN ({quoted(names.VIDEO_EXTENSIONS)}) AS is_video FROM file WHERE ext IN ({quoted(names.MEDIA_EXTENSIONS)})")
on_files("skip_extras", lambda f: f.filter(~names.is_edited(F.col("name"))).select("file_id", "name"), "SELECT file_id, name FROM file WHERE NOT (" + " OR ".join(f"ends_with(regexp_replace(lower(name), '\\.[^.]*$', ''), '{s}')" for s in names.EDITED_SUFFIXES) + ")")
on_files("size_limit", lambda f: f.select("file_id", names.too_large(F.col("size"), F.col("file_id") % 2 == 0, 4096).alias("refused"), names.too_large(F.col("size") * 65536, F.lit(True)).alias("large")), "SELECT file_id, file_id % 2 = 0 AND size > 4096 AS refused, size * 65536 > 67108864 AS large FROM file")
on_files("pixel_rename", lambda f: f.select("file_id", names.pixel_name(F.regexp_replace("name", r"\.mp4$", ".MP")).alias("renamed")), "SELECT file_id, regexp_replace(regexp_replace(name, '\\.mp4$', '.MP'), '\\.[mM][pPvV]$', '.mp4') AS renamed FROM file")
on_files("name_forms", lambda f: f.select("file_id", names.short_name(F.concat(F.repeat("name", 3))).alias("short"), names.bracket_swap(F.regexp_replace("name", r"(\.[^.]*)$", "(7)$1")).alias("swapped"), names.stem(F.col("name")).alias("stem"), names.extension(F.col("name")).alias("extension"), names.base_name(F.col("path")).alias("base"), names.directory(F.col("path")).alias("directory")), "SELECT file_id, CASE WHEN length(repeat(name, 3)) + 5 > 51 THEN left(repeat(name, 3), 46) ELSE repeat(name, 3) END AS short, name || '(7)' AS swapped, regexp_replace(name, '\\.[^.]*$', '') AS stem, ext AS extension, name AS base, 'Takeout/' || folder AS directory FROM file")
on("path_sanitize", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", names.safe_name(F.col("url")).alias("safe"), names.clean_segments(F.col("url")).alias("clean")), "SELECT page_id, trim(regexp_replace(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g'), '\\s+', ' ', 'g')) AS safe, array_to_string(list_transform(string_split(url, '/'), lambda x: CASE WHEN regexp_replace(x, '[. ]+$', '') = '' THEN '_' ELSE regexp_replace(x, '[. ]+$', '') END), '/') AS clean FROM pages")
on_files("unique_names", moves.unique_names, ", n AS (SELECT file_id, folder, name, ext, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY file_id) - 1 AS n FROM file) SELECT file_id, folder, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '(' || n || ').' || ext END AS unique_name FROM n")
on_files("required_space", lambda f: f.agg(F.round(F.sum("size") * F.lit(1.1)).cast("long").alias("bytes")), "SELECT CAST(round(sum(size) * 1.1) AS BIGINT) AS bytes FROM file")
on("iso_durations", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", dates.iso_duration((F.col("event_id") * 37)).alias("duration")), "SELECT event_id, 'PT' || CAST(event_id * 37 // 3600 AS VARCHAR) || 'H' || CAST(event_id * 37 % 3600 // 60 AS VARCHAR) || 'M' || CAST(event_id * 37 % 60 AS VARCHAR) || 'S' AS duration FROM events")

# Sidecars and dates

NAME_DATE_SQL = "CASE WHEN regexp_matches(name, '(20|19|18)[0-9]{2}(01|02|03|04|05|06|07|08|09|10|11|12)[0-3][0-9][-_][0-9]{6}') THEN try_strptime(regexp_replace(regexp_extract(name, '(20|19|18)[0-9]{2}(01|02|03|04|05|06|07|08|09|10|11|12)[0-3][0-9][-_][0-9]{6}', 0), '[-_]', '', 'g'), '%Y%m%d%H%M%S') END"
FOLDER_DATE_SQL = f"CASE WHEN try_cast(regexp_extract(folder, '(?:^|[^0-9])((?:18|19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) AS INT) BETWEEN 1900 AND {LATEST_YEAR + 1} THEN make_timestamp(CAST(regexp_extract(folder, '(?:^|[^0-9])((?:18|19|20)[0-9]{{2}})(?:[^0-9]|$)', 1) AS BIGINT), 1, 1, 0, 0, 0.0) END"
text_of = lambda c: F.date_format(c, FORMAT)
SQL_FORMAT = "'%Y-%m-%d %H:%M:%S'"
on_files("date_from_filename", lambda f: f.select("file_id", text_of(dates.from_name(F.col("name"))).alias("guess")), f"SELECT file_id, strftime({NAME_DATE_SQL}, {SQL_FORMAT}) AS guess FROM file")
on_files("date_from_folder", lambda f: f.select("file_id", text_of(dates.from_folder(F.col("folder"), LATEST_YEAR)).alias("year_date")), f"SELECT file_id, strftime({FOLDER_DATE_SQL}, {SQL_FORMAT}) AS year_date FROM file")
ORDER_TEXT = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags as cameras write them: colons in the date, every seventh a placeholder."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "0000:00:00 00:00:00").when(F.col("o_orderkey") % 7 == 1, "1970:01:01 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return o.select("o_orderkey", text_of(dates.from_exif(raw)).alias("taken"))


on("date_from_exif_text", exif_dates, f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 2 THEN NULL ELSE {ORDER_TEXT} END AS taken FROM orders")


def earliest_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order the earliest and the first (by line) of its shipping dates."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_shipdate")
    return li.groupBy("l_orderkey").agg(text_of(F.min("l_shipdate")).alias("earliest"), text_of(F.min_by("l_shipdate", F.struct("l_linenumber", "l_shipdate"))).alias("first_tag"))


on("date_earliest_tag", earliest_tag, f"SELECT l_orderkey, strftime(min(l_shipdate), {SQL_FORMAT}) AS earliest, strftime((array_agg(l_shipdate ORDER BY l_linenumber, l_shipdate))[1], {SQL_FORMAT}) AS first_tag FROM lineitem GROUP BY 1")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.sidecar_match(files(spark, sf_dir), sidecars(spark, sf_dir))


STEM_SQL, EXT_SQL = "regexp_replace(name, '\\.[^.]*$', '')", "'.' || ext"
EDITED_SQL = "'(" + "|".join(names.EDITED_SUFFIXES) + ")$'"
# The transformations as they work on names without a number in brackets; the tests cover the others.
CHANGES = [
    ("as it is", "name"),
    ("shortened", "left(name, 46)"),
    ("bracket swapped", "name"),
    ("no extension", STEM_SQL),
    ("no edited ending", f"regexp_replace({STEM_SQL}, {EDITED_SQL}, '') || {EXT_SQL}"),
    ("motion photo", f"CASE ext WHEN 'mp' THEN {STEM_SQL} || '.MP.jpg' ELSE name END"),
    ("other extension", f"CASE WHEN ext IN ('mp4', 'mov', 'jpg', 'jpeg', 'mp', 'mv') THEN {STEM_SQL} || '.HEIC' ELSE name END"),
    ("no partial ending", f"regexp_replace({STEM_SQL}, {EDITED_SQL}, '') || {EXT_SQL}"),
]


def match_sql(tryhard: bool = False) -> str:
    plain = " UNION ALL ".join(f"SELECT file_id, folder, {i} AS rank, '{s}' AS strategy, {e} AS plain FROM file" for i, (s, e) in enumerate(CHANGES if tryhard else CHANGES[:6]))
    return f"""WITH {FILES_SQL}, {SIDECARS_SQL}, p AS ({plain}),
    c AS (SELECT file_id, folder AS dir, rank * 100 AS priority, strategy, plain || '.supplemental-metadata.json' AS json_name FROM p
        UNION ALL SELECT file_id, folder, rank * 100 + 22 - n, strategy, plain || '.' || left('supplemental-metadata', n) || '.json' FROM p, (SELECT unnest(range(1, 22)) AS n)
            WHERE length(plain) + 27 > 51 AND length(plain) + 1 + n + 5 <= 51
        UNION ALL SELECT file_id, folder, rank * 100 + 90, strategy, plain || '.json' FROM p),
    m AS (SELECT file_id, json_name, strategy, body, row_number() OVER (PARTITION BY file_id ORDER BY priority, body) AS n FROM c JOIN sidecar USING (dir, json_name)),
    matched AS (SELECT file_id, json_name, strategy, body FROM m WHERE n = 1) """


MATCH_SQL = match_sql()
on("sidecar_basic_match", lambda s, d: matched(s, d).drop("body"), MATCH_SQL + "SELECT file_id, json_name, strategy FROM matched")
on("sidecar_tryhard_match", lambda s, d: matching.sidecar_match(files(s, d), sidecars(s, d), tryhard=True).drop("body"), match_sql(True) + "SELECT file_id, json_name, strategy FROM matched")
on("sidecar_strategy_histogram", lambda s, d: matched(s, d).groupBy("strategy").agg(F.count("*").alias("n")), MATCH_SQL + "SELECT strategy, count(*) AS n FROM matched GROUP BY 1")
TAKEN_SQL = "make_timestamp(CAST(json_extract_string(body, '$.photoTakenTime.timestamp') AS BIGINT) * 1000000)"
on("date_from_sidecar", lambda s, d: matching.sidecar_fields(matched(s, d)).withColumn("taken", text_of("taken")), MATCH_SQL + f"SELECT file_id, strftime({TAKEN_SQL}, {SQL_FORMAT}) AS taken, CAST(json_extract_string(body, '$.geoData.latitude') AS DOUBLE) AS latitude, CAST(json_extract_string(body, '$.geoData.longitude') AS DOUBLE) AS longitude, json_extract_string(body, '$.title') AS title, json_extract(body, '$.googlePhotosOrigin.fromPartnerSharing') IS NOT NULL AS partner_shared FROM matched")


def dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as degrees, minutes and seconds with their directions."""
    f = matching.sidecar_fields(matched(spark, sf_dir)).filter("latitude <> 0 or longitude <> 0")
    part = lambda c, n: [F.floor(F.abs(c)).cast("int").alias(f"{n}_deg"), F.floor(F.abs(c) * 60 % 60).cast("int").alias(f"{n}_min")]
    return f.select("file_id", *part(F.col("latitude"), "lat"), F.when(F.col("latitude") < 0, "S").otherwise("N").alias("lat_ref"), *part(F.col("longitude"), "lon"), F.when(F.col("longitude") < 0, "W").otherwise("E").alias("lon_ref"))


on("geo_dms", dms, MATCH_SQL + ", g AS (SELECT file_id, CAST(json_extract_string(body, '$.geoData.latitude') AS DOUBLE) AS la, CAST(json_extract_string(body, '$.geoData.longitude') AS DOUBLE) AS lo FROM matched) SELECT file_id, CAST(floor(abs(la)) AS INT) AS lat_deg, CAST(floor(abs(la) * 60 % 60) AS INT) AS lat_min, CASE WHEN la < 0 THEN 'S' ELSE 'N' END AS lat_ref, CAST(floor(abs(lo)) AS INT) AS lon_deg, CAST(floor(abs(lo) * 60 % 60) AS INT) AS lon_min, CASE WHEN lo < 0 THEN 'W' ELSE 'E' END AS lon_ref FROM g")


def found_dates(spark: SparkSession, sf_dir: str, sidecar_of: DataFrame | None = None) -> DataFrame:
    f = files(spark, sf_dir)
    met = matching.sidecar_match(f, sidecars(spark, sf_dir), tryhard=True) if sidecar_of is None else sidecar_of
    return matching.method_dates(f, met, exif(spark, sf_dir), LATEST_YEAR)


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.date_waterfall(found_dates(spark, sf_dir))


def dated_and_placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dates, and the fields of careful sidecars: both of one match by all strategies, written once."""
    met = Workspace(spark, "matched").save(matching.sidecar_match(files(spark, sf_dir), sidecars(spark, sf_dir), tryhard=True), "matched")
    careful = met.filter(F.col("strategy").isin([s for s, _ in matching.STRATEGIES[: matching.BASIC]]))
    return matching.date_waterfall(found_dates(spark, sf_dir, met)), matching.sidecar_fields(careful)


def partner_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    days, fields = dated_and_placed(spark, sf_dir)
    rows = days.join(fields.select("file_id", "partner_shared"), "file_id", "left")
    return rows.select("file_id", moves.main_directory(F.col("taken"), 2, F.coalesce("partner_shared", F.lit(False))).alias("target"))


CAREFUL_SQL = f"strategy IN ({quoted([s for s, _ in matching.STRATEGIES[: matching.BASIC]])})"
DATED_SQL = match_sql(True) + f""", w AS (SELECT f.file_id, CASE WHEN {CAREFUL_SQL} THEN {TAKEN_SQL} END AS jd, {EXIF_TAG_SQL} AS ed, {NAME_DATE_SQL} AS gd, CASE WHEN NOT {CAREFUL_SQL} THEN {TAKEN_SQL} END AS hd, {FOLDER_DATE_SQL} AS fd
    FROM (SELECT file_id, folder, name, ext FROM file) f LEFT JOIN (SELECT file_id, strategy, body FROM matched) m USING (file_id)),
dated AS (SELECT file_id, coalesce(jd, ed, gd, hd, fd) AS taken, CASE WHEN jd IS NOT NULL THEN 'json' WHEN ed IS NOT NULL THEN 'exif' WHEN gd IS NOT NULL THEN 'guess' WHEN hd IS NOT NULL THEN 'jsonTryHard' WHEN fd IS NOT NULL THEN 'folderYear' ELSE 'none' END AS method,
    CASE WHEN jd IS NOT NULL THEN 1 WHEN ed IS NOT NULL THEN 2 WHEN gd IS NOT NULL THEN 3 WHEN hd IS NOT NULL THEN 4 WHEN fd IS NOT NULL THEN 5 ELSE 99 END AS accuracy FROM w) """
on("dup_keeper", lambda s, d: content.keepers(files(s, d), dated(s, d)), DATED_SQL + f", k AS (SELECT sha256(text) AS sha256, file_id AS keeper, path, row_number() OVER (PARTITION BY size, sha256(text) ORDER BY accuracy, length(name), CASE WHEN {YEAR_SQL} THEN 0 ELSE 1 END, length(path), path, file_id) AS n FROM file JOIN dated USING (file_id)) SELECT sha256, keeper, path FROM k WHERE n = 1")
METHOD_SQL = {m: f"min_by({c}, entity_rank) FILTER ({c} IS NOT NULL{more})" for m, c, more in (("json", "jd", ""), ("exif", "ed", " AND role = 'primary'"), ("guess", "gd", ""), ("jsonTryHard", "hd", ""), ("folderYear", "fd", ""))}
on("entity_dates", lambda s, d: matching.entity_dates(content.roles(files(s, d)), found_dates(s, d)).withColumn("taken", text_of("taken")), DATED_SQL + ROLES_SQL + f""", e AS (SELECT sha256, ext, {", ".join(f'{sql} AS "{m}"' for m, sql in METHOD_SQL.items())} FROM roles JOIN w USING (file_id) WHERE role <> 'duplicate' GROUP BY size, ext, sha256)
    SELECT sha256, ext, strftime(coalesce("json", "exif", "guess", "jsonTryHard", "folderYear"), {SQL_FORMAT}) AS taken, CASE {" ".join(f"WHEN \"{m}\" IS NOT NULL THEN '{m}'" for m in METHOD_SQL)} ELSE 'none' END AS method, CASE {" ".join(f'WHEN "{m}" IS NOT NULL THEN {dates.ACCURACY[m]}' for m in METHOD_SQL)} ELSE 99 END AS accuracy FROM e""")
on("date_waterfall", lambda s, d: dated(s, d).withColumn("taken", text_of("taken")), DATED_SQL + f"SELECT file_id, strftime(taken, {SQL_FORMAT}) AS taken, method, accuracy FROM dated")
on("date_method_histogram", lambda s, d: dated(s, d).groupBy("method", "accuracy").agg(F.count("*").alias("n")), DATED_SQL + "SELECT method, accuracy, count(*) AS n FROM dated GROUP BY ALL")
on("target_directory", lambda s, d: dated(s, d).select("file_id", dates.date_folder(F.col("taken"), 1).alias("by_year"), dates.date_folder(F.col("taken"), 2).alias("by_month"), dates.date_folder(F.col("taken"), 3).alias("by_day")), DATED_SQL + "SELECT file_id, coalesce(strftime(taken, '%Y'), 'date-unknown') AS by_year, coalesce(strftime(taken, '%Y/%m'), 'date-unknown') AS by_month, coalesce(strftime(taken, '%Y/%m/%d'), 'date-unknown') AS by_day FROM dated")

# Albums

on_files("album_counts", lambda f: f.filter(~names.is_canonical(F.col("folder"))).groupBy(F.trim("folder").alias("album")).agg(F.count("*").alias("files"), F.countDistinct(F.sha2("text", 256)).alias("contents")), f"SELECT trim(folder) AS album, count(*) AS files, count(DISTINCT sha256(text)) AS contents FROM file WHERE NOT {CANONICAL_SQL} GROUP BY 1")
on("album_stats", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("text").agg(F.countDistinct("conv_id").alias("albums")).agg(F.count("*").alias("files"), F.count_if(F.col("albums") > 1).alias("in_several"), F.max("albums").alias("most")), "SELECT count(*) AS files, count(*) FILTER (albums > 1) AS in_several, max(albums) AS most FROM (SELECT count(DISTINCT conv_id) AS albums FROM conversations GROUP BY text)")

# Plans

OPS_SQL = {
    "shortcut": "CASE WHEN is_first THEN ['move|' || main] ELSE [] END || CASE WHEN NOT canonical THEN ['symlink|' || album] ELSE [] END || CASE WHEN NOT is_first AND NOT canonical THEN ['delete|'] WHEN canonical AND NOT is_first THEN ['leave|'] ELSE [] END",
    "reverse-shortcut": "CASE WHEN NOT canonical THEN ['move|' || album] WHEN best_album IS NOT NULL THEN ['reverse_symlink|' || main] WHEN entity_rank = 1 THEN ['move|' || main] ELSE ['leave|'] END",
    "duplicate-copy": "CASE WHEN canonical THEN ['move|' || main] ELSE ['move|' || album] END || CASE WHEN NOT any_canonical AND entity_rank = 1 THEN ['copy|' || main] ELSE [] END",
    "json": "CASE WHEN entity_rank = 1 THEN ['move|' || main] ELSE ['delete|'] END || CASE WHEN NOT canonical THEN ['json_reference|' || album] ELSE [] END",
    "nothing": "CASE WHEN entity_rank = 1 THEN ['move|' || main] ELSE ['delete|'] END",
    "ignore": "CASE WHEN canonical THEN ['move|' || main] ELSE ['delete|'] END",
}


def plan_sql(policy: str) -> str:
    return DATED_SQL + ROLES_SQL + f""", k AS (SELECT *, {CANONICAL_SQL} AS canonical, {SPECIAL_SQL} AS sp FROM roles WHERE role <> 'duplicate'),
    e AS (SELECT k.*, bool_or(canonical) OVER w AS any_canonical, min(entity_rank) FILTER (canonical) OVER w AS best_canonical, min(entity_rank) FILTER (NOT canonical) OVER w AS best_album FROM k WINDOW w AS (PARTITION BY size, ext, sha256)),
    t AS (SELECT e.*, entity_rank = coalesce(best_canonical, 1) AS is_first, 'ALL_PHOTOS/' || coalesce(strftime(taken, '%Y/%m'), 'date-unknown') AS main, 'Albums/' || folder AS album FROM e LEFT JOIN dated USING (file_id)),
    o AS (SELECT sha256, file_id, unnest(CASE WHEN sp IS NOT NULL THEN ['move|Special Folders/' || upper(substr(sp, 1, 1)) || substr(sp, 2)] ELSE {OPS_SQL[policy]} END) AS o FROM t),
    ops AS (SELECT sha256, file_id, string_split(o, '|')[1] AS op, string_split(o, '|')[2] AS target FROM o) """


def plan_of(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    return moves.plan(content.roles(files(spark, sf_dir)), dated(spark, sf_dir), policy)


for policy in moves.POLICIES:
    on(f"plan_{policy.replace('-', '_')}", lambda s, d, p=policy: plan_of(s, d, p), plan_sql(policy) + "SELECT sha256, file_id, op, target FROM ops")

on("plan_summary", lambda s, d: plan_of(s, d, "shortcut").groupBy("op", F.col("target").startswith("Albums/").alias("is_album")).agg(F.count("*").alias("n")), plan_sql("shortcut") + "SELECT op, starts_with(target, 'Albums/') AS is_album, count(*) AS n FROM ops GROUP BY ALL")
on("plan_unaccounted", lambda s, d: content.roles(files(s, d)).filter("role = 'primary'").select("file_id").join(plan_of(s, d, "shortcut"), "file_id", "left_anti"), plan_sql("shortcut") + "SELECT file_id FROM roles WHERE role = 'primary' AND file_id NOT IN (SELECT file_id FROM ops)")
on("albums_info_entries", lambda s, d: plan_of(s, d, "json").filter("op = 'json_reference'").groupBy("target").agg(F.count("*").alias("entries"), F.min("file_id").alias("first_file")), plan_sql("json") + "SELECT target, count(*) AS entries, min(file_id) AS first_file FROM ops WHERE op = 'json_reference' GROUP BY 1")


def exif_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags each dated media file would get; JPEG natively, PNG as XMP, others as EXIF."""
    f = files(spark, sf_dir).filter(F.col("ext").isin(names.MEDIA_EXTENSIONS)).select("file_id", "ext")
    rows = f.join(dated(spark, sf_dir).filter("taken is not null").select("file_id", "taken"), "file_id")
    writer = F.when(F.col("ext") == "jpg", "native").when(F.col("ext") == "png", "xmp").otherwise("exif")
    return rows.select("file_id", writer.alias("writer"), F.concat(F.lit("DateTimeOriginal="), F.date_format("taken", "yyyy:MM:dd HH:mm:ss")).alias("tags"))


EXIF_SQL = DATED_SQL + f", x AS (SELECT file_id, CASE ext WHEN 'jpg' THEN 'native' WHEN 'png' THEN 'xmp' ELSE 'exif' END AS writer, 'DateTimeOriginal=' || strftime(taken, '%Y:%m:%d %H:%M:%S') AS tags FROM (SELECT file_id, ext FROM file WHERE ext IN ({quoted(names.MEDIA_EXTENSIONS)})) JOIN dated USING (file_id) WHERE taken IS NOT NULL) "
on("exif_plan", exif_plan, EXIF_SQL + "SELECT * FROM x")


def tagset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with equal tags share a batch: at most 100 images or 24 films."""
    rows = exif_plan(spark, sf_dir).withColumn("video", F.col("writer") == "exif")
    return tags.batches(rows, ["writer", "tags"], F.col("video")).groupBy("writer", "tags", "batch").agg(F.count("*").alias("files"))


on("exif_tagset_batches", tagset_batches, EXIF_SQL + ", b AS (SELECT writer, tags, (row_number() OVER (PARTITION BY writer, tags ORDER BY file_id) - 1) // CASE writer WHEN 'exif' THEN 24 ELSE 100 END AS batch FROM x) SELECT writer, tags, batch, count(*) AS files FROM b GROUP BY ALL")
on("time_plan", lambda s, d: content.roles(files(s, d)).filter("role <> 'duplicate'").select("file_id").join(dated(s, d).filter("taken is not null"), "file_id").select("file_id", F.unix_seconds("taken").alias("mtime"), (F.unix_millis("taken") * 10000 + 116444736000000000).alias("filetime")), DATED_SQL + ROLES_SQL + "SELECT file_id, CAST(epoch(taken) AS BIGINT) AS mtime, CAST(epoch(taken) AS BIGINT) * 10000000 + 116444736000000000 AS filetime FROM dated JOIN (SELECT file_id FROM roles WHERE role <> 'duplicate') USING (file_id) WHERE taken IS NOT NULL")


# Further functions and statistics

TITLE_SQL = MATCH_SQL + r""", t AS (SELECT f.file_id, f.folder, f.name, f.ext, m.body, json_extract_string(m.body, '$.title') AS title, regexp_replace(f.name, '\.[^.]*$', '') AS stem FROM file f LEFT JOIN matched m USING (file_id)),
u AS (SELECT *, regexp_replace(title, '\.[a-zA-Z0-9]{2,5}$', '') AS full_name FROM t),
v AS (SELECT *, CASE WHEN length(stem) < length(full_name) AND starts_with(lower(full_name), lower(stem)) THEN replace(full_name, ':', '_') || '.' || ext END AS new_name FROM u),
w AS (SELECT *, CASE WHEN body IS NULL THEN 'no sidecar' WHEN title = '' THEN 'no title' WHEN new_name IS NULL THEN 'not truncated' WHEN (folder, new_name) IN (SELECT (folder, name) FROM file) THEN 'target exists' ELSE 'truncated' END AS status FROM v) """
on("title_truncation_status", lambda s, d: matching.title_status(matched(s, d), files(s, d)), TITLE_SQL + "SELECT file_id, status, CASE WHEN status = 'truncated' THEN new_name END AS new_name FROM w")
on("partner_shared", partner_targets, DATED_SQL + "SELECT file_id, CASE WHEN json_extract(body, '$.googlePhotosOrigin.fromPartnerSharing') IS NOT NULL THEN 'PARTNER_SHARED/' ELSE '' END || 'ALL_PHOTOS/' || coalesce(strftime(taken, '%Y/%m'), 'date-unknown') AS target FROM dated LEFT JOIN (SELECT file_id, body FROM matched WHERE " + CAREFUL_SQL + ") USING (file_id)")


def camera_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in eight of the ways that cameras and tools write them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    forms = ["yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy.M.d H:m:s", "yyyy-MM-dd HH:mm:ss'+0200'", "yyyy:MM:dd HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss", "'0000:00:00 'HH:mm:ss"]
    k = F.col("o_orderkey") % 8
    raw = F.coalesce(*(F.when(k == i, F.date_format("t", form)) for i, form in enumerate(forms)))
    return o.select("o_orderkey", text_of(dates.from_mixed_text(raw)).alias("taken"))


on("date_from_camera_text", camera_texts, f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 4 THEN strftime(CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 HOUR, {SQL_FORMAT}) ELSE strftime(o_orderdate, {SQL_FORMAT}) END AS taken FROM orders")


def from_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files, their paths written with backslashes."""
    f = files(spark, sf_dir)
    listed = f.filter("file_id % 2 = 0").select(F.replace("path", F.lit("/"), F.lit("\\")).alias("path"), F.concat(F.date_format(F.timestamp_seconds(F.col("file_id") * 86400 + 1200000000), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("oldest"))
    return matching.dictionary_dates(f, listed).withColumn("taken", text_of("taken"))


on_files("date_from_dictionary", lambda f: f, ", k AS (SELECT path, min(file_id) AS i FROM file WHERE file_id % 2 = 0 GROUP BY 1) SELECT file_id, strftime(make_timestamp((i * 86400 + 1200000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS taken FROM file JOIN k USING (path)")
QUERIES["date_from_dictionary"] = from_dictionary

FOLDER_NAMES = ["'Fotos del ' || y", "y || ' Pictures'", "'Photos ' || y", "y || '-07'", "CAST(y AS VARCHAR)", "'Trip 12 ' || y || ' Rome'", "'None'"]


def folder_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year folders in seven ways of naming, years in and out of range."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").withColumn("y", (F.lit(1850) + F.col("event_id") % 250).cast("string"))
    y, k = F.col("y"), F.col("event_id") % 7
    forms = [F.concat(F.lit("Fotos del "), y), F.concat(y, F.lit(" Pictures")), F.concat(F.lit("Photos "), y), F.concat(y, F.lit("-07")), y, F.concat(F.lit("Trip 12 "), y, F.lit(" Rome")), F.lit("None")]
    folder = F.coalesce(*(F.when(k == i, f) for i, f in enumerate(forms)))
    return e.select("event_id", F.year(dates.from_folder(folder, LATEST_YEAR)).cast("string").alias("year"))


on("folder_year_forms", folder_years, f"SELECT event_id, CAST(CASE WHEN event_id % 7 < 6 AND 1850 + event_id % 250 BETWEEN 1900 AND {LATEST_YEAR + 1} THEN 1850 + event_id % 250 END AS VARCHAR) AS year FROM events")
on("untitled_album", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("UNBENANNT "), F.col("conv_id").cast("string"))).otherwise(F.col("role")).alias("album")).select("conv_id", "turn", moves.album_directory(F.col("album")).alias("directory")), "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Untitled Albums/UNBENANNT ' || conv_id ELSE 'Albums/' || role END AS directory FROM conversations")
on("dup_best_media", lambda s, d: entities.best_media(content.roles(files(s, d)), dated(s, d)), DATED_SQL + ROLES_SQL + f", a AS (SELECT size, ext, sha256, count(DISTINCT CASE WHEN NOT {CANONICAL_SQL} THEN folder END) AS albums FROM roles GROUP BY ALL), r AS (SELECT sha256, ext, file_id, albums, row_number() OVER (PARTITION BY size, ext, sha256 ORDER BY accuracy, CASE WHEN {CANONICAL_SQL} THEN 1 ELSE 0 END, length(path), path, file_id) AS n FROM roles JOIN dated USING (file_id) JOIN a USING (size, ext, sha256)) SELECT sha256, ext, file_id AS best, albums FROM r WHERE n = 1")
on("entity_merge", lambda s, d: entities.merged(content.roles(files(s, d)), dated(s, d)), DATED_SQL + ROLES_SQL + f", d AS (SELECT size, ext, sha256, roles.file_id, role, folder, {CANONICAL_SQL} AS canonical, taken, accuracy, entity_rank FROM roles JOIN dated USING (file_id)) SELECT sha256, ext, min(file_id) FILTER (role = 'primary') AS primary_file, count(*) FILTER (role = 'secondary') AS secondaries, count(*) FILTER (role = 'duplicate') AS duplicates, coalesce(array_to_string(list_sort(list(DISTINCT folder) FILTER (NOT canonical)), '|'), '') AS albums, strftime((array_agg(taken ORDER BY accuracy, entity_rank))[1], {SQL_FORMAT}) AS taken, min(accuracy) AS accuracy FROM d GROUP BY size, ext, sha256")
on_files("grouping_stats", entities.grouping_stats, ", g AS (SELECT size, count(*) AS n, count(DISTINCT sha256(text)) AS contents FROM file GROUP BY size) SELECT count(*) AS size_buckets, count(*) FILTER (n = 1) AS single_buckets, count(*) FILTER (n > 1) AS shared_buckets, CAST(sum(contents) AS BIGINT) AS contents, max(n) AS largest FROM g")
on("collection_stats", lambda s, d: entities.collection_stats(content.roles(files(s, d)), dated(s, d)), DATED_SQL + ROLES_SQL + f", cs AS (SELECT size, ext, sha256, bool_or(accuracy < 99) AS dated, bool_or(NOT {CANONICAL_SQL}) AS in_album FROM roles JOIN dated USING (file_id) GROUP BY ALL), k AS (SELECT count(*) AS files FROM file) SELECT count(*) AS entities, count(*) FILTER (dated) AS dated, count(*) FILTER (in_album) AS in_album, any_value(files) - count(*) AS more_files FROM cs, k")
on("album_membership_prefix", lambda s, d: entities.membership(files(s, d)), f", d AS (SELECT DISTINCT 'Takeout/' || folder AS dir, folder AS album FROM file WHERE NOT {CANONICAL_SQL}) SELECT file_id, album FROM file JOIN d ON 'Takeout/' || folder = dir OR starts_with('Takeout/' || folder, dir || '/')")
ORACLES["album_membership_prefix"] = f"WITH {FILES_SQL}" + ORACLES["album_membership_prefix"]
on_files("album_kinds", entities.album_kinds, f", e AS (SELECT size, ext, sha256(text) AS h, bool_or({CANONICAL_SQL}) AS c, bool_or(NOT {CANONICAL_SQL}) AS a FROM file GROUP BY ALL) SELECT CASE WHEN c AND a THEN 'both' WHEN a THEN 'album only' ELSE 'year only' END AS kind, count(*) AS n FROM e GROUP BY 1")


def extension_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that begin as one of five types do, under the names of ``files``."""
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "000000186674797069736F6D", "49492A00", "00"]
    f = files(spark, sf_dir).withColumn("head", F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("file_id") % 5 + 1).cast("int"))))
    return entities.extension_fixes(f)


on_files("extension_fix_plan", lambda f: f, ", h AS (SELECT file_id, folder, name, ext, (['image/jpeg', 'image/png', 'video/mp4', NULL, NULL])[file_id % 5 + 1] AS mime, (['jpg', 'png', 'mp4', NULL, NULL])[file_id % 5 + 1] AS new_ext FROM file) SELECT file_id, mime, name || '.' || new_ext AS new_name FROM h WHERE new_ext IS NOT NULL AND new_ext <> ext AND NOT name LIKE '%-edited.%' AND (folder, name || '.' || new_ext) NOT IN (SELECT (folder, name) FROM file)")
QUERIES["extension_fix_plan"] = extension_plan
on("path_functions", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", names.directory(F.col("url")).alias("directory"), names.base_name(F.col("url")).alias("base"), names.trimmed_segments(F.replace("url", F.lit("/"), F.lit(" /"))).alias("trimmed"), names.replace_last(F.col("url"), "e", "<E>").alias("replaced"), names.rebased(F.concat(F.lit("old/in/"), "url"), F.lit("old/in"), F.lit("new")).alias("rebased"), names.rebased(F.col("url"), F.lit("old"), F.lit("new")).alias("kept")), "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS directory, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(url, ' +(/|$)', '\\1', 'g') AS trimmed, regexp_replace(url, '^(.*)e([^e]*)$', '\\1<E>\\2') AS replaced, 'new/' || url AS rebased, url AS kept FROM pages")
on_files("format_sizes", lambda f: f.select("file_id", dates.thousands(F.col("size") * 1000).alias("number"), dates.duration_text(F.col("size")).alias("duration"), dates.size_text(F.col("size") * 1000).alias("size_text")), ", d AS (SELECT file_id, size AS s FROM file) SELECT file_id, format('{:,}', s * 1000) AS number, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END ELSE s // 3600 || 'h' || CASE WHEN s // 60 % 60 > 0 THEN ' ' || s // 60 % 60 || 'm' ELSE '' END END AS duration, CASE WHEN s <= 0 THEN '0 B' WHEN s < 1000 THEN s || '.00 KB' ELSE (s + 5) // 10 // 100 || '.' || lpad(CAST((s + 5) // 10 % 100 AS VARCHAR), 2, '0') || ' MB' END AS size_text FROM d")
on("nfc_paths", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", repairs.nfc(F.col("text")).alias("nfc")), "SELECT doc_id, nfc_normalize(text) AS nfc FROM documents")
on_files("emoji_codec", lambda f: f.select("file_id", repairs.emoji_to_hex(F.concat(F.lit("\U0001f600"), "name")).alias("encoded")).withColumn("decoded", repairs.hex_to_emoji(F.col("encoded"))), "SELECT file_id, '_0x1f600_' || name AS encoded, '\U0001f600' || name AS decoded FROM file")
on_files("mojibake_repair", lambda f: f.select("file_id", *(repairs.repair(F.concat(F.lit(bad), "name")).alias(n) for n, bad in (("enye", "Espa\u00a5a MA\u00a5O "), ("latin", "Jos\u00c3\u00a9 "), ("page", "a\u00a4o mam\u00a0 ")))), "SELECT file_id, 'Espa\u00f1a MA\u00d1O ' || name AS enye, 'Jos\u00e9 ' || name AS latin, 'a\u00f1o mam\u00e1 ' || name AS page FROM file")
on_files("fnv_signature", lambda f: f.select("file_id", repairs.quick_signature(F.col("text").cast("binary"), F.col("ext")).alias("signature"), repairs.sample_fingerprint(F.col("text").cast("binary")).alias("fingerprint")), "")
del ORACLES["fnv_signature"]

# Execution


def free_name_plan(f: DataFrame) -> DataFrame:
    """Many claims on one name or a numbered one, in folders where some numbers are taken."""
    i = F.col("file_id")
    numbered = lambda n: F.concat(F.lit("p("), n.cast("string"), F.lit(")."), "ext")
    claims = f.select("file_id", F.col("folder").alias("dir"), F.when(i % 6 == 0, numbered(i % 5 + 1)).otherwise(F.concat(F.lit("p."), "ext")).alias("name"))
    existing = f.filter(i % 50 == 0).select(F.col("folder").alias("dir"), numbered(i % 9 + 1).alias("name")).distinct()
    return execute.free_names(claims, existing, "file_id").select("file_id", "free_name")


on_files("free_names", free_name_plan, """, c AS (SELECT file_id, folder AS dir, ext, CASE WHEN file_id % 6 = 0 THEN file_id % 5 + 1 END AS k FROM file),
    s AS (SELECT file_id, dir, ext, k, CASE WHEN k IS NULL THEN 'p' ELSE 'p(' || k || ')' END AS stem FROM c),
    x AS (SELECT DISTINCT folder AS dir, ext, file_id % 9 + 1 AS k FROM file WHERE file_id % 50 = 0),
    taken AS (SELECT dir, ext, 'p' AS stem, k AS n FROM x UNION SELECT dir, ext, 'p(' || k || ')', 0 FROM x UNION SELECT dir, ext, 'p', k FROM c WHERE k IS NOT NULL),
    most AS (SELECT dir, ext, stem, count(*) + 10 AS m FROM s GROUP BY ALL),
    every AS (SELECT dir, ext, stem, unnest(range(0, m)) AS n FROM most),
    free AS (SELECT *, row_number() OVER (PARTITION BY dir, ext, stem ORDER BY n) AS r FROM every ANTI JOIN taken USING (dir, ext, stem, n)),
    asked AS (SELECT *, row_number() OVER (PARTITION BY dir, ext, stem ORDER BY file_id) AS r FROM s)
    SELECT file_id, stem || CASE WHEN n = 0 THEN '' ELSE '(' || n || ')' END || '.' || ext AS free_name FROM asked JOIN free USING (dir, ext, stem, r)""")
on("quarantine_plan", lambda s, d: execute.quarantine_plan(content.roles(files(s, d))), f"WITH {FILES_SQL}" + ROLES_SQL + "SELECT sha256, file_id, 'quarantine' AS op, '_Duplicates/Takeout/' || folder AS target FROM roles WHERE role = 'duplicate'")
on_files("zip_safe_path", lambda f: f.select("file_id", zips.safe_path(F.concat(F.element_at(F.array(*map(F.lit, ["", "../", "/", "C:", "a/./", "a\\..\\", "\x07"])), (F.col("file_id") % 7 + 1).cast("int")), "path")).alias("target")), "SELECT file_id, CASE file_id % 7 WHEN 0 THEN path WHEN 4 THEN 'a/' || path WHEN 6 THEN path END AS target FROM file")
on("filetime_ticks", lambda s, d: dated(s, d).filter("taken IS NOT NULL").select("file_id", dates.filetime(F.col("taken")).alias("ticks")), DATED_SQL + "SELECT file_id, epoch_ms(taken) * 10000 + 116444736000000000 AS ticks FROM dated WHERE taken IS NOT NULL")

# Tags to write, and what else a whole run needs

MIMES = {"jpg": "image/jpeg", "png": "image/png", "mp4": "video/x-msvideo", "txt": "video/mpeg"}


def not_written(f: DataFrame) -> DataFrame:
    """Types by content of every other file only, with some extensions that no writer takes."""
    ext = F.when(F.col("file_id") % 6 == 0, "bmp").when(F.col("file_id") % 10 == 0, "mpg").otherwise(F.col("ext"))
    mime = F.when(F.col("file_id") % 2 == 0, F.try_element_at(F.create_map(*(F.lit(x) for kv in MIMES.items() for x in kv)), F.col("ext")))
    return f.select("file_id", tags.unsupported(ext, mime, F.lit(None).cast("string")).alias("kind"))


on_files("write_unsupported", not_written, ", u AS (SELECT file_id, CASE WHEN file_id % 6 = 0 THEN 'bmp' WHEN file_id % 10 = 0 THEN 'mpg' ELSE ext END AS x, CASE WHEN file_id % 2 = 0 THEN CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'mp4' THEN 'video/x-msvideo' ELSE 'video/mpeg' END END AS mime FROM file) SELECT file_id, CASE WHEN x = 'avi' OR mime = 'video/x-msvideo' THEN 'AVI' WHEN x = 'mpg' OR mime LIKE '%mpeg%' THEN 'MPEG' WHEN x = 'bmp' THEN 'BMP' END AS kind FROM u")


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, tags: the whole set for each dated or placed file, JPEG ones under XMP names."""
    days, fields = dated_and_placed(spark, sf_dir)
    rows = files(spark, sf_dir).select("file_id", "ext").join(days, "file_id").join(fields.select("file_id", "latitude", "longitude"), "file_id", "left")
    plain = tags.tags_of(F.col("taken"), F.col("method"), F.col("latitude"), F.col("longitude"))
    rows = rows.withColumn("plain", plain).filter(F.size("plain") > 0)
    return rows.select("file_id", tags.tag_key(F.when(F.col("ext") == "jpg", tags.as_xmp(F.col("plain"))).otherwise(F.col("plain"))).alias("tags"))


PLACE_SQL = f"SELECT file_id, CAST(json_extract_string(body, '$.geoData.latitude') AS DOUBLE) AS la, CAST(json_extract_string(body, '$.geoData.longitude') AS DOUBLE) AS lo FROM matched WHERE {CAREFUL_SQL}"
on("write_tag_sets", tag_sets, DATED_SQL + f""", g AS ({PLACE_SQL}), t AS (SELECT file_id, ext, strftime(taken, '%Y:%m:%d %H:%M:%S') AS c, method IN ('json', 'jsonTryHard') AS utc, la IS NOT NULL AND la <> 0 AND lo <> 0 AS placed, la, lo FROM dated JOIN (SELECT file_id, ext FROM file) USING (file_id) LEFT JOIN g USING (file_id)),
    k AS (SELECT file_id, CASE WHEN ext = 'jpg' THEN
        CASE WHEN utc THEN ['OffsetTime="+00:00"', 'OffsetTimeDigitized="+00:00"', 'OffsetTimeOriginal="+00:00"'] ELSE [] END || CASE WHEN c IS NOT NULL THEN ['XMP:CreateDate=' || c, 'XMP:DateTimeOriginal=' || c, 'XMP:ModifyDate=' || c] ELSE [] END || CASE WHEN placed THEN ['XMP:GPSLatitude=' || la, 'XMP:GPSLongitude=' || lo] ELSE [] END
        ELSE CASE WHEN c IS NOT NULL THEN ['DateTime=' || c, 'DateTimeDigitized=' || c, 'DateTimeOriginal=' || c] ELSE [] END || CASE WHEN placed THEN ['GPSLatitude=' || abs(la), 'GPSLatitudeRef=' || CASE WHEN la < 0 THEN 'S' ELSE 'N' END, 'GPSLongitude=' || abs(lo), 'GPSLongitudeRef=' || CASE WHEN lo < 0 THEN 'W' ELSE 'E' END] ELSE [] END || CASE WHEN utc THEN ['OffsetTime="+00:00"', 'OffsetTimeDigitized="+00:00"', 'OffsetTimeOriginal="+00:00"'] ELSE [] END END AS l FROM t)
    SELECT file_id, array_to_string(list_sort(l), ';') AS tags FROM k WHERE len(l) > 0""")
on("xmp_dates", lambda s, d: dated(s, d).filter("taken IS NOT NULL").select("file_id", dates.xmp_clock(F.col("taken"), F.col("method")).alias("xmp")), DATED_SQL + "SELECT file_id, strftime(taken, '%Y:%m:%d %H:%M:%S') || CASE WHEN method IN ('json', 'jsonTryHard') THEN '+00:00' ELSE '' END AS xmp FROM dated WHERE taken IS NOT NULL")
on("valid_positions", lambda s, d: matching.sidecar_fields(matched(s, d)).select("file_id", (tags.valid_coordinate(F.col("latitude")) & tags.valid_coordinate(F.col("longitude"))).alias("valid"), tags.valid_coordinate(F.col("longitude")).alias("east_west")), MATCH_SQL + "SELECT file_id, CAST(json_extract_string(body, '$.geoData.latitude') AS DOUBLE) <> 0 AND CAST(json_extract_string(body, '$.geoData.longitude') AS DOUBLE) <> 0 AS valid, CAST(json_extract_string(body, '$.geoData.longitude') AS DOUBLE) <> 0 AS east_west FROM matched")
on_files("identical_pairs", lambda f: content.identical(f.select(F.col("file_id").alias("b"), "size").join(f.groupBy("size").agg(F.min("file_id").alias("a")), "size").select("a", "b"), f), ", m AS (SELECT size, min(file_id) AS a FROM file GROUP BY 1) SELECT a, f.file_id AS b, sha256(g.text) = sha256(f.text) AS same FROM file f JOIN m USING (size) JOIN file g ON g.file_id = a")


def merged_away(f: DataFrame) -> DataFrame:
    """Entities of which a smaller file has the same size are taken to be merged away."""
    rows = f.select(F.col("file_id").alias("entity"), "size")
    gone = rows.join(f.groupBy("size").agg(F.min("file_id").alias("first")), "size").filter("entity <> first")
    return entities.remaining(rows, gone)


on_files("entities_remaining", merged_away, "SELECT min(file_id) AS entity, size FROM file GROUP BY size")


def plan_files(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    return plan_of(spark, sf_dir, policy).select(F.col("file_id").alias("source"), "target", (F.col("op") == "symlink").alias("link"))


on("files_union", lambda s, d: entities.all_files(plan_files(s, d, "nothing"), plan_files(s, d, "shortcut")), plan_sql("nothing").replace(" ops AS", " ops1 AS").replace(" o AS (SELECT", " o1 AS (SELECT").replace("FROM o)", "FROM o1)") + plan_sql("shortcut")[plan_sql("shortcut").index(", k AS") :][plan_sql("shortcut")[plan_sql("shortcut").index(", k AS") :].index(",\n    o AS") :] + "SELECT file_id AS source, target, op = 'symlink' AS link FROM ops1 UNION SELECT file_id, target, op = 'symlink' FROM ops")
on_files("touched_files", lambda f: tags.touched(content.roles(f).select("path", (F.col("role") == "primary").alias("is_primary"))), ROLES_SQL + ", t AS (SELECT path, bool_or(role = 'primary') AS p FROM roles GROUP BY 1) SELECT count(*) FILTER (p) AS primary_files, count(*) FILTER (NOT p) AS other_files FROM t")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric, value of a whole run, each step's in a row of its own."""
    f = files(spark, sf_dir)
    rows = content.roles(f).join(dated(spark, sf_dir).select("file_id", "method"), "file_id")
    canonical = names.is_canonical(F.col("folder"))
    found = rows.agg(F.count("*").alias("files"), F.count_if(F.col("ext").isin(names.MEDIA_EXTENSIONS)).alias("media"), F.count_if(F.col("role") == "duplicate").alias("duplicates_removed"), F.count_if(names.is_edited(F.col("name"))).alias("extras"), F.count_if(F.col("method") != "none").alias("dated"), F.countDistinct(F.when(~canonical, F.col("folder"))).alias("albums"))
    return found.select(F.explode(F.map_entries(F.create_map(*(x for c in found.columns for x in (F.lit(c), F.col(c)))))).alias("e")).select(F.col("e.key").alias("metric"), F.col("e.value").alias("value"))


EDITED_NAME_SQL = " OR ".join(f"ends_with(regexp_replace(lower(name), '\\.[^.]*$', ''), '{s}')" for s in names.EDITED_SUFFIXES)
on("run_summary", run_summary, DATED_SQL + ROLES_SQL + f", r AS (SELECT * FROM roles JOIN (SELECT file_id, method FROM dated) USING (file_id)), s AS (SELECT count(*) AS files, count(*) FILTER (ext IN ({quoted(names.MEDIA_EXTENSIONS)})) AS media, count(*) FILTER (role = 'duplicate') AS duplicates_removed, count(*) FILTER ({EDITED_NAME_SQL}) AS extras, count(*) FILTER (method <> 'none') AS dated, count(DISTINCT CASE WHEN NOT {CANONICAL_SQL} THEN folder END) AS albums FROM r) UNPIVOT s ON files, media, duplicates_removed, extras, dated, albums INTO NAME metric VALUE value".replace("UNPIVOT s ON", "SELECT metric, value FROM (UNPIVOT s ON") + ")")
on_files("extras_removed", lambda f: f.select("file_id", names.without_extra(F.col("name")).alias("plain")), f", e AS (SELECT file_id, name, ext, {EDITED_NAME_SQL} AS edited FROM file) SELECT file_id, CASE WHEN edited THEN regexp_replace(name, '-edited\\.[^.]*$', '') || '.' || ext ELSE name END AS plain FROM e")
on_files("zip_entry_names", lambda f: f.select("file_id", names.zip_entry_name(F.concat(F.lit("a?\\x. /"), "folder", F.lit("//"), F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("aux."), "ext")).otherwise(F.col("name")), F.lit(". "))).alias("entry")), "SELECT file_id, 'a_/x/' || folder || '/' || CASE WHEN file_id % 3 = 0 THEN 'aux_file.' || ext ELSE name END AS entry FROM file")
on_files("error_paths", lambda f: tags.bad_paths(f.select(F.concat(F.lit("Error: cannot read - /"), "path", F.lit("\nWarning: '/other/"), "name", F.lit("' is odd\nError in "), "path")).toDF("error")), "SELECT DISTINCT unnest(['/' || path, '/other/' || name]) AS path FROM file WHERE ext <> 'txt'")
on_files("media_counts", lambda f: f.filter(F.col("ext").isin(names.MEDIA_EXTENSIONS)).groupBy(names.is_year_folder(F.col("folder")).alias("in_year")).agg(F.count("*").alias("n")), f"SELECT {YEAR_SQL} AS in_year, count(*) AS n FROM file WHERE ext IN ({quoted(names.MEDIA_EXTENSIONS)}) GROUP BY 1")
on("resumed_dates", lambda s, d: dated(s, d).select("file_id", "taken").join(from_dictionary(s, d).withColumnRenamed("taken", "known"), "file_id", "left").select("file_id", F.coalesce("known", text_of("taken")).alias("taken")), DATED_SQL + f", k AS (SELECT path, min(file_id) AS i FROM file WHERE file_id % 2 = 0 GROUP BY 1) SELECT file_id, coalesce(strftime(make_timestamp((i * 86400 + 1200000000) * 1000000), {SQL_FORMAT}), strftime(taken, {SQL_FORMAT})) AS taken FROM dated JOIN (SELECT file_id, path FROM file) USING (file_id) LEFT JOIN k USING (path)")
on_files("albums_info_json", lambda f: f.filter(~names.is_canonical(F.col("folder"))).select("file_id", F.to_json(F.struct(F.trim("folder").alias("album"), F.col("name").alias("file"), "size")).alias("entry")), f"SELECT file_id, '{{\"album\":\"' || trim(folder) || '\",\"file\":\"' || name || '\",\"size\":' || size || '}}' AS entry FROM file WHERE NOT {CANONICAL_SQL}")


def exif_routes(f: DataFrame) -> DataFrame:
    """Every way through the router: listed, too large, native, native miss, film."""
    i, day = F.col("file_id"), lambda n: F.timestamp_seconds(F.col("file_id") * 86400 + n)
    mime = F.try_element_at(F.create_map(*(F.lit(x) for kv in {"jpg": "image/jpeg", "png": "image/png", "mp4": "video/mp4"}.items() for x in kv)), F.col("ext"))
    taken = matching.exif_route(F.col("size") * 65536, i % 3 == 0, mime, F.when(i % 10 == 0, day(1)), F.when(i % 4 != 1, day(2)), F.when(i % 7 != 0, day(3)))
    return f.select("file_id", text_of(taken).alias("taken"))


on_files("exif_route", exif_routes, f", r AS (SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 1 WHEN file_id % 3 = 0 AND size * 65536 > 67108864 THEN NULL WHEN ext IN ('jpg', 'png') AND file_id % 4 <> 1 THEN 2 WHEN file_id % 7 <> 0 THEN 3 END AS n FROM file) SELECT file_id, strftime(make_timestamp((file_id * 86400 + n) * 1000000), {SQL_FORMAT}) AS taken FROM r")
