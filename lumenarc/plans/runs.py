"""Registered queries of the album document and of a run in steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions import names
from lumenarc.operators import content, steps
from lumenarc.plans.catalogue import CANONICAL_SQL, EDITED_NAME_SQL, ROLES_SQL, on, quoted
from lumenarc.runtime import Workspace, mounted
from lumenarc.sources.archive import FILES_SQL, files
from lumenarc.sources.document import write_document

ENTRY = ["albumName", "albumPath", "fileName", "filePath", "targetPath"]
ENTRY_SCHEMA = f"albums map<string, array<struct<{', '.join(f'{c}: string' for c in ENTRY)}>>>, metadata struct<strategy: string, total_albums: long, total_entities: long>"


def album_entries(roles: DataFrame) -> DataFrame:
    """An entry for each file of an album folder that is no duplicate; the target is its entity's primary file."""
    entity = ["size", "ext", "sha256"]
    primary = roles.filter("role = 'primary'").select(*entity, F.concat(F.lit("ALL_PHOTOS/"), "name").alias("targetPath"))
    rows = roles.filter((F.col("role") != "duplicate") & ~names.is_canonical(F.col("folder"))).join(primary, entity)
    return rows.select(F.col("folder").alias("albumName"), F.concat(F.lit("Albums/"), "folder").alias("albumPath"), F.col("name").alias("fileName"), F.concat_ws("/", F.lit("Albums"), "folder", "name").alias("filePath"), "targetPath")


def albums_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document written by all tasks, and read back as (album, entries, first and last file, total_albums)."""
    work = Workspace(spark, "albums")
    entries = work.save(album_entries(content.roles(files(spark, sf_dir))), "entries")
    path = f"{work.root}/albums-info.json"
    write_document(entries, "albumName", ENTRY[1:], mounted(path), "albums", {"total_entities": entries.count(), "strategy": "json"})
    read = spark.read.schema(ENTRY_SCHEMA).option("multiLine", "true").json(path)
    rows = read.select(F.explode("albums").alias("album", "of"), "metadata.*")
    return rows.select("album", F.size("of").cast("long").alias("entries"), F.get("of", F.lit(0))["fileName"].alias("first_file"), F.element_at("of", -1)["targetPath"].alias("last_target"), "strategy", "total_albums", "total_entities")


on("albums_document", albums_document, f"""WITH {FILES_SQL}{ROLES_SQL}, p AS (SELECT size, ext, sha256, 'ALL_PHOTOS/' || name AS target FROM roles WHERE role = 'primary'),
e AS (SELECT folder AS album, name, target FROM roles JOIN p USING (size, ext, sha256) WHERE role <> 'duplicate' AND NOT {CANONICAL_SQL})
SELECT album, count(*) AS entries, min(name) AS first_file, (array_agg(target ORDER BY name DESC, target DESC))[1] AS last_target, 'json' AS strategy, (SELECT count(DISTINCT album) FROM e) AS total_albums, (SELECT count(*) FROM e) AS total_entities FROM e GROUP BY album""")

# C14, A15, E20, E24


def archive_steps(sf_dir: str) -> list[steps.Step]:
    canonical = names.is_canonical(F.col("folder"))
    return [
        steps.Step(1, "fix extensions", lambda s, t: {}, skip=lambda o: "extensions are left as they are" if o.get("fix_extensions") == "none" else None),
        steps.Step(2, "discover", lambda s, t: {"files": files(s, sf_dir)}, {"files": {"files": F.count(F.lit(1)), "media": F.count_if(F.col("ext").isin(names.MEDIA_EXTENSIONS)), "extras": F.count_if(names.is_edited(F.col("name"))), "in_albums": F.count_if(~canonical)}}),
        steps.Step(3, "merge", lambda s, t: {"roles": content.roles(t["files"])}, {"roles": {"primary": F.count_if(F.col("role") == "primary"), "secondary": F.count_if(F.col("role") == "secondary"), "duplicates_removed": F.count_if(F.col("role") == "duplicate"), "bytes_saved": F.sum(F.when(F.col("role") == "duplicate", F.col("size")).otherwise(0))}}),
        steps.Step(5, "albums", lambda s, t: {"entries": album_entries(t["roles"])}, {"entries": {"album_entries": F.count(F.lit(1))}}, skip=lambda o: "no albums are made" if o.get("albums") == "nothing" else None),
    ]


def run_in_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that the steps observed: of a first run without albums, and of one that resumes it and makes them."""
    root = mounted(Workspace(spark, "run").root)
    steps.run(spark, archive_steps(sf_dir), sf_dir, root, {"fix_extensions": "none", "albums": "nothing"})
    outcomes, _ = steps.run(spark, archive_steps(sf_dir), sf_dir, root, {"fix_extensions": "none"})
    return steps.summary(spark, outcomes)


on("run_in_steps", run_in_steps, f"""WITH {FILES_SQL}{ROLES_SQL}, m AS (SELECT 'discover' AS step, 'resumed' AS state, 'files' AS metric, count(*) AS value FROM file
UNION ALL SELECT 'discover', 'resumed', 'media', count(*) FROM file WHERE ext IN ({quoted(names.MEDIA_EXTENSIONS)}) UNION ALL SELECT 'discover', 'resumed', 'extras', count(*) FROM file WHERE {EDITED_NAME_SQL} UNION ALL SELECT 'discover', 'resumed', 'in_albums', count(*) FROM file WHERE NOT {CANONICAL_SQL}
UNION ALL SELECT 'merge', 'resumed', 'primary', count(*) FROM roles WHERE role = 'primary' UNION ALL SELECT 'merge', 'resumed', 'secondary', count(*) FROM roles WHERE role = 'secondary'
UNION ALL SELECT 'merge', 'resumed', 'duplicates_removed', count(*) FROM roles WHERE role = 'duplicate' UNION ALL SELECT 'merge', 'resumed', 'bytes_saved', CAST(coalesce(sum(size), 0) AS BIGINT) FROM roles WHERE role = 'duplicate'
UNION ALL SELECT 'albums', 'done', 'album_entries', count(*) FROM roles WHERE role <> 'duplicate' AND NOT {CANONICAL_SQL})
SELECT * FROM m""")
