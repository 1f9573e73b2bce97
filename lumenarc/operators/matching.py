"""Media files and their sidecars, and the dates that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import dates, names
from lumenarc.runtime import Workspace


#: (name, transformation of the file's name), from the most careful to the boldest; the last four only if tried hard.
STRATEGIES = [
    ("as it is", lambda n: n),
    ("shortened", names.short_name),
    ("bracket swapped", names.bracket_swap),
    ("no extension", names.stem),
    ("no edited ending", names.without_edit),
    ("motion photo", names.motion_photo),
    ("other extension", names.as_heic),
    ("no partial ending", names.without_partial_edit),
    ("extension restored", names.with_restored_extension),
    ("no edge-case ending", names.without_edge_edit),
]
BASIC = 6
# Fixed value: types whose tags are read natively.
NATIVE_TYPES = ["image/jpeg", "image/tiff", "image/heic", "image/png", "image/webp", "image/jxl"]


def sidecar_forms(plain: Column, number: Column) -> Column:
    """The sidecar names of one plain name, in the order they are tried.

    The full suffix; if that exceeds the limit, the suffix cut to each length
    that fits; the full suffix with the file's number after or before it; the
    plain one; the plain one with the number. ``plain`` is used so often that it
    should be a column or an element, not an expression.
    """
    full = names.SIDECAR_SUFFIX
    bare = F.regexp_replace(plain, r"\(\d+\)", "")
    long = F.length(plain) + len(full) + 5 > names.NAME_LIMIT
    room = F.greatest(F.lit(0), F.least(F.lit(len(full) - 1), F.lit(names.NAME_LIMIT - 6) - F.length(plain)))
    cut = F.transform(F.when(long & (room > 0), F.sequence(room, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: F.concat(plain, F.left(F.lit(full), n + 1), F.lit(".json")))
    numbered = lambda *parts: F.when(number != "", F.concat(*parts))
    return F.array_compact(
        F.concat(
            F.array(F.concat(plain, F.lit(f"{full}.json"))),
            cut,
            F.array(numbered(bare, F.lit(full), number, F.lit(".json")), numbered(bare, number, F.lit(f"{full}.json")), F.concat(plain, F.lit(".json")), numbered(bare, number, F.lit(".json"))),
        )
    )


def number_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(\(\d+\))", 1)


def sidecar_names(name: Column, strategies: list[tuple]) -> Column:
    """(json_name, strategy) of all sidecars that a file could have by ``strategies``, in the order they are tried; a name may come again."""
    plains = F.array(*(F.struct(F.lit(strategy).alias("strategy"), change(name).alias("plain"), number_of(name).alias("number")) for strategy, change in strategies))
    forms = lambda x: F.transform(sidecar_forms(x["plain"], x["number"]), lambda n: F.struct(n.alias("json_name"), x["strategy"].alias("strategy")))
    return F.flatten(F.transform(plains, forms))


def root_of(name: Column) -> Column:
    """The start of a name that every strategy keeps: up to the first bracket, dot or dash, at most 12 characters."""
    return F.left(F.regexp_extract(name, r"^[^(.\-]*", 0), F.lit(12))


def near_sidecars(files: DataFrame, there: DataFrame) -> DataFrame:
    """file_id, dir, name of the files whose folder has a sidecar (of ``there``) with the same root: no other can have one."""
    rooted = there.select("dir", root_of(F.col("json_name")).alias("root")).distinct()
    near = files.select("file_id", "name", F.col("folder").alias("dir"), root_of(F.col("name")).alias("root"))
    return near.join(rooted, ["dir", "root"], "left_semi").drop("root")


def names_met(near: DataFrame, there: DataFrame, strategies: list[tuple]) -> DataFrame:
    """file_id, dir, json_name, strategy of the first name of ``there`` (dir, json_name; each once) that fits near(file_id, dir, name)."""
    # Exploded twice, so that the costly plain names are made once each and their forms, by the dozen, from a column.
    name = F.col("name")
    plains = near.select("file_id", "dir", "name", number_of(name).alias("number"), F.posexplode(F.array_distinct(F.array(*(change(name) for _, change in strategies)))).alias("rank", "plain"))
    wide = plains.select("file_id", "dir", "name", "rank", "plain", F.posexplode(sidecar_forms(F.col("plain"), F.col("number"))).alias("form", "json_name"))
    best = wide.join(there, ["dir", "json_name"]).groupBy("file_id").agg(F.min_by(F.struct("dir", "json_name", "name", "plain"), F.struct("rank", "form")).alias("m")).select("file_id", "m.*")
    strategy = F.coalesce(*(F.when(change(name) == F.col("plain"), strategy) for strategy, change in strategies))
    return best.select("file_id", "dir", "json_name", strategy.alias("strategy"))


def sidecar_match(files: DataFrame, sidecars: DataFrame, tryhard: bool = False) -> DataFrame:
    """file_id, json_name, strategy, body of the first sidecar name that exists in the file's folder.

    The bold strategies look only at files that the careful ones leave without
    a sidecar. Bodies come last: of the one chosen; of repeated names the least.
    Names are written once and read by every step.
    """
    work = Workspace(files.sparkSession, "sidecars")
    there = work.save(sidecars.select("dir", "json_name").distinct(), "there")
    near = near_sidecars(files, there)
    if tryhard:
        near = work.save(near, "near")
        careful = work.save(names_met(near, there, STRATEGIES[:BASIC]), "careful")
        rest = near.join(careful.select("file_id"), "file_id", "left_anti")
        met = careful.unionByName(names_met(rest, there, STRATEGIES[BASIC:]))
    else:
        met = names_met(near, there, STRATEGIES[:BASIC])
    bodies = sidecars.groupBy("dir", "json_name").agg(F.min("body").alias("body"))
    return met.join(bodies, ["dir", "json_name"]).select("file_id", "json_name", "strategy", "body")


def staged_match(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """file_id, stage, dir, json_name: the sidecar of each file(file_id, folder, name), found for the mending of extensions.

    Stages, each an equi-join over what is still without a sidecar: the careful
    names; the bold ones; ``<name>.json``; the same without regard to case and
    blanks at the end, or to the extension (``folded``); and both in the folder
    without the blanks at its end, if it has any. Of several sidecars with one
    folded name, full names go before names without extension, then the least.
    Files without a sidecar are absent, as are those with a null name or folder.
    """
    work = Workspace(files.sparkSession, "staged-match")
    there = sidecars.select("dir", "json_name").filter(F.lower("json_name").endswith(".json")).distinct()
    plain = F.left(F.col("json_name"), F.length("json_name") - 5)
    # Two keys a sidecar: its whole name, and its name as if it were a file's without extension.
    keyed = there.select("dir", "json_name", F.posexplode(F.array(F.lower("json_name"), F.lower(F.rtrim(plain)))).alias("rank", "key"))
    bare = F.rtrim("folder")

    def direct(rest: DataFrame, folder: Column) -> DataFrame:
        wanted = rest.select("file_id", folder.alias("dir"), F.concat("name", F.lit(".json")).alias("json_name"))
        return wanted.join(there, ["dir", "json_name"], "left_semi")

    def folded(rest: DataFrame, folder: Column) -> DataFrame:
        full, short = F.lower(F.concat("name", F.lit(".json"))), F.lower(F.rtrim(names.stem(F.col("name"))))
        wanted = rest.select("file_id", folder.alias("dir"), F.posexplode(F.array(full, short)).alias("rank", "key"))
        best = wanted.join(keyed, ["dir", "rank", "key"]).groupBy("file_id").agg(F.min(F.struct("rank", "json_name", "dir")).alias("m"))
        return best.select("file_id", "m.dir", "m.json_name")

    trimmed = lambda find: lambda rest: find(rest.filter(bare != F.col("folder")), bare)
    stages = {
        "careful": lambda rest: names_met(near_sidecars(rest, there), there, STRATEGIES[:BASIC]),
        "bold": lambda rest: names_met(near_sidecars(rest, there), there, STRATEGIES[BASIC:]),
        "direct": lambda rest: direct(rest, F.col("folder")),
        "folded": lambda rest: folded(rest, F.col("folder")),
        "trimmed": trimmed(direct),
        "trimmed folded": trimmed(folded),
    }
    rest, found = work.save(files.select("file_id", "folder", "name"), "rest"), None
    for i, (stage, find) in enumerate(stages.items()):
        met = work.save(find(rest).select("file_id", F.lit(stage).alias("stage"), "dir", "json_name"), f"met-{i}")
        found = met if found is None else found.unionByName(met)
        # What is left shrinks from stage to stage; it is written, so a stage doesn't repeat the ones before.
        rest = work.save(rest.join(met, "file_id", "left_anti"), f"rest-{i}")
    return found


def title_status(matched: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, status, new_name: whether the sidecar's title shows that the file's name was cut off.

    Status: no sidecar, no title, not truncated, target exists, or truncated;
    the last has the name the file should have, with its own extension (both of
    a double one).
    """
    rows = files.select("file_id", "folder", "name").join(matched.select("file_id", "body"), "file_id", "left")
    title = F.get_json_object("body", "$.title")
    double = r"\.[a-zA-Z0-9]{2,5}\.[a-zA-Z0-9]{2,5}$"
    ext = F.when(F.col("name").rlike(double), F.regexp_extract("name", double, 0)).otherwise(F.regexp_extract("name", r"^.+(\.[^.]*)$", 1))
    now = F.left(F.col("name"), F.length("name") - F.length(ext))
    full = F.regexp_replace(title, r"\.[a-zA-Z0-9]{2,5}$", "")
    a, b = F.trim(F.lower(now)), F.trim(F.lower(full))
    cut = (F.length(a) < F.length(b)) & b.startswith(a)
    rows = rows.withColumn("new_name", F.when(F.coalesce(cut, F.lit(False)), F.concat(F.regexp_replace(F.regexp_replace(full, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f]", ""), ext)))
    taken = files.select("folder", F.col("name").alias("new_name"), F.lit(True).alias("taken")).distinct()
    rows = rows.join(taken, ["folder", "new_name"], "left")
    status = F.when(F.col("body").isNull(), "no sidecar").when(F.coalesce(title, F.lit("")) == "", "no title").when(F.col("new_name").isNull(), "not truncated").when(F.col("taken"), "target exists").otherwise("truncated")
    return rows.select("file_id", status.alias("status"), F.when(status == "truncated", F.col("new_name")).alias("new_name"))


def dictionary_dates(files: DataFrame, dictionary: DataFrame) -> DataFrame:
    """file_id, taken from dictionary(path, oldest): an outside list of dates, its slashes normalised."""
    known = dictionary.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), dates.from_mixed_text(F.col("oldest")).alias("taken")).filter("taken is not null")
    first = known.groupBy("path").agg(F.min("taken").alias("taken"))
    return files.select("file_id", "path").join(first, "path").select("file_id", "taken")


def sidecar_fields(matched: DataFrame) -> DataFrame:
    """Date taken, coordinates, title and whether a partner shared it."""
    get = lambda p: F.get_json_object("body", p)
    return matched.select("file_id", dates.from_epoch(get("$.photoTakenTime.timestamp")).alias("taken"), get("$.geoData.latitude").try_cast("double").alias("latitude"), get("$.geoData.longitude").try_cast("double").alias("longitude"), get("$.title").alias("title"), get("$.googlePhotosOrigin.fromPartnerSharing").isNotNull().alias("partner_shared"))


def method_dates(files: DataFrame, matched: DataFrame, exif: DataFrame, latest_year: int = 2026) -> DataFrame:
    """file_id and the date that each method finds: json, exif, guess, jsonTryHard, folderYear.

    ``matched`` has the best of all strategies; a match by one of the careful
    ones is json, one by the bold ones jsonTryHard. ``exif`` is (file_id, raw).
    """
    taken = sidecar_fields(matched).select("file_id", F.col("taken").alias("sidecar")).join(matched.select("file_id", "strategy"), "file_id")
    careful = F.col("strategy").isin([s for s, _ in STRATEGIES[:BASIC]])
    rows = files.select("file_id", "folder", "name").join(taken, "file_id", "left").join(exif.select("file_id", dates.from_exif(F.col("raw")).alias("exif")), "file_id", "left")
    found = {"json": F.when(careful, F.col("sidecar")), "exif": F.col("exif"), "guess": dates.from_name(F.col("name")), "jsonTryHard": F.when(~careful, F.col("sidecar")), "folderYear": dates.from_folder(F.col("folder"), latest_year)}
    return rows.select("file_id", *(c.alias(m) for m, c in found.items()))


def first_method(columns: dict[str, Column]) -> list[Column]:
    """taken, method and accuracy: of the first method with a date; ``none`` and 99 without any."""
    method = F.coalesce(*(F.when(c.isNotNull(), F.lit(m)) for m, c in columns.items()), F.lit("none"))
    accuracy = F.coalesce(*(F.when(c.isNotNull(), F.lit(dates.ACCURACY[m])) for m, c in columns.items()), F.lit(dates.ACCURACY["none"]))
    return [F.coalesce(*columns.values()).alias("taken"), method.alias("method"), accuracy.alias("accuracy")]


def date_waterfall(found: DataFrame) -> DataFrame:
    """file_id, taken, method, accuracy of method_dates: the first method that has one."""
    return found.select("file_id", *first_method({m: F.col(m) for m in dates.METHODS[:-1]}))


def entity_dates(roles: DataFrame, found: DataFrame) -> DataFrame:
    """sha256, ext, taken, method, accuracy of each entity: method by method, its primary file first, then the others in rank.

    EXIF is read of the primary alone; duplicates have no say.
    """
    rows = roles.filter("role <> 'duplicate'").join(found, "file_id")
    first = lambda m: F.min_by(m, F.when(F.col(m).isNotNull(), F.col("entity_rank")))
    own = {m: (F.max(F.when(F.col("role") == "primary", F.col(m))) if m == "exif" else first(m)) for m in dates.METHODS[:-1]}
    best = rows.groupBy("size", "ext", "sha256").agg(*(c.alias(m) for m, c in own.items()))
    return best.select("sha256", "ext", *first_method({m: F.col(m) for m in dates.METHODS[:-1]}))


def exif_route(size: Column, enforced: Column, mime: Column, listed: Column, native: Column, external: Column) -> Column:
    """The date to take of an outside list, the native reader and an outside tool: the list first; nothing for a file that is
    too large; the tool alone for films and types that the native reader doesn't know; else the native date, then the tool's."""
    read = F.when(names.too_large(size, enforced), None).when(mime.isin(*NATIVE_TYPES), F.coalesce(native, external)).otherwise(external)
    return F.coalesce(listed, read)
