"""Carries out planned file operations, in the tasks, on a file system that all executors mount.

Each row names all that its operation needs, the free name of its target
included, so that tasks need not look at each other. A task that runs twice
(lost executor, speculation) finds its own work done and reports success
again; files come into being under a name of their own and are then renamed.
"""

from __future__ import annotations

import errno
import filecmp
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from datetime import timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions import names
from lumenarc.runtime import Workspace, ship

#: What must have succeeded for an entity before the next of these begins.
PHASES = [("move", "copy", "quarantine"), ("symlink", "reverse_symlink"), ("delete",)]
NUMBERED = r"^(.+)\(([1-9]\d{0,8})\)(\.[^.]*)?$"


def free_names(claims: DataFrame, existing: DataFrame, claim_id: str = "claim_id") -> DataFrame:
    """claims(claim_id, dir, name, ..) with ``free_name``: the name, or ``stem(n).ext`` with the least n that is free.

    existing(dir, name) are taken, and so is a numbered name that some claim
    asks for itself. Case makes no difference. Null names stay null. Of equal
    claims the least claim_id goes first. Each family of names (folder, stem,
    extension) is numbered by one running count: of n-th rank r the number is
    r plus the taken numbers that have at most r free ones below them.
    """
    ext = F.regexp_extract("name", r"^.+(\.[^.]*)$", 1)
    parsed = F.regexp_extract("name", NUMBERED, 2)
    family = {"stem": F.lower(names.stem(F.col("name"))), "ext": F.lower(ext)}
    as_numbered = F.struct(F.lower(F.regexp_extract("name", NUMBERED, 1)).alias("stem"), F.lower(F.regexp_extract("name", NUMBERED, 3)).alias("ext"), parsed.try_cast("long").alias("n"))
    as_plain = F.struct(family["stem"].alias("stem"), family["ext"].alias("ext"), F.lit(0).cast("long").alias("n"))

    named = claims.filter("name IS NOT NULL")
    asked = named.filter(parsed != "").select("dir", F.inline(F.array(as_numbered)))
    held = existing.filter("name IS NOT NULL").select("dir", F.inline(F.array_compact(F.array(as_plain, F.when(parsed != "", as_numbered)))))
    taken = held.unionByName(asked).distinct()

    key = ["dir", "stem", "ext"]
    gap = F.col("n") - (F.row_number().over(Window.partitionBy(*key).orderBy("n")) - 1)
    rank = (F.row_number().over(Window.partitionBy(*key).orderBy(claim_id)) - 1).cast("long")
    marks = taken.select(*key, gap.alias("at"), F.lit(0).alias("is_claim"), F.lit(None).cast(claims.schema[claim_id].dataType).alias(claim_id))
    ranked = named.select("dir", claim_id, *(c.alias(n) for n, c in family.items())).withColumn("at", rank)
    rows = marks.unionByName(ranked.withColumn("is_claim", F.lit(1)))
    below = F.sum(1 - F.col("is_claim")).over(Window.partitionBy(*key).orderBy("at", "is_claim").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("n", F.col("at") + below).filter("is_claim = 1").select(claim_id, "n")
    free = F.when(F.col("n") == 0, F.col("name")).otherwise(F.concat(names.stem(F.col("name")), F.lit("("), F.col("n").cast("string"), F.lit(")"), ext))
    return claims.join(numbered, claim_id, "left").withColumn("free_name", free).drop("n")


def operations(plan: DataFrame, files: DataFrame, out_root: str, existing: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """plan(sha256, file_id, op, target) as rows to execute: op_id, entity, op, source, target, taken.

    files gives file_id, path and ext; existing(dir, name) is what lies below
    out_root already; taken(file_id, taken) are the dates that moved files get.
    Links point at the entity's first moved or copied file.
    """
    path = F.col("path")
    rows = plan.join(files.select("file_id", "path", "ext"), "file_id").filter(F.col("op").isin([o for phase in PHASES for o in phase]))
    rows = rows.withColumns({"entity": F.concat_ws(".", "sha256", "ext"), "op_id": F.concat_ws("/", "file_id", "op"), "dir": F.when(F.col("op") != "delete", F.concat(F.lit(out_root + "/"), "target")), "name": F.when(F.col("op") != "delete", names.base_name(path))})
    rows = free_names(rows, existing, "op_id").withColumn("target", F.concat_ws("/", "dir", "free_name"))
    carried = rows.filter(F.col("op").isin(*PHASES[0])).groupBy("entity").agg(F.min_by("target", F.struct(F.col("op") != "move", F.col("file_id"))).alias("carried"))
    rows = rows.join(carried, "entity", "left")
    source = F.when(F.col("op").isin(*PHASES[1]), F.col("carried")).otherwise(path)
    if taken is None:
        rows = rows.withColumn("taken", F.lit(None).cast("timestamp"))
    else:
        rows = rows.join(taken.select("file_id", "taken"), "file_id", "left")
    return rows.select("op_id", "entity", "op", source.alias("source"), "target", "taken")


def quarantine_plan(roles: DataFrame) -> DataFrame:
    """Duplicates go to ``_Duplicates/<their own folder>`` instead of being removed."""
    target = F.concat_ws("/", F.lit("_Duplicates"), F.nullif(names.directory(F.col("path")), F.lit("")))
    return roles.filter("role = 'duplicate'").select("sha256", "file_id", F.lit("quarantine").alias("op"), target.alias("target"))


def _settle(source: str, target: str) -> bool:
    """Whether an earlier attempt made ``target``; another file there is an error."""
    if not os.path.lexists(target):
        return False
    if os.path.isfile(target) and filecmp.cmp(source, target, shallow=False):
        return True
    raise FileExistsError(errno.EEXIST, "another file is there", target)


def _copy(source: str, target: str) -> None:
    if _settle(source, target):
        return
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        shutil.copy2(source, part)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)


def _move(source: str, target: str) -> None:
    if not os.path.lexists(source) and os.path.lexists(target):
        return
    if not _settle(source, target):
        try:
            os.rename(source, target)
            return
        except OSError as error:
            if error.errno != errno.EXDEV:
                raise
        _copy(source, target)
    if os.path.abspath(source) != os.path.abspath(target):
        os.remove(source)


def _link(source: str, target: str) -> None:
    text = os.path.relpath(source, os.path.dirname(target))
    if os.path.islink(target) and os.readlink(target) == text:
        return
    os.symlink(text, target)


def _delete(source: str, _: str) -> None:
    try:
        os.remove(source)
    except FileNotFoundError:
        pass


ACTIONS: dict[str, Callable[[str, str], None]] = {"move": _move, "quarantine": _move, "copy": _copy, "symlink": _link, "reverse_symlink": _link, "delete": _delete}


def set_time(path: str, taken: pd.Timestamp) -> None:
    """Modification and access time, of a link itself rather than of what it points at."""
    seconds = taken.to_pydatetime().replace(tzinfo=timezone.utc).timestamp()
    os.utime(path, (seconds, seconds), follow_symlinks=False)


def perform(op: str, source: str | None, target: str | None, taken: pd.Timestamp | None) -> str | None:
    """None, or why the operation failed. Failures are results: they never stop the others."""
    try:
        if not source or (op != "delete" and not target):
            raise ValueError("no source" if not source else "no target")
        if op != "delete":
            os.makedirs(os.path.dirname(target), exist_ok=True)
        ACTIONS[op](source, target)
        if op != "delete" and taken is not None and not pd.isna(taken):
            set_time(target, taken)
    except (OSError, ValueError) as error:
        return f"{type(error).__name__}: {error}"
    return None


def _perform_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors = [perform(*row) for row in b[["op", "source", "target", "taken"]].itertuples(index=False, name=None)]
        yield pd.DataFrame({"op_id": b["op_id"], "entity": b["entity"], "op": b["op"], "target": b["target"], "ok": [e is None for e in errors], "error": errors})


def execute(ops: DataFrame) -> DataFrame:
    """op_id, entity, op, target, ok, error of each operation, in three phases: carry, link, delete.

    An entity that failed in one phase is skipped in the next (``error`` says
    so), so that no source is deleted whose copy does not exist. Results are
    written between the phases; an empty plan gives an empty result.
    """
    spark = ops.sparkSession
    ship(spark)
    work = Workspace(spark, "execute")
    ops = work.save(ops, "plan")
    schema = "op_id string, entity string, op string, target string, ok boolean, error string"
    done: DataFrame | None = None
    for i, phase in enumerate(PHASES):
        rows = ops.filter(F.col("op").isin(*phase))
        skipped = None
        if done is not None:
            failed = done.filter(~F.col("ok")).select("entity").distinct()
            skipped = rows.join(failed, "entity", "left_semi").select("op_id", "entity", "op", "target", F.lit(False).alias("ok"), F.lit("skipped: an earlier operation failed").alias("error"))
            rows = rows.join(failed, "entity", "left_anti")
        found = rows.select("op_id", "entity", "op", "source", "target", "taken").mapInPandas(_perform_all, schema)
        found = work.save(found if skipped is None else found.unionByName(skipped), f"phase{i}")
        done = found if done is None else done.unionByName(found)
    return done


def summary(results: DataFrame, root: str) -> DataFrame:
    """op, is_album, operations, failures."""
    album: Column = F.coalesce(F.col("target").startswith(f"{root}/Albums/") | F.col("target").startswith(f"{root}/Untitled Albums/"), F.lit(False))
    return results.groupBy("op", album.alias("is_album")).agg(F.count("*").alias("operations"), F.count_if(~F.col("ok")).alias("failures"))


def rename_pair(media: str, new_media: str, sidecar: str | None) -> None:
    """Renames a file and its sidecar, or neither; what an earlier attempt renamed stays so."""
    new_sidecar = f"{new_media}.json"
    if os.path.lexists(media):
        if os.path.lexists(new_media):
            raise FileExistsError(errno.EEXIST, "another file is there", new_media)
        os.rename(media, new_media)
    elif not os.path.lexists(new_media):
        raise FileNotFoundError(errno.ENOENT, "no such file", media)
    elif sidecar is not None and not os.path.lexists(sidecar) and os.path.lexists(new_sidecar):
        return
    if sidecar is None:
        return
    try:
        if os.path.lexists(new_sidecar):
            raise FileExistsError(errno.EEXIST, "another file is there", new_sidecar)
        os.rename(sidecar, new_sidecar)
    except OSError:
        os.rename(new_media, media)
        raise


def rename_plan(files: DataFrame, fixes: DataFrame, found: DataFrame, root: str = "") -> DataFrame:
    """op_id, media, new_media, sidecar of fixes(file_id, new_name): files(file_id, folder, name) beside their sidecar.

    found(file_id, dir, json_name) are the sidecars of those that have one. Of
    files that share a sidecar the least id takes it along; the others are
    renamed alone.
    """
    # One row per sidecar before it meets the files.
    own = found.join(fixes.select("file_id"), "file_id", "left_semi").groupBy("dir", "json_name").agg(F.min("file_id").alias("file_id"))
    rows = fixes.select("file_id", "new_name").join(files.select("file_id", "folder", "name"), "file_id").join(own, "file_id", "left")
    prefix = [F.lit(root)] if root else []
    sidecar = F.when(F.col("json_name").isNotNull(), F.concat_ws("/", *prefix, "dir", "json_name"))
    return rows.select(F.col("file_id").cast("string").alias("op_id"), F.concat_ws("/", *prefix, "folder", "name").alias("media"), F.concat_ws("/", *prefix, "folder", "new_name").alias("new_media"), sidecar.alias("sidecar"))


def _rename_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors = []
        for media, new_media, sidecar in b[["media", "new_media", "sidecar"]].itertuples(index=False, name=None):
            try:
                rename_pair(media, new_media, sidecar if isinstance(sidecar, str) else None)
                errors.append(None)
            except OSError as error:
                errors.append(f"{type(error).__name__}: {error}")
        yield pd.DataFrame({"op_id": b["op_id"], "new_media": b["new_media"], "ok": [e is None for e in errors], "error": errors})


def rename_pairs(plan: DataFrame) -> DataFrame:
    """op_id, new_media, ok, error of each pair of a rename plan; a pair that fails is left as it was and stops no other."""
    ship(plan.sparkSession)
    return Workspace(plan.sparkSession, "rename").save(plan.mapInPandas(_rename_all, "op_id string, new_media string, ok boolean, error string"), "renamed")


def bisected(batch: list, act: Callable[[list], object]) -> tuple[list, list]:
    """(done, failed): a batch that fails as a whole is halved until the rows at fault stand alone."""
    done, failed, waiting = [], [], [batch] if batch else []
    while waiting:
        part = waiting.pop()
        try:
            act(part)
            done += part
        except Exception:  # noqa: BLE001 - whatever the tool raises
            if len(part) == 1:
                failed += part
            else:
                half = len(part) // 2
                waiting += [part[half:], part[:half]]
    return done, failed
