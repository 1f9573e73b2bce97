"""Zip archives: their entries as a table, and extraction of all of them.

An archive is read by as many tasks as its bytes fill, each opening it for its
own entries, so that one large archive isn't one task's work. Contents are
streamed from file to file and never become rows.
"""

from __future__ import annotations

import os
import shutil
import stat
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import names
from lumenarc.runtime import Workspace, ship

ENTRIES = "zip string, entry string, position long, size long, is_link boolean, error string"


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["zip", "entry", "position", "size", "is_link", "error"]
    for b in batches:
        for path in b["path"]:
            try:
                with zipfile.ZipFile(path) as z:
                    found = [(path, i.filename, n, i.file_size, stat.S_ISLNK(i.external_attr >> 16), None) for n, i in enumerate(z.infolist()) if not i.is_dir()]
            except (OSError, zipfile.BadZipFile, TypeError) as error:
                found = [(path, None, None, None, None, f"{type(error).__name__}: {error}")]
            yield pd.DataFrame(found, columns=columns).astype({"position": "Int64", "size": "Int64", "is_link": "boolean"})


def entries(zips: DataFrame) -> DataFrame:
    """zip, entry, position, size, is_link of each file in zips(path); a row with ``error`` for each unreadable archive."""
    ship(zips.sparkSession)
    return zips.select("path").distinct().mapInPandas(_list, ENTRIES)


def safe_path(entry: Column) -> Column:
    """The entry's path below the destination; null if it would leave it (absolute, with a drive, or over ``..``)."""
    plain = F.replace(entry, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    cleaned = F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"[\x00-\x1F\x7F]", "")), "/")
    leaves = plain.startswith("/") | plain.rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..")
    return F.when(~leaves & (cleaned != ""), cleaned)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors = pd.Series([None] * len(b), index=b.index, dtype=object)
        for path, rows in b.groupby("zip"):
            try:
                with zipfile.ZipFile(path) as z:
                    infos = z.infolist()
                    for at, position, target in rows[["position", "target"]].itertuples(name=None):
                        errors[at] = _extract_one(z, infos[position], target)
            except (OSError, zipfile.BadZipFile) as error:
                errors[rows.index] = f"{type(error).__name__}: {error}"
        yield pd.DataFrame({"zip": b["zip"], "entry": b["entry"], "target": b["target"], "ok": errors.isna(), "error": errors})


def _extract_one(z: zipfile.ZipFile, info: zipfile.ZipInfo, target: str) -> str | None:
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with z.open(info) as source, open(part, "wb") as sink:
            shutil.copyfileobj(source, sink, 1 << 20)
        os.replace(part, target)
    except (OSError, RuntimeError, NotImplementedError, zipfile.BadZipFile, EOFError) as error:
        if os.path.exists(part):
            os.remove(part)
        return f"{type(error).__name__}: {error}"
    return None


def extract(zips: DataFrame, destination: str, task_bytes: int = 256 << 20) -> DataFrame:
    """zip, entry, target, ok, error of each entry of zips(path), extracted below ``destination``.

    The destination must be empty or absent. Entries that would leave it, and
    links, are refused; names that some systems refuse are mended. Of entries with one target the last one of the last
    archive (by path) is taken, the others say so. Repeating it is harmless.
    """
    if os.path.isdir(destination) and os.listdir(destination):
        raise FileExistsError(f"not empty: {destination}")
    work = Workspace(zips.sparkSession, "zips")
    root = F.lit(destination.rstrip("/") + "/")
    found = work.save(entries(zips).withColumn("target", F.concat(root, names.zip_entry_name(safe_path(F.col("entry"))))), "entries")
    usable = found.filter(F.col("error").isNull() & F.col("target").isNotNull() & ~F.col("is_link"))
    last = usable.groupBy("target").agg(F.max(F.struct("zip", "position")).alias("last")).select("target", "last.*", F.lit(True).alias("taken"))
    marked = found.join(last, ["target", "zip", "position"], "left")
    total = usable.agg(F.sum("size")).first()[0] or 0
    chosen = marked.filter("taken").select("zip", "entry", "position", "target").repartition(int(total // task_bytes) + 1, "zip", "position")
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("is_link"), "refused: a link").when(F.col("target").isNull(), "refused: outside the destination").otherwise("replaced by a later entry")
    refused = marked.filter(F.col("taken").isNull()).select("zip", "entry", "target", F.lit(False).alias("ok"), why.alias("error"))
    done = chosen.mapInPandas(_extract, "zip string, entry string, target string, ok boolean, error string")
    return work.save(done.unionByName(refused), "extracted")


def resolve_root(path: str) -> str:
    """The folder that holds the year folders: ``path`` itself, its child named Takeout, or a child that looks like one."""
    if not os.path.isdir(path):
        raise FileNotFoundError(path)

    def looks_like_one(folder: str) -> bool:
        return any(c.is_dir() and c.name.rpartition(" ")[2].isdigit() and c.name.startswith(("Photos from ", "Fotos del ", "Fotos von ")) for c in os.scandir(folder))

    children = sorted(c.path for c in os.scandir(path) if c.is_dir())
    candidates = [path, *sorted(children, key=lambda c: os.path.basename(c).lower() != "takeout")]
    for folder in candidates:
        below = sorted(c.path for c in os.scandir(folder) if c.is_dir())
        for candidate in [folder, *below]:
            if looks_like_one(candidate):
                return candidate
    raise ValueError(f"no export found in {path}")
