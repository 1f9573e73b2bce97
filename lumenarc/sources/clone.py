"""A working copy of an export, listed and copied by tasks on a mount that all executors share."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.operators.balance import balanced
from lumenarc.operators.execute import perform
from lumenarc.runtime import Workspace, ship

ENTRIES = "path string, kind string, size long, error string"
COPIES = "path string, kind string, ok boolean, error string"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), kind (dir, file, link, other), size, error of all entries.

    Folders are listed level by level, those of a level by many tasks. Links
    are not followed, so there are no loops. A folder that can't be listed has
    its reason in ``error``; an empty root gives an empty table.
    """
    ship(spark)
    work = Workspace(spark, "tree")

    def kind(e: os.DirEntry) -> str:
        return "link" if e.is_symlink() else "dir" if e.is_dir() else "file" if e.is_file() else "other"

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        rows += [(os.path.join(folder, e.name), kind(e), e.stat(follow_symlinks=False).st_size, None) for e in entries]
                except OSError as error:
                    rows.append((folder, "dir", 0, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "kind", "size", "error"])

    level, found = spark.createDataFrame([("",)], "path string"), None
    for n in range(os.pathconf(root, "PC_PATH_MAX")):  # no path is deeper
        rows = work.save(level.mapInPandas(children, ENTRIES), f"level-{n}")
        found = rows if found is None else found.unionByName(rows)
        level = rows.filter("kind = 'dir' and error is null").select("path").repartition("path")
        if level.isEmpty():
            break
    return found


def free_name(root: str) -> str:
    """``root`` with ``_tmp``, ``_tmp1`` and so on: the first that is free."""
    root, n = root.rstrip("/"), 0
    while os.path.lexists(target := f"{root}_tmp{n or ''}"):
        n += 1
    return target


def _each(act: Callable[[str], str | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = [act(path) for path in b["path"]]
            yield pd.DataFrame({"path": b["path"], "kind": b["kind"], "ok": [e is None for e in errors], "error": errors})

    return run


def _tried(act: Callable[[str, str], object], source: str, target: str) -> str | None:
    try:
        act(source, target)
    except OSError as error:
        return f"{type(error).__name__}: {error}"
    return None


def _link(source: str, target: str) -> None:
    text = os.readlink(source)
    if not (os.path.islink(target) and os.readlink(target) == text):
        os.symlink(text, target)


def clone(spark: SparkSession, root: str, parts: int | None = None) -> tuple[str, DataFrame]:
    """The copy's folder, and path, kind, ok, error of each entry.

    Folders come first, then files, dealt over ``parts`` partitions by their
    size, and links as links; at last folders take their times. What fails
    does not stop the rest. A task that runs twice finds its work done.
    """
    root, target = root.rstrip("/"), free_name(root)
    work = Workspace(spark, "clone")
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = tree(spark, root)
    os.makedirs(target)
    unread = entries.filter("error is not null").select("path", "kind", F.lit(False).alias("ok"), "error")
    read = entries.filter("error is null")
    at = lambda path: (os.path.join(root, path), os.path.join(target, path))
    folders = read.filter("kind = 'dir'")
    made = work.save(folders.mapInPandas(_each(lambda p: _tried(lambda _, t: os.makedirs(t, exist_ok=True), *at(p))), COPIES), "folders")
    dealt = balanced(read.filter("kind = 'file'"), "size", parts, "path").select("path", "kind")
    files = work.save(dealt.mapInPandas(_each(lambda p: perform("copy", *at(p), None)), COPIES), "files")
    links = work.save(read.filter("kind = 'link'").mapInPandas(_each(lambda p: _tried(_link, *at(p))), COPIES), "links")
    other = read.filter("kind = 'other'").select("path", "kind", F.lit(False).alias("ok"), F.lit("neither a file nor a folder nor a link").alias("error"))
    work.save(made.filter("ok").mapInPandas(_each(lambda p: _tried(shutil.copystat, *at(p))), COPIES), "times")
    return target, made.unionByName(files).unionByName(links).unionByName(other).unionByName(unread)
