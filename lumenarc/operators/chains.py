"""Replacements of replacements, and the merge of all that end in one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.runtime import Workspace


def resolved(mapping: DataFrame) -> DataFrame:
    """old, final, cyclic: where each chain of mapping(old, new) ends.

    Pointer jumping: each round a pointer takes over the pointer it points at,
    so a chain of length n is followed in log2(n) rounds. A round that brings no
    pointer to an end leaves only those on or before a cycle; all of these end
    in the cycle's least entity. Of repeated olds the least new counts; nulls
    and loops replace nothing.
    """
    work = Workspace(mapping.sparkSession, "chains")
    given = mapping.filter("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min("new").alias("new"))
    given = work.save(given, "given")
    olds = given.select(F.col("old").alias("new"))
    done = work.save(given.join(olds, "new", "left_anti").select("old", F.col("new").alias("final")), "done-0")
    now, n, before = work.save(given.join(olds, "new", "left_semi").select("old", "new"), "open-0"), 0, None
    while (left := now.count()) not in (0, before):
        n, before = n + 1, left
        ends = now.join(done.select(F.col("old").alias("new"), "final"), "new").select("old", "final")
        done = work.save(done.unionByName(ends), f"done-{n}")
        still = now.join(done, "old", "left_anti").select("old", "new")
        jump = still.select(F.col("old").alias("new"), F.col("new").alias("next"))
        now = work.save(still.join(jump, "new", "left").select("old", F.coalesce("next", "new").alias("new")), f"open-{n}")
    found = done.withColumn("cyclic", F.lit(False))
    return found if left == 0 else found.unionByName(cycles(given, done, left, work))


def cycles(given: DataFrame, done: DataFrame, left: int, work: Workspace) -> DataFrame:
    """old, final, cyclic of the ``left`` pointers of ``given`` that are not ``done``: the least entity of the cycle that each reaches."""
    walk = work.save(given.join(done, "old", "left_anti").select("old", F.col("new").alias("at"), F.col("new").alias("least")), "walk-0")
    for i in range(1, left.bit_length() + 1):  # 2**i steps at least as many as there are pointers: each is on its cycle, and has seen all of it
        ahead = walk.select(F.col("old").alias("at"), F.col("at").alias("far"), F.col("least").alias("other"))
        walk = work.save(walk.join(ahead, "at").select("old", F.col("far").alias("at"), F.least("least", "other").alias("least")), f"walk-{i}")
    around = walk.select(F.col("old").alias("at"), F.col("least").alias("final"))
    return walk.select("old", "at").join(around, "at").select("old", "final", F.lit(True).alias("cyclic"))


def replaced(rows: DataFrame, mapping: DataFrame, entity: str = "entity") -> DataFrame:
    """rows with each entity that was merged away under the name of the one that its replacements end in."""
    ends = resolved(mapping).select(F.col("old").alias(entity), "final")
    return rows.join(ends, entity, "left").withColumn(entity, F.coalesce("final", entity)).drop("final")


def merged(entities: DataFrame, files: DataFrame, albums: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per entity that is left: entity, merged (how many others), taken, accuracy, method, partner_shared, files, albums.

    entities(entity, ord, taken, accuracy, method, partner_shared) are merged in
    the order of ``ord``: the most accurate date stays, of equally accurate ones
    the later entity's; if none has an accuracy, the first date and the first
    method there are. ``files`` counts the different (source, target, link) of
    all, ``albums`` lists different names, each with its number of different
    folders: album names are a folder's name long and gathered once each.
    """
    spark = entities.sparkSession
    ends = Workspace(spark, "merged").save(resolved(mapping).select(F.col("old").alias("entity"), "final"), "ends")

    def moved(rows: DataFrame) -> DataFrame:
        return rows.join(ends, "entity", "left").withColumn("entity", F.coalesce("final", "entity")).drop("final")

    known = F.col("accuracy").isNotNull()
    best = lambda c: F.min_by(c, F.when(known, F.struct(F.col("accuracy"), -F.col("ord"))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    any_known = F.bool_or(known)
    found = moved(entities).groupBy("entity").agg(
        (F.count("*") - 1).alias("merged"),
        *(F.when(any_known, best(c)).otherwise(first(c)).alias(c) for c in ("taken", "method")),
        F.min("accuracy").alias("accuracy"),
        F.coalesce(F.bool_or("partner_shared"), F.lit(False)).alias("partner_shared"),
    )
    own_files = moved(files).select("entity", "source", "target", "link").distinct().groupBy("entity").agg(F.count("*").alias("files"))
    folders = moved(albums).groupBy("entity", "album").agg(F.countDistinct("dir").alias("dirs"))
    own_albums = folders.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(F.concat("album", F.lit(":"), F.col("dirs").cast("string")))), "|").alias("albums"))
    found = found.join(own_files, "entity", "left").join(own_albums, "entity", "left")
    return found.select("entity", "merged", "taken", "accuracy", "method", "partner_shared", F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("albums", F.lit("")).alias("albums"))


def first_failures(results: DataFrame, by: list[str], order: list[str], most: int = 5) -> DataFrame:
    """Per ``by`` the first ``most`` failed rows of results(.., ok, error), with their ``place`` and how many ``more`` failed.

    Each task passes on at most ``most`` rows of a group, so one that fails a
    billion times is no task's burden.
    """
    failed = results.filter(~F.col("ok"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    top = failed.withColumn("place", place).filter(F.col("place") <= most)
    counts = failed.groupBy(*by).agg(F.count("*").alias("n"))
    same = [top[c].eqNullSafe(counts[c]) for c in by]
    joined = top.join(counts, same)
    return joined.select(*(top[c] for c in top.columns), F.greatest(F.lit(0).cast("long"), counts["n"] - most).alias("more"))
