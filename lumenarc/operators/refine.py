"""Equal contents by refinement: each phase looks only at what the one before left together.

Size and extension cost nothing; a sampled signature reads some kilobytes of
each file that shares both; the full hash reads only files that share the
signature too. Groups of few files skip the sample, which would cost them
about as much as it saves. What is shuffled are keys, never contents, and each
phase's survivors are a written table, so no phase is repeated for the next.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.functions import repairs
from lumenarc.runtime import Workspace
from lumenarc.sources import byte_ranges

#: Groups of at most so many files go straight to the full hash.
SMALL = 3


class Contents(Protocol):
    """How a phase gets at the contents of the files that are left."""

    columns: tuple[str, ...]

    def signatures(self, rows: DataFrame) -> DataFrame:
        """rows(file_id, size, ext, kind, ..) with signature and error; ``kind`` is the extension that the sample may depend on."""


    def hashes(self, rows: DataFrame) -> DataFrame:
        """rows(file_id, size, ext, ..) with sha256 and error."""



class OfFiles:
    """Contents on a shared file system: rows carry ``path``, and bytes are read where they lie."""

    columns = ("path",)

    def signatures(self, rows: DataFrame) -> DataFrame:
        return byte_ranges.signatures(rows, ("file_id", "path", "size", "ext"), ext="kind")

    def hashes(self, rows: DataFrame) -> DataFrame:
        return byte_ranges.digests(rows, keep=("file_id", "path", "size", "ext")).withColumnRenamed("digest", "sha256")


class OfTable:
    """Contents in a column of table(file_id, ..); the rows left are met by their id, and slices, not contents, go to Python."""

    columns = ()

    def __init__(self, table: DataFrame, content: str = "text"):
        self.table = table.select("file_id", F.col(content).cast("binary").alias("__content"))

    def signatures(self, rows: DataFrame) -> DataFrame:
        body, n = F.col("__content"), repairs.CHUNK
        size = F.octet_length(body)
        slices = [F.substring(body, F.lit(1), F.lit(n)), F.substring(body, F.floor(size / 2).cast("int") + 1, F.lit(n)), F.substring(body, F.greatest(F.lit(1), size - n + 1), F.lit(n))]
        return rows.join(self.table, "file_id").select(*rows.columns, repairs.slice_signature(size.cast("long"), F.col("kind"), *slices).alias("signature"), F.lit(None).cast("string").alias("error"))

    def hashes(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table, "file_id").select(*rows.columns, F.sha2("__content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))


class Refined(NamedTuple):
    #: file_id, size, ext, sha256 of each file whose content another one has.
    members: DataFrame
    #: phase, files (it looked at), survivors (that still share all with another); signature and hash read contents.
    phases: DataFrame
    #: file_id, phase, error of files that could not be read: they are in no group.
    errors: DataFrame


def sharing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``group_files``, of those whose keys another row has too; a null key is shared with nothing."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("group_files")).filter("group_files > 1")
    return rows.join(counts, keys)


def refined(files: DataFrame, contents: Contents, small: int = SMALL, by_ext: bool = True) -> Refined:
    """Groups of equal contents among files(file_id, size, ext, ..).

    Without ``by_ext`` files of different extensions may be equal. A null size
    means that the file was not found: it is in no group. An empty table gives
    empty ones.
    """
    spark = files.sparkSession
    work = Workspace(spark, "refine")
    keys = ["size", "ext"] if by_ext else ["size"]
    given = files.select("file_id", "size", "ext", *contents.columns)
    met = work.save(sharing(given, keys), "size")
    large = F.col("group_files") > small
    # Written with their errors: a file is sampled and hashed once.
    # Equal files of unlike extensions need samples from the same places.
    to_sample = met.filter(large).drop("group_files").withColumn("kind", F.col("ext") if by_ext else F.lit(""))
    sampled = work.save(contents.signatures(to_sample), "sampled")
    alike = work.save(sharing(sampled.filter("signature is not null"), [*keys, "signature"]).drop("group_files"), "alike")
    to_hash = met.filter(~large).drop("group_files").unionByName(alike.select("file_id", "size", "ext", *contents.columns))
    hashed = work.save(contents.hashes(to_hash), "hashed")
    members = work.save(sharing(hashed.filter("sha256 is not null"), [*keys, "sha256"]).select("file_id", "size", "ext", "sha256"), "members")
    looked = [("size", given, met), ("signature", sampled, alike), ("hash", hashed, members)]
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(p).alias("phase"), F.lit(k).alias("k"), "n") for p, *tables in looked for k, t in zip(("files", "survivors"), tables, strict=True)]
    of = lambda k: F.max(F.when(F.col("k") == k, F.col("n"))).alias(k)
    phases = reduce(DataFrame.unionByName, counts).groupBy("phase").agg(of("files"), of("survivors"))
    errors = [t.filter("error is not null").select("file_id", F.lit(p).alias("phase"), "error") for t, p in ((sampled, "signature"), (hashed, "hash"))]
    return Refined(members, phases, errors[0].unionByName(errors[1]))


def groups(members: DataFrame, by_ext: bool = True) -> DataFrame:
    """size, ext, sha256, members, first (least file_id) and wasted bytes of each group."""
    keys = ["size", "ext", "sha256"] if by_ext else ["size", "sha256"]
    found = members.groupBy(*keys).agg(F.count("*").alias("members"), F.min("file_id").alias("first"))
    return found.withColumn("wasted", F.col("size") * (F.col("members") - 1))
