"""Files as rows of byte ranges, and what is read of them without holding one whole.

``spark.read.format("byte_ranges")`` plans its partitions by bytes: a large
file is split over several, small ones share one. Filters on path, size and
offset are pushed to the listing, so that ``offset = 0`` reads the head of each
file and no more; without ``data`` in the schema no file is opened. The folder
must be one that the driver and all executors mount.

Digests and samples need no rows of bytes: a task reads its files one after
the other in steps of ``STEP`` bytes, and files are dealt to tasks by size.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from lumenarc.functions import names, repairs
from lumenarc.operators.balance import balanced
from lumenarc.runtime import ship

STEP = 1 << 20
SCHEMA = "path string, size long, modified timestamp, offset long, data binary"
#: Bytes that a task reads on average, and what opening a file costs in bytes.
TASK_BYTES, OPEN_BYTES = 256 << 20, 64 << 10
KINDS = {"path": pa.string(), "size": pa.int64(), "modified": pa.timestamp("us", tz="UTC"), "offset": pa.int64(), "data": pa.binary()}
TESTS: dict[type, Callable] = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringContains: lambda a, b: b in a, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b)}


@dataclass
class Ranges(InputPartition):
    """Runs of ranges: (path, size, modified in µs, first offset, end)."""

    runs: list[tuple[str, int, int, int, int]] = field(default_factory=list)


def listed(root: str) -> Iterator[os.DirEntry]:
    """The files below ``root``, folder by folder, in order; links are not followed."""
    with os.scandir(root) as found:
        entries = sorted(found, key=lambda e: e.name)
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            yield from listed(e.path)
        elif e.is_file(follow_symlinks=False):
            yield e


class RangeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.columns = schema.fieldNames()
        self.root = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 8 << 20))
        self.partition_bytes = int(options.get("partitionBytes", 128 << 20))
        self.pushed: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", "size", "offset"):
                self.pushed.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def keeps(self, column: str, value: object) -> bool:
        return all(TESTS[kind](value, against) for c, kind, against in self.pushed if c == column)

    def partitions(self) -> list[InputPartition]:
        parts, room, reads = [Ranges()], self.partition_bytes, "data" in self.columns
        for e in listed(self.root):
            stat = e.stat(follow_symlinks=False)
            if not (self.keeps("path", e.path) and self.keeps("size", stat.st_size)):
                continue
            for at in range(0, max(1, stat.st_size), self.range_bytes):
                if not self.keeps("offset", at):
                    continue
                end = min(at + self.range_bytes, stat.st_size)
                cost = end - at + OPEN_BYTES if reads else OPEN_BYTES
                if cost > room and parts[-1].runs:
                    parts.append(Ranges())
                    room = self.partition_bytes
                room -= cost
                runs = parts[-1].runs
                if runs and runs[-1][0] == e.path and runs[-1][4] == at:
                    runs[-1] = (*runs[-1][:4], end)
                else:
                    runs.append((e.path, stat.st_size, stat.st_mtime_ns // 1000, at, end))
        return parts

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds, rows, held = [KINDS[c] for c in self.columns], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(self.columns, kinds, strict=True)], names=self.columns)

        for path, size, modified, first, end in partition.runs:
            opened = open(path, "rb") if "data" in self.columns else None  # noqa: SIM115
            try:
                for at in range(first, max(end, first + 1), self.range_bytes):
                    row = {"path": path, "size": size, "modified": datetime.fromtimestamp(modified / 1e6, UTC), "offset": at}
                    if opened:
                        opened.seek(at)
                        row["data"] = opened.read(min(self.range_bytes, end - at))
                        held += len(row["data"])
                    rows.append(row)
                    if held >= self.range_bytes or len(rows) == 4096:
                        yield batch()
                        rows, held = [], 0
            finally:
                if opened:
                    opened.close()
        if rows:
            yield batch()


class ByteRanges(DataSource):
    """Options: path, rangeBytes (of a row), partitionBytes. A schema of fewer columns reads no more than these."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RangeReader:
        return RangeReader(schema, self.options)


def byte_ranges(spark: SparkSession, root: str, columns: list[str] | None = None, range_bytes: int = 8 << 20, partition_bytes: int = 128 << 20) -> DataFrame:
    """path, size, modified, offset and data of all files below ``root``; an empty file is one empty range."""
    ship(spark)
    spark.dataSource.register(ByteRanges)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("byte_ranges").schema(", ".join(fields)).option("rangeBytes", str(range_bytes)).option("partitionBytes", str(partition_bytes)).load(root)


def media_files(spark: SparkSession, root: str, by: str = "names", header: int = 512) -> DataFrame:
    """path, folder, name, ext, size, modified of the photos and films below ``root``.

    By ``names``: those with an extension of a photo or film. By ``headers``:
    those whose first ``header`` bytes show one, and all with a ``<path>.json``
    beside them; then wrong extensions don't matter.
    """
    path, base = F.col("path"), names.base_name(F.col("path"))
    if by == "names":
        found = byte_ranges(spark, root, ["path", "size", "modified", "offset"]).filter("offset = 0")
        found = found.filter(names.extension(base).isin(names.MEDIA_EXTENSIONS))
    else:
        heads = byte_ranges(spark, root, range_bytes=header).filter("offset = 0")
        sidecars = byte_ranges(spark, root, ["path", "offset"]).filter((F.col("offset") == 0) & path.endswith(".json"))
        described = sidecars.select(F.left(path, F.length(path) - 5).alias("path"), F.lit(True).alias("described"))
        shown = F.coalesce(repairs.type_by_content(F.col("data")).rlike("^(image|video)/"), F.lit(False))
        found = heads.join(described, "path", "left").filter(shown | F.col("described").isNotNull())
    return found.select("path", names.base_name(names.directory(path)).alias("folder"), base.alias("name"), names.extension(base).alias("ext"), "size", "modified")


def tasks_for(files: DataFrame, cost: Column, task_bytes: int) -> DataFrame:
    """files(path, size, ..) dealt to tasks so that each has near ``task_bytes`` to read."""
    priced = files.withColumn("__bytes", cost + OPEN_BYTES)
    parts = int((priced.agg(F.sum("__bytes")).first()[0] or 0) // task_bytes) + 1
    return balanced(priced, "__bytes", parts, "path").drop("part", "__bytes")


def over_files(files: DataFrame, name: str, read: Callable[[str, dict], str], keep: list[str]) -> DataFrame:
    """keep, ``name`` (what ``read(path, row)`` gives) and ``error``; a file that can't be read is a row with an error."""
    ship(files.sparkSession)
    columns = list(dict.fromkeys([*keep, "path"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                try:
                    values.append(read(row["path"].removeprefix("file:"), row))
                    errors.append(None)
                except (OSError, ValueError) as error:
                    values.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=[*columns, name, "error"])

    given = files.select(*columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in given.dtypes)
    return given.mapInArrow(run, f"{schema}, {name} string, error string")


def digests(files: DataFrame, algorithm: str = "sha256", head: int | None = None, keep: tuple[str, ...] = ("path", "size"), task_bytes: int = TASK_BYTES) -> DataFrame:
    """keep, digest (hex) and error of files(path, size, ..): of the whole file, or of its first ``head`` bytes; memory is one step's."""

    def read(path: str, row: dict) -> str:
        running, left = hashlib.new(algorithm), head
        with open(path, "rb") as f:
            while data := f.read(STEP if left is None else min(STEP, left)):
                running.update(data)
                left = None if left is None else left - len(data)
        return running.hexdigest()

    cost = F.col("size") if head is None else F.least("size", F.lit(head))
    return over_files(tasks_for(files, cost, task_bytes), "digest", read, [*keep])


def signatures(files: DataFrame, keep: tuple[str, ...] = ("path", "size", "ext"), ext: str = "ext", task_bytes: int = TASK_BYTES) -> DataFrame:
    """keep, signature and error of files(path, size, ``ext``, ..): three short reads of each, whatever its size."""
    n = repairs.CHUNK

    def read(path: str, row: dict) -> str:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            parts = []
            for at in (0, size // 2, max(0, size - n)):
                f.seek(at)
                parts.append(f.read(n))
        return repairs.signatures_of([size], [row[ext]], *([p] for p in parts))[0]

    return over_files(tasks_for(files, F.lit(3 * n), task_bytes), "signature", read, list(dict.fromkeys([*keep, ext])))
