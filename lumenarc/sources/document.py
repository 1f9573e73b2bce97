"""One JSON document, written by many tasks: all of it or nothing.

``df.write.format("json_document")`` takes (group, entry) rows, an entry being
a JSON object, whose partitions follow each other in the order of groups. A
task writes its part to a file of its own in a hidden folder beside the target;
the driver's commit puts the parts together, byte by byte and without reading a
row, under a name of its own, and renames it. A group may go on from
one part into the next, so a frequent one is not one task's. A failed or
killed job leaves the earlier document as it was, and no parts.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lumenarc.runtime import ship

CLOSE = "\n    ]"


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    first: str | None
    last: str | None
    groups: int
    entries: int


def opening(group: str) -> str:
    return f"    {json.dumps(group, ensure_ascii=False)}: [\n"


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, target: str, field: str, metadata: dict):
        self.target, self.field, self.metadata = target, field, metadata
        folder, name = os.path.split(target)
        self.staging = f"{folder}/.{name}-{uuid.uuid4().hex}"
        os.makedirs(self.staging)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context = TaskContext.get()
        path = f"{self.staging}/{context.partitionId():08d}-{context.taskAttemptId()}"
        first = last = None
        groups = entries = 0
        with open(path, "w", encoding="utf-8") as f:
            for batch in iterator:
                for group, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if first is None:
                        first, groups = group, 1
                    elif group != last:
                        f.write(f"{CLOSE},\n{opening(group)}")
                        groups += 1
                    else:
                        f.write(",\n")
                    text = json.dumps(json.loads(entry), indent=2, ensure_ascii=False)
                    f.write("      " + text.replace("\n", "\n      "))
                    last = group
                    entries += 1
        return Part(context.partitionId(), path, first, last, groups, entries)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.entries), key=lambda m: m.number)
        whole, before, groups = f"{self.staging}/document", None, 0
        with open(whole, "wb") as out:
            out.write(f'{{\n  "{self.field}": {{'.encode())
            for part in parts:
                goes_on = before is not None and before.last == part.first
                out.write((",\n" if goes_on else (f"{CLOSE},\n" if before else "\n") + opening(part.first)).encode())
                with open(part.path, "rb") as source:
                    shutil.copyfileobj(source, out, 1 << 20)
                groups += part.groups - goes_on
                before = part
            out.write((f"{CLOSE}\n  " if parts else "").encode() + b"},\n")
            metadata = {"generated": datetime.now(UTC).isoformat(), f"total_{self.field}": groups, **self.metadata}
            out.write(('  "metadata": ' + json.dumps(metadata, indent=2, ensure_ascii=False).replace("\n", "\n  ") + "\n}").encode())
            out.flush()
            os.fsync(out.fileno())
        os.replace(whole, self.target)
        shutil.rmtree(self.staging)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class JsonDocument(DataSource):
    """Options: path, field (name of the object of groups), metadata (JSON object)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        target = self.options["path"]
        if os.path.lexists(target) and not overwrite:
            raise FileExistsError(target)
        return DocumentWriter(target, self.options.get("field", "groups"), json.loads(self.options.get("metadata", "{}")))


def write_document(entries: DataFrame, group: str, order: list[str], path: str, field: str, metadata: dict) -> None:
    """Replaces the document at ``path``: under ``field`` each group, in order, with its entries (all columns), in ``order``.

    Null groups have no place in it and are left out; no entries make a document without groups.
    """
    spark = entries.sparkSession
    ship(spark)
    spark.dataSource.register(JsonDocument)
    rows = entries.filter(F.col(group).isNotNull())
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    texts = ranged.select(F.col(group).alias("group"), F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"}).alias("entry"))
    texts.write.format("json_document").mode("overwrite").option("field", field).option("metadata", json.dumps(metadata)).save(path)
