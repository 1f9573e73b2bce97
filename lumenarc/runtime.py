"""Session defaults and shared working storage.

Everything that has to outlive one Spark job goes to the folder named in
``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(app: str = "lumenarc", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SESSION_CONF | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set and all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenarc-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def mounted(uri: str) -> str:
    """The path of a folder that the driver and all executors mount, for code that opens files itself."""
    if "://" in uri and not uri.startswith("file:"):
        raise ValueError(f"not a mounted folder: {uri}")
    return "/" + uri.removeprefix("file:").lstrip("/")


class Workspace:
    """Parquet tables of one operator run below the shared folder.

    A saved table cuts the lineage: a lost executor costs only the tasks that
    were running, since everything before is read again from shared storage.
    """

    #: Workspaces that are not removed yet, in the order they were made.
    live: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        Workspace.live.append(self)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lumenarc/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.root}/{name}")
        return self.read(name, df.schema if partition_by is None else None)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(f"{self.root}/{name}")

    def remove(self) -> None:
        """Deletes all tables; for when no result that reads them is needed any more."""
        Workspace.live.remove(self)
        self.drop("")

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lumenarc_shipped", False):
        return
    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='lumenarc-')}/lumenarc", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._lumenarc_shipped = True
