"""Files and sidecars in any order of arrival, against the match of all at once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import matching
from lumenarc.streaming import discovery

START = datetime(2020, 1, 1)
FILES = [("1", "d", "IMG_1.jpg"), ("2", "d", "IMG_2.jpg"), ("3", "e", "IMG_1.jpg"), ("4", "d", "IMG_1(1).jpg"), ("5", "d", "lonely.png"), ("6", "Photos from 2019", "IMG_9-edited.jpg"), ("7", "Archive", "a.mp4"), ("8", None, "x.jpg")]
SIDECARS = [("d", "IMG_1.jpg.json"), ("d", "IMG_1.jpg.supplemental-metadata.json"), ("d", "IMG_1.jpg(1).json"), ("d", "IMG_2.json"), ("Photos from 2019", "IMG_9.jpg.json"), ("Archive", "a.mp4.json"), ("z", "unused.json")]


def run(spark, tmp_path, batches, wait):
    """What comes out after each batch of (file or sidecar, minute) rows."""
    media_schema, side_schema = "file_id string, dir string, name string, at timestamp", "dir string, json_name string, at timestamp"
    for i, batch in enumerate(batches):
        media = spark.createDataFrame([(*r, START + timedelta(minutes=m)) for r, m in batch if len(r) == 3], media_schema)
        side = spark.createDataFrame([(*r, START + timedelta(minutes=m)) for r, m in batch if len(r) == 2], side_schema)
        discovery.events(media, side).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    schema = discovery.events(media, side).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = discovery.matched(stream, wait).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    return spark.read.schema(discovery.OUT).parquet(f"{tmp_path}/out")


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_result(spark, tmp_path, seed):
    rows = [*FILES, *SIDECARS]
    random.Random(seed).shuffle(rows)
    batches = [[(r, 1) for r in rows[i::3]] for i in range(3)] + [[(("q", "end.json"), 10_000)]]
    got = {r["file_id"]: (r["json_name"], r["strategy"]) for r in run(spark, tmp_path, batches, "1 hour").collect()}
    files = spark.createDataFrame([r for r in FILES if r[1]], "file_id string, folder string, name string")
    sidecars = spark.createDataFrame([(*s, "{}") for s in SIDECARS], "dir string, json_name string, body string")
    want = {r["file_id"]: (r["json_name"], r["strategy"]) for r in matching.sidecar_match(files, sidecars).collect()}
    assert got == {r[0]: want.get(r[0], (None, None)) for r in FILES if r[1]}


def test_a_file_waits_only_so_long(spark, tmp_path):
    batches = [[(FILES[1], 0)], [(FILES[4], 30)], [(("d", "IMG_2.json"), 90)], [(("q", "end.json"), 500)]]
    got = {r["file_id"]: r["json_name"] for r in run(spark, tmp_path, batches, "20 minutes").collect()}
    assert got == {"2": None, "5": None}


def test_folders_have_kinds(spark):
    found = spark.createDataFrame([("1", "in/Photos from 2019", "a"), ("2", "in/Archive", "a"), ("3", "in/Lake", "a")], "file_id string, dir string, name string")
    assert [(r["kind"], r["phase"]) for r in discovery.discovered(found).orderBy("file_id").collect()] == [("year", 0), ("special", 2), ("album", 1)]
