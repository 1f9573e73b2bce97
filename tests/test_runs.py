"""The document sink and runs in steps."""

import json
import os
from datetime import UTC, datetime, timedelta
from enum import Enum

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import progress, steps
from lumenarc.sources.document import write_document

SCHEMA = "album string, name string, n long"


def written(spark, rows, path, parts=7):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    write_document(df, "album", ["name", "n"], str(path), "albums", {"strategy": "json"})
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def test_document_of_many_parts(spark, tmp_path):
    rows = [("hot", f"f{i:05d}", i) for i in range(3000)] + [('a "quoted"\n', "x", 1), ("ä", "y", None), ("z", "é", 2), (None, "lost", 3)]
    found = written(spark, rows, tmp_path / "albums-info.json")
    want = {}
    for album, name, n in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0].encode(), r[1])):
        want.setdefault(album, []).append({"album": album, "name": name, "n": n})
    assert found["albums"] == want and list(found["albums"]) == list(want)
    assert found["metadata"]["total_albums"] == 4 and found["metadata"]["strategy"] == "json" and os.listdir(tmp_path) == ["albums-info.json"]


def test_document_of_nothing(spark, tmp_path):
    assert written(spark, [], tmp_path / "d.json")["albums"] == {}


def test_a_failed_task_leaves_the_old_document(spark, tmp_path):
    path = tmp_path / "d.json"
    old = written(spark, [("a", "b", 1)], path)
    df = spark.createDataFrame([(f"g{i % 9}", f"n{i}", i) for i in range(900)], SCHEMA)
    # Fails only once it is written: sampling for the ranges does not look at n.
    broken = df.withColumn("n", F.when(F.col("n") == 700, F.raise_error(F.lit("killed"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="killed"):
        write_document(broken, "album", ["name"], str(path), "albums", {})
    with open(path, encoding="utf-8") as f:
        assert json.load(f) == old
    assert os.listdir(tmp_path) == ["d.json"]


def test_reruns_do_only_what_is_left(spark, tmp_path):
    made = []

    def make(name, fails=False):
        def run(s, tables):
            made.append(name)
            if fails:
                raise OSError("no room")
            return {name: s.range(10 * len(made)).withColumn("path", F.concat(F.lit("/in/"), "id"))}

        return run

    observe = lambda n: {n: {f"{n}_rows": F.count(F.lit(1)), f"{n}_most": F.max("id")}}
    first = [steps.Step(1, "a", make("a"), observe("a")), steps.Step(2, "b", make("b"), observe("b"), skip=lambda o: "not wanted" if not o.get("b") else None), steps.Step(3, "c", make("c", True), observe("c"))]
    with pytest.raises(OSError, match="no room"):
        steps.run(spark, first, "/in", str(tmp_path))
    again = [first[0], first[1], steps.Step(3, "c", make("c"), observe("c"))]
    outcomes, tables = steps.run(spark, again, "/new", str(tmp_path))
    assert made == ["a", "c", "c"] and [o.state for o in outcomes] == ["resumed", "skipped", "done"]
    assert {o.name: o.metrics for o in outcomes} == {"a": {"a_rows": 10, "a_most": 9}, "b": {}, "c": {"c_rows": 30, "c_most": 29}}
    assert tables["a"].count() == 10 and tables["a"].first()["path"].startswith("/new/")
    outcomes, tables = steps.run(spark, again, "/new", str(tmp_path), {"b": True})
    assert made == ["a", "c", "c", "b"] and [o.state for o in outcomes] == ["resumed", "done", "resumed"] and set(tables) == {"a", "b", "c"}
    assert {(r["step"], r["metric"]): r["value"] for r in steps.summary(spark, outcomes).collect()}["b", "b_rows"] == tables["b"].count() == 40


def test_json_safe():
    class Kind(Enum):
        PHOTO = 1

    value = {"k": Kind.PHOTO, "t": datetime(2020, 1, 2, tzinfo=UTC), "d": timedelta(seconds=90), "s": {3, 1}, "l": (None, 1.5, True), 4: object}
    assert progress.json_safe(value) == {"k": "PHOTO", "t": "2020-01-02T00:00:00+00:00", "d": {"iso8601": "PT90S", "seconds": 90}, "s": [1, 3], "l": [None, 1.5, True], "4": str(object)}
