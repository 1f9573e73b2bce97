"""Discovery, albums of entities and the tag plan by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import discovery, tag_plan
from lumenarc.operators.entities import ENTITY


def test_discovery_by_years_and_albums(spark):
    paths = ["Photos from 2020/a.jpg", "Photos from 2020/deep/b.jpg", "Trip/c.jpg", "Trip/deep/er/d.mp4", "Bare/deep/e.jpg", "Notes/f.txt", "g.jpg", "Trip/h.json"]
    files = spark.createDataFrame([(i, f"in/root/{p}", p.rpartition(".")[2]) for i, p in enumerate(paths)] + [(98, "elsewhere/Trip/x.jpg", "jpg"), (99, None, None)], "file_id long, path string, ext string")
    shared = spark.createDataFrame([(3, True), (0, False), (5, True)], "file_id long, partner_shared boolean")
    got = {r["file_id"]: tuple(r)[1:] for r in discovery.discover(files, "in/root/", shared).collect()}
    year = "in/root/Photos from 2020"
    assert got == {0: (0, None, year, False), 1: (0, None, f"{year}/deep", False), 2: (1, "Trip", "in/root/Trip", False), 3: (1, "Trip", "in/root/Trip/deep/er", True)}
    assert discovery.discover(files.limit(0), "in/root").count() == 0
    # Rows that name the year or lie directly in an album are taken without a shuffle of theirs.
    plan = discovery.discover(files, "in/root")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_albums_of_entities(spark):
    rows = [(1, "x", "in/2020", "2020"), (2, "x", "in/Trip", "Trip"), (3, "x", "in/Trip/sub", "sub"), (4, "y", "in/2021", "2021"), (5, "y", "in/2021", "2021"), (6, "z", "in/Trip", "Trip")]
    files = spark.createDataFrame([(i, 1, "jpg", h, f"{d}/{i}.jpg", f) for i, h, d, f in rows], "file_id long, size long, ext string, sha256 string, path string, folder string")
    found = spark.createDataFrame([(2, "Trip", "in/Trip"), (3, "Trip", "in/Trip/sub"), (1, None, "in/2020")], "file_id long, album string, dir string")
    albums = discovery.entity_albums(files, found)
    assert {(r["sha256"], r["album"], r["dir"]) for r in albums.collect()} == {("x", "Trip", "in/Trip"), ("x", "sub", "in/Trip/sub"), ("x", "Trip", "in/Trip/sub"), ("z", "Trip", "in/Trip")}
    assert discovery.album_statistics(files, albums).first().asDict() == {"entities": 3, "album_entities": 2, "year_only_entities": 1, "multi_album_entities": 1, "different_albums": 2}
    assert [r["sha256"] for r in discovery.only_in(files, albums, years=True).collect()] == ["y"]
    assert sorted(r["sha256"] for r in discovery.only_in(files, albums, years=False).collect()) == ["x", "z"]
    none = discovery.entity_albums(files.limit(0))
    assert set(ENTITY) < set(none.columns) and discovery.album_statistics(files.limit(0), none).first()["entities"] == 0


@pytest.mark.parametrize("policy", ["ignore", "no such policy"])
def test_output_count_of_an_unknown_policy(policy):
    with pytest.raises(ValueError, match=policy):
        discovery.output_count(policy)


def test_tag_plan_cases(spark):
    written = spark.createDataFrame([(i, f"out/{i}.x") for i in range(9)], "file_id long, path string")
    day = "2020-05-06 07:08:09"
    rows = [(0, "jpg", day, "json", 1.5, -2.5), (1, "jpg", day, "guess", None, None), (2, "jpeg", None, "none", 1.5, 2.5), (3, "jpg", day, "json", 1.5, 2.5), (4, "png", day, "json", -1.5, 2.5),
            (5, "mp4", day, "exif", 0.0, 2.5), (6, "avi", day, "json", None, None), (7, "jpg", None, "none", None, None), (8, "heic", None, "none", float("nan"), 2.0)]
    entity_of = spark.createDataFrame([(i, e, i % 2 == 0, t, m, a, b) for i, e, t, m, a, b in rows], "file_id long, ext string, is_primary boolean, day string, method string, latitude double, longitude double")
    entity_of = entity_of.withColumn("taken", F.to_timestamp("day")).drop("day")
    forced = spark.createDataFrame([("out/3.x",), ("out/3.x",), ("out/4.x",)], "path string")
    plan = tag_plan.tag_plan(written, entity_of, forced)
    got = {r["file_id"]: r for r in plan.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6]
    assert {i: r["native"] for i, r in got.items()} == {0: "date+gps", 1: "date", 2: "gps", 3: None, 4: None, 5: None, 6: None}
    clock = "2020:05:06 07:08:09"
    assert got[0]["queued"] == f'DateTime={clock};DateTimeDigitized={clock};DateTimeOriginal={clock};OffsetTime="+00:00";OffsetTimeDigitized="+00:00";OffsetTimeOriginal="+00:00"'
    assert "GPSLatitude=1.5;GPSLatitudeRef=N;GPSLongitude=2.5;GPSLongitudeRef=W" in got[0]["fallback"]
    assert got[1]["queued"] is None and got[1]["fallback"] == f"DateTime={clock};DateTimeDigitized={clock};DateTimeOriginal={clock}"
    assert got[2]["queued"] is None and got[2]["fallback"].startswith("GPSLatitude=1.5")
    assert got[3]["queued"] == f"XMP:CreateDate={clock}+00:00;XMP:DateTimeOriginal={clock}+00:00;XMP:GPSLatitude=1.5;XMP:GPSLongitude=2.5;XMP:ModifyDate={clock}+00:00"
    assert "XMP:GPSLatitude=-1.5" in got[4]["queued"] and got[3]["fallback"] is got[4]["fallback"] is None
    assert got[5]["queued"] == got[1]["fallback"] and got[6]["queued"] is None and got[6]["skipped"] == "AVI"
    failed = spark.createDataFrame([(1,), (1,), (2,), (4,)], "file_id long")
    after = {r["file_id"]: r["queued"] for r in tag_plan.after_native(plan, failed).collect()}
    assert after == {0: got[0]["queued"], 1: got[1]["fallback"], 2: got[2]["fallback"], 3: got[3]["queued"], 4: got[4]["queued"], 5: got[5]["queued"]}
    assert tag_plan.written_counts(plan, failed).first().asDict() == {"dates_primary": 1, "dates_other": 0, "gps_primary": 1, "gps_other": 0, "queued": 6}


def test_outputs_are_no_links_and_exist(spark):
    plan = spark.createDataFrame([(1, "move", "A"), (1, "symlink", "B"), (2, "move", "A"), (3, "delete", ""), (4, "copy", "C")], "file_id long, op string, target string")
    files = spark.createDataFrame([(i, f"{i}.jpg") for i in range(1, 5)], "file_id long, name string")
    existing = spark.createDataFrame([("A/1.jpg",), ("B/1.jpg",), ("C/4.jpg",)], "path string")
    assert {tuple(r) for r in tag_plan.outputs(plan, files, existing).collect()} == {(1, "A/1.jpg"), (4, "C/4.jpg")}
