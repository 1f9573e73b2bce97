"""Executors, zip archives, EXIF and progress on real files."""

import os
import struct
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenarc.functions import exif
from lumenarc.operators import content, execute, moves, progress
from lumenarc.sources import clone, zips
from lumenarc.sources.archive import scan

CLAIMS = "claim_id int, dir string, name string"
FILES = "dir string, name string"
OPS = "op_id string, entity string, op string, source string, target string, taken timestamp"


def put(path, data: bytes = b"x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def free(spark, claims, existing=()):
    found = execute.free_names(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(list(existing), FILES))
    return {r.claim_id: r.free_name for r in found.collect()}


def test_free_names_fill_the_gaps(spark):
    taken = [("d", "a.jpg"), ("d", "A(2).jpg"), ("e", "a(1).jpg")]
    assert free(spark, [(1, "d", "a.jpg"), (2, "d", "a.jpg"), (3, "e", "a.jpg"), (4, "e", "a.jpg")], taken) == {1: "a(1).jpg", 2: "a(3).jpg", 3: "a.jpg", 4: "a(2).jpg"}


def test_free_names_leave_what_is_asked_for(spark):
    found = free(spark, [(1, "d", "a.jpg"), (2, "d", "a.jpg"), (3, "d", "a(1).jpg"), (4, "d", "a(1).jpg"), (5, "d", None), (6, "d", ".jpg"), (7, "d", ".jpg"), (8, "d", "b"), (9, "d", "B")])
    assert found == {1: "a.jpg", 2: "a(2).jpg", 3: "a(1).jpg", 4: "a(1)(1).jpg", 5: None, 6: ".jpg", 7: ".jpg(1)", 8: "b", 9: "B(1)"}


def test_free_names_of_no_claims(spark):
    assert free(spark, []) == {}


def test_a_plan_is_carried_out_and_may_run_twice(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    year, album = put(source / "Photos from 2015" / "IMG_1.jpg", b"one"), put(source / "Lake" / "IMG_1.jpg", b"one")
    other = put(source / "Photos from 2016" / "IMG_1.jpg", b"two")
    files = scan(spark, str(source), content=True).withColumn("path", F.regexp_replace("path", "^file:", "")).withColumn("file_id", F.xxhash64("path"))
    dated = files.select("file_id", F.lit(datetime(2015, 6, 1, 12)).alias("taken"))
    plan = moves.plan(content.roles(files, "content"), dated, "shortcut", division=0)
    ops = execute.operations(plan, files, str(out), spark.createDataFrame([], FILES), dated)
    rows = [tuple(r) for r in ops.collect()]
    again = spark.createDataFrame(rows, OPS)
    for _ in range(2):
        results = execute.execute(again).collect()
        assert len(results) == len(rows) and all(r.ok for r in results), results
    assert sorted(p.read_bytes() for p in (out / "ALL_PHOTOS").iterdir()) == [b"one", b"two"]
    assert {p.name for p in (out / "ALL_PHOTOS").iterdir()} == {"IMG_1.jpg", "IMG_1(1).jpg"}
    link = out / "Albums" / "Lake" / "IMG_1.jpg"
    assert link.is_symlink() and link.read_bytes() == b"one" and not os.path.isabs(os.readlink(link))
    assert not any(os.path.exists(p) for p in (year, album, other))
    assert {os.path.getmtime(p) for p in (out / "ALL_PHOTOS").iterdir()} == {1433160000.0}


def test_nothing_is_deleted_of_an_entity_that_failed(spark, tmp_path):
    keep = put(tmp_path / "b.jpg")
    rows = [("1", "e", "move", str(tmp_path / "absent.jpg"), str(tmp_path / "out" / "a.jpg"), None), ("2", "e", "delete", keep, None, None), ("3", "f", "delete", put(tmp_path / "c.jpg"), None, None), ("4", "g", "move", None, "/x", None)]
    found = {r.op_id: r for r in execute.execute(spark.createDataFrame(rows, OPS)).collect()}
    assert [found[i].ok for i in "1234"] == [False, False, True, False]
    assert os.path.exists(keep) and "skipped" in found["2"].error
    failures = {(r.op, r.failures) for r in execute.summary(execute.execute(spark.createDataFrame([], OPS)), "/o").collect()}
    assert failures == set()


def test_another_file_is_never_overwritten(tmp_path):
    source, target = put(tmp_path / "a", b"1"), put(tmp_path / "b", b"2")
    assert "FileExistsError" in execute.perform("move", source, target, None)
    assert "FileExistsError" in execute.perform("copy", source, target, None)
    assert (tmp_path / "a").read_bytes() == b"1" and (tmp_path / "b").read_bytes() == b"2"
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]


def test_rename_pair_rolls_back(tmp_path):
    media, sidecar = put(tmp_path / "a.png"), put(tmp_path / "a.png.json")
    put(tmp_path / "a.png.jpg.json")
    with pytest.raises(FileExistsError):
        execute.rename_pair(media, str(tmp_path / "a.png.jpg"), sidecar)
    assert os.path.exists(media) and os.path.exists(sidecar)
    execute.rename_pair(media, str(tmp_path / "a.jpg"), sidecar)
    assert sorted(os.listdir(tmp_path)) == ["a.jpg", "a.jpg.json", "a.png.jpg.json"]


def test_bisected_finds_the_rows_at_fault():
    def act(batch):
        if {3, 7} & set(batch):
            raise RuntimeError(batch)

    done, failed = execute.bisected(list(range(10)), act)
    assert sorted(done) == [0, 1, 2, 4, 5, 6, 8, 9] and sorted(failed) == [3, 7]
    assert execute.bisected([], act) == ([], [])


def test_zip_entries_stay_inside(spark, tmp_path):
    for name, text in (("a.zip", b"old"), ("b.zip", b"new")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("Takeout/Photos from 2015/x.jpg", text)
            z.writestr("../outside.jpg", b"no")
            z.writestr("/absolute.jpg", b"no")
            z.writestr(f"Takeout/{name}.json", b"{}")
            link = zipfile.ZipInfo("Takeout/link")
            link.external_attr = 0o120777 << 16
            z.writestr(link, "/etc/passwd")
    put(tmp_path / "broken.zip", b"no archive")
    out = tmp_path / "out"
    archives = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.zip", "b.zip", "broken.zip")], "path string")
    found = zips.extract(archives, str(out), task_bytes=4).collect()
    inside = {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()}
    assert inside == {"Takeout/Photos from 2015/x.jpg": b"new", "Takeout/a.zip.json": b"{}", "Takeout/b.zip.json": b"{}"}
    assert sorted(os.listdir(tmp_path)) == ["a.zip", "b.zip", "broken.zip", "out"]
    assert sum(r.ok for r in found) == 3 and len(found) == 11
    assert sum("outside" in (r.error or "") for r in found) == 4 and sum("link" in (r.error or "") for r in found) == 2
    assert zips.resolve_root(str(out)) == str(out / "Takeout")
    with pytest.raises(FileExistsError):
        zips.extract(archives, str(out))


def test_clone_is_made_by_tasks(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(12):
        put(source / f"d{i % 3}" / "deep" / f"f{i}", b"x" * i)
    os.symlink("f0", source / "d0" / "deep" / "link")
    os.symlink("..", source / "d1" / "loop")
    (source / "empty").mkdir()
    os.utime(source / "d2", (1_000_000, 1_000_000))
    target, done = clone.clone(spark, str(source) + "/", parts=3)
    assert os.path.basename(target) == "in_tmp"
    assert Counter((r["kind"], r["ok"]) for r in done.collect()) == {("dir", True): 7, ("file", True): 12, ("link", True): 2}
    assert all(open(f"{target}/d{i % 3}/deep/f{i}", "rb").read() == b"x" * i for i in range(12))
    assert os.readlink(f"{target}/d0/deep/link") == "f0" and os.readlink(f"{target}/d1/loop") == ".."
    assert os.path.isdir(f"{target}/empty") and os.stat(f"{target}/d2").st_mtime == 1_000_000
    assert os.path.basename(clone.free_name(str(source))) == "in_tmp1"
    (tmp_path / "none").mkdir()
    assert clone.clone(spark, str(tmp_path / "none"))[1].count() == 0


def test_rename_pairs_on_a_plan(spark, tmp_path):
    for name in ("a.png", "a.png.json", "b.png", "c.png", "c.png.json", "c.png.jpg.json", "e.png", "e.png.jpg"):
        put(tmp_path / "F" / name, name.encode())
    files = spark.createDataFrame([(i, "F", f"{n}.png") for i, n in enumerate("abcde")], "file_id long, folder string, name string")
    fixes = files.selectExpr("file_id", "concat(name, '.jpg') as new_name")
    found = spark.createDataFrame([(0, "F", "a.png.json"), (1, "F", "a.png.json"), (2, "F", "c.png.json"), (9, "F", "x.json")], "file_id long, dir string, json_name string")
    plan = execute.rename_plan(files, fixes, found, str(tmp_path))
    for _ in range(2):  # a task that runs twice finds its work done
        got = {r["op_id"]: (r["ok"], (r["error"] or "").partition(":")[0]) for r in execute.rename_pairs(plan).collect()}
        assert got == {"0": (True, ""), "1": (True, ""), "2": (False, "FileExistsError"), "3": (False, "FileNotFoundError"), "4": (False, "FileExistsError")}
    assert sorted(os.listdir(tmp_path / "F")) == ["a.png.jpg", "a.png.jpg.json", "b.png.jpg", "c.png", "c.png.jpg.json", "c.png.json", "e.png", "e.png.jpg"]


JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0\xff\xda\x00\x02data\xff\xd9"


def test_exif_is_written_and_read_back():
    taken, place = datetime(2019, 7, 8, 9, 10, 11), (-33.8568, 151.2153)
    tagged = exif.with_tags(JPEG, taken, place)
    original, modified, north, east = exif.read(tagged)
    assert original == modified == "2019:07:08 09:10:11"
    assert (north, east) == (pytest.approx(place[0], abs=1e-7), pytest.approx(place[1], abs=1e-7))
    assert tagged.endswith(JPEG[2:])
    later = exif.with_tags(tagged, datetime(2020, 1, 2, 3, 4, 5))
    assert exif.read(later)[:3] == ("2020:01:02 03:04:05", "2020:01:02 03:04:05", north)
    assert exif.with_tags(JPEG, position=(0, 0)) == JPEG


def test_exif_writing_keeps_other_fields():
    model = b"Camera X\0"
    block = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHII", 0x0110, 2, len(model), 26) + struct.pack("<I", 0) + model
    jpeg = JPEG[:2] + b"\xff\xe1" + (len(block) + 8).to_bytes(2) + b"Exif\0\0" + block + JPEG[2:]
    tagged = exif.with_tags(jpeg, datetime(2001, 2, 3))
    start, end = exif.find_tiff(tagged)
    tiff = exif.Tiff(tagged[start + 10 : end])
    assert tiff.text(tiff.first()[0], 0x0110) == "Camera X" and exif.read(tagged)[0] == "2001:02:03 00:00:00"


def test_exif_of_broken_files(spark):
    tagged = exif.with_tags(JPEG, datetime(2019, 7, 8), (1.5, 2.5))
    for cut in range(len(tagged)):
        assert len(exif.read(tagged[:cut])) == 4
    assert exif.read(None) == exif.read(b"") == exif.read(b"\x89PNG") == (None, None, None, None)
    with pytest.raises(ValueError):
        exif.with_tags(b"no", datetime(2019, 7, 8))
    rows = spark.createDataFrame([(1, tagged), (2, None), (3, b"")], "id int, head binary").select("id", exif.fields("head").alias("x")).select("id", "x.*")
    assert {r.id: (r.original, r.latitude) for r in rows.collect()} == {1: ("2019:07:08 00:00:00", 1.5), 2: (None, None), 3: (None, None)}


def test_progress_goes_on_under_other_roots(spark, tmp_path):
    out = str(tmp_path / "out")
    assert progress.restore(spark, out, "/new") == {} and progress.completed(progress.load(out)) == set()
    table = spark.createDataFrame([(1, "/old/a.jpg", out + "/b.jpg"), (2, "/older/a.jpg", None)], "id int, path string, target string")
    progress.save(out, 1, 1.5, {"n": 2}, {"files": table}, "/old")
    progress.save(out, 3, 2, {}, {"files": table}, "/old", "done")
    assert progress.completed(progress.load(out)) == {1, 3}
    moved = str(tmp_path / "moved")
    os.rename(out, moved)
    found = {tuple(r) for r in progress.restore(spark, moved, "/new")["files"].collect()}
    assert found == {(1, "/new/a.jpg", moved + "/b.jpg"), (2, "/older/a.jpg", None)}
    put(tmp_path / "moved" / "progress.json", b"{broken")
    assert progress.load(moved) == {}
