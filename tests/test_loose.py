"""VARIANT documents: loaders of real files, lossless writing, spellings of a path."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from lumenarc.sources import loose


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_real_sidecars(spark, tmp_path):
    full = {"title": "ä b.jpg", "photoTakenTime": {"timestamp": "1500000000"}, "geoData": {"latitude": -1.5, "longitude": 2}, "googlePhotosOrigin": {"fromPartnerSharing": {}}, "unknown": {"deep": [1, None, "x", 1.25]}}
    put(tmp_path / "Photos from 2017/a b+c.jpg.json", json.dumps(full, ensure_ascii=False))
    put(tmp_path / "Photos from 2017/number.json", '{"photoTakenTime": {"timestamp": 1500000000}, "geoData": {"latitude": "north"}, "googlePhotosOrigin": {"fromPartnerSharing": null}}')
    put(tmp_path / "broken.json", '{"title": "x"')
    put(tmp_path / "list.json", "[1, 2]")
    put(tmp_path / "empty.json", "")
    put(tmp_path / "no.txt", "{}")
    docs = loose.documents(spark, str(tmp_path))
    rows = {r["json_name"]: r for r in loose.sidecar_fields(docs, "dir", "json_name").collect()}
    assert set(rows) == {"a b+c.jpg.json", "number.json", "broken.json", "list.json"}
    r = rows["a b+c.jpg.json"]
    assert (r["dir"], r["title"], r["taken"], r["latitude"], r["longitude"], r["partner_shared"], r["described"]) == (f"{tmp_path}/Photos from 2017", "ä b.jpg", datetime(2017, 7, 14, 2, 40), -1.5, 2.0, True, True)
    r = rows["number.json"]
    assert (r["title"], r["taken"], r["latitude"], r["partner_shared"]) == (None, datetime(2017, 7, 14, 2, 40), None, False)
    assert not any(rows[n]["described"] for n in ("broken.json", "list.json"))
    again = docs.filter("json_name = 'a b+c.jpg.json'").select(loose.written(F.col("body"))).first()[0]
    assert json.loads(again) == full


def test_dictionary_file_of_many_entries(spark, tmp_path):
    entries = {f"C:\\in\\{i}.jpg": {"OldestDate": "2001-02-03T04:05:06Z", "Source": "x"} for i in range(500)} | {"skip": 3, "none": {"OldestDate": None}, "other": {"Else": 1}}
    put(tmp_path / "dates.json", json.dumps(entries))
    found = loose.dictionary(loose.documents(spark, str(tmp_path)))
    rows = {r["path"]: r["oldest"] for r in found.select("path", "oldest").collect()}
    assert len(rows) == 502 and rows["C:/in/7.jpg"] == "2001-02-03T04:05:06Z" and rows["none"] is None and rows["other"] is None


def test_the_first_usable_spelling_counts(spark):
    files = spark.createDataFrame([(1, "a/b.jpg", None), (2, "./x/../c.jpg", None), (3, "/abs/d.jpg", None), (4, "link.jpg", "/real/e.jpg"), (5, "z.jpg", None), (6, None, None)], "file_id long, path string, real string")
    entries = spark.createDataFrame([("a/b.jpg", "0000:00:00"), ("/base/a/b.jpg", "2001-01-01"), ("/base/c.jpg", " 2002-01-01 "), ("/abs/d.jpg", "2003-01-01"), ("/abs/d.jpg", "2002-06-01"), ("/real/e.jpg", "2004-01-01"), ("z.jpg", "1904-01-01")], "path string, oldest string")
    got = {r["file_id"]: (r["taken"].year, r["spelling"]) for r in loose.dictionary_dates(files, entries, "/base/", "real").collect()}
    assert got == {1: (2001, "absolute"), 2: (2002, "absolute"), 3: (2002, "given"), 4: (2004, "resolved")}


def test_paths_become_plain(spark):
    cases = {"a//b/./c": "a/b/c", "/a/../../b": "/b", "..\\x": "x", "": "", "/": "/", "a/b/..": "a"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", loose.normal_path(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == cases
