"""Column functions and operators on small cases."""

import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.functions import dates, names, repairs
from lumenarc.operators import entities, matching, tags
from lumenarc.plans import catalogue


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string")
    return [r[1] for r in df.select("i", build(F.col("v")).alias("r")).orderBy("i").collect()]


def texts(spark, values, build):
    return column(spark, values, lambda c: F.date_format(build(c), "yyyy-MM-dd HH:mm:ss"))


def test_dates_in_file_names(spark):
    cases = {
        "Screenshot_20190919-053857_Camera-edited.jpg": "2019-09-19 05:38:57",
        "MVIMG_20190215_193501.MP4": "2019-02-15 19:35:01",
        "Screenshot_2019-04-16-11-19-37-232_com.jpg": "2019-04-16 11:19:37",
        "signal-2020-10-26-163832.jpg": "2020-10-26 16:38:32",
        "00004XTR_00004_BURST20190216172030.jpg": "2019-02-16 17:20:30",
        "2016_01_30_11_49_15.mp4": "2016-01-30 11:49:15",
        "IMG_20190230_101010.jpg": "2019-03-02 10:10:10",
        "IMG_1234.jpg": None,
        "": None,
        None: None,
    }
    assert texts(spark, list(cases), dates.from_name) == list(cases.values())


def test_years_in_folder_names(spark):
    cases = {"Photos from 2014": 2014, "2015 Pictures": 2015, "Photos 2016": 2016, "2017-05": 2017, "2018": 2018, "Rome 1234 and 2019": 2019, "Photos from 1850": None, "x": None, None: None}
    assert column(spark, list(cases), lambda c: F.year(dates.from_folder(c, 2026))) == list(cases.values())


def test_lenient_dates(spark):
    cases = {
        "2020:05:06 07:08:09": "2020-05-06 07:08:09",
        " 2020.5.6 7:8 ": "2020-05-06 07:08:00",
        "2020/05/06": "2020-05-06 00:00:00",
        "2020-05-06T07:08:09.123Z": "2020-05-06 07:08:09",
        "2020-05-06T07:08:09+02:00": "2020-05-06 05:08:09",
        "2020:05:06 07:08:09-0330": "2020-05-06 10:38:09",
        "20200506": "2020-05-06 00:00:00",
        "2020:05:06 07:08:09.123": None,
        "0000:00:00 00:00:00": None,
        "1904:01:01 00:00:00": None,
        "2020:13:01 00:00:00": None,
        "20:05:06": None,
        "soon": None,
        "": None,
        None: None,
    }
    assert texts(spark, list(cases), dates.from_text) == list(cases.values())


def test_names(spark):
    assert column(spark, ["a-edited.jpg", "a-EDITED(2).jpg", "a-ha editado.png", "a.jpg", None], names.without_edit) == ["a.jpg", "a.jpg", "a.png", "a.jpg", None]
    assert column(spark, ["a-ed.jpg", "a-e(1).jpg", "a-x.jpg", "a-.jpg"], names.without_partial_edit) == ["a.jpg", "a.jpg", "a-x.jpg", "a-.jpg"]
    assert column(spark, ["a-ed.jp", "a-ed.mo", "a.jp"], names.with_restored_extension) == ["a.jpg", "a.mov", "a.jp"]
    assert column(spark, ["a-ed.jpg", "a-e.jpg", "a-x1.jpg"], names.without_edge_edit) == ["a.jpg", "a-e.jpg", "a-x1.jpg"]
    assert column(spark, ["p.MP", "p.mp4"], names.motion_photo) == ["p.MP.jpg", "p.mp4"]
    assert column(spark, ["Takeout/2019/x.jpg", "t\\PHOTOS  from 2019\\x.jpg", "t/fotos von 19/x.jpg"], names.in_year_folder) == [True, True, False]
    assert column(spark, ["a/b/c", "a/bc", "a/b"], lambda c: names.is_sub_path(c, F.lit("a/b"))) == [True, False, True]
    assert column(spark, ["x(1).(1).jpg", "abc"], lambda c: names.replace_last(c, "(1)", "")) == ["x(1)..jpg", "abc"]
    assert column(spark, ["o/ALL_PHOTOS/2020", "o/2020-07", "o/Albums/x"], names.is_canonical_target) == [True, True, False]
    assert column(spark, ["Unbenannt 3", "Sans titre", "My untitled"], names.is_untitled) == [True, True, False]


def test_repairs(spark):
    assert column(spark, ["a¥o", "MA¥O", "José", "JosÃ©", "a¤o", "mam ", "東京Ã", None], repairs.repair) == ["año", "MAÑO", "José", "José", "año", "mamá", "東京Ã", None]
    named = ["Trip 😀☀️", "Trip 12#", "©", None]
    coded = column(spark, named, repairs.emoji_to_hex)
    assert coded[:2] == ["Trip _0x1f600__0x2600__0xfe0f_", "Trip 12#"]
    assert column(spark, coded, repairs.hex_to_emoji) == named
    assert column(spark, ["é", None], repairs.nfc) == ["é", None]


def fnv(data, basis, prime, bits):
    h = basis
    for b in data:
        h = ((h ^ b) * prime) % (1 << bits)
    return h


def test_signatures(spark):
    bodies = [b"", b"foobar", bytes(range(256)) * 50]
    df = spark.createDataFrame([(i, bytearray(b), "jpg") for i, b in enumerate(bodies)], "i long, content binary, ext string")
    got = df.select("i", repairs.quick_signature("content", "ext"), repairs.sample_fingerprint("content")).orderBy("i").collect()
    f32 = lambda b: fnv(b, repairs.FNV32_BASIS, repairs.FNV32_PRIME, 32)
    for (_, quick, sample), b in zip(got, bodies, strict=True):
        middle = f32(b[len(b) // 2 :][:4096]) if len(b) > 4096 else 0
        assert quick == f"{len(b)}|jpg|{f32(b[:4096])}|{middle}|{f32(b[-4096:])}"
        h = fnv(b, repairs.FNV64_BASIS, repairs.FNV64_PRIME, 64)
        assert sample == (f"{len(b)}b:{h:016x}:{h:016x}:{h:016x}" if b else "SZ0")


MATCHES = [
    ("a.jpg", "a.jpg.supplemental-metadata.json", False, "as it is"),
    ("x" * 30 + ".jpg", "x" * 30 + ".jpg.supplement.json", False, "as it is"),
    ("a.jpg", "a.jpg.supplement.json", True, None),
    ("image(11).jpg", "image.jpg(11).json", False, "as it is"),
    ("image(11).jpg", "image.jpg.supplemental-metadata(11).json", False, "as it is"),
    ("image(11).jpg", "image(11).jpg.json", False, "as it is"),
    ("a-edited(1).jpg", "a.jpg.json", False, "no edited ending"),
    ("a-edi.jpg", "a.jpg.json", False, None),
    ("a-edi.jpg", "a.jpg.json", True, "no partial ending"),
    ("p.MP", "p.MP.jpg.json", False, "motion photo"),
    ("v.mp4", "v.HEIC.json", True, "other extension"),
    ("a-ed.jp", "a.jpg.json", True, "extension restored"),
]


@pytest.mark.parametrize(("name", "json_name", "tryhard", "strategy"), MATCHES)
def test_sidecar_names(spark, name, json_name, tryhard, strategy):
    found = spark.range(1).select(matching.sidecar_names(F.lit(name), matching.STRATEGIES if tryhard else matching.STRATEGIES[: matching.BASIC])).first()[0]
    assert next((x["strategy"] for x in found if x["json_name"] == json_name), None) == strategy


def test_extension_fixes_and_links(spark):
    rows = [(1, "f", "a.png", "png", b"\xff\xd8\xff\xe0"), (2, "f", "b.jpeg", "jpeg", b"\xff\xd8\xff"), (3, "f", "c.png", "png", b"\xff\xd8\xff"), (4, "f", "c.png.jpg", "jpg", b"\xff\xd8\xff"), (5, "f", "d-edited.png", "png", b"\xff\xd8\xff"), (6, "f", "e.jpg", "jpg", b"II*\0"), (7, "f", "g.jpg", "jpg", None)]
    files = spark.createDataFrame([(*r[:4], bytearray(r[4]) if r[4] else None) for r in rows], "file_id long, folder string, name string, ext string, head binary")
    assert [tuple(r) for r in entities.extension_fixes(files).collect()] == [(1, "image/jpeg", "a.png.jpg")]
    assert entities.extension_fixes(files, skip_jpeg=True).count() == 0
    links = spark.createDataFrame([("e", "A", 1, "x.jpg"), ("e", "A", 2, "x.jpg"), ("e", "B", 3, "x.jpg")], "entity string, album string, file_id long, base string")
    assert {r["file_id"]: r["link_name"] for r in entities.reserved_names(links).collect()} == {1: "x.jpg", 2: "x(1).jpg", 3: "x.jpg"}


def test_membership_by_prefix(spark):
    files = spark.createDataFrame([(1, "Trip", "t/Trip/a.jpg"), (2, "Day", "t/Trip/Day/b.jpg"), (3, "2019", "t/Trip/2019/c.jpg"), (4, "Tripod", "t/Tripod/d.jpg")], "file_id long, folder string, path string")
    assert sorted(map(tuple, entities.membership(files).collect())) == [(1, "Trip"), (2, "Day"), (2, "Trip"), (3, "Trip"), (4, "Tripod")]




def test_seconds_carry_over(spark):
    got = spark.createDataFrame([(1.0,), (-0.9999999999,), (12.5083333,), (179.99999,), (0.0,), (None,)], "x double").select(tags.dms(F.col("x")).alias("p")).collect()
    assert [None if r["p"]["degrees"] is None else tuple(r["p"])[:3] for r in got] == [(1, 0, 0), (1, 0, 0), (12, 30, 3000), (179, 59, 5996), (0, 0, 0), None]


def test_dates_of_tags_skip_what_is_none(spark):
    rows = [(1, "CreateDate", "2001:01:01 00:00:00"), (1, "DateTimeOriginal", "0000:00:00"), (1, "ModifyDate", "2000:01:01 00:00:00"), (1, "Other", "1999:01:01"), (2, "DateTime", "1904:01:01 00:00:00"), (3, None, None), (4, "DateTime", None)]
    got = {r["i"]: tuple(d and d.year for d in (r["earliest"], r["first"])) for r in tags.read_dates(spark.createDataFrame(rows, "i int, tag string, value string"), ["i"]).collect()}
    assert got == {1: (2000, 2001), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_usual_dates_are_read_without_the_lenient_forms(spark):
    def seconds(text):
        best = []
        for _ in range(3):
            start = time.perf_counter()
            spark.range(20_000).select(dates.from_text(F.concat(F.lit(text), (F.col("id") % 9 + 1).cast("string"))).alias("t")).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds("2021:03:04 05:06:0") * 2 < seconds("2021-03-04 5:06:0")


def test_mixed_dates_are_read_once(spark):
    cases = ["2020:05:06 07:08:09", " 2020.5.6 7:8 ", "2020/05/06", "2020-05-06T07:08:09.123Z", "20200506T070809", "2020-0506 07:08 +05", "2020-05-06T07:08:09-0330", "2020:05:06 07:08:09-0330", "2020:05:06 07:08:09+02", "2020-05-06-02", "2020-05-06\n", "2020-05-06T07:08Z\n", "2020.5.6\t7:8", "2020.5.6 7:8\n", "2020:02:31 25:61:61", "2020-02-00", "2020-13-06T07:08:09", "1970-01-01T02:00:00+02:00", "1901-01-01T00:30:00+02:00", "2036:01:01 23:59:59", "1904-01-01", "0000:00:00 07:08:09", "1899-05-05", "20:05:06", "+2020.5.6 1:2", "T", "soon", "", None]
    assert texts(spark, cases, dates.from_mixed_text) == texts(spark, cases, dates.from_text)
    plan = catalogue.QUERIES["date_from_camera_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert plan.count("date_format") == 9  # one for each way of writing, and that of the result; from_text named each hundreds of times


def test_fnv_holds_few_contents_at_a_time():
    slices = [b"x" * (64 << 10), *[b"ab" * (i % 30) for i in range(3000)]]
    tracemalloc.start()
    got = repairs.fnv1a(slices, repairs.FNV32_BASIS, repairs.FNV32_PRIME, np.uint32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 1, 2, 31, 2999):
        h = repairs.FNV32_BASIS
        for b in slices[i]:
            h = ((h ^ b) * repairs.FNV32_PRIME) & 0xFFFFFFFF
        assert int(got[i]) == h
    assert peak < 32 << 20  # a grid of all was 197 MB
