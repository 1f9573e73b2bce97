"""Byte ranges, dealing by size and content grouping by refinement, on real files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lumenarc.operators import balance, refine
from lumenarc.sources import byte_ranges


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Groups of one size and extension: equal files, files unlike in the head only, in an unsampled place only, and one of a kind."""
    d = tmp_path_factory.mktemp("files")
    body = bytes(range(256)) * 256  # 64 KiB
    bodies = {f"a/same{i}.jpg": body for i in range(3)} | {f"b/head{i}.jpg": bytes([i]) + body[1:] for i in range(5)}
    bodies |= {f"b/deep{i}.jpg": body[:20_000] + bytes([i]) + body[20_001:] for i in range(4)} | {"b/deep9.jpg": body[:20_000] + b"\x01" + body[20_001:]}
    bodies |= {"c/other.png": body, "c/alone.jpg": b"x" * 77, "c/pair1.gif": b"GIF8" + b"y" * 40, "c/pair2.gif": b"GIF8" + b"y" * 40, "c/none1.txt": b"", "c/none2.txt": b"", "c/clip.dat": b"\xff\xd8\xff" + b"z" * 9, "c/odd.bin": b"q", "c/odd.bin.json": b"{}"}
    for name, data in bodies.items():
        path = d / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    return d, {str(d / n): b for n, b in bodies.items()}


def table_of(spark, d):
    listed = byte_ranges.byte_ranges(spark, str(d), ["path", "size", "offset"]).filter("offset = 0")
    return listed.select(F.col("path").alias("file_id"), "path", "size", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ext"))


def test_ranges_join_to_the_files(spark, root):
    d, bodies = root
    rows = byte_ranges.byte_ranges(spark, str(d), range_bytes=10_000, partition_bytes=30_000).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["offset"])):
        assert r["offset"] == len(found.get(r["path"], b"")) and r["size"] == len(bodies[r["path"]]) and len(r["data"]) <= 10_000
        found[r["path"]] = found.get(r["path"], b"") + bytes(r["data"])
    assert found == bodies


def test_large_files_are_split_and_small_ones_share(spark, root):
    d, bodies = root
    schema = spark.createDataFrame([], byte_ranges.SCHEMA).schema
    reader = byte_ranges.RangeReader(schema, {"path": str(d), "rangeBytes": "4096", "partitionBytes": "200000"})
    parts = reader.partitions()
    cost = [sum(end - at + byte_ranges.OPEN_BYTES * -(-(max(1, end - at)) // 4096) for *_, at, end in p.runs) for p in parts]
    assert max(cost) <= 200_000 and len(parts) >= sum(map(len, bodies.values())) // 200_000
    assert sum(end - at for p in parts for *_, at, end in p.runs) == sum(map(len, bodies.values()))


def test_filters_reach_the_listing(spark, root):
    d, _ = root
    df = byte_ranges.byte_ranges(spark, str(d), range_bytes=512).filter((F.col("offset") == 0) & (F.col("size") > 70) & F.col("path").endswith(".jpg") & (F.length("data") > 10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(offset" not in plan.replace("isnotnull(offset", "") and "length(data" in plan  # what was pushed is not asked again
    rows = df.collect()
    assert len(rows) == 14 and all(len(r["data"]) <= 512 for r in rows)


def test_without_data_no_file_is_opened(spark, root):
    d, bodies = root
    os.chmod(d / "c/alone.jpg", 0)
    schema = byte_ranges.byte_ranges(spark, str(d), ["path", "size"])
    assert schema.columns == ["path", "size"] and {r["path"] for r in schema.collect()} == set(bodies)
    os.chmod(d / "c/alone.jpg", 0o644)


def test_media_by_names_and_by_headers(spark, root):
    d, bodies = root
    short = lambda df: {r["path"].removeprefix(f"{d}/") for r in df.collect()}
    assert short(byte_ranges.media_files(spark, str(d))) == {p.removeprefix(f"{d}/") for p in bodies if p.endswith((".jpg", ".png", ".gif"))}
    assert short(byte_ranges.media_files(spark, str(d), "headers")) == {"c/clip.dat", "c/odd.bin", "c/pair1.gif", "c/pair2.gif"}


@pytest.mark.parametrize(("algorithm", "head"), [("sha256", None), ("md5", None), ("md5", 1000)])
def test_digests(spark, root, algorithm, head):
    d, bodies = root
    got = {r["path"]: r["digest"] for r in byte_ranges.digests(table_of(spark, d), algorithm, head, task_bytes=100_000).collect()}
    assert got == {p: hashlib.new(algorithm, b[:head]).hexdigest() for p, b in bodies.items()}


def test_file_over_two_gibibytes(spark, tmp_path):
    path, size = tmp_path / "film.mp4", (2 << 30) + 5
    with open(path, "wb") as f:
        f.truncate(size)
    files = table_of(spark, tmp_path)
    want = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        want.update(bytes(min(1 << 24, size - at)))
    assert [r["digest"] for r in byte_ranges.digests(files).collect()] == [want.hexdigest()]
    assert byte_ranges.byte_ranges(spark, str(tmp_path), ["offset"], range_bytes=1 << 28).count() == 9


@pytest.mark.parametrize(("small", "by_ext"), [(3, True), (0, True), (3, False)])
def test_groups_equal_plain_hashing(spark, root, small, by_ext):
    d, bodies = root
    found = refine.refined(table_of(spark, d), refine.OfFiles(), small, by_ext)
    plain = {}
    for p, b in bodies.items():
        plain.setdefault((p.rpartition(".")[2] if by_ext else "", hashlib.sha256(b).hexdigest()), set()).add(p)
    got = {}
    for r in found.members.collect():
        got.setdefault((r["ext"] if by_ext else "", r["sha256"]), set()).add(r["file_id"])
    assert got == {k: v for k, v in plain.items() if len(v) > 1} and found.errors.count() == 0


def test_files_of_a_signature_of_their_own_are_never_hashed(spark, root, monkeypatch):
    d, _ = root
    opened = spark.sparkContext.accumulator(0)
    hashed = refine.OfFiles.hashes

    class Counting(refine.OfFiles):
        def hashes(self, rows):
            opened.add(len(seen := [r["path"] for r in rows.select("path").collect()]))
            assert not any("/head" in p and not p.endswith("head0.jpg") for p in seen) and not any("alone" in p or "other" in p for p in seen)
            return hashed(self, rows)

    found = refine.refined(table_of(spark, d), Counting())
    phases = {r["phase"]: (r["files"], r["survivors"]) for r in found.phases.collect()}
    # head1..4 leave after their signature; deep0..9 and same0..2 share one with head0
    assert phases == {"size": (22, 17), "signature": (13, 9), "hash": (13, 10)} and opened.value == 13


def test_unreadable_files_are_errors(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.jpg").write_bytes(b"1234")
    files = table_of(spark, tmp_path)
    files = spark.createDataFrame([tuple(r) for r in files.collect()], files.schema)
    (tmp_path / "b.jpg").unlink()
    found = refine.refined(files, refine.OfFiles())
    assert found.members.count() == 0 and [(r["phase"], "FileNotFoundError" in r["error"]) for r in found.errors.collect()] == [("hash", True)]


def test_nothing_and_nulls(spark):
    schema = "file_id long, size long, ext string, text string, signature string, sha256 string"
    for rows, members in (([], 0), ([(1, None, "a", None, "", ""), (2, None, "a", None, "", ""), (None, 1, "a", "x", "", ""), (3, 1, "a", "x", "", ""), (4, 1, "a", "y", "", ""), (5, 1, "b", "x", "", "")], 0)):
        files = spark.createDataFrame(rows, schema)
        assert refine.refined(files, refine.OfTable(files)).members.count() == members


def test_dealt_by_cost_near_the_best(spark):
    costs = [10_000, 9_000, 9_000, 400, 300] + [i % 90 for i in range(4_000)]
    df = spark.createDataFrame(list(enumerate(costs)), "id long, cost long")
    dealt = balance.balanced(df, "cost", 16, "id")
    loads = {r["part"]: r["s"] for r in dealt.groupBy("part").agg(F.sum("cost").alias("s")).collect()}
    assert sum(loads.values()) == sum(costs) and max(loads.values()) * 3 <= 4 * max(sum(costs) / 16, max(costs))
    assert dealt.rdd.getNumPartitions() == 16
    assert {(r["p"], r["part"]) for r in dealt.select(F.spark_partition_id().alias("p"), "part").distinct().collect()} == {(p, p) for p in loads}


def test_dealing_nothing_and_odd_costs(spark):
    schema = "id long, cost long, part int"
    assert balance.balanced(spark.createDataFrame([], schema), "cost", 4, "id").count() == 0
    assert balance.balanced(spark.createDataFrame([(1, None, 0), (None, 5, 0), (1, -3, 0), (2, 0, 0)], schema), "cost", 4, "id").count() == 4
