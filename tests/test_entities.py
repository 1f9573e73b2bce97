"""Replacement chains, merges, staged sidecar search, retries and first failures."""

import random

import pytest

from lumenarc.operators import chains, matching, retry

MAPPING = "old long, new long"


def brute(pairs):
    to = {}
    for old, new in pairs:
        if old is not None and new is not None and old != new:
            to[old] = min(new, to.get(old, new))
    found = {}
    for old in to:
        seen, at = [], old
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        found[old] = (min(seen[seen.index(at) :]), True) if at in to else (at, False)
    return found


@pytest.mark.parametrize("pairs", [
    [], [(i, i - 1) for i in range(1, 70)], [(1, 2), (2, 3), (3, 1), (9, 3), (8, 9), (0, 8)], [(1, 2), (2, 1), (5, 4), (4, 3), (7, 7), (None, 1), (6, None), (5, 9)],
    [(i, (i + 1) % 33) for i in range(33)] + [(100 + i, 99 + i) for i in range(1, 12)] + [(100, 4)],
])
def test_chains_end(spark, pairs):
    got = {r["old"]: (r["final"], r["cyclic"]) for r in chains.resolved(spark.createDataFrame(pairs, MAPPING)).collect()}
    assert got == brute(pairs)


def test_random_maps_end(spark):
    rng = random.Random(4)
    pairs = [(i, rng.randrange(250)) for i in range(200)]
    got = {r["old"]: (r["final"], r["cyclic"]) for r in chains.resolved(spark.createDataFrame(pairs, MAPPING)).collect()}
    assert got == brute(pairs)


def test_merge_takes_the_later_of_equal_dates(spark):
    entities = spark.createDataFrame([(1, 1, "a", 2, "m1", False), (2, 2, "b", 1, "m2", None), (3, 3, "c", 1, "m3", True), (4, 4, None, None, "m4", None), (5, 5, None, None, None, None), (6, 6, "f", None, "m6", False)], "entity long, ord long, taken string, accuracy int, method string, partner_shared boolean")
    files = spark.createDataFrame([(1, "s", "t", False), (3, "s", "t", False), (3, "s", "t", True), (6, "x", None, False)], "entity long, source string, target string, link boolean")
    albums = spark.createDataFrame([(1, "A", "d1"), (2, "A", "d2"), (3, "B", "d1"), (3, "A", "d1")], "entity long, album string, dir string")
    mapping = spark.createDataFrame([(3, 2), (2, 1), (6, 5), (5, 4)], MAPPING)
    got = {r[0]: tuple(r)[1:] for r in chains.merged(entities, files, albums, mapping).select("entity", "merged", "taken", "accuracy", "method", "partner_shared", "files", "albums").collect()}
    assert got == {1: (2, "c", 1, "m3", True, 2, "A:2|B:1"), 4: (2, "f", None, "m4", False, 1, "")}
    assert [r["entity"] for r in chains.replaced(files, mapping).orderBy("entity").collect()] == [1, 1, 1, 4]


FILES, SIDECARS = "file_id long, folder string, name string", "dir string, json_name string, body string"


def test_each_stage_of_the_search(spark):
    files = [(1, "d", "a.jpg"), (2, "d", "b-edi.jpg"), (3, "d", "c.jpg"), (4, "d", "e.jpg"), (5, "f ", "g.jpg"), (6, "f ", "h.jpg"), (7, "f ", "i.jpg"), (8, "d", "none.jpg"), (9, None, "x.jpg"), (10, "d", None), (11, "d", "K.jpg")]
    sidecars = [("d", "a.jpg.json"), ("d", "A.JPG.json"), ("d", "b.jpg.json"), ("d", "C.jpg.JSON"), ("d", "E .json"), ("f", "g.jpg.json"), ("f", "H.jpg.json"), ("f ", "i.jpg.json"), ("f", "i.jpg.json"), ("d", "k  .json"), ("d", "k.jpg.json"), ("d", "k.jpg.txt")]
    found = matching.staged_match(spark.createDataFrame(files, FILES), spark.createDataFrame([(*s, "{}") for s in sidecars], SIDECARS))
    assert {r["file_id"]: (r["stage"], r["dir"], r["json_name"]) for r in found.collect()} == {
        1: ("careful", "d", "a.jpg.json"), 2: ("bold", "d", "b.jpg.json"), 3: ("folded", "d", "C.jpg.JSON"), 4: ("folded", "d", "E .json"),
        5: ("trimmed", "f", "g.jpg.json"), 6: ("trimmed folded", "f", "H.jpg.json"), 7: ("careful", "f ", "i.jpg.json"), 11: ("folded", "d", "k.jpg.json"),
    }
    assert matching.staged_match(spark.createDataFrame([], FILES), spark.createDataFrame([], SIDECARS)).count() == 0


def test_bisection_finds_the_faults_in_few_rounds(spark):
    ops = [(i, i // 100 if i < 450 else None, f"/p/{i}.jpg") for i in range(500)]
    bad = {f"/p/{i}.jpg" for i in (3, 250, 251, 460)}

    def act(paths):
        if any(p in bad for p in paths):
            raise ValueError("refused")

    found = retry.bisected(spark.createDataFrame(ops, "op_id long, batch long, payload string"), act).collect()
    assert len(found) == 500 and {r["op_id"] for r in found if not r["ok"]} == {3, 250, 251, 460}
    assert all(r["error"] == "ValueError: refused" for r in found if not r["ok"])
    tries = {r["op_id"]: r["tries"] for r in found}
    assert tries[150] == 1 and max(tries.values()) <= 8  # batches of 100


def test_named_faults_stand_alone_at_once(spark):
    ops = [(i, 1, f"/p/{i}.jpg") for i in range(64)]

    def act(paths):
        if "/p/7.jpg" in paths:
            raise ValueError("Error: cannot write - /p/7.jpg")
        if "/p/9.jpg" in paths:
            raise ValueError("Error: something else")

    found = {r["op_id"]: r for r in retry.bisected(spark.createDataFrame(ops, "op_id long, batch long, payload string"), act, by_name=True).collect()}
    assert {i for i, r in found.items() if not r["ok"]} == {7, 9} and found[7]["tries"] == 2 and max(r["tries"] for r in found.values()) <= 8


def test_retry_of_nothing(spark):
    assert retry.bisected(spark.createDataFrame([], "op_id long, batch long, payload string"), retry.strict_dates).count() == 0


def test_first_failures_are_cut_before_the_shuffle(spark):
    rows = [(i, "move" if i % 2 else None, i % 7 == 0, i > 990) for i in range(1000)]
    df = spark.createDataFrame(rows, "op_id long, op string, is_primary boolean, ok boolean")
    found = chains.first_failures(df, ["op", "is_primary"], ["op_id"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    got = sorted((str(r["op"]), r["is_primary"], r["place"], r["op_id"], r["more"]) for r in found.collect())
    want = []
    for op in {"move", None}:
        for p in (True, False):
            ids = [i for i, o, q, ok in rows if o == op and q == p and not ok]
            want += [(str(op), p, n + 1, i, len(ids) - 3) for n, i in enumerate(ids[:3])]
    assert got == sorted(want)
