"""Filter audit, sharding and prefix trie against brute force, SQL and odd rows."""

import hashlib
import heapq
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import filter_audit, prefix_trie, sharding

DIR = "/root/testdata/sf0.001"


def cells(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize(("query", "sql"), [(filter_audit.op11_filter_audit, filter_audit.ORACLE), (prefix_trie.op13_prefix_trie, prefix_trie.ORACLE)])
def test_matches_sql(spark, query, sql):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert cells(query(spark, DIR).toPandas()) == cells(c.sql(sql).df())


# Filter audit

DOCS = "doc_id long, text string, source string, mask int, good boolean, words string, bits int, part string"


def odd_docs():
    rng, words = random.Random(3), [f"w{i}" for i in range(40)]
    kinds = ["", None, "UPPER CASE " * 30, " ".join(rng.choices(words, k=60)), "a b\tc\n" * 40, "x# y", "é ü   % " * 20, " ".join(f"n{i}" for i in range(70)), "long " * 30_000]
    return [(rng.choice([None, *range(60)]), rng.choice(kinds), rng.choice(["a", None, "b"])) for _ in range(120)]


def brute_audit(docs, good, toxic):
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = t.encode().split()
        fails = {x for x, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and ids[t] < i), strict=True) if f}
        rows.append((s or "", fails, i in good, i in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for n, x in enumerate(order, 1):
                out = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                found[part, "".join(order), n] = [len(left), len(out), sum(x in r[1] for r in gone), sum(r[1] == {x} and r[0] == part for r in rows), sum(r[2] for r in out), sum(r[3] for r in out)]
                gone += out
    for part in {r[0] for r in rows}:
        for x in "ABCDE":
            keys = [(part, "".join(o), o.index(x) + 1) for o in permutations("ABCDE")]
            total = sum(found[k][1] for k in keys)
            for k in keys:
                found[k].append(total)
    return found


def test_audit_of_odd_rows(spark):
    docs = odd_docs()
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (99, 1, 1), (3, 1, None), *((i, i % 2, i % 3) for i in range(10, 50))]
    df = spark.createDataFrame([(*d, 7, True, "w", 9, "p") for d in docs], DOCS)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, id string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(filter_audit.failures(df, marks)).collect()}
    assert got == brute_audit(docs, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})


def test_audit_of_nothing(spark):
    df, marks = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failures(df, marks)).collect() == []


def test_parity_sums_invert(spark):
    rows = spark.range(500).select((F.col("id") * F.col("id") % 13 % 8).cast("int").alias("m"), (F.col("id") % 2).alias("k"))
    want = {(r["k"], r["m"]): r["count"] for r in rows.groupBy("k", "m").count().collect()}
    got = filter_audit.parity_sums(rows, ["k"], "m", 3).select("k", F.posexplode(filter_audit.cells(F.col("sums"), 3)).alias("m", "n")).filter("n > 0").collect()
    assert {(r["k"], r["m"]): r["n"] for r in got} == want


# Sharding


def check_shards(rows, given, shards=8):
    """All rows there, groups together, slots gapless; the shards' sizes."""
    loads, slots, home = [0] * shards, {}, {}
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want
    for r in rows:
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert home.setdefault((r["size"], r["text_crc32"]), r["shard"]) == r["shard"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return loads


def test_few_groups_follow_the_plain_heap(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    loads = check_shards(sharding.op12_sharding(spark, DIR).collect(), given)
    groups = {}
    for _, t in given:
        groups[t] = groups.get(t, 0) + len((t or "").encode()) + 1
    heap = [(0, i) for i in range(8)]
    for n in sorted(groups.values(), reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, i))
    assert sorted(loads) == sorted(load for load, _ in heap)


@pytest.mark.parametrize(("part_groups", "range_rows"), [(1 << 18, 1 << 16), (40, 100)])
def test_parts_keep_sizes_near(spark, monkeypatch, part_groups, range_rows):
    monkeypatch.setattr(sharding, "LARGE", 400)
    monkeypatch.setattr(sharding, "PART_GROUPS", part_groups)
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    rng = random.Random(1)
    given = [(i, "x" * int(rng.paretovariate(1.1) * 20) + str(i)) for i in range(3000)] + [(5000 + i, "copy of one text") for i in range(1500)]
    df = spark.createDataFrame([(*g, "s", 1, 2) for g in given], "doc_id long, text string, shard string, digest int, slot int")
    loads = check_shards(sharding.shard(df).collect(), given)
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 8


def test_a_group_over_a_shard_has_it_alone(spark):
    given = [(i, "hot " * 50) for i in range(300)] + [(1000 + i, f"t{i}") for i in range(700)]
    loads = sorted(check_shards(sharding.shard(spark.createDataFrame(given, "doc_id long, text string")).collect(), given))
    assert loads[-1] == 300 * 201 and loads[-2] - loads[0] <= 8


def test_sharding_of_odd_rows(spark):
    given = [(None, None), (None, None), (1, ""), (1, ""), (2, "a"), (2, "b"), (None, "ä" * 100_000), (3, "a")]
    check_shards(sharding.shard(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# Prefix trie


def brute_trie(turns):
    convs = {}
    for c, n, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((n is not None, n or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c in own:
        h, leader = zlib.crc32(str(c).encode()) % 4, int(c - np.fmod(c, 20))
        built[c] = tuple(own.get(leader, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    found = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        words = lambda p: len(p[-1][1].encode().split()) if p else 0
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        found.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in under), sum((len(nodes[p]) - 1) * words(p) for p in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found)


def odd_turns():
    rng = random.Random(8)
    said = ["", None, "yes", "no thank you", "  a b", "maybe\tso", "word " * 20_000]
    rows = []
    for c in [*range(-45, 30), 41, 43, 61, 1 << 40]:
        rows += [(c, rng.choice([n, n, n, None]), rng.choice(["user", None, "bot"]), rng.choice(said[:4] if n < 2 else said)) for n in range(rng.randrange(1, 7))]
    for c in range(100, 160):  # one conversation, and a prefix of it, many times
        rows += [(c, n, "user", f"t{n}") for n in range(3 if c % 3 else 5)]
    return [*rows, *rows[:5], (None, 1, "user", "lost")]


def tried(df, **more):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **more).collect()), key=lambda r: (r[0], r[1]))


TURNS = "conv_id long, turn long, role string, text string, d int, key string, digest long"


def test_trie_of_odd_rows(spark):
    turns = odd_turns()
    df = spark.createDataFrame([(*t, 1, "k", 2) for t in turns], TURNS)
    assert tried(df) == brute_trie(turns)


def test_trie_splits_collisions(spark):
    plain = prefix_trie.hashes

    def weak(digests, attempt):  # so few different hashes that unlike turns and prefixes meet at the first two attempts
        return [x % np.uint64(2) if attempt < 2 else x for x in plain(digests, attempt)]

    turns = odd_turns()
    assert tried(spark.createDataFrame([(*t, 1, "k", 2) for t in turns], TURNS), hashed=weak) == brute_trie(turns)


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH_BITS", 3)
    monkeypatch.setattr(prefix_trie, "IDS_BITS", 2)
    turns = [(1, n, "user", f"same {n % 7}") for n in range(400)] + [(c, n, "user", f"same {n % 7}") for c in (2, 3, 0) for n in range(60)]
    assert tried(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")) == brute_trie(turns)


def test_trie_of_nothing(spark):
    assert tried(spark.createDataFrame([], TURNS)) == []
