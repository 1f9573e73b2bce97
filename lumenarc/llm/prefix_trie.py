"""The trie of shared conversation prefixes.

Every conversation is rebuilt from the first turns of the conversation that
leads its block and its own turns after them; each distinct prefix is a node.

Turns are sorted over ranges, and numpy scans each range once: with turn i's
hash x(i), the sum of x(i) * W**i modulo two primes is a polynomial fingerprint
of the turns so far. Sums of ranges add up once shifted by a power of W, so a
conversation may lie in many ranges, and a rebuilt prefix's fingerprint follows
from those of its two pieces. Equal fingerprints at a depth are a candidate
group. Its representative is its least member; a member that shares its last
turn with the representative of its group at every depth has the same prefix
as it, since equal sums less equal last terms are equal sums one turn before.
So the SHA-256 of each last turn is held against the representative's, one
distinct value a group, not one row a member. Groups in which one differs, and
the groups below them, are split by a fresh fingerprint, until none is left.

A node's values reach all of its ancestors along the path of its
representative: first summed from a conversation's end upwards over the nodes
that it represents, then once a node over the conversations that pass it. There
is no round per level, however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import fold, mix, table
from lumenarc.llm.mixing import token_count
from lumenarc.runtime import Workspace, ship

#: Conversations of a block share the first turns of its leader; fewer than LEAD of them are taken.
BLOCK, LEAD = 20, 4
#: The primes of a fingerprint, which are below 2**31, and the polynomials' bases. Both halves are kept in one long.
PRIMES, BASES, HALF = (2147483647, 2147483629), (1103515245, 1812433253), 31
#: Turns whose sums are added up first where a conversation's nodes are summed from its end.
STRETCH_BITS = 12
#: Ids (2**bits) that one string of the list hashed for a node's ends covers.
IDS_BITS = 8


def hashes(digests: pa.Array, attempt: int) -> list[np.ndarray]:
    """For each prime a hash of each 32-byte digest; other functions at each attempt."""
    raw = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4).astype(np.uint64)
    return [mix(raw[:, (2 * attempt + i) % 4] + np.uint64(attempt)) % np.uint64(p) for i, p in enumerate(PRIMES)]


def powers(base: int, prime: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo prime, by squaring."""
    found, square, left, p = np.ones(exponents.size, np.uint64), base, exponents.astype(np.uint64), np.uint64(prime)
    while left.any():
        found = np.where(left & np.uint64(1), found * np.uint64(square) % p, found)
        left, square = left >> np.uint64(1), square * square % prime
    return found


def half(fp: Column, i: int) -> Column:
    return F.shiftright(fp, HALF) if i == 0 else fp.bitwiseAND(F.lit((1 << HALF) - 1))


def packed(halves: list[Column]) -> Column:
    return F.shiftleft(halves[0], HALF).bitwiseOR(halves[1])


def shifted(fp: Column, less: Column, by: list[Column], plus: Column) -> Column:
    """plus + by * (fp - less), for each prime; no step leaves 63 bits."""
    return packed([(half(plus, i) + by[i] * (half(fp, i) - half(less, i) + p)) % p for i, p in enumerate(PRIMES)])


def scanned(turns: DataFrame, attempt: int = 0, hashed: Callable[[pa.Array, int], list[np.ndarray]] = hashes) -> DataFrame:
    """turns(conv_id, turn, digest, words) with their sorted range, their ``place`` (from 1) in the conversation's turns of the range, and the fingerprints ``upto`` and ``before`` of these turns with and without the own one."""
    spark = turns.sparkSession
    ship(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, count, carried = TaskContext.get().partitionId(), None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, digest, words = (batch.column(batch.schema.get_field_index(n)) for n in ("conv_id", "digest", "words"))
            ids = conv.to_numpy()
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            runs = np.diff(np.r_[start, ids.size])
            goes_on = last == ids[0]
            first = np.repeat(np.where((start == 0) & goes_on, count, 0), runs)
            place = np.arange(ids.size) - np.repeat(start, runs) + 1 + first
            upto, before = np.zeros(ids.size, np.uint64), np.zeros(ids.size, np.uint64)
            for i, (x, p, base) in enumerate(zip(hashed(digest, attempt), PRIMES, BASES, strict=True)):
                term = x * powers(base, p, place) % np.uint64(p)
                run = np.cumsum(term, dtype=np.uint64)
                less = np.where(start > 0, run[start - 1], np.uint64(0))
                more = np.repeat(np.where((start == 0) & goes_on, np.uint64(carried[i]), np.uint64(0)), runs)
                sums = (run - np.repeat(less, runs) + more) % np.uint64(p)
                upto = upto << np.uint64(HALF) | sums
                before = before << np.uint64(HALF) | (sums + np.uint64(p) - term) % np.uint64(p)
                carried[i] = int(sums[-1])
            last, count = ids[-1], int(place[-1])
            numbers = [np.full(ids.size, here, np.int64), place.astype(np.int64), upto.view(np.int64), before.view(np.int64)]
            yield pa.RecordBatch.from_arrays([conv, digest, words, *map(pa.array, numbers)], ["conv_id", "digest", "words", "range", "place", "upto", "before"])

    keys = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows alike in all else differ in ``row``, so that ranges can part them too.
    given = turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return given.mapInArrow(scan, "conv_id long, digest binary, words long, range long, place long, upto long, before long")


def joined(ranges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """scanned turns with ``at``, ``upto`` and ``before`` over the whole conversation.

    Of conversations that lie in several ranges, one row a range goes to the
    driver and back: at most twice as many as there are ranges.
    """
    spark = ranges.sparkSession
    found = work.save(ranges, f"{name}-scan")
    sizes = found.groupBy("conv_id", "range").agg(F.max("place").alias("n"), F.max_by("upto", "place").alias("total"))
    several = sizes.groupBy("conv_id").agg(F.count("*").alias("r"), F.collect_list(F.struct("range", "n", "total")).alias("of")).filter("r > 1")
    spans = []
    for row in several.select("conv_id", F.array_sort("of").alias("of")).collect():
        at, sums = 0, [0, 0]
        for r in row["of"]:
            by = [pow(b, at, p) for b, p in zip(BASES, PRIMES, strict=True)]
            spans.append((row["conv_id"], r["range"], at, by[0], by[1], sums[0] << HALF | sums[1]))
            halves = (r["total"] >> HALF, r["total"] & ((1 << HALF) - 1))
            sums = [(s + m * x) % p for s, m, x, p in zip(sums, by, halves, PRIMES, strict=True)]
            at += r["n"]
    table_ = F.broadcast(spark.createDataFrame(spans, "conv_id long, range long, __n long, __by0 long, __by1 long, __plus long"))
    rows = found.join(table_, ["conv_id", "range"], "left")
    moved = lambda c: F.when(F.col("__n").isNull(), F.col(c)).otherwise(shifted(F.col(c), F.lit(0).cast("long"), [F.col("__by0"), F.col("__by1")], F.col("__plus"))).alias(c)
    return rows.select("conv_id", (F.col("place") + F.coalesce("__n", F.lit(0))).alias("at"), "digest", "words", moved("upto"), moved("before"))


def rebuilt(turns: DataFrame, work: Workspace, attempt: int = 0, hashed: Callable = hashes) -> DataFrame:
    """conv_id, d, digest, words, fp, pfp (of the prefixes with d and d - 1 turns), is_end; d = 0 for every conversation."""
    own = joined(scanned(turns, attempt, hashed), work, f"turns-{attempt}")
    head = F.when(F.col("at") < LEAD, F.struct("at", "digest", "words", "upto", "before"))
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("head"))
    convs = work.save(convs.withColumn("h", fold(F.col("conv_id"), LEAD)), f"convs-{attempt}")
    leaders = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("leader"), F.col("head").alias("lead"))
    zero = F.lit(0).cast("long")
    sum_at = lambda heads, n: F.coalesce(F.get(heads, (n - 1).cast("int"))["upto"], zero)
    made = convs.join(leaders, convs["conv_id"] - convs["conv_id"] % BLOCK == leaders["leader"], "left")
    made = made.withColumn("t", F.least("h", F.coalesce(F.size("lead"), F.lit(0))).cast("long"))
    # get() counts from 0, so index -1 of "none taken" gives null and the sum 0.
    made = made.select("conv_id", "h", "t", sum_at(F.col("lead"), F.col("t")).alias("plus"), sum_at(F.col("head"), F.least("h", "n")).alias("less"), (F.col("t") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"), F.slice("lead", F.lit(1), F.col("t").cast("int")).alias("lead"))
    made = work.save(made, f"made-{attempt}")
    led = made.select("conv_id", "length", F.explode("lead").alias("x")).select("conv_id", F.col("x.at").alias("d"), "x.digest", "x.words", F.col("x.upto").alias("fp"), F.col("x.before").alias("pfp"), (F.col("x.at") == F.col("length")).alias("is_end"))
    rest = own.filter(F.col("at") > fold(F.col("conv_id"), LEAD)).join(made.drop("lead"), "conv_id")
    steps = [[pow(b, -i, p) for i in range(LEAD)] for b, p in zip(BASES, PRIMES, strict=True)]
    by = [F.get(F.array(*map(F.lit, s)), (F.col("h") - F.col("t")).cast("int")).cast("long") for s in steps]
    move = lambda c: shifted(F.col(c), F.col("less"), by, F.col("plus"))
    d = F.col("at") - F.col("h") + F.col("t")
    rest = rest.select("conv_id", d.alias("d"), "digest", "words", move("upto").alias("fp"), move("before").alias("pfp"), (d == F.col("length")).alias("is_end"))
    roots = made.select("conv_id", zero.alias("d"), F.lit(b"").alias("digest"), zero.alias("words"), zero.alias("fp"), F.lit(None).cast("long").alias("pfp"), (F.col("length") == 0).alias("is_end"))
    return work.save(roots.unionByName(led).unionByName(rest), f"rebuilt-{attempt}")


def verified(turns: DataFrame, work: Workspace, hashed: Callable = hashes) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, key, pkey, digest, words, is_end) of all rebuilt turns, and the nodes d, key, pkey, conv_id, n_convs, words.

    Candidate groups are split until each last turn in one is its
    representative's; a key then stands for one prefix.
    """
    attempt = 0
    rows = rebuilt(turns, work, 0, hashed)
    rows = rows.select("conv_id", "d", F.col("fp").cast("string").alias("key"), F.col("pfp").cast("string").alias("pkey"), "digest", "words", "is_end")
    while True:
        nodes = rows.groupBy("d", "key", "pkey", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
        nodes = work.save(nodes, f"nodes-{attempt}")
        against = nodes.groupBy("d", "key").agg(F.count("*").alias("c"), F.min_by("digest", "conv_id").alias("right")).filter("c > 1").select("d", "key", "right")
        against = work.save(against, f"mixed-{attempt}")
        if against.isEmpty():
            return rows, nodes.drop("digest")
        attempt += 1
        wrong = rows.join(against, ["d", "key"]).filter("digest <> right").groupBy("conv_id").agg(F.min("d").alias("from"))
        split = rows.join(wrong, "conv_id").filter("d >= from").select("d", "key").distinct()
        split = work.save(split, f"split-{attempt}")
        fresh = rebuilt(turns, work, attempt, hashed).select("conv_id", "d", "fp", "pfp")
        own = split.withColumn("own", F.lit(True))
        parents = split.select((F.col("d") + 1).alias("d"), F.col("key").alias("pkey"), F.lit(True).alias("above"))
        more = lambda key, flag, fp: F.when(F.col(flag), F.concat_ws("-", key, F.col(fp).cast("string"))).otherwise(F.col(key)).alias(key)
        rows = rows.join(fresh, ["conv_id", "d"]).join(own, ["d", "key"], "left").join(parents, ["d", "pkey"], "left")
        rows = work.save(rows.select("conv_id", "d", more("key", "own", "fp"), more("pkey", "above", "pfp"), "digest", "words", "is_end"), f"rows-{attempt}")


def from_end(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """conv_id, d and, for each of ``sums``, its sum over the conversation's own nodes from depth d on.

    Stretches of a conversation are summed first, so no task orders all of it.
    """
    cut = nodes.select("conv_id", "d", *sums, F.shiftright("d", STRETCH_BITS).alias("stretch"))
    whole = cut.groupBy("conv_id", "stretch").agg(*(F.sum(c).alias(f"{c}_all") for c in sums))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch"))
    whole = whole.select("conv_id", "stretch", *((F.sum(f"{c}_all").over(later) - F.col(f"{c}_all")).alias(f"{c}_later") for c in sums))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("d"))
    run = cut.select("conv_id", "d", "stretch", *(F.sum(c).over(inside).alias(c) for c in sums))
    return run.join(whole, ["conv_id", "stretch"]).select("conv_id", "d", *((F.col(c) + F.col(f"{c}_later")).alias(c) for c in sums))


def ends(rows: DataFrame) -> DataFrame:
    """d, key, ends_sha256 of each node at which conversations end.

    Ids are joined to strings of at most ``2**IDS_BITS`` ids; a task feeds a
    node's strings, sorted, to one hash and keeps none of them.
    """
    ship(rows.sparkSession)
    block = F.shiftright("conv_id", IDS_BITS)
    texts = rows.filter("is_end").groupBy("d", "key", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for d, key, ids in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("d", "key", "ids")), strict=True):
                if node != (d, key):
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = (d, key), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield out(done)
        if node is not None:
            yield out([(*node, running.hexdigest())])

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["d", "key", "ends_sha256"])

    return texts.repartition("d", "key").sortWithinPartitions("d", "key", "block").mapInArrow(digest, "d long, key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hashed: Callable = hashes) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty; a null turn comes first, and turns of equal
    number are in the order of their SHA-256, so that repeated rows are turns of
    their own. A row without a conv_id is in no conversation. An empty table has
    no conversation, so no root either. Other columns are not looked at. Texts of
    any length are read once and not shuffled: their digest and word count are.
    """
    work = Workspace(conversations.sparkSession, "prefix-trie")
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    turns = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("digest"), token_count(text_).alias("words"))
    turns = work.save(turns.filter("conv_id is not null"), "turns")
    rows, nodes = verified(turns, work, hashed)
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pkey").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["d", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = work.save(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("leaf", (F.col("n_children") == 0).cast("long")).drop("words"), "nodes")
    # A conversation represents its prefixes from some depth on; above it, it passes nodes of lesser conversations.
    owners = nodes.groupBy("conv_id").agg(F.min("d").alias("first"), F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    passing = rows.select("conv_id", "d", "key").join(owners, "conv_id").filter("d < first").groupBy("d", "key").agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    own = from_end(nodes, ["saved", "leaf"]).withColumnsRenamed({"saved": "own_saved", "leaf": "own_leaves"})
    parents = nodes.select((F.col("d") + 1).alias("d"), F.col("key").alias("pkey"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(own, ["conv_id", "d"]).join(passing, ["d", "key"], "left").join(ends(rows), ["d", "key"], "left").join(parents, ["d", "pkey"], "left")
    none = hashlib.sha256(b"").hexdigest()
    with_more = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0).cast("long"))
    return found.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", with_more("own_leaves", "more_leaves").alias("n_leaves"), with_more("own_saved", "more_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH RECURSIVE step(b, k, v) AS (SELECT b, 0, b FROM range(256) r(b) UNION ALL SELECT b, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8),
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS leader, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM turns), tab),
parts AS (SELECT convs.c, 0 AS own, pos, role, text FROM convs JOIN turns ON turns.c = leader AND pos <= h
    UNION ALL SELECT convs.c, 1, pos, role, text FROM convs JOIN turns ON turns.c = convs.c AND pos > h),
made AS (SELECT c, row_number() OVER w AS d, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path FROM parts WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
rows_ AS (SELECT c, 0 AS d, '' AS text, '' AS path FROM convs UNION ALL SELECT c, d, text, path FROM made),
marked AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS is_end FROM rows_),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256,
    (count(*) - 1) * max(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS saved FROM marked GROUP BY d, path),
kids AS (SELECT d - 1 AS d, left(path, 64 * (CAST(d AS BIGINT) - 1)) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
flat AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON nodes.d = kids.d AND nodes.path = kids.path),
below AS (SELECT v.d, v.path, count(*) FILTER (u.n_children = 0) AS n_leaves, CAST(sum(u.saved) AS BIGINT) AS saved_tokens FROM flat v JOIN flat u ON u.d >= v.d AND starts_with(u.path, v.path) GROUP BY ALL)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM flat v JOIN below ON v.d = below.d AND v.path = below.path LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = left(v.path, 64 * (CAST(v.d AS BIGINT) - 1))
"""
