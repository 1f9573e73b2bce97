"""Exact Jaccard join of n-gram sets in metric space.

Jaccard distance is a metric, so distances to pivots bound distances between
documents. One thing of texts defeats Voronoi regions of the whole table: two
documents without a common n-gram are at distance 1 from each other and from
nearly every pivot, so the window around a region's border holds nearly all
documents (the README has figures). The join therefore has two parts.

1. A filter by signatures, which is no part of the metric method, divides the
   table into regions that no link leaves. By size, sets fall into classes; a
   class cuts the universe of n-grams into more parts than two linked sets of
   it can differ in n-grams, so linked sets agree in one part altogether, and
   meet there. Parts of one or two n-grams don't count; sets whose parts that
   agree could all be such meet in another cut, and after ``CUTS`` of them by
   their first n-grams, as in prefix filtering. Sets that meet, directly or through others, form a region.
2. Within a region, pivots are documents. All are measured against them, and
   links to pivots join components. A document goes to the Voronoi region of
   its nearest pivot and to each other one that the triangle inequality allows
   for a link (distance at most the nearest's plus twice the link's, and less
   than 1); documents that are so far from all pivots that a link may lead to
   one at distance 1 from them also share a region of their own. These regions
   join likewise until they are small; pairs that are in one component already
   need no comparison.

Regions above ``REGION`` sets, which bounds a task's memory, are divided in
rounds of distributed steps; smaller ones in one task. Regions that pivots do
not make smaller are compared in blocks, each pair of blocks in its own task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import mix, small_batches, table, texts
from lumenarc.llm.components import connected_components
from lumenarc.llm.line_dedup import bitmap, maybe_in
from lumenarc.runtime import Workspace

#: Cuts of the universe, each tried where the one before left a set too many thin parts. The n-grams that come last may be those of a passage that many documents share.
CUTS = 6
#: Ratio of the sizes at the ends of a size class.
CLASS_RATIO = 1.3
#: N-grams up to which a part can count as thin: so little in common says nothing.
THIN = 2
#: Sets of a region that one task holds.
REGION = 1024
#: Sets that are compared at all pairs.
LEAF = 8
#: In one task a pivot for so many sets of a region, at most so many pivots; pivots of a distributed step; steps.
SETS_PER_PIVOT, PIVOTS, WIDE_PIVOTS, STEPS = 8, 64, 32, 6
#: A region's parts are used only if the largest has at most this share of its sets, and all together at most this multiple: else recursion would cost more than pairs.
SHRINK, SPREAD = 0.8, 1.5
#: Sets below this size carry a profile.
PROFILED = 256
#: Sets of one cell up to which its pairs are told apart by size and profile; larger cells stay whole.
CELL = 4096
#: Sets that may share a signature in one task and all be passed on; of more, one goes for all.
LOCAL = 64
#: Signatures one task holds before it combines and passes them on.
HOLD = 2_000_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words; all words as one run if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        return mix(np.array([np.bitwise_xor.reduce(mix(h * FACTORS[: len(h)])) + np.uint64(len(h))], np.uint64))
    runs = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        runs += h[i : len(h) - k + 1 + i] * FACTORS[i]
    return np.unique(mix(runs))


def set_key(shingle_set: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


class Classes:
    """Size classes for a threshold, and the signatures by which sets of a class meet."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.bounds = [1]

    def bound(self, c: int) -> int:
        """The least size in class c."""
        while len(self.bounds) <= c:
            last = self.bounds[-1]
            self.bounds.append(max(last + 1, int(last * CLASS_RATIO)))
        return self.bounds[c]

    def of(self, size: int) -> list[int]:
        """A set's own class, and the next if a linked set could be in it."""
        c = 0
        while self.bound(c + 1) <= size:
            c += 1
        return [c, c + 1] if size >= self.threshold * self.bound(c + 1) else [c]

    def parts(self, c: int) -> tuple[int, int]:
        """The most n-grams in which linked sets of the class differ, and into how many parts it cuts."""
        t = self.threshold
        differ = int((1 - t) / (1 + t) * 2 * (self.bound(c + 1) - 1))
        return differ, differ + 1 + -(-differ // 4)

    def thin(self, c: int) -> int:
        """Up to how many n-grams a part of the class is thin: as many as leave enough other parts to the largest sets."""
        differ, m = self.parts(c)
        mean = (self.bound(c + 1) - 1) / m
        share, term, found = 0.0, math.exp(-mean), 0
        for k in range(THIN + 1):
            share += term
            term *= mean / (k + 1)
            if share <= 0.8 * (m - differ) / m:
                found = k
        return found

    def signatures(self, s: np.ndarray) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for c in self.of(s.size):
            differ, m = self.parts(c)
            if not differ:
                continue  # only equal sets are linked, and those have one key
            own, each = min(differ, int((1 - self.threshold) / self.threshold * s.size)), mix(s + np.uint64(0x9E37))
            for cut in range(CUTS):
                at = (((mix(s + np.uint64(cut)) if cut else s) >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
                sums, some = np.zeros(m, np.uint64), np.bincount(at, minlength=m) > self.thin(c)
                np.add.at(sums, at, each)
                part = np.arange(m, dtype=np.uint64) + np.uint64((c << 40) + (cut << 48))
                found.append(mix(sums + mix(part + np.uint64(1)))[some])
                if m - int(some.sum()) < m - own:
                    break
                # All parts that agree could be thin ones: two such sets meet in the next cut, or after the last by the first n-grams.
            else:
                first = s[: s.size - -(-self.threshold.numerator * s.size // self.threshold.denominator) + 1]
                found.append(mix(first ^ mix(np.array([(c << 40) + (1 << 39)], np.uint64))))
        return np.concatenate(found)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """common / (a + b - common) >= t, in integers."""
    return common * t.denominator >= t.numerator * (a + b - common)


def profile(s: np.ndarray) -> int:
    """Distances to 16 pivots: how many n-grams lie in each sixteenth of the universe, 15 at most, in 4 bits each.

    The sum of two profiles' differences is at most the sets' own difference.
    Large sets hardly meet by chance and have none (-1).
    """
    if s.size >= PROFILED:
        return -1
    n = np.minimum(np.bincount((s & np.uint64(15)).astype(np.int64), minlength=16), 15).astype(np.uint64)
    return int(np.bitwise_or.reduce(n << (np.arange(16, dtype=np.uint64) * np.uint64(4))).view(np.int64))


def may_link(pa_: np.ndarray, na: np.ndarray, pb: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sizes and profiles allow a link; exact bounds, so no link is lost."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    fits = small * t.denominator >= large * t.numerator
    x, y = pa_.astype(np.int64).view(np.uint64), pb.astype(np.int64).view(np.uint64)
    apart = np.zeros(np.broadcast(x, y).shape, np.int64)
    for k in range(16):
        shift = np.uint64(4 * k)
        apart += np.abs(((x >> shift) & np.uint64(15)).astype(np.int64) - ((y >> shift) & np.uint64(15)).astype(np.int64))
    bound = (t.denominator - t.numerator) * (na + nb) // (t.denominator + t.numerator)
    return fits & ((apart <= bound) | (pa_ == -1) | (pb == -1))


class Forest:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def single(self, members: np.ndarray) -> bool:
        first = self.find(int(members[0]))
        return all(self.find(int(i)) == first for i in members)


def windows(far: np.ndarray, reach: float) -> np.ndarray:
    """Which members (columns) belong to each pivot's region (rows) and, in a last row, to the one beyond all pivots.

    If o is linked to q and o's nearest pivot is at less than 1 - reach, the
    triangle inequality puts q at most twice the reach beyond its own nearest
    from that pivot, and below 1; so both are in its region. Otherwise both are
    that far from all pivots, and in the last row.
    """
    nearest = far.min(0)
    near = (far <= nearest + 2 * reach + 1e-9) & (far < 1)
    return np.vstack([near, nearest >= 1 - reach - 1e-9])


class Region:
    """Sets of one region; ``join`` links what is near, directly or through others."""

    def __init__(self, sets: list[np.ndarray], threshold: Fraction):
        self.sets, self.t = sets, threshold
        self.sizes = np.array([s.size for s in sets], np.int64)
        self.forest = Forest(len(sets))

    def common(self, pivots: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections, pivots by members, exact."""
        flat = np.concatenate([self.sets[i] for i in members])
        ends = np.concatenate([[0], np.cumsum(self.sizes[members])])[:-1]
        out = np.empty((len(pivots), len(members)), np.int64)
        for k, p in enumerate(pivots):
            own = self.sets[p]
            at = np.minimum(np.searchsorted(own, flat), own.size - 1)
            out[k] = np.add.reduceat((own[at] == flat).astype(np.int64), ends)
        return out

    def measure(self, pivots: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Joins what is linked to a pivot and returns the distances."""
        n = self.common(pivots, members)
        a, b = self.sizes[pivots][:, None], self.sizes[members][None]
        for k, j in zip(*np.nonzero(linked(n, a, b, self.t)), strict=True):
            self.forest.join(int(pivots[k]), int(members[j]))
        return 1 - n / (a + b - n)

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) < 2 or self.forest.single(members):
            return
        if len(members) <= LEAF or depth > 12:
            return self.pairs(members)
        rng = np.random.default_rng(len(members) + depth)
        pivots = rng.choice(members, min(PIVOTS, max(2, len(members) // SETS_PER_PIVOT)), replace=False)
        far = self.measure(pivots, members)
        if self.forest.single(members):
            return None
        cells = [members[own] for own in windows(far, float(1 - self.t))]
        if max(map(len, cells)) > SHRINK * len(members) or sum(map(len, cells)) > SPREAD * len(members):
            return self.pairs(members)
        for cell in cells:
            self.join(cell, depth + 1)
        return None

    def pairs(self, members: np.ndarray) -> None:
        """Each in turn against the later ones that are in other components and near enough in size."""
        order = members[np.argsort(self.sizes[members], kind="stable")]
        sizes = self.sizes[order]
        for i in range(len(order) - 1):
            end = np.searchsorted(sizes, int(sizes[i] * self.t.denominator // self.t.numerator), side="right")
            root = self.forest.find(int(order[i]))
            rest = np.array([j for j in order[i + 1 : end] if self.forest.find(int(j)) != root], np.int64)
            if rest.size:
                self.measure(order[i : i + 1], rest)


def near_duplicates(docs: DataFrame, words: int, threshold: Fraction, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), one row per row.

    A text without words (or null) has an empty set and is linked with nothing:
    its component is its own id. Equal sets are linked. Rows that share an id
    stay apart; a null id takes part beside rows with one; sets that only rows without id have are linked with nothing.
    """
    spark = docs.sparkSession
    small_batches(spark, 512)
    work = Workspace(spark, "jaccard-join")
    num, den = threshold.numerator, threshold.denominator
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Documents: set key (null without words), id, size >= 0. Edges: set, set, -2. Signatures: signature, set, -10 - size, profile.
    names = ["key", "other", "n", "profile"]
    schema = "key long, other long, n int, profile long"

    def arrow(key, other, n, profiles=None) -> pa.RecordBatch:
        last = pa.nulls(len(n), pa.int64()) if profiles is None else pa.array(profiles, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int32()), last], names)

    def edges_of(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if a.size:
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield arrow(pairs[:, 0], pairs[:, 1], np.full(len(pairs), -2, np.int32))

    def met(keys: np.ndarray, rows: np.ndarray, owners: np.ndarray, sizes: np.ndarray, profiles: np.ndarray) -> Iterator[pa.RecordBatch]:
        """This task's signatures. Where more than LOCAL of its sets share one, a chain of edges joins them and one goes on."""
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(start, keys.size))
        crowded = np.repeat(count > LOCAL, count)
        first = np.zeros(keys.size, bool)
        first[start] = True
        link = crowded & ~first
        at = np.flatnonzero(link)
        yield from edges_of(owners[rows[at - 1]], owners[rows[at]])
        keys, rows = keys[~link], rows[~link]
        for i in range(0, keys.size, 100_000):
            r = rows[i : i + 100_000]
            yield arrow(keys[i : i + 100_000], owners[r], -10 - sizes[r], profiles[r])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen, held, owners, size = Classes(Fraction(num, den)), set(), [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            o = np.array(owners, np.int64).reshape(-1, 3)
            rows = np.repeat(np.arange(len(held)), [x.size for x in held])
            yield from met(np.concatenate(held), rows, o[:, 0], o[:, 1].astype(np.int32), o[:, 2])

        for batch in batches:
            ids, keys, ns = batch.column(0), [], []
            for body in texts(batch):
                s = shingles(body, words)
                key = set_key(s) if s.size else None
                keys.append(key), ns.append(s.size)
                if s.size and key not in seen:
                    seen.add(key)
                    held.append(classes.signatures(s).view(np.int64))
                    owners.append((key, s.size, profile(s)))
                    size += held[-1].size
            yield arrow(keys, ids, ns)
            if size > HOLD:
                yield from out()
                held, owners, size = [], [], 0
        if size:
            yield from out()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key: documents and edges as they are; edges that join what may link in each cell."""
        t = Fraction(num, den)

        def cells(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            keys, sets, ns, profiles = rows
            sizes = (-10 - ns).astype(np.int64)
            same = np.flatnonzero(keys[1:] == keys[:-1])
            if not same.size:
                return
            ok = may_link(profiles[same], sizes[same], profiles[same + 1], sizes[same + 1], t)
            a, b = [sets[same[ok]]], [sets[same[ok] + 1]]
            # Cells where neighbours may not link: all pairs, until one component is left.
            for key in np.unique(keys[same[~ok]]):
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                if hi - lo == 2:
                    continue
                if hi - lo > CELL:
                    a.append(sets[lo : hi - 1]), b.append(sets[lo + 1 : hi])
                    continue
                forest = Forest(hi - lo)
                for i in np.flatnonzero(may_link(profiles[lo : hi - 1], sizes[lo : hi - 1], profiles[lo + 1 : hi], sizes[lo + 1 : hi], t)):
                    forest.join(int(i), int(i) + 1)
                left = len({forest.find(i) for i in range(hi - lo)})
                for i in range(hi - lo - 2):
                    if left == 1:
                        break
                    fits = may_link(profiles[lo + i], sizes[lo + i], profiles[lo + i + 2 : hi], sizes[lo + i + 2 : hi], t)
                    for j in np.flatnonzero(fits) + i + 2:
                        if forest.find(i) != forest.find(int(j)):
                            forest.join(i, int(j))
                            left -= 1
                            a.append(sets[lo + i : lo + i + 1]), b.append(sets[lo + j : lo + j + 1])
            yield from edges_of(np.concatenate(a), np.concatenate(b))

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            n = batch.column(2).to_numpy()
            mine = n <= -10
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            if not mine.any():
                continue
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.filter(pa.array(mine)).columns)
            # All but the last cell, which may go on in the next batch.
            keys = rows[0]
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                held.append(tuple(c[:cut] for c in rows))
                yield from cells(tuple(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            held.append(tuple(c[cut:] for c in rows))
        if held:
            yield from cells(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    signed = given.mapInArrow(sign, schema)
    # Documents without a set, and copies, spread by id; all that share a signature meet.
    spread = F.when(F.col("n") <= -10, F.col("key")).otherwise(F.xxhash64("key", "other"))
    wide = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    met_rows = signed.repartition(spread).sortWithinPartitions("key", F.desc("n"), "other").mapInArrow(chain, schema)
    graph = work.save(met_rows, "graph")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", wide)
    documents = graph.filter("n >= 0").select(F.col("other").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "key")
    edges = graph.filter("n = -2").select(F.col("key").alias("a"), F.col("other").alias("b"))
    regions = connected_components(edges, work, "regions")
    sets = work.save(documents.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("size")), "sets")
    live = work.save(regions.join(sets.filter("least is not null"), F.col("node") == F.col("key")).select("key", F.col("component").alias("region"), "least"), "live")
    links = links_of(given, live, words, threshold, work)
    joined = connected_components(links, work, "links")
    of_set = sets.join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"), "least")
    least = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_set.select("key", "component").join(least, "component").select(F.col("key").alias("set_key"), "component_id")
    empty = documents.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return documents.filter("key is not null").join(named, F.col("key") == F.col("set_key")).select("doc_id", "n_shingles", "component_id").unionByName(empty)


def links_of(given: DataFrame, live: DataFrame, words: int, threshold: Fraction, work: Workspace) -> DataFrame:
    """Edges (a, b) of set keys that connect what exact links connect, region by region.

    A region of at most ``REGION`` sets goes to one task. A larger one is
    divided by ``divide`` until all parts are small, or of one component, or
    go to ``blocks``.
    """
    spark = given.sparkSession
    num, den = threshold.numerator, threshold.denominator
    placed = live.select("key", "region", F.col("least").alias("id"))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-gram sets of the region's documents; rows that share an id but not the set are left out."""
        for batch in batches:
            keep, out = [], []
            for i, (key, body) in enumerate(zip(batch.column(0).to_pylist(), texts(batch), strict=True)):
                s = shingles(body, words)
                if s.size and set_key(s) == key:
                    keep.append(i), out.append(s.tobytes())
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], ["key", "unit", "grams"])

    # The bitmap only spares texts the shuffle; the join is exact.
    wanted = maybe_in(given, "doc_id", bitmap(live.select("least"), "least"))
    brought = wanted.join(placed, F.col("doc_id") == F.col("id")).select("key", F.col("region").cast("string").alias("region"), "text").mapInArrow(bring, "key long, unit string, grams binary")
    # Rows that repeat an id and its text come twice; what groups them leaves one.
    now = work.save(brought, "grams").withColumn("component", F.lit(None).cast("long"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by unit: joins each unit's sets and returns a forest of links."""
        unit, keys, sets, known = None, [], [], []

        def out() -> pa.RecordBatch:
            region = Region(sets, Fraction(num, den))
            first: dict[int, int] = {}
            for i, c in enumerate(known):  # what other units joined already
                if c is not None:
                    region.forest.join(first.setdefault(c, i), i)
            region.join(np.arange(len(sets)))
            pairs = [(keys[i], keys[r]) for i in range(len(keys)) if (r := region.forest.find(i)) != i]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for u, key, grams, component in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if u != unit:
                    if len(sets) > 1:
                        yield out()
                    unit, keys, sets, known = u, [], [], []
                elif key == keys[-1]:
                    continue
                keys.append(key), sets.append(np.frombuffer(grams, np.uint64)), known.append(component)
        if len(sets) > 1:
            yield out()

    def joined(units: DataFrame) -> DataFrame:
        return units.select("unit", "key", "grams", "component").repartition("unit").sortWithinPartitions("unit", "key").mapInArrow(solve, "a long, b long")

    found = None
    now = now.withColumn("stuck", F.lit(False))
    for step in range(STEPS + 1):
        sizes = work.save(now.select("unit", "key").distinct().groupBy("unit").agg(F.count("*").alias("members")), f"sizes-{step}")
        largest = sizes.agg(F.max("members")).first()[0] or 0
        sized = now.join(sizes, "unit")
        links = joined(sized.filter(F.col("members") <= REGION))
        if largest > REGION:
            large = sized.filter(F.col("members") > REGION)
            large = large if step else large.dropDuplicates(["unit", "key"])
            stuck = F.col("stuck") if step < STEPS else F.lit(True)
            links = links.unionByName(joined(blocks(large.filter(stuck))))
            divided = work.save(divide(large.filter(~stuck), threshold, step), f"divided-{step}")
            links = links.unionByName(divided.filter("cell = -1").select(F.col("key").alias("a"), F.col("other").alias("b")))
        found = work.save(links if found is None else links.unionByName(found), f"near-{step}")
        if largest <= REGION or step == STEPS:
            return found
        # Units whose parts overlap too much, or one of which is hardly smaller, go on as they are, to blocks.
        parts = divided.filter("cell >= 0").groupBy("unit", "cell").agg(F.count("*").alias("n"), F.max("members").alias("members"))
        wide = parts.groupBy("unit").agg(((F.sum("n") > SPREAD * F.max("members")) | (F.max("n") > SHRINK * F.max("members"))).alias("wide"))
        cells = divided.filter("cell >= 0").join(wide, "unit").select("unit", "key", F.when(F.col("wide"), 0).otherwise(F.col("cell")).alias("cell"), "wide").distinct()
        labels = connected_components(found, work, f"near-cc-{step}").withColumnRenamed("node", "key")
        held = large.filter(~stuck).select("unit", "key", "grams").join(cells, ["unit", "key"]).join(labels, "key", "left")
        held = held.select(F.concat_ws("/", "unit", "cell").alias("unit"), "key", "grams", F.coalesce("component", "key").alias("component"), F.col("wide").alias("stuck"))
        # Parts of one component need no further comparison.
        open_ = held.groupBy("unit").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("unit")
        now = work.save(held.join(open_, "unit", "left_semi"), f"parts-{step}")
    raise AssertionError("the last step returns")


def divide(large: DataFrame, threshold: Fraction, step: int) -> DataFrame:
    """One step of Voronoi regions of units too large for a task.

    Rows unit, cell >= 0, key, members (the unit's size): a set and a region it
    belongs to; rows with cell -1, key, other: links to pivots. The sets of a unit are measured in parts of ``REGION``, each beside a copy of
    the unit's ``WIDE_PIVOTS`` pivots.
    """
    draw = F.xxhash64(F.lit(31 + step), "key")
    few = large.filter(F.shiftrightunsigned(draw, 33) < F.lit(4.0 * WIDE_PIVOTS * (1 << 31)) / F.col("members"))
    place = F.row_number().over(Window.partitionBy("unit").orderBy(draw))
    ways = F.ceil(F.col("members") / REGION).cast("int")
    pivots = few.withColumn("place", place).filter(F.col("place") <= WIDE_PIVOTS).withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    members = large.withColumn("way", F.pmod(F.xxhash64(F.lit(29), "key"), ways).cast("int")).withColumn("place", F.lit(0))
    columns = ["unit", "way", F.col("place") == 0, "key", "grams", "members"]
    rows = pivots.select(*columns).toDF("unit", "way", "member", "key", "grams", "members").unionByName(members.select(*columns).toDF("unit", "way", "member", "key", "grams", "members"))
    reach, t = float(1 - threshold), threshold
    names = ["unit", "cell", "key", "members", "other"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, sets, held = None, [], [], []

        def out() -> pa.RecordBatch:
            region = Region(sets + [np.frombuffer(g, np.uint64) for _, g, _ in held], t)
            mine = np.arange(len(sets), len(sets) + len(held))
            n = region.common(np.arange(len(sets)), mine)
            a, b = region.sizes[: len(sets)][:, None], region.sizes[mine][None]
            rows = [(at[0], -1, held[j][0], None, keys[k]) for k, j in zip(*np.nonzero(linked(n, a, b, t)), strict=True) if held[j][0] != keys[k]]
            rows += [(at[0], int(c), held[j][0], held[j][2], None) for c, j in zip(*np.nonzero(windows(1 - n / (a + b - n), reach)), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for unit, way, member, key, grams, members in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (unit, way) != at:
                    if held:
                        yield out()
                    at, keys, sets = (unit, way), [], []
                if member:
                    held.append((key, grams, members))
                    if len(held) == 256:
                        yield out()
                else:
                    keys.append(key), sets.append(np.frombuffer(grams, np.uint64))
        if held:
            yield out()

    dealt = rows.repartition("unit", "way").sortWithinPartitions("unit", "way", "member", "key")
    return dealt.mapInArrow(measure, "unit string, cell int, key long, members long, other long")


def blocks(large: DataFrame) -> DataFrame:
    """Units that pivots don't make smaller, as units of at most REGION sets: each pair of blocks meets, but for pairs inside the largest component."""
    half = REGION // 2
    named = large.withColumn("component", F.coalesce("component", "key"))
    main = named.groupBy("unit", "component").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    named = named.join(main, "unit").withColumn("rest", F.col("component") != F.col("main"))
    counts = named.groupBy("unit").agg(F.ceil(F.count_if("rest") / half).cast("int").alias("outer"), F.ceil(F.count("*") / half).cast("int").alias("all"))
    named = named.join(counts.filter(F.col("outer") > 0), "unit")
    own = lambda n: F.pmod(F.xxhash64(F.lit(37), "key"), F.col(n)).cast("int")
    unit = F.concat_ws("/", "unit", "x", "y")
    ones = named.withColumn("x", own("all")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)))
    others = named.filter("rest").withColumn("y", own("outer")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).filter(F.col("x") != own("all"))  # where it isn't yet
    columns = [unit.alias("unit"), "key", "grams", "component"]
    return ones.select(*columns).unionByName(others.select(*columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), 4, Fraction(85, 100))
