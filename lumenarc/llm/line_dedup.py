"""Fuzzy line dedup: MinHash, banding, exact Jaccard, distributed union-find.

1. Every line is a set of shingles, its runs of ``SHINGLE`` characters, from
   all of the line. Lines up to ``WHOLE`` characters are signed by all
   shingles; longer ones by the third of them that a hash selects, and from
   ``LONG`` characters on by a quarter of that (and always by the first).
   Lengths between two levels are signed at both, and lines of so few
   different shingles that a selection leaves little of them also whole.
   Equal lines are combined before the shuffle.
2. Bands of ``ROWS`` minima each let lines meet. All lines of a cell are paired
   with its least line, then those outside the cell's largest component with
   ``DRAWN`` lines of it. What is still unlike is paired, all at once if that is
   at most ``CELL`` pairs a line or few pairs in all; in other cells all are
   paired with one more line outside the largest component, until few are left
   or ``ROUNDS`` rounds are over, and then all with each other. So no pair of a
   cell goes unjudged unless both are in one component already. Two filters
   judge pairs where they meet, before a text is fetched: four bits of each
   minimum must allow ``AGREE`` equal ones; and, after the least lines, shingles
   are counted mod 2 in ``64 * WORDS`` slots, so that a slot in which two lines
   differ is a shingle that only one has: what has too many of those is unlike
   without error. No pair is compared twice.
3. Pairs are kept if the exact Jaccard similarity of their lines, as sets of
   all shingles, is at least the threshold.
4. Components of the kept pairs, and equal lines, keep their first line: the
   one with the least document id, then the least place.

Two bitmaps of a fixed largest size (``BITMAP_BITS``) are broadcast, so that
texts which need no comparison or change are not shuffled. They only save
work; the joins behind them are exact.

Native: DataFrame functions only. Lines are told apart by a 64-bit hash.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import aside, table
from lumenarc.llm.components import connected_components
from lumenarc.runtime import Workspace

SHINGLE = 5
#: Every minimum is in three bands: at Jaccard 0.8 a pair shares one of them in about 99 of 100 cases.
MINIMA, BANDS, ROWS = 30, 18, 5
#: Equal minima, of MINIMA, that a pair's sketches must allow for it to be compared: about one in 2,000 pairs as alike as the threshold.
AGREE = 16
#: Up to WHOLE characters lines are signed whole, from PART to LESS by a part of their shingles, from LONG on by a quarter of that part.
PART, WHOLE, LONG, LESS = 160, 200, 640, 800
#: Of how many shingles one is selected, by its hash, at each level.
SHARES = (1, 3, 12)
#: Lines signed by a selection of fewer different shingles (counted in 64 bits) are also signed whole.
FEW = 24
#: Lines of a cell outside its largest component up to which all unlike ones are paired at once.
CELL = 1024
#: Lines of a cell's largest component that the others of the cell meet before all unlike ones are paired.
DRAWN = 4
#: Longs of a line's parities.
WORDS = 16
#: All uncompared pairs of different components are made at once if they are at most so many per line and cell, or after so many rounds.
OPEN_PAIRS, ROUNDS = 4, 8
THRESHOLD = 0.8
BITMAP_BITS = 1 << 24


def grams(line: Column) -> Column:
    """The hashes of all runs of SHINGLE characters; none of a shorter line, which only equals the same line."""
    size = 4 * SHINGLE

    def of(wide: Column) -> Column:
        last = F.octet_length(wide) - size
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1, F.lit(4)), lambda at: F.xxhash64(F.substring(wide, at, F.lit(size))))).otherwise(F.array().cast("array<bigint>"))

    # Inside a transform, so that the line is encoded once and not for every run.
    return F.transform(F.array(F.encode(line, "UTF-32")), of)[0]


def salts() -> list[tuple[int, int]]:
    """A 31-bit number and an odd one per minimum; an exclusive or with the first and a product with the second (mod 2**31) permute hashes."""
    draws = (hashlib.sha256(b"minimum %d" % k).digest() for k in range(MINIMA))
    return [(int.from_bytes(d[:4], "little") >> 1, int.from_bytes(d[4:8], "little") >> 1 | 1) for d in draws]


def band_rows() -> list[list[int]]:
    """The minima of each band: three orders of all minima, cut into runs of ROWS."""
    orders = (sorted(range(MINIMA), key=lambda k: hashlib.sha256(b"order %d %d" % (o, k)).digest()) for o in range(3))
    return [order[i : i + ROWS] for order in orders for i in range(0, MINIMA, ROWS)][:BANDS]


def shingled(lines: DataFrame, levels: Column) -> DataFrame:
    """lh, level, at, x: a row per line, level of the array ``levels`` and chosen shingle (by its hash x); at is 0 in exactly one of them.

    A line's first shingle is always chosen; a line without one has a row with a null ``x``.
    """
    # Four bytes for every character: a shingle is then cut out by its place, not by a walk along the line.
    wide = lines.select("lh", F.encode("line", "UTF-32").alias("wide"), F.explode(levels).alias("level"))
    last = F.octet_length("wide") - 4 * SHINGLE
    places = wide.select("lh", "level", "wide", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(4)))).alias("at"))
    # No condition in what makes the hash: it is then computed once, not for each minimum.
    x = F.xxhash64(F.substring("wide", F.col("at") + 1, F.lit(4 * SHINGLE)))
    hashed = places.select("lh", "level", F.coalesce("at", F.lit(0)).alias("at"), F.col("at").isNotNull().alias("any"), x.alias("x"))
    share = F.when(F.col("level") == 0, 1).when(F.col("level") == 1, SHARES[1]).otherwise(SHARES[2])
    return hashed.filter((F.col("at") == 0) | (F.col("x").bitwiseAND(F.lit((1 << 32) - 1)) % share == 0))


def signed_at(lines: DataFrame, levels: Column) -> DataFrame:
    """lh, level, uses, seen (64 bits that count different shingles) and the minima, null for lines without a shingle."""
    y = F.shiftrightunsigned("x", 33)
    minima = [F.min((y.bitwiseXOR(F.lit(s)) * F.lit(m)).bitwiseAND(F.lit((1 << 31) - 1))).alias(f"m{k}") for k, (s, m) in enumerate(salts())]
    seen = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), y.bitwiseAND(F.lit(63)).cast("int")))
    found = shingled(lines, levels).groupBy("lh", "level").agg(F.sum((F.col("at") == 0).cast("long")).alias("uses"), F.max("any").alias("any"), seen.alias("seen"), *minima)
    return found.select("lh", "level", "uses", F.when(F.col("any"), F.col("seen")).alias("seen"), *(F.when(F.col("any"), F.col(f"m{k}").cast("int")).alias(f"m{k}") for k in range(MINIMA)))


def signatures(lines: DataFrame, work: Workspace) -> DataFrame:
    """The signatures of all lines: level 0 by all shingles, 1 and 2 by a selection."""
    n = F.length("line")
    levels = F.array_compact(F.array(F.when(n <= WHOLE, 0), F.when(n.between(PART, LESS), 1), F.when(n >= LONG, 2)))
    signed = work.save(signed_at(lines, levels), "signatures")
    of = signed.groupBy("lh").agg(F.min("level").alias("level"), F.bool_or((F.col("level") > 0) & (F.coalesce(F.bit_count("seen"), F.lit(0)) < FEW)).alias("few"))
    few = work.save(of.filter("level > 0 and few").select("lh"), "few")
    if few.isEmpty():
        return signed
    again = maybe_in(lines.filter(n > WHOLE).select("lh", "line"), "lh", bitmap(few, "lh")).join(few, "lh", "left_semi")
    return signed.unionByName(work.save(signed_at(again, F.array(F.lit(0))), "signatures-few"))


def bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A one-hash Bloom filter of a long column as rows (word, bits): at most BITMAP_BITS / 64 rows."""
    bits = min(BITMAP_BITS, max(1 << 12, 1 << (16 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(F.lit(41), key), F.lit(bits))
    rows = keys.select(F.floor(slot / 64).cast("int").alias("__word"), (slot % 64).cast("int").alias("b"))
    one = F.expr("shiftleft(1L, b)")
    return rows.groupBy("__word").agg(F.bit_or(one).alias("__bits")), bits


def maybe_in(df: DataFrame, key: str, filter_: tuple[DataFrame, int], negate: bool = False) -> DataFrame:
    """Rows whose key may be in the filter (or, negated, is surely not)."""
    rows, bits = filter_
    slot = F.pmod(F.xxhash64(F.lit(41), F.col(key)), F.lit(bits))
    # At most BITMAP_BITS / 64 rows of two numbers.
    with_bits = df.withColumn("__slot", slot).withColumn("__word", F.floor(F.col("__slot") / 64).cast("int")).join(F.broadcast(rows), "__word", "left")
    hit = F.coalesce(F.expr("(__bits & shiftleft(1L, cast(__slot % 64 as int))) <> 0"), F.lit(False))
    return with_bits.filter(~hit if negate else hit).drop("__slot", "__word", "__bits")


def lines_of(rows: DataFrame) -> DataFrame:
    """rk, doc_id, pos, line, lh of the lines that count: those that are not blank."""
    split = rows.select("__rk", "__id", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    return split.filter(F.col("line").rlike(r"\S")).withColumn("lh", F.xxhash64("line"))


def sketch() -> list[Column]:
    """Two numbers with four bits of each minimum."""
    nibble = lambda k, at: F.shiftleft(F.shiftright(F.col(f"m{k}"), 3).bitwiseAND(F.lit(15)).cast("long"), 4 * at)
    half = MINIMA // 2
    return [functools.reduce(Column.bitwiseOR, (nibble(k, k - first) for k in range(first, first + half))).alias(f"s{i}") for i, first in enumerate((0, half))]


def may_agree() -> Column:
    """Whether the sketches s and t allow AGREE equal minima: equal minima have equal bits, so no pair that agrees is lost."""
    differ = F.lit(0)
    for i in range(2):
        x = F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x0111_1111_1111_1111))
        differ = differ + F.bit_count(x)
    return differ <= MINIMA - AGREE


def parities(texts: DataFrame) -> DataFrame:
    """lh, n and p0 to p15 of texts(lh, line): the number of a line's different shingles, and of those in each slot whether it is odd."""
    # Named before its use, so that it is made once.
    sets = texts.select("lh", grams(F.col("line")).alias("g")).select("lh", F.explode(F.array_distinct("g")).alias("x"))
    slot = F.col("x").bitwiseAND(F.lit(63)).cast("int")
    bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), slot), F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1))
    odd = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")).alias(f"p{k}") for k in range(WORDS)]
    return sets.groupBy("lh").agg(F.count("*").alias("n"), *odd)


def may_be_alike(threshold: float) -> Column:
    """Whether the parities p and q allow the threshold: sets of n and u shingles with it differ in at most (1 - t) / (1 + t) of n + u."""
    differ = functools.reduce(Column.__add__, (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"q{k}"))) for k in range(WORDS)))
    return differ <= (F.col("n") + F.col("u")) * ((1 - threshold) / (1 + threshold)) + 1e-6


def agreeing(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
    """Different a < b of pairs(lh, other) that are in none of the tables ``done``."""
    found = pairs.select(F.least("lh", "other").alias("a"), F.greatest("lh", "other").alias("b")).distinct()
    for before in done:
        found = found.join(before, ["a", "b"], "left_anti")
    return found


def alike(pairs: DataFrame, lines: DataFrame, work: Workspace, threshold: float, done: list[DataFrame]) -> DataFrame:
    """The a, b of pairs(lh, other) whose lines have at least the threshold; what is compared is added to ``done``, and was not if it is there."""
    step = len(done)
    pairs = work.save(agreeing(pairs, done), f"pairs-{step}")
    done.append(pairs)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("lh")).distinct()
    nodes = work.save(nodes, f"nodes-{step}")
    some = maybe_in(lines.select("lh", "line"), "lh", bitmap(nodes, "lh")).distinct()
    text = work.save(some.join(nodes, "lh", "left_semi"), f"texts-{step}")
    both = pairs.join(text.select(F.col("lh").alias("a"), F.col("line").alias("la")), "a").join(text.select(F.col("lh").alias("b"), F.col("line").alias("lb")), "b")
    # Each array is named before its several uses, so that it is made once.
    sets = both.select("a", "b", grams(F.col("la")).alias("ga"), grams(F.col("lb")).alias("gb"))
    common = sets.select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("n"), F.size(F.array_union("ga", "gb")).alias("all"))
    kept = work.save(common.filter(F.col("n") >= threshold * F.col("all")).select("a", "b"), f"kept-{step}")
    for name in ("nodes", "texts"):
        work.drop(f"{name}-{step}")
    return kept


def linked(signed: DataFrame, lines: DataFrame, work: Workspace, threshold: float) -> DataFrame:
    """node, component of the lines linked by similar pairs of a cell."""
    bands = F.array(*(F.xxhash64(F.lit(j), "level", *(f"m{k}" for k in own)) for j, own in enumerate(band_rows())))
    banded = signed.filter("m0 IS NOT NULL").select("lh", *sketch(), F.explode(bands).alias("band"))
    cells = banded.groupBy("band").agg(F.count("*").alias("size"), F.min("lh").alias("low")).filter("size > 1").select("band", "low")
    cells = work.save(cells, "cells")
    met = work.save(maybe_in(banded, "band", bitmap(cells, "band")).join(cells, "band"), "met")
    # All lines of a cell meet its least one, which then leaves. What met by chance is told by the sketches before it is shuffled.
    least = met.filter("lh = low").select("band", *(F.col(f"s{i}").alias(f"t{i}") for i in range(2)))
    pairs = met.filter("lh <> low").join(least, "band").filter(may_agree()).select("lh", F.col("low").alias("other"))
    done: list[DataFrame] = []
    components = connected_components(alike(pairs, lines, work, threshold, done), work, "lines-0")
    rest = met.filter("lh <> low").select("band", "lh", "s0", "s1")
    size = rest.count()
    own = ["lh", "c", "s0", "s1", "n", *(f"p{k}" for k in range(WORDS))]
    other = ["other", "d", "t0", "t1", "u", *(f"q{k}" for k in range(WORDS))]
    for step in range(ROUNDS + 1):
        named = rest.join(components.withColumnRenamed("node", "lh"), "lh", "left").withColumn("c", F.coalesce("component", "lh")).drop("component")
        named = work.save(named, f"named-{step}")
        for name in ("met", "cells") if not step else ("marked",) if step == 1 else (f"named-{step - 1}",):
            work.drop(name)
        n = F.col("n").cast("double")
        sizes = named.groupBy("band", "c").agg(F.count("*").alias("n")).groupBy("band")
        sizes = sizes.agg(F.sum("n").alias("size"), ((F.sum(n) * F.sum(n) - F.sum(n * n)) / 2).alias("open"), F.max(F.struct("n", "c"))["c"].alias("major"), F.max("n").alias("most"), F.count("*").alias("parts")).filter("parts > 1")
        sizes = work.save(sizes.select("band", "open", "major", (F.col("size") - F.col("most")).alias("minors")), f"open-{step}")
        left = sizes.agg(F.coalesce(F.sum("open"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.when(F.col("minors") > CELL, 1)), F.lit(0)).alias("large")).first()
        if not left["n"]:
            return components
        if not step:
            # From here on only lines are compared that agree with an unlike one of their cell: most meet by chance.
            named = named.join(sizes.select("band", "major"), "band")
            minor = named.filter("c <> major").select(*(F.col(x).alias(y) for x, y in zip(["band", *own[:4]], ["cell", *other[:4]], strict=True)))
            meet = (F.col("band") == F.col("cell")) & (F.col("c") != F.col("d")) & may_agree()
            some = named.join(minor, meet, "left_semi").select("band", "lh").unionByName(minor.join(named, meet, "left_semi").select(F.col("cell").alias("band"), F.col("other").alias("lh")))
            some = work.save(some.distinct(), "some")
            nodes = work.save(some.select("lh").distinct(), "nodes")
            lines = work.save(maybe_in(lines.select("lh", "line"), "lh", bitmap(nodes, "lh")).join(nodes, "lh", "left_semi").dropDuplicates(["lh"]), "texts")
            named = named.drop("major").join(some, ["band", "lh"], "left_semi")
            named = work.save(named.join(work.save(parities(lines), "parities"), "lh"), "marked")
            for name in ("named-0", "parities", "some"):
                work.drop(name)
        # All at once where that is at most CELL pairs a line, or few pairs in all.
        last = step > 0 and (left["large"] == 0 or left["n"] <= OPEN_PAIRS * size or step == ROUNDS)
        named = named.join(sizes.select("band", "major", ((F.col("minors") > CELL) & F.lit(not last)).alias("large")), "band")
        minor = named.filter("c <> major").select("band", "large", *(F.col(x).alias(y) for x, y in zip(own, other, strict=True)))
        if not step:
            # Told apart by the cell too, so that a line meets others in each of its cells.
            salt = F.xxhash64(F.lit(7), "band")
            drawn = named.filter("c = major").groupBy("band", F.pmod(F.xxhash64("band", "lh"), F.lit(DRAWN)).alias("slot")).agg(F.min(F.col("lh").bitwiseXOR(salt)).alias("x"))
            drawn = work.save(drawn.select("band", F.col("x").bitwiseXOR(salt).alias("lh")).distinct(), "drawn")
            pairs = named.join(drawn, ["band", "lh"], "left_semi").join(minor.drop("large"), "band")
        else:
            if not last:
                pivots = minor.filter("large").groupBy("band").agg(F.min(F.struct(*other)).alias("p"))
                pivots = work.save(pivots.select("band", "p.*"), f"pivots-{step}")
                minor = minor.filter("not large").drop("large").unionByName(pivots)
            pairs = named.join(minor.select("band", *other), "band")
        pairs = pairs.filter("c <> d").filter(may_agree() & may_be_alike(threshold)).select("lh", "other")
        found = alike(pairs, lines, work, threshold, done)
        # Only components are joined from here on, so that their names are enough.
        names = components.withColumnRenamed("component", "c")
        ends = found.join(names.withColumnRenamed("node", "a").withColumnRenamed("c", "ca"), "a", "left").join(names.withColumnRenamed("node", "b").withColumnRenamed("c", "cb"), "b", "left")
        ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = connected_components(ends, work, f"lines-{step + 1}").select(F.col("node").alias("c"), F.col("component").alias("e"))
        both = names.join(joined, "c", "full").select(F.coalesce("node", "c").alias("node"), F.coalesce("e", "c").alias("component"))
        components = work.save(both.unionByName(joined.select(F.col("c").alias("node"), F.col("e").alias("component"))).distinct(), f"components-{step}")
        if last:
            return components
        # A pivot has met all that are left in its cell; the lines of the first step only some.
        rest = named if not step else named.filter("large").join(pivots.select("band", F.col("other").alias("lh")), ["band", "lh"], "left_anti")
        rest = rest.drop("c", "major", "large")
    raise AssertionError("the last round returns")


def similar_lines(rows: DataFrame, work: Workspace, threshold: float) -> DataFrame:
    """lh, grp: every line that has an equal or similar one, with the key of its group."""
    lines = lines_of(rows)
    signed = signatures(lines, work)
    components = linked(signed, lines, work, threshold).select(F.col("node").alias("lh"), "component")
    repeated = signed.filter("uses > 1").select("lh").distinct()  # each level of a line counts all its uses
    return repeated.join(components, "lh", "full").select("lh", F.coalesce("component", "lh").alias("grp"))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all but the first of equal and similar lines taken out of ``text``.

    All columns stay; n_lines and n_removed come last (and replace such columns
    of the input). Every row comes back, also one without any line left (then
    with an empty text); a null text stays null and has no lines. Rows that
    repeat an id and its text count as one: they stay alike.
    """
    work = Workspace(docs.sparkSession, "line-dedup")
    docs, own = aside(docs.drop("n_lines", "n_removed"))
    text, doc_id = own[text], own[doc_id]
    body = F.coalesce(F.col(text), F.lit(""))
    row_key = F.xxhash64(F.col(doc_id), body)
    rows = docs.select(F.col(doc_id).alias("__id"), body.alias("__text"), row_key.alias("__rk"))
    groups = work.save(similar_lines(rows, work, threshold), "groups")
    places = maybe_in(lines_of(rows).select("__rk", "__id", "pos", "lh"), "lh", bitmap(groups, "lh")).join(groups, "lh").select("grp", "__id", "__rk", "pos")
    places = work.save(places, "places")
    # Written, so that the join below starts from two shuffles and a hot group can be split.
    first = work.save(places.groupBy("grp").agg(F.min(F.struct("__id", "__rk", "pos")).alias("first")), "first")
    gone = places.join(first, "grp").filter((F.col("__rk") != F.col("first.__rk")) | (F.col("pos") != F.col("first.pos")))
    gone = work.save(gone.groupBy("__rk").agg(F.collect_set("pos").alias("__gone")), "gone")
    filter_ = bitmap(gone.select("__rk"), "__rk")
    named = docs.withColumn("__rk", row_key)
    hit = maybe_in(named, "__rk", filter_).join(gone, "__rk", "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    # Counted from the bytes, without making the lines.
    breaks = F.octet_length(F.col(text)) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(breaks + 1)
    split = F.split(F.col(text), "\n", -1)
    # Two uses of the named array: it is not put into the lambda and made anew for each line.
    hit = hit.withColumn("__lines", split).withColumn("__count", F.size("__lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    changed = F.when(F.size("__gone") > 0, kept).otherwise(F.col(text))
    hit = hit.withColumn("n_lines", n_lines).withColumn("n_removed", F.size("__gone")).withColumn(text, changed).drop("__rk", "__gone", "__lines", "__count")
    miss = maybe_in(named, "__rk", filter_, negate=True).withColumn("n_lines", n_lines).withColumn("n_removed", F.lit(0)).drop("__rk")
    return hit.unionByName(miss).withColumnsRenamed({o: c for c, o in own.items()})


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
