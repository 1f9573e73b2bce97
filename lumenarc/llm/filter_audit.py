"""How document filters interact: a Walsh-Hadamard audit of all orders of them.

A document's failures are bits of a mask. Per part and label class only the
``2**k`` signed parity sums are aggregated: for each set w of filters the sum
of +1 over documents that fail an even number of w's filters and of -1 over
the others. The transform is its own inverse up to ``2**k``, so the counts of
all masks (cells) come back exactly, as integers. From the cells every order of
the filters follows without another look at a document: a step removes the
cells that have its bit and none of an earlier step. A document with f failures
is removed by each of its filters in k!/f of the k! orders, which gives the
Shapley sums in closed form.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import SPACE, table
from lumenarc.runtime import Workspace

#: The filters of ``failures``, in the order of their bits.
LETTERS = "ABCDE"


def sign(mask: Column, subset: Column) -> Column:
    """+1 if the two share an even number of bits, else -1."""
    return 1 - 2 * F.bit_count(mask.bitwiseAND(subset)).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame, keys: list[str], mask: str, k: int) -> DataFrame:
    """keys and ``sums``, an array of the ``2**k`` signed parity sums of the rows' masks, combined before the shuffle."""
    found = rows.groupBy(*keys).agg(*(F.sum(sign(F.col(mask), F.lit(w))).cast("long").alias(f"__{w}") for w in range(1 << k)))
    return found.select(*keys, F.array(*(f"__{w}" for w in range(1 << k))).alias("sums"))


def cells(sums: Column, k: int) -> Column:
    """The number of rows of each mask, from their parity sums."""
    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    total = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda acc, w: acc + F.get(sums, w) * sign(m, w))
    return F.transform(every, lambda m: F.shiftright(total(m), k))


def steps(letters: str) -> Column:
    """All orders of the letters with their steps: filter_order, step (from 1), bit of its filter, bits of the earlier ones."""
    found, bit = [], {x: 1 << i for i, x in enumerate(letters)}
    for order in permutations(letters):
        for i, x in enumerate(order):
            found.append({"o": "".join(order), "s": i + 1, "b": bit[x], "p": sum(bit[y] for y in order[:i])})
    return F.from_json(F.lit(json.dumps(found)), "array<struct<o: string, s: int, b: int, p: int>>")


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step of rows(part, mask, good, toxic), zeros included.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. Null masks and labels count as no failure, no label.
    An empty table gives an empty one. What follows the aggregate is
    ``2**k`` numbers a part.
    """
    k = len(letters)
    given = rows.select("part", F.coalesce("mask", F.lit(0)).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    of = parity_sums(given, ["part", "good", "toxic"], "mask", k).select("part", "good", "toxic", F.posexplode(cells(F.col("sums"), k)).alias("m", "n"))
    having = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    flat = of.groupBy("part", "m").agg(F.sum("n").alias("n"), having("good").alias("g"), having("toxic").alias("t"))
    gathered = flat.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("m", "n", "g", "t"))).alias("cells"))  # 2**k of each part
    each = gathered.select("part", "cells", F.explode(steps(letters)).alias("x"))
    bit, prior = F.col("x.b"), F.col("x.p")

    def total(of: str, keep) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(keep(c["m"]), c[of]).otherwise(0))

    failing = lambda m: m.bitwiseAND(bit) != 0
    removed = lambda m: failing(m) & (m.bitwiseAND(prior) == 0)
    orders = F.lit(math.factorial(k)).cast("long")
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(failing(c["m"]), c["n"] * F.floor(orders / F.bit_count(c["m"]))).otherwise(0))
    return each.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total("n", lambda m: m.bitwiseAND(bit.bitwiseOR(prior)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: failing(m) & (m.bitwiseAND(prior) != 0)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("g", removed).alias("good_lost"), total("t", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def failures(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """part, mask, good, toxic of every document: the bits of the filters that it fails.

    A: under 50 words; B: under 65 in 100 words are distinct; C: over 5 in 100
    code points are A-Z; D: holds one of # $ % & * |; E: identical (SHA-256) to
    the text of a smaller id. A null text is empty, a null source the empty
    name. A row without an id has no smaller and no larger one: it never fails
    E and makes no other fail; rows that repeat an id don't fail E through each
    other. A document is good (toxic) if any of its rows in ``labels`` says 1.
    Other columns are not looked at. Texts are read once and not shuffled:
    per document its id, part, four bits and digest are.
    """
    work = Workspace(docs.sparkSession, "filter-audit")
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    given = given.withColumn("words", F.array_remove(F.split("body", SPACE), ""))
    given = given.select("id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), F.length("body").alias("chars"), F.length(F.regexp_replace("body", "[^A-Z]+", "")).alias("capitals"), F.col("body").rlike("[#$%&*|]").alias("symbol"))
    fails = [F.col("n") < 50, 100 * F.col("distinct").cast("long") < 65 * F.col("n").cast("long"), 100 * F.col("capitals").cast("long") > 5 * F.col("chars").cast("long"), F.col("symbol")]
    thin = work.save(given.select("id", "part", "digest", sum(f.cast("int") * (1 << i) for i, f in enumerate(fails)).alias("bits")), "thin")
    # Whether a row is its text's first is asked by (id, digest), not by digest: copies of one text don't meet in one task.
    first = thin.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter("id is not null").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
    rows = thin.join(first, ["id", "digest"], "left").join(marks, "id", "left")
    again = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int") * 16
    return rows.select("part", (F.col("bits") + again).alias("mask"), "good", "toxic")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
f AS (SELECT part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)),
r AS (SELECT *, contains(fails, x) AS failing, translate(fails, earlier, '') <> fails AS gone FROM f, s),
c AS (SELECT part, filter_order, step, x, count(*) FILTER (NOT failing AND NOT gone) AS kept, count(*) FILTER (failing AND NOT gone) AS removed,
    count(*) FILTER (failing AND gone) AS redundant, count(*) FILTER (fails = x) AS unique_fails,
    count(*) FILTER (failing AND NOT gone AND good) AS good_lost, count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost FROM r GROUP BY ALL)
SELECT * EXCLUDE (x), CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c
"""
