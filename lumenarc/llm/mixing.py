"""Temperature mixing of sources.

A source's share of the tokens, raised to an exponent and normalised, is its
weight. The exponent is found by repeated section: ``SECTIONS`` exponents are
measured at once by one small aggregate, and the interval that holds the goal
is cut again, until it is narrower than ``PRECISION``. The weights become
documents by block permutations: a source's documents are dealt into blocks by
a hash, blocks are in the order of another; a source gives all its documents
as often as its budget holds them, then whole blocks, then documents of the
first block that does not fit.

Native: DataFrame functions only. What goes to the driver is one row per
exponent; sources are broadcast only if there are at most ``BROADCAST_SOURCES``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import SPACE, aside, table
from lumenarc.runtime import Workspace

SECTIONS, PRECISION = 16, 1e-7
#: Documents a block holds on average.
BLOCK = 256
BROADCAST_SOURCES = 10_000
#: Ranges of block orders whose sums are added up first; so no task orders all blocks of a source.
RANGE_BITS = 12


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    words = F.size(F.split(F.trim(F.regexp_replace(text, SPACE, " ")), " "))
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(words).cast("long")


def measure(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """Per exponent: normaliser, entropy (nats), largest and least p^(a-1)."""
    rows = sources.filter("share > 0").select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    w, log = F.pow("share", F.col("a")), F.log("share")
    found = rows.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * log).alias("wl"), F.max(F.pow("share", F.col("a") - 1)).alias("most"), F.min(F.pow("share", F.col("a") - 1)).alias("least"), F.log(F.sum(w)).alias("log_z"))
    return {r["a"]: (r["z"], r["log_z"] - r["wl"] / r["z"], r["most"], r["least"]) for r in found.collect()}


def exponent(sources: DataFrame, tokens: int, budget: float | None, entropy: float | None, max_repeat: float | None) -> float:
    """The exponent that meets the goal; both goals fall as it rises.

    ``entropy``: the weights' entropy as a share of the largest possible one.
    ``max_repeat``: the smallest exponent (flattest weights) that repeats no
    source more often. Where even the ends of 0..1 don't meet it, the nearer end.
    """
    count = sources.filter("share > 0").count()
    if count < 2:
        return 1.0

    def value(x: tuple[float, float, float, float]) -> float:
        z, h, most, least = x
        if entropy is not None:
            return h / math.log(count)
        return most / least if budget is None else budget / tokens * most / z

    goal = entropy if entropy is not None else max_repeat
    low, high = 0.0, 1.0
    while high - low > PRECISION:
        at = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        found = measure(sources, at)
        values = [value(found[a]) for a in at]
        if values[0] <= goal:
            return low
        if values[-1] > goal:
            return high
        i = next(i for i, v in enumerate(values) if v <= goal)
        low, high = at[i - 1], at[i]
    return high


def first_over(parts: DataFrame, order: str) -> DataFrame:
    """__s, at, left: per source of parts(__s, rest, n) the first in order with which the sum exceeds rest, and what is left for it."""
    upto = F.sum("n").over(Window.partitionBy("__s").orderBy(order))
    over = parts.withColumn("__upto", upto).filter("__upto > rest")
    return over.groupBy("__s").agg(F.min(order).alias("at"), F.min_by(F.col("rest") - (F.col("__upto") - F.col("n")), order).alias("left"))


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", budget: float | None = None, entropy: float | None = None, max_repeat: float | None = 2.0, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, with n_tokens, weight, draw (1, 2, ...) and block_order.

    ``budget`` is in tokens: a number, or None for the least that draws every
    document at least once. No source draws more tokens than its weight of the
    budget. A null source counts as the empty name; sources without a token
    draw their documents once if the budget is None and never otherwise. Rows
    that repeat an id and its text are drawn alike. An empty table gives an
    empty one; columns named like the four new ones are replaced by them.
    """
    if (entropy is None) == (max_repeat is None):
        raise ValueError("name either an entropy or a repetition limit")
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    added = ("n_tokens", "weight", "draw", "block_order")
    # Columns of the input have names of their own meanwhile, and cannot clash with those made here.
    held, own = aside(docs)
    row_hash = F.xxhash64(F.lit(seed), F.col(own[doc_id]), F.coalesce(F.col(own[text]), F.lit("")))
    given = held.withColumn("__s", F.coalesce(F.col(own[source]).cast("string"), F.lit(""))).withColumn("n_tokens", token_count(F.col(own[text]))).withColumn("__h", row_hash)
    thin = work.save(given.select("__s", "n_tokens", "__h"), "thin")
    totals = thin.groupBy("__s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = work.save(totals, "totals")
    tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("share", F.col("tokens") / F.lit(max(tokens, 1)))
    a = exponent(shares, max(tokens, 1), budget, entropy, max_repeat)
    z, _, _, least = measure(shares, [a]).get(a, (1.0, 0.0, 1.0, 1.0))
    spend = max(tokens, 1) * z / least if budget is None else budget
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(a))).otherwise(0.0)
    plan = shares.withColumn("weight", power / z).withColumn("target", F.col("weight") * spend)
    # A product that should be whole may fall short of it in its last bits.
    rounds = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens") + 1e-9)).otherwise(1 if budget is None else 0)
    plan = plan.withColumn("rounds", rounds.cast("long")).withColumn("rest", F.greatest(F.lit(0.0), F.when(F.col("tokens") > 0, F.col("target") - F.col("rounds") * F.col("tokens")).otherwise(0.0)))
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / BLOCK).cast("long"))
    plan = work.save(plan.select("__s", "weight", "rounds", "rest", "blocks"), "plan")
    few = plan.count() <= BROADCAST_SOURCES

    def with_plan(df: DataFrame, more: DataFrame) -> DataFrame:
        return df.join(F.broadcast(more) if few else more, "__s")

    block = F.pmod(F.xxhash64(F.lit(seed + 1), "__h"), F.col("blocks"))
    order = F.xxhash64(F.lit(seed + 2), "__s", block)
    placed = with_plan(thin, plan.filter("rest > 0")).withColumn("block_order", order)
    # The first range of orders that no longer fits as a whole, then in it the first such block, and what is left for it.
    blocks = placed.groupBy("__s", "block_order", "rest").agg(F.sum("n_tokens").alias("n")).withColumn("__range", F.shiftright("block_order", 64 - RANGE_BITS))
    blocks = work.save(blocks, "blocks")
    ranges = first_over(blocks.groupBy("__s", "__range", "rest").agg(F.sum("n").alias("n")), "__range").select("__s", F.col("at").alias("__range"), F.col("left").alias("room"))
    inner = with_plan(blocks, work.save(ranges, "ranges").withColumnRenamed("__range", "__cut")).filter("__range = __cut")
    cut = first_over(inner.select("__s", "block_order", F.col("room").alias("rest"), "n"), "block_order").withColumnRenamed("at", "cut")
    cut = work.save(cut, "cut")
    inside = with_plan(placed.select("__s", "block_order", "__h", "n_tokens"), cut).filter("block_order = cut")
    run = F.sum("n_tokens").over(Window.partitionBy("__s").orderBy("__h"))  # of one block per source; equal rows together
    last = inside.withColumn("run", run).filter("run <= left").groupBy("__s").agg(F.max("__h").alias("last"))
    limits = work.save(plan.join(cut, "__s", "left").join(last, "__s", "left"), "limits")
    drawn = with_plan(given, limits).withColumn("block_order", order)
    fits = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("block_order") < F.col("cut")) | ((F.col("block_order") == F.col("cut")) & (F.col("__h") <= F.col("last"))))
    times = F.col("rounds") + F.coalesce(fits, F.lit(False)).cast("long")
    drawn = drawn.withColumn("__n", times).filter("__n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return drawn.select(*(F.col(o).alias(c) for c, o in own.items() if c not in added), "n_tokens", "weight", "draw", "block_order")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mix_sources(docs, max_repeat=2.0).drop("text")
