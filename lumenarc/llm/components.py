"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.runtime import Workspace

#: Rows of a written file, and files there are at least: small tables are not spread over all shuffle partitions.
FILE_ROWS, FILES = 250_000, 8


def both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """node, component (least node reachable) of edges(a, b); loops and repeats do no harm.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which
    keep no more edges than they were given and end after a number of rounds
    logarithmic in the size of a component. Each round is a written table. Nodes
    without an edge to another node are absent; no edges give an empty table.
    """
    now = work.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-0")
    step, before, rows = 0, None, now.count()
    while True:
        # Rows never grow, so the last round's tell how many files are enough; beyond the shuffle's partitions this changes nothing.
        files = FILES + rows // FILE_ROWS
        large = both(now)
        # Written, so that the join starts from two shuffles and the rows of a hot node can be split.
        least = work.save(large.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(2 * files), f"{name}-least-{step}")
        # Large star: neighbours above a node link to its least neighbour.
        grown = large.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: neighbours below a node, and the node, link to the least of them.
        small = grown.groupBy("a").agg(F.min("b").alias("m"))
        shrunk = grown.join(small, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step += 1
        new = work.save(shrunk.select("e.a", "e.b").filter("a <> b").distinct().coalesce(files), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        work.drop(f"{name}-least-{step - 1}")
        now = new
        # Unchanged totals of an order-free hash: the stars have settled.
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, rows = mark, mark["n"]
