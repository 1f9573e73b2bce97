"""From raw documents to packed training windows in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import aside, fold
from lumenarc.llm.jaccard_join import near_duplicates
from lumenarc.llm.language_id import identify, learn
from lumenarc.llm.line_dedup import line_dedup
from lumenarc.llm.mixing import mix_sources
from lumenarc.llm.packing import pack
from lumenarc.runtime import Workspace

#: The flattest mix repeats no source more often than this.
MAX_REPEAT = 1.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; what is rejected (no letters, no known language) goes.

    Null and empty texts are rejected, repeated rows judged alike; an empty table gives an empty one.
    """
    held, own = aside(docs)
    model = learn(held.filter(fold(F.col(own["doc_id"]), 4) != 2), own["text"], own["lang"])
    found = identify(held, model, own["text"], keep=tuple(own.values()))
    return found.filter(~F.col("rejected")).select(*(F.col(n).alias(c) for c, n in own.items()))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each group of equal or similar lines keeps its first; documents left without a line go.

    Documents that lost no line stay, also empty ones; rows that repeat an id and its text stay alike.
    """
    found = line_dedup(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document with the least id stays.

    Rows that share an id but not the text are told apart; a null id comes last.
    Rows that repeat an id and its text stay or go together; documents without
    words stay.
    """
    held, own = aside(docs)
    id_ = F.col(own["doc_id"])
    # Never null, and told apart by the text too.
    held = held.withColumn("__row", F.xxhash64(id_, F.coalesce(F.col(own["text"]), F.lit(""))))
    found = near_duplicates(held, 5, Fraction(8, 10), text=own["text"], doc_id="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    # Rows that are alone in their group, nearly all, need no comparison.
    groups = found.groupBy("__group").agg(F.min("__row").alias("x"), F.max("__row").alias("y")).filter("x < y").select("__group")
    ids = held.select("__row", F.coalesce(id_.cast("long"), F.lit((1 << 63) - 1)).alias("__id"))
    members = found.join(groups, "__group", "left_semi").distinct().join(ids, "__row").distinct()
    members = Workspace(spark, "near").save(members, "members")
    first = members.groupBy("__group").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__first"))
    gone = members.join(first, "__group").filter("__row <> __first").select("__row")
    return held.join(gone, "__row", "left_anti").select(*(F.col(o).alias(c) for c, o in own.items()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in flattened shares: every document at least once, none of a source over MAX_REPEAT times on average.

    A null source is one of its own; documents without a word are drawn once.
    """
    return mix_sources(docs, max_repeat=MAX_REPEAT).select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all drawn documents in windows of 1024 ids; a null or empty text is its end id."""
    packed = pack(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("windows", windows)]

#: No SQL expresses a stage that learns, signs or packs; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage wrote for itself is then removed."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = len(Workspace.live)
        docs = work.save(stage(spark, docs, sf_dir), name)
        for own in Workspace.live[before:]:
            own.remove()
    return docs
