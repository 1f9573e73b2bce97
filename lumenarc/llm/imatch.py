"""I-Match document fingerprints.

Terms whose share of documents lies within a band (neither so common that they
say nothing nor so rare that they are noise) form the lexicon. A document's
lexicon terms, distinct and sorted, are hashed; further hashes take only the
terms of one of several randomised subsets of the lexicon, drawn at three
rates, so that documents which differ in some terms still agree in a part of
their hashes. Texts that many rows repeat count once, so that copies don't
push their own terms out of the band. A document with few lexicon terms (of
rare terms, in a tiny table, in a large family of near copies) is hashed by
all its terms instead. The lexicon has at most (mean distinct terms of a
document) / ``MIN_SHARE`` terms, as every term in it is in at least
``MIN_SHARE`` of them, and never more than ``LEXICON``: that bounds what is
broadcast.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import mix, small_batches, table, texts
from lumenarc.runtime import Workspace

#: The band of the inverse document frequency, as shares of the documents.
MIN_SHARE, MAX_SHARE = 0.001, 0.2
#: Subsets per rate at which a lexicon term belongs to a subset.
RATES, PER_RATE = (1 / 16, 1 / 64, 1 / 256), 8
SUBSETS = len(RATES) * PER_RATE
#: Documents with fewer lexicon terms are hashed by all their terms: few of them would make unlike documents equal.
FEW = 8
#: Most terms of a lexicon; where the band holds more, its low end rises.
LEXICON = 1 << 20
#: A text that at least 1 / HOT of all rows have counts as one document; there are at most HOT such texts.
HOT = 4096
#: What a hot text's copies add up to, dealt out evenly in whole numbers.
UNIT = 1 << 40
#: Terms that one task counts before it passes its counts on.
FLUSH = 300_000

#: A-Z to a-z; ASCII that is no letter or digit to a space, where terms end.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def distinct_terms(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def hot_texts(docs: DataFrame, rows: int, text: str = "text") -> dict[int, int]:
    """xxhash64 and rows of each text that several rows and at least 1 / HOT of all have; HOT entries at most."""
    same = docs.groupBy(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same")).agg(F.count("*").alias("n"))
    return {r["same"]: r["n"] for r in same.filter(F.col("n") >= max(2, rows / HOT)).collect()}


def document_frequencies(docs: DataFrame, text: str = "text", hot: dict[int, int] | None = None) -> DataFrame:
    """term binary, df long over all documents; null counts as empty, the rows of each ``hot`` text as one document."""
    hot = hot or {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        parts: Counter = Counter()  # of hot texts, in shares of UNIT

        def out() -> pa.RecordBatch:
            terms = list(seen | parts)
            columns = [pa.array(terms, pa.binary()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (seen, parts))]
            seen.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "df", "part"])

        for batch in batches:
            for body, same in zip(texts(batch), batch.column(1).to_pylist(), strict=True):
                copies = hot.get(same)
                if copies is None:
                    seen.update(distinct_terms(body))
                else:
                    share = UNIT // copies
                    for term in distinct_terms(body):
                        parts[term] += share
                if len(seen) + len(parts) > FLUSH:
                    yield out()
        if seen or parts:
            yield out()

    given = docs.select(F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"))
    sums = given.mapInArrow(count, "term binary, df long, part long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("part").alias("part"))
    return sums.select("term", (F.col("df") + F.floor((F.col("part") + UNIT // 2) / UNIT)).alias("df"))


class Lexicon:
    """Terms in sorted order with their hashes and the subsets they belong to."""

    def __init__(self, terms: list[bytes]):
        terms = sorted(terms)
        self.at = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
        self.member = self.subsets(self.hashes)

    @staticmethod
    def subsets(hashes: np.ndarray) -> np.ndarray:
        """Which of the subsets each term belongs to; its hash alone decides."""
        draws = mix(hashes[:, None] + np.arange(1, SUBSETS + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
        bounds = np.repeat([int(r * (1 << 53)) for r in RATES], PER_RATE).astype(np.uint64)
        return (draws >> np.uint64(11)) < bounds[None]

    def fingerprint(self, text: bytes) -> str:
        """32 hex digits for all lexicon terms, then 8 for each subset ('-' without a term).

        With fewer than FEW lexicon terms all terms of the text take their
        place. A text without any term (empty, only punctuation) has the hash
        of its bytes instead, so it only equals the same text.
        """
        get = self.at.get
        terms = distinct_terms(text)
        at = sorted({i for t in terms if (i := get(t)) is not None})
        if not terms:
            return "=" + hashlib.md5(text, usedforsecurity=False).hexdigest()
        if len(at) < FEW:
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in sorted(terms)], np.uint64)
            member = self.subsets(hashes)
        else:
            hashes, member = self.hashes[at], self.member[at]
        parts = [xxhash.xxh3_128_hexdigest(hashes.tobytes())]
        for k in range(SUBSETS):
            own = hashes[member[:, k]]
            parts.append(f"{xxhash.xxh3_64_intdigest(own.tobytes()) >> 32:08x}" if own.size else "-")
        return ":".join(parts)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the share of equal hashes among those that at least one of both has."""
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split(":"), b.split(":"), strict=True) if x != "-" or y != "-"]
    return sum(x == y for x, y in pairs) / len(pairs)


def lexicon(docs: DataFrame, text: str = "text", min_share: float = MIN_SHARE, max_share: float = MAX_SHARE, most: int = LEXICON) -> Lexicon:
    """The terms in the band of ``min_share`` to ``max_share`` of all documents, texts that many rows repeat taken once.

    Null and empty texts count as documents without terms. In a tiny or empty
    table no term may be in the band: the lexicon is empty then. Should the
    band hold over ``most`` terms, its low end rises to the first document
    frequency that leaves no more.
    """
    rows = docs.count()
    hot = hot_texts(docs, rows, text)
    n = rows - sum(hot.values()) + len(hot)
    inside = document_frequencies(docs, text, hot).filter(F.col("df").between(int(np.ceil(max(1, min_share * n))), int(max_share * n)))
    work = Workspace(docs.sparkSession, "imatch")
    inside = work.save(inside, "band")
    while (found := inside.count()) > most:
        # The rank is approximate, so one step may leave some too many; each step takes at least one frequency away.
        low = inside.agg(F.percentile_approx("df", 1 - most / found, 10_000).alias("low")).first()["low"]
        inside = inside.filter(F.col("df") > low)
    words = Lexicon([bytes(r["term"]) for r in inside.select("term").collect()])
    work.remove()
    return words


def fingerprints(docs: DataFrame, words: Lexicon, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint, one row per row; null counts as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.fingerprint(t) for t in texts(batch)], pa.string())], ["doc_id", "fingerprint"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def ranges_of(docs: DataFrame, doc_id: str, count: int) -> tuple[list[int], dict[int, int]]:
    """Bounds that cut the ids into ``count`` ranges, and each non-empty range's first id.

    Both are as long as ``count`` at most. A range is the number of bounds at
    or below the id.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    bounds = ids.agg(F.percentile_approx("id", [i / count for i in range(1, count)], 10_000).alias("q")).first()["q"] if count > 1 else None
    bounds = sorted(set(bounds or []))
    first = ids.groupBy(range_of(F.col("id"), bounds).alias("r")).agg(F.min("id").alias("first"))
    return bounds, {r["r"]: r["first"] for r in first.collect()}


def range_of(id_, bounds: list[int]):
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.aggregate(F.array(*map(F.lit, bounds)), F.lit(0), lambda n, b: n + F.when(b <= id_, 1).otherwise(0)), F.lit(0))


def with_next(docs: DataFrame, words: Lexicon, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Next is by ascending id, after the last the first; rows that share an id
    follow each other by text, and a null id comes first. Null texts count as
    empty; a table of one row is its own next, an empty one gives none. Texts are shuffled
    once, to ranges of ids; each range also gets the first row of the next one.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    shared = spark.sparkContext.broadcast(words)
    id_ = F.col(doc_id).cast("long")
    given = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds, first = ranges_of(given, "at", parts)
    full = sorted(first)
    own = given.withColumn("part", range_of(F.col("at"), bounds)).withColumn("guest", F.lit(False))
    # The first row of each range also goes to the range before it, the very first to the last.
    before = [F.lit(x) for i, r in enumerate(full) for x in (r, full[i - 1])] or [F.lit(0), F.lit(0)]
    guests = own.filter(F.col("at").isin(list(first.values()))).withColumn("part", F.create_map(*before)[F.col("part")]).withColumn("guest", F.lit(True))
    dealt = own.unionByName(guests).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "guest", "at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        held: tuple | None = None  # the row that waits for its next
        closed = True  # whether that range already met its guest
        rows: list[tuple] = []

        def pair(a: tuple, b_text: str, b_print: str) -> tuple:
            id_, body, printed = a
            half = len(body) // 2
            edited = body[: len(body) - half] + b_text[:half]
            raw = edited.encode()
            edited_print = lex.fingerprint(raw)
            return id_, len(body), hashlib.sha256(raw).hexdigest(), printed, edited_print, likeness(printed, edited_print), likeness(printed, b_print)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return batch

        for batch in batches:
            for id_, body, guest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                if guest and closed:
                    continue
                printed = lex.fingerprint(body.encode())
                if held is not None and not closed:
                    rows.append(pair(held, body, printed))
                held, closed = (None, True) if guest else ((id_, body, printed), False)
                if len(rows) == 512:
                    yield out()
        if rows:
            yield out()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    small_batches(spark)
    return with_next(docs, lexicon(docs))
