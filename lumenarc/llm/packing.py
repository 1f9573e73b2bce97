"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is the ids of its whole text and an end id. Full windows are cut
off at once; what is left is cut into pieces, and pieces of some hundreds of
documents (a group) are dealt over k windows: every piece starts as a partial
partition of its own, and the two partial partitions with the largest
imbalance are merged, fullest window on emptiest, until one is left. If a
window exceeds its capacity, k rises.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import small_batches, table
from lumenarc.runtime import Workspace

CAPACITY = 1024
#: Pieces are at most this long, so that a window holds several and evens out.
PIECE = 256
#: Documents whose rests are packed together; more make the last window matter less.
GROUP_DOCS = 512


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of ``lengths`` in each of ``windows`` near-equal windows."""
    tick = itertools.count()
    # A partial partition: its imbalance, and its windows that hold something as (sum, indices), fullest first.
    heap = [(-n, next(tick), [(n, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        free = windows - len(a)
        merged = a + b[:free] if free >= len(b) else None
        if merged is None:
            # The fullest of b meet the emptiest of a, first of all its empty windows.
            spare, rest = b[:free], b[free:]
            joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(reversed(a), rest, strict=False)]
            merged = spare + joined + a[: len(a) - len(rest)]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], next(tick), merged))
    return [indices for _, indices in heap[0][2]] if heap else []


def windows_of(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The fewest windows, tried upwards from the sum's need, in which differencing keeps to the capacity."""
    k = -(-sum(lengths) // capacity)
    while True:
        found = difference(lengths, k) if k else []
        over = max((sum(lengths[i] for i in w) for w in found), default=0)
        if over <= capacity:
            return found
        k += 1


def binary_tail(total: int, capacity: int = CAPACITY) -> list[int]:
    """The sizes of a group's last, smaller windows: the powers of two that make up total mod capacity."""
    rest = total % capacity
    return [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Encoder:
    """The ids of a vocabulary in public_tokenizers, as ``tokenizers`` gives them.

    The same vocabulary in ``tiktoken`` gives the same ids for a quarter of the
    time; special tokens, and texts on which it fails (its pattern overflows
    on millions of blanks in a row), go to ``tokenizers`` itself.
    """

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.name, self.fast, self.slow = name, None, None

    def exact(self, text: str) -> list[int]:
        if self.slow is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(public_tokenizers.path(self.name))
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if "<|" in text:  # perhaps a special token
            return self.exact(text)
        if self.fast is None:
            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(self.name.replace(".json", ".tiktoken")), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # noqa: BLE001 - the encoder's own panic is no Exception
            return self.exact(text)


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, grp long"


def pack(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, group_docs: int = GROUP_DOCS, vocabulary: str = "byte_bpe_50k.json", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text counts as empty and is the end id alone; repeated rows are
    packed each for itself. Pieces of a sequence lie gapless from offset 0.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    groups = max(1, -(-docs.count() // group_docs))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.withColumn("grp", F.pmod(F.xxhash64(F.lit(17), F.monotonically_increasing_id()), F.lit(groups)))
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        number = (TaskContext.get().partitionId() << 33) | 1  # odd: windows full from the start
        for batch in batches:
            rows = []
            for id_, body, grp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.array([*encoder.ids(body), 0], "<u4")
                full = ids.size // capacity * capacity
                for at in range(0, full, capacity):
                    rows.append((id_, at, capacity, ids[at : at + capacity].tobytes(), ids.size, number, 0, -1))
                    number += 2
                for at in range(full, ids.size, piece):
                    part = ids[at : at + piece]
                    rows.append((id_, at, part.size, part.tobytes(), ids.size, -1, -1, grp))
                if len(rows) >= 2048:
                    yield arrow(rows)
                    rows = []
            if rows:
                yield arrow(rows)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []

        def out() -> pa.RecordBatch:
            return arrow(place(own, capacity))

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if own and own[-1][7] != row[7]:
                    yield out()
                    own = []
                own.append(row)
        if own:
            yield out()

    # Written once: the tokenizer is the dear part, and a lost executor then repeats none of it.
    cuts = Workspace(spark, "packing").save(given.mapInArrow(cut, PIECES), "pieces")
    rests = cuts.filter("grp >= 0").repartition("grp").sortWithinPartitions("grp", "doc_id", "start", "ids").mapInArrow(deal, PIECES)
    return cuts.filter("grp < 0").unionByName(rests).drop("grp")


def place(rows: list[tuple], capacity: int) -> list[tuple]:
    """A group's pieces with their sequence and offset.

    The last tokens, total mod capacity, are cut to windows whose lengths are
    powers of two, which need no padding; all others share the full windows.
    """
    grp = rows[0][7]
    tails = binary_tail(sum(r[2] for r in rows), capacity)
    number, done, left = itertools.count(), [], list(rows)
    for size in tails:
        sequence, at = (grp << 24 | next(number)) << 1, 0
        while at < size:
            id_, start, n, ids, total, *_ = left.pop()
            take = min(n, size - at)
            done.append((id_, start + n - take, take, ids[4 * (n - take) :], total, sequence, at, grp))
            if take < n:
                left.append((id_, start, n - take, ids[: 4 * (n - take)], total, -1, -1, grp))
            at += take
    for window in windows_of([r[2] for r in left], capacity):
        sequence, at = (grp << 24 | next(number)) << 1, 0
        for i in sorted(window):
            id_, start, n, ids, total, *_ = left[i]
            done.append((id_, start, n, ids, total, sequence, at, grp))
            at += n
    return done


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents", "doc_id", "text"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
