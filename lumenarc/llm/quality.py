"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed: byte trigrams of the text, runs of character classes (how
words are written) and whether a word repeats the one before. A bounded sample
of labelled rows gives the tf-idf weights, the latent space (truncated SVD by
randomised subspace iteration in numpy) and the labelled vectors, which are
broadcast: their size follows from the documented parameters alone. Every
document is projected, its exact cosines with all labelled vectors come from
blocked matrix products, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import fold, small_batches, table, texts

#: At most so many labelled rows per label; the sample is the same at every run.
SAMPLE_PER_LABEL = 1500
GRAMS, SHAPES, REPEATS = 1 << 12, 1 << 12, 8
TERMS = GRAMS + SHAPES + REPEATS
RANK, NEIGHBOURS, BLOCK = 64, 25, 256
THRESHOLD = 0.3


def classes() -> np.ndarray:
    """The class of each byte: lower, upper, digit, space, line end, beyond ASCII, and ten of other marks."""
    kind = np.array([6 + b % 10 for b in range(256)], np.int64)
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (bytes(range(128, 256)), 5)):
        kind[list(chars)] = k
    return kind


CLASS = classes()


def terms(text: bytes) -> np.ndarray:
    """Counts of all terms of a whole text; the empty text has none."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.zeros(TERMS, np.float32)
    if not raw.size:
        return counts
    if raw.size >= 3:
        x = raw.astype(np.uint32)
        code = (x[:-2] * np.uint32(66049) + x[1:-1] * np.uint32(257) + x[2:]) * np.uint32(2654435761)
        counts[:GRAMS] = np.bincount(code >> np.uint32(20), minlength=GRAMS)
    kind = CLASS[raw]
    runs = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
    runs = np.concatenate([[3], runs, [3]])
    if runs.size >= 3:
        counts[GRAMS : GRAMS + SHAPES] = np.bincount(runs[:-2] << 8 | runs[1:-1] << 4 | runs[2:], minlength=SHAPES)
    words = text.split()
    if len(words) > 1:
        same = sum(map(bytes.__eq__, words, words[1:])) / (len(words) - 1)
        counts[GRAMS + SHAPES + min(REPEATS - 1, int(same * REPEATS))] = len(words)
    return counts


@dataclass(frozen=True)
class Space:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # labelled rows x RANK, each of length 1
    labels: np.ndarray
    weights: np.ndarray  # makes up for the sample's own mix of labels
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.idf) @ self.axes)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest, each with its cosine to the fourth and its label's weight."""
        near = latent @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(near, at, 1), 0, 1) ** 4 * self.weights[at]
        total = weight.sum(1)
        share = (weight * self.labels[at]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, share, self.prior)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf; each of the three kinds of terms has the same length."""
    x = np.log1p(counts) * idf
    for a, b in ((0, GRAMS), (GRAMS, GRAMS + SHAPES), (GRAMS + SHAPES, TERMS)):
        x[:, a:b] = unit(x[:, a:b])
    return x


def fit(rows: list[tuple[str, int]], share_of_ones: float) -> Space | None:
    """The space of (text, label) rows; None without any."""
    return fit_counts(np.stack([terms((t or "").encode()) for t, _ in rows]), np.array([y for _, y in rows], np.float64), share_of_ones) if rows else None


def fit_counts(counts: np.ndarray, labels: np.ndarray, share_of_ones: float, seed: int = 5) -> Space | None:
    """The space of rows of term counts and their labels; None without any."""
    if not len(labels):
        return None
    idf = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    x = weighted(counts, idf)
    rng = np.random.default_rng(seed)
    rank = min(RANK, len(labels))
    basis = np.linalg.qr(x.T @ (x @ rng.normal(size=(TERMS, rank)).astype(np.float32)))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ turn.T).astype(np.float32)
    of_sample = labels.mean()
    weights = np.where(labels == 1, share_of_ones / max(of_sample, 1e-9), (1 - share_of_ones) / max(1 - of_sample, 1e-9))
    return Space(idf, axes, unit(x @ axes).astype(np.float32), labels, weights, float(share_of_ones))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, np.ndarray, float]:
    """Term counts and labels of at most ``per_label`` ids of each label, chosen by a hash of the id, and the share of label 1 among all.

    Texts are counted in the tasks; rows that repeat an id add at most as many
    rows again as there are, and a null label, or one but 0 and 1, is left out.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total, chosen = sum(counts.values()), None
    for y, n in counts.items():
        part = known.filter(F.col("quality") == y).withColumn("h", F.xxhash64(F.lit(3), "doc_id"))
        if n > 2 * per_label:
            part = part.filter(F.shiftrightunsigned("h", 33) < int((1 << 31) * 2.0 * per_label / n))
        part = part.orderBy("h").limit(per_label).select("doc_id", "quality")
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return np.zeros((0, TERMS), np.float32), np.zeros(0), 0.5
    # Two samples of at most per_label ids each, so this side may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality", F.xxhash64("doc_id", "text").alias("h"))
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(body) for body in texts(batch)]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            n = [c[i] for c, i in zip(found, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32())), batch.column(1).cast(pa.int32()), batch.column(2)], ["at", "n", "quality", "h"])

    bags = rows.mapInArrow(count, "at array<int>, n array<float>, quality int, h long").orderBy("h", "quality").limit(4 * per_label).collect()
    dense = np.zeros((len(bags), TERMS), np.float32)
    for row, r in zip(dense, bags, strict=True):
        row[r["at"]] = r["n"]
    return dense, np.array([r["quality"] for r in bags], np.float64), counts.get(1, 0) / total


def score(docs: DataFrame, space: Space | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns plus score (0 to 1) and predicted (score >= 0.3), one row per row.

    A null text counts as empty; with no term in common with any labelled row
    the score is the share of label 1, and 0.5 if there is nothing to learn from.
    Rows that repeat are scored alike; of equally near neighbours any may vote. Kept columns of the two new names are replaced by them.
    """
    keep = tuple(c for c in keep if c not in ("score", "predicted"))
    held = {c: f"__in{i}" for i, c in enumerate(keep)}
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            found, block = [], []

            def flush(found: list = found, block: list = block) -> None:
                if block:
                    found.append(s.vote(s.project(np.stack(block))))
                    block.clear()

            if s is None:
                found.append(np.full(batch.num_rows, 0.5))
            else:
                for body in texts(batch, "__text"):
                    block.append(terms(body))
                    if len(block) == BLOCK:
                        flush()
                flush()
            scores = np.clip(np.concatenate(found) if found else np.zeros(0), 0, 1).astype(np.float64)
            at = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [*(batch.schema.names[i] for i in at), "score", "predicted"])

    schema = ", ".join([*(f"{held[c]} {t}" for c, t in docs.select(*keep).dtypes), "score double, predicted int"])
    found = docs.select(*(F.col(c).alias(o) for c, o in held.items()), F.col(text).alias("__text")).mapInArrow(run, schema)
    return found.withColumnsRenamed({o: c for c, o in held.items()})


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    found = score(docs, fit_counts(*labelled_sample(docs, labels.filter(fold(F.col("doc_id"), 5) != 0))))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
