"""Language identification from averaged hashed subword embeddings.

Each subword (2 to 4 bytes of the text in lower case, word ends included) is
hashed to one of ``BUCKETS`` rows of an embedding table. A document is the mean
of its subwords' embeddings; a linear layer and a softmax give the languages.
Both are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows. A part of that sample, kept from the training, sets
the softmax temperature and the score under which a prediction is rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import fold, small_batches, table, texts

BUCKETS, DIM, ORDERS = 1 << 14, 16, (2, 3, 4)
#: At most so many different texts of each language are learned from; the sample is the same at every run.
LANGUAGE_ROWS = 750
EPOCHS, RATE, BATCH = 12, 4.0, 32
#: A small sample goes round more often, until it has made so many steps.
LEAST_STEPS = 840
#: Longest gradient of one text's embedding: many copies of a short text in one batch would else drive the weights to infinity.
CLIP = 32.0
#: A quarter of the sample calibrates; this share of its right predictions may be rejected.
REJECT_SHARE = 0.002
LETTER = regex.compile(r"\p{L}")


def subwords(text: bytes) -> np.ndarray:
    """The bucket of every subword of the whole text."""
    raw = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    raw[(raw < 65) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 128))] = 32
    found = []
    for n in ORDERS:
        if raw.size >= n:
            code = np.zeros(raw.size - n + 1, np.uint32)
            for i in range(n):
                code = code * np.uint32(257) + raw[i : raw.size - n + 1 + i]
            found.append(((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64))
    return np.concatenate(found)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages: embedding times output layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: bytes) -> np.ndarray:
        counts = np.bincount(subwords(text), minlength=BUCKETS)
        return counts.astype(np.float32) @ self.weights / max(1, counts.sum()) + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]  # subwords and their shares of a text


def bag(text: bytes) -> Bag:
    ids, n = np.unique(subwords(text), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def bags_of(rows: pa.Table, ids: str, shares: str) -> list[Bag]:
    """The bags of two list columns as slices of their Arrow buffers: a Python number for each would take ten times their size."""
    found = []
    for batch in rows.select([ids, shares]).to_batches():
        (a, a_at), (b, b_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns)
        found += [(a[a_at[i] : a_at[i + 1]], b[b_at[i] : b_at[i + 1]]) for i in range(batch.num_rows)]
    return found


def passage(text: bytes, words: int = 8) -> bytes:
    """Some words of the text, from a place that its checksum chooses."""
    found = text.split()
    at = zlib.crc32(text) % max(1, len(found) - words)
    return b" ".join(found[at : at + words])


def train(rows: list[tuple[str, str]]) -> Model | None:
    """Model of (text, language) rows; None without any."""
    raw = [text.encode() for text, _ in rows]
    return fit(list(map(bag, raw)), [bag(passage(t)) for t in raw], [lang for _, lang in rows])


def fit(found: list[Bag], passages: list[Bag], of: list[str], seed: int = 7) -> Model | None:
    """Model of texts, a passage of each, and their languages; None without any."""
    langs = tuple(sorted(set(of)))
    if not langs:
        return None
    label = {lang: i for i, lang in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(of))
    bags = [(*found[i], label[of[i]]) for i in order]
    held = bags[: len(bags) // 4] if len(bags) >= 40 else bags
    fit = bags[len(bags) // 4 :] if len(bags) >= 40 else bags
    table_, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    batches = max(1, len(fit) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(fit)), batches):
            rate = RATE * (1 - done / steps)
            done += 1
            means = np.stack([fit[i][1] @ table_[fit[i][0]] for i in batch])
            logits = means @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), [fit[i][2] for i in batch]] -= 1
            back = p @ out.T
            back *= np.minimum(1, CLIP / np.maximum(np.linalg.norm(back, axis=1, keepdims=True), 1e-9))
            out -= rate * means.T @ p / len(batch)
            bias -= rate * p.mean(0)
            for i, g in zip(batch, back, strict=True):
                table_[fit[i][0]] -= rate * fit[i][1][:, None] * g
    weights = table_ @ out
    seen = np.zeros(BUCKETS, bool)
    for ids, *_ in fit:
        seen[ids] = True
    weights[~seen] = 0  # subwords never met speak for no language, so foreign text scores low
    # Calibration also sees passages of a few words, which whole documents alone would make look too easy.
    held = held + [(*passages[i], label[of[i]]) for i in order[: len(held)]]
    logits = np.stack([w @ weights[ids] + bias for ids, w, _ in held])
    truth = np.array([y for *_, y in held])

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float(-(x[np.arange(len(truth)), truth] - np.log(np.exp(x).sum(1))).mean())

    temperature = float(min(np.geomspace(0.05, 4, 60), key=loss))
    model = Model(langs, weights, bias, temperature, 0.0)
    best = model.scores(logits)
    right = np.sort(best.max(1)[best.argmax(1) == truth])
    # The share of right predictions below the bound is REJECT_SHARE; never more than a coin's worth of certainty.
    bound = float(right[int(len(right) * REJECT_SHARE)]) if len(right) else 0.0
    return Model(langs, weights, bias, temperature, min(bound * 0.9, 0.5))


def chosen(labelled: DataFrame, text: str, lang: str, rows: int = LANGUAGE_ROWS) -> DataFrame:
    """text, lang, h: at most ``rows`` different texts of each language, chosen by a hash of the text; null ones are left out."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    keyed = known.withColumn("h", F.xxhash64(F.lit(11), "text"))
    # Only hashes are shuffled to count the different texts of each language; one row per language is broadcast.
    counts = keyed.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    # Leaves the top-k a small multiple of what it takes; copies of a text are one before the shuffle.
    few = keyed.join(F.broadcast(counts), "lang").filter((F.col("n") <= 2 * rows) | (F.shiftrightunsigned("h", 33) < F.lit(2.0 * rows * (1 << 31)) / F.col("n")))
    different = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return different.withColumn("place", place).filter(F.col("place") <= rows).select("text", "lang", "h")


def sample(labelled: DataFrame, text: str, lang: str, rows: int = LANGUAGE_ROWS) -> list[tuple[str, str]]:
    """The chosen texts themselves."""
    return [(r[0], r[1]) for r in chosen(labelled, text, lang, rows).orderBy("h", "lang").select("text", "lang").collect()]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Model of a labelled table. Texts become bags of subwords, at most BUCKETS numbers each, before they go to the driver."""
    small_batches(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = list(texts(batch))
            columns = [[x.tolist() for x in part] for part in zip(*(bag(t) + bag(passage(t)) for t in raw), strict=True)] if raw else [[]] * 4
            kinds = [pa.list_(pa.int32()), pa.list_(pa.float32())] * 2
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), batch.column(1), batch.column(2)], ["ids", "w", "part_ids", "part_w", "lang", "h"])

    rows = chosen(labelled, text, lang).mapInArrow(count, "ids array<int>, w array<float>, part_ids array<int>, part_w array<float>, lang string, h long").orderBy("h", "lang").toArrow()
    return fit(bags_of(rows, "ids", "w"), bags_of(rows, "part_ids", "part_w"), rows["lang"].to_pylist())


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus lang_pred, score and rejected, one row per row.

    A null text, or one without a letter, gets ``und``, score 0 and is
    rejected; so is every row if the model is None (nothing to learn from).
    Kept columns of the three new names are replaced by them; rows that repeat
    are judged alike, and long texts whole.
    """
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", "rejected"))
    held = {c: f"__in{i}" for i, c in enumerate(keep)}
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for body in texts(batch, "__text"):
                if m is None or not LETTER.search(body.decode("utf-8", "replace")):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                p = m.scores(m.logits(body))
                langs.append(m.langs[int(p.argmax())]), scores.append(float(p.max())), rejected.append(bool(p.max() < m.reject_below))
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    given = docs.select(*(F.col(c).alias(o) for c, o in held.items()), F.col(text).alias("__text"))
    schema = ", ".join([*(f"{held[c]} {t}" for c, t in docs.select(*keep).dtypes), "lang_pred string, score double, rejected boolean"])
    return given.mapInArrow(run, schema).withColumnsRenamed({o: c for c, o in held.items()})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
