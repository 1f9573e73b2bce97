"""Class-based n-gram scores (Brown et al., 1992) with exchange clustering.

Clustering knows ``HEAD`` words, the most frequent ones, one by one; all others
share ``TAILS`` pseudo-words by a hash of their last four bytes before closing
punctuation. The exchange algorithm moves one (pseudo-)word at a time to the
class that raises the likelihood of the class bigrams most, over a sparse table
of the bigrams that occur. Then each further word of the ``LEXICON`` goes to
the class that fits its own contexts best, counted over the whole corpus; the
rest have their pseudo-word's class. A text's probability is the product over
its tokens of P(class | class before) and P(word | class), whose counts are
taken once more with the final classes. Word counts are exact and distributed:
those of the lexicon are broadcast (a fixed number), those of all others joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.llm.common import fold, small_batches, table, texts
from lumenarc.runtime import Workspace

HEAD, TAILS, CLASSES = 4096, 256, 48
TYPES = HEAD + TAILS + 1
END = TYPES - 1
#: Words whose counts are broadcast.
LEXICON = 65_536
ADD = 0.1
ROUNDS = 4
FLUSH = 300_000


def tokens(text: bytes) -> list[bytes]:
    """Lower-cases A-Z; the words between ASCII white space. The end follows unsaid."""
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, c long over all rows of docs(text), without the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in batches:
            for body in texts(batch):
                seen.update(tokens(body))
                if len(seen) > FLUSH:
                    yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def tail_type(word: bytes) -> int:
    return HEAD + xxhash.xxh32_intdigest(word.rstrip(b".,;:!?")[-4:]) % TAILS


class Ids(dict):
    """One number per word: its place in the lexicon (most frequent first), or beyond it the lexicon's size + the number of its pseudo-word.

    A plain dictionary of the lexicon that adds what it is asked for; what was
    added goes when it is more than FLUSH words.
    """

    def __init__(self, lexicon: list[bytes]):
        super().__init__(zip(lexicon, range(len(lexicon)), strict=True))
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.lexicon) + FLUSH:
            self.clear()
            self.update(zip(self.lexicon, range(len(self.lexicon)), strict=True))
        found = self[word] = len(self.lexicon) + tail_type(word) - HEAD
        return found

    def __reduce__(self):
        return Ids, (self.lexicon,)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def types(self) -> np.ndarray:
        """The type of each number: its own for the head, a pseudo-word for the others."""
        return np.array([*range(min(HEAD, len(self.lexicon))), *map(tail_type, self.lexicon[HEAD:]), *range(HEAD, HEAD + TAILS)], np.int64)


def framed(x: np.ndarray, end: int) -> np.ndarray:
    return np.concatenate([[end], x, [end]])


def code_counts(docs: DataFrame, codes, state) -> DataFrame:
    """code long, n long: how often ``codes(state, words)`` gives each code, over all rows of docs(text). The state is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(code.size, np.int64)
            np.add.at(n, at, np.concatenate([x for _, x in held]))
            return code, n

        for batch in batches:
            code = np.concatenate([codes(shared.value, tokens(body)) for body in texts(batch)] or [np.zeros(0, np.int64)])
            held.append(np.unique(code, return_counts=True))
            size += held[-1][0].size
            if size > 4 * FLUSH:
                held[:] = [merged()]
                size = held[0][0].size
                if size > 2 * FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int64()), pa.array(held[0][1], pa.int64())], ["code", "n"])
                    held.clear()
                    size = 0
        if held:
            code, n = merged()
            for i in range(0, code.size, 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(code[i : i + 100_000], pa.int64()), pa.array(n[i : i + 100_000], pa.int64())], ["code", "n"])

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def type_pairs(state: tuple, words: list[bytes]) -> np.ndarray:
    """first * TYPES + second of the text's types, the ends included on both sides."""
    ids, types = state
    x = framed(types[ids.of(words)], END)
    return x[:-1] * TYPES + x[1:]


def contexts(state: tuple, words: list[bytes]) -> np.ndarray:
    """place * 2 * CLASSES + (class before, or CLASSES + class after) of each word of the lexicon beyond the head, which has the places from 0."""
    ids, class_of, end = state
    x = ids.of(words)
    c = framed(class_of[x], end)
    own = np.flatnonzero((x >= HEAD) & (x < len(ids.lexicon)))
    at = (x[own] - HEAD) * 2
    return np.concatenate([at * CLASSES + c[own], (at + 1) * CLASSES + c[own + 2]])


def class_pairs(classes: Classes, words: list[bytes]) -> np.ndarray:
    x = framed(classes.of(words), classes.end)
    return x[:-1] * CLASSES + x[1:]


@dataclass
class Classes:
    """The class of each word: by its own number or its pseudo-word's."""

    ids: Ids
    class_of: np.ndarray
    end: int

    def of(self, words: list[bytes]) -> np.ndarray:
        return self.class_of[self.ids.of(words)]


def exchange(first: np.ndarray, second: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each of ``size`` types, from the bigrams (first, second) that occur n times. The last type keeps a class of its own, the last.

    Starts from classes dealt by frequency; then each type in turn leaves its
    class for the one with the highest likelihood of the class bigrams, until
    a round moves none or ``rounds`` are over.
    """
    own = classes - 1
    n = n.astype(np.float64)
    freq = np.bincount(first, n, size) + np.bincount(second, n, size)
    order = np.argsort(-freq[: size - 1], kind="stable")
    cls = np.empty(size, np.int64)
    cls[order] = np.arange(size - 1) % own
    cls[size - 1] = own
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    after = np.searchsorted(first[by_first], np.arange(size + 1))
    before = np.searchsorted(second[by_second], np.arange(size + 1))
    next_type, next_n = second[by_first], n[by_first]
    last_type, last_n = first[by_second], n[by_second]
    grid = np.bincount(cls[first] * classes + cls[second], n, classes * classes).reshape(classes, classes)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    for _ in range(rounds):
        moved = 0
        for w in order:
            if freq[w] == 0:
                continue
            a = int(cls[w])
            right, left = slice(after[w], after[w + 1]), slice(before[w], before[w + 1])
            me = float(next_n[right][next_type[right] == w].sum())
            to = np.bincount(cls[next_type[right]], next_n[right], classes)
            fro = np.bincount(cls[last_type[left]], last_n[left], classes)
            to[a] -= me
            fro[a] -= me
            grid[a] -= to
            grid[:, a] -= fro
            grid[a, a] -= me
            rows, cols = grid.sum(1), grid.sum(0)
            # What joining class g adds to sum f(pairs) - sum f(rows) - sum f(columns); only pairs with the word's own neighbours change.
            t, b = np.flatnonzero(to), np.flatnonzero(fro)
            gain = (f(grid[:, t] + to[t]) - f(grid[:, t])).sum(1) + (f(grid[b] + fro[b, None]) - f(grid[b])).sum(0)
            d = np.diag(grid)
            gain += f(d + to + fro + me) - f(d + to) - f(d + fro) + f(d)
            gain -= f(rows + to.sum() + me) - f(rows) + f(cols + fro.sum() + me) - f(cols)
            g = int(np.argmax(gain[:own]))
            if gain[g] <= gain[a] + 1e-9:
                g = a
            grid[g] += to
            grid[:, g] += fro
            grid[g, g] += me
            if g != a:
                moved += 1
                cls[w] = g
        if not moved:
            break
    return cls


@dataclass
class Model:
    classes: Classes
    transition: np.ndarray  # log10 P(class | class before)
    emission_base: np.ndarray  # class -> log10 of the emission's denominator
    known: np.ndarray  # log10(c + ADD) of the lexicon's words
    base_denominator: float
    end_log: float
    end_known: bool
    train_tokens: int


def smoothed(grid: np.ndarray, unigram: np.ndarray, strength: float = 50.0) -> np.ndarray:
    """log10 P(class | class before), class bigrams smoothed towards the classes' own shares."""
    return np.log10((grid + strength * unigram[None]) / (grid.sum(1, keepdims=True) + strength))


def fit(train: DataFrame, work: Workspace) -> tuple[Model, DataFrame]:
    """The model of docs(text), and h, c of the words beyond the lexicon.

    A null text counts as empty. Without any row all counts are nil: classes
    are equally likely, and every word is unknown.
    """
    spark = train.sparkSession
    counts = work.save(word_counts(train), "words")
    docs = train.count()
    first = counts.orderBy(F.desc("c"), "word").limit(LEXICON).toArrow()
    top = list(zip(first["word"].to_pylist(), first["c"].to_pylist(), strict=True))
    ids = Ids([w for w, _ in top])
    types = ids.types()
    cells = code_counts(train, type_pairs, (ids, types)).toArrow()  # at most TYPES * TYPES rows
    code, n = cells["code"].to_numpy(), cells["n"].to_numpy()
    del cells
    cls = exchange(code // TYPES, code % TYPES, n, TYPES)
    grid = np.bincount(cls[code // TYPES] * CLASSES + cls[code % TYPES], n, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    del code, n
    log = smoothed(grid, (grid.sum(0) + 1) / (grid.sum() + CLASSES))
    class_of, end, places = cls[types], int(cls[END]), max(0, len(top) - HEAD)
    if places:
        met = code_counts(train, contexts, (ids, class_of, end)).toArrow()  # at most LEXICON * 2 * CLASSES rows
        near = np.zeros(places * 2 * CLASSES)
        near[met["code"].to_numpy()] = met["n"].to_numpy()
        near = near.reshape(places, 2, CLASSES)
        class_of[HEAD : len(top)] = (near[:, 0] @ log + near[:, 1] @ log.T)[:, : CLASSES - 1].argmax(1)
    classes = Classes(ids, class_of, end)
    pairs = code_counts(train, class_pairs, classes).collect()  # at most CLASSES * CLASSES rows
    grid = np.zeros(CLASSES * CLASSES)
    for r in pairs:
        grid[r["code"]] = r["n"]
    grid = grid.reshape(CLASSES, CLASSES)
    shared = spark.sparkContext.broadcast(classes)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES, np.int64)
        for batch in batches:
            c = shared.value.of(batch.column(0).to_pylist())
            n += np.bincount(c, batch.column(1).to_numpy(), CLASSES)
            v += np.bincount(c, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n.astype(np.int64)), pa.array(v)], ["class", "n", "v"])

    # Tokens and different words of each class, from all words.
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(classed, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["class"]], v[r["class"]] = r["n"], r["v"]
    n[classes.end], v[classes.end] = docs, bool(docs)
    total, vocabulary = int(n.sum()), int(v.sum())
    transition = smoothed(grid, (n + 1) / (n.sum() + CLASSES))
    emission_base = np.log10(n + ADD * (v + 1))
    known = np.log10(np.array([c for _, c in top], np.float64) + ADD)
    model = Model(classes, transition, emission_base, known, float(np.log10(total + ADD * (vocabulary + 1))), float(np.log10(docs + ADD)), bool(docs), total)
    last = top[-1] if len(top) == LEXICON else None
    rest = counts.filter((F.col("c") < last[1]) | ((F.col("c") == last[1]) & (F.col("word") > F.lit(last[0])))) if last else counts.limit(0)
    return model, rest.select(word_key(F.col("word")).alias("h"), "c")


def word_key(word):
    return F.xxhash64(word)


def scores(docs: DataFrame, model: Model, rest: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus n_tokens, n_known, train_tokens, base_score, score, perplexity for each row.

    A null text counts as empty: the end alone. Rows that repeat are scored
    alike, long texts whole; an empty table gives an empty one. Words beyond the lexicon are
    shuffled once per document with their number of uses; they are so rare
    that no key of theirs is hot.
    """
    spark = docs.sparkSession
    held = {c: f"__in{i}" for i, c in enumerate(keep)}
    docs = docs.select(*(F.col(c).alias(o) for c, o in held.items()), F.col("text").alias("__text"))
    given_names, keep = keep, tuple(held.values())
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids, class_of, end = m.classes.ids, m.classes.class_of, m.classes.end
        for batch in batches:
            out = []
            for body in texts(batch, "__text"):
                words = tokens(body)
                x = ids.of(words)
                beyond = x >= len(ids.lexicon)
                seldom = Counter(words[i] for i in np.flatnonzero(beyond))
                path = framed(class_of[x], end)
                logs = float(m.known[x[~beyond]].sum()) + m.end_log
                n = len(words) + 1
                path_log = float(m.transition[path[:-1], path[1:]].sum() - m.emission_base[path[1:]].sum())
                out.append((n, n - sum(seldom.values()) - (not m.end_known), logs - n * m.base_denominator, logs + path_log, list(seldom), list(seldom.values())))
            at = [i for i, c in enumerate(batch.schema.names) if c != "__text"]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *columns], [*(batch.schema.names[i] for i in at), *names])

    names = ["n_tokens", "lexicon_known", "lexicon_base", "lexicon_score", "words", "uses"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes), "n_tokens long, lexicon_known long, lexicon_base double, lexicon_score double, words array<binary>, uses array<long>"])
    first = docs.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    # Each document is one row of its own plus one per seldom word; the first carries its columns.
    seldom = F.transform(F.arrays_zip("words", "uses"), lambda x: F.struct(word_key(x["words"]).alias("h"), x["uses"].alias("k")))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("k")))
    rows = first.select("row", *keep, "n_tokens", "lexicon_known", "lexicon_base", "lexicon_score", F.explode(F.concat(whole, seldom)).alias("w"))
    is_whole = F.col("w.h").isNull()
    thin = rows.select("row", F.when(is_whole, F.struct(*keep, "n_tokens", "lexicon_known", "lexicon_base", "lexicon_score")).alias("whole"), "w.h", "w.k")
    # Rows without a word get keys of their own, so they spread over the join's tasks.
    counts = rest.select(F.col("h").alias("rest_h"), "c")
    joined = thin.join(counts, F.coalesce(F.col("h"), F.col("row")) == F.col("rest_h"), "left")
    c = F.when(F.col("h").isNotNull(), F.coalesce("c", F.lit(0)))
    summed = joined.groupBy("row").agg(F.max("whole").alias("x"), F.coalesce(F.sum(F.col("k") * F.log10(c + ADD)), F.lit(0.0)).alias("logs"), F.coalesce(F.sum(F.when(c > 0, F.col("k"))), F.lit(0)).alias("known"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_seldom"))
    score = F.col("x.lexicon_score") + F.col("logs")
    return summed.select(
        *(F.col(f"x.{held[c]}").alias(c) for c in given_names), "x.n_tokens", (F.col("x.lexicon_known") + F.col("known")).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("x.lexicon_base") + F.col("logs")).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("x.n_tokens")).alias("perplexity"),
    )


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model, rest = fit(docs.filter(fold(F.col("doc_id"), 10) != 0), Workspace(spark, "brown"))
    found = scores(docs, model, rest)
    return found.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
