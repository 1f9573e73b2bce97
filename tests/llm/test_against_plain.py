"""Mixing and language ID against plain Python versions."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenarc.llm import language_id, mixing

SMALL = "/root/testdata/sf0.001"


def plain_mix(rows, repeat):
    """rows(id, source, words, h, block_order) drawn as often as temperature mixing says; a dict of id, h and draws."""
    tokens, of = Counter(), defaultdict(list)
    for _, source, words, h, order in rows:
        tokens[source] += words
        of[source].append((order, h, words))
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    most, least = max(share.values()), min(share.values())
    a = 0.0 if most / least <= repeat else 1 - math.log(repeat) / math.log(most / least)
    spend = total / min(p ** (a - 1) for p in share.values())  # times the normaliser, which cancels below
    drawn = {}
    for source, own in of.items():
        if source not in share:
            drawn |= {(source, h): 1 for _, h, _ in own}
            continue
        target = spend * share[source] ** a
        rounds = math.floor(target / tokens[source] + 1e-9)
        room, blocks = target - rounds * tokens[source], defaultdict(list)
        for order, h, words in own:
            blocks[order].append((h, words))
        extra = set()
        for order in sorted(blocks):
            n = sum(w for _, w in blocks[order])
            if n <= room:
                room -= n
                extra |= {h for h, _ in blocks[order]}
                continue
            by_hash = Counter()
            for h, words in blocks[order]:  # equal rows stand together
                by_hash[h] += words
            for h in sorted(by_hash):
                room -= by_hash[h]
                if room < 0:
                    break
                extra.add(h)
            break
        drawn |= {(source, h): rounds + (h in extra) for _, h, _ in own}
    return drawn


def test_mixing_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rng = random.Random(5)
    rows = []
    for source, n in (("a", 260), ("b", 90), (None, 31), ("", 12), ("c", 3), ("blank", 4)):
        for _ in range(n):
            words = 0 if source == "blank" else rng.choice([0, 1, 2, 5, 9, 40])
            rows.append((len(rows), " ".join(f"w{rng.randrange(99)}" for _ in range(words)), source))
    rows += [rows[7]] * 3 + [(None, None, "a"), (None, "same words", "b"), (None, "same words", "b"), (900, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seed = 1
    h = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))
    for repeat in (1.2137, 1.7137, 3.3137, 1000.0):
        got = mixing.mix_sources(docs, max_repeat=repeat, seed=seed).withColumn("h", h)
        placed = got.filter("draw = 1").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "h", "block_order").collect()
        assert len(placed) == len(rows)  # without a budget every document is drawn
        assert all(r["n_tokens"] == len((t or "").split()) for r in placed for t in [next(t for i, t, s in rows if i == r["doc_id"] and (s or "") == r["source"])] if r["doc_id"] is not None)
        want = plain_mix([tuple(r) for r in placed], repeat)
        times = Counter((r["source"] or "", r["h"]) for r in got.collect())
        copies = Counter((r["source"], r["h"]) for r in placed)
        assert times == Counter({k: want[k] * n for k, n in copies.items()})


def plain_language(model, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, True
    raw = [c if 97 <= c <= 122 or 65 <= c <= 90 or c >= 128 else 32 for c in b" " + text.encode().lower() + b" "]
    counts = Counter()
    for n in language_id.ORDERS:
        for i in range(len(raw) - n + 1):
            code = 0
            for c in raw[i : i + n]:
                code = code * 257 + c
            counts[(code * 2654435761 & 0xFFFFFFFF) >> 18] += 1
    total = sum(counts.values())
    logits = [sum(k / total * float(model.weights[b, j]) for b, k in counts.items()) + float(model.bias[j]) for j in range(len(model.langs))]
    top = max(logits)
    e = [math.exp((x - top) / model.temperature) for x in logits]
    best = max(range(len(e)), key=e.__getitem__)
    return model.langs[best], e[best] / sum(e), e[best] / sum(e) < model.reject_below


def test_language_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs)
    odd = [(-1, None), (-2, ""), (-3, "  \n"), (-4, "123 %%"), (-5, "ß"), (-6, "日本語の文"), (-7, "ABC abc"), (-8, "ABC abc"), (-9, "the of and " * 20_000)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = language_id.identify(table, model).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score, rejected = plain_language(model, texts[r["doc_id"]])
        assert (r["lang_pred"], r["rejected"]) == (lang, rejected) and abs(r["score"] - score) < 1e-3


def test_language_held_out_accuracy(spark):
    found = language_id.op10_language_id(spark, SMALL.replace("0.001", "0.01")).filter("held_out")
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang", "text").filter(r"lang is not null and text rlike '\\p{L}'")
    right = [r["lang"] == r["lang_pred"] for r in found.join(docs, "doc_id").collect()]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
