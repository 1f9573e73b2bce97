"""Each stage of the pipeline against a plain version over the same rows."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
from test_operators import ROWS, SCHEMA, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from lumenarc.llm import language_id
from lumenarc.llm.common import fold

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the last result, as lists of rows."""
    docs, found = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    from lumenarc.runtime import Workspace

    work = Workspace(spark, "stages")
    found["given"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = work.save(stage(spark, docs, DIR), name)
        found[name] = docs.collect()
    return found


def test_language_rejects_what_the_model_rejects(spark, stages):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = language_id.train(language_id.sample(docs.filter(fold(docs.doc_id, 4) != 2), "text", "lang"))
    judged = {r["doc_id"]: r["rejected"] for r in language_id.identify(docs, model).collect()}
    assert sorted(r["doc_id"] for r in stages["language"]) == sorted(i for i, gone in judged.items() if not gone)
    given = {r["doc_id"]: r for r in stages["given"]}
    assert all(given[r["doc_id"]] == r for r in stages["language"])
    letters = {i for i, r in given.items() if any(c.isalpha() for c in r["text"] or "")}
    kept = {r["doc_id"] for r in stages["language"]}
    assert kept <= letters and len(kept) >= 0.95 * len(letters)


def brute_lines(rows):
    """doc_id -> text after exact removal of all but the first of each group of equal or similar lines."""
    places, grams = defaultdict(list), {}
    for r in rows:
        for pos, line in enumerate((r["text"] or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places[line].append((r["doc_id"], pos))
                grams[line] = {line[i : i + 5] for i in range(len(line) - 4)}
    up, order = {x: x for x in places}, sorted(places, key=lambda x: len(grams[x]))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(order):
        if not grams[a]:
            continue  # shorter than a shingle: only equal to itself
        for b in order[i + 1 :]:
            if 5 * len(grams[a]) < 4 * len(grams[b]):
                break
            n = len(grams[a] & grams[b])
            if 5 * n >= 4 * (len(grams[a]) + len(grams[b]) - n):
                up[find(b)] = find(a)
    groups = defaultdict(list)
    for x, at in places.items():
        groups[find(x)] += at
    gone = {p for at in groups.values() for p in sorted(at)[1:]}
    return {r["doc_id"]: [(pos, line) for pos, line in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], pos) not in gone] for r in rows}, len(gone)


def test_lines_against_all_pairs(stages):
    want, removed = brute_lines(stages["language"])
    got = {r["doc_id"]: r["text"] for r in stages["lines"]}
    lines = lambda texts: sum(t.count("\n") + 1 for t in texts if t)
    exact = {i: "\n".join(line for _, line in kept) for i, kept in want.items()}
    differ = lines(got.values()) - lines(t for i, t in exact.items() if i in got)
    # Banding may miss a group; nothing may go that all pairs keep.
    assert 0 <= differ <= 0.01 * removed
    assert all(Counter(exact[i].split("\n")) <= Counter(t.split("\n")) for i, t in got.items() if exact[i])
    assert {i for i, t in exact.items() if t.strip()} <= set(got)
    assert all(r["n_chars"] == len(r["text"]) for r in stages["lines"])


def test_near_keeps_one_of_each_group(stages):
    want = brute_components([(r["doc_id"], r["text"]) for r in stages["lines"]], 5, 8, 10)
    assert sorted(r["doc_id"] for r in stages["near"]) == sorted({c for _, c in want.values()})
    given = {r["doc_id"]: r for r in stages["lines"]}
    assert all(given[r["doc_id"]] == r for r in stages["near"])


def test_near_tells_rows_that_share_an_id_apart(spark):
    """Of rows with one id or none only those go that are near a row of lesser id."""
    a, b, c = ("one two three four five six seven eight", "nothing of all that is in any other text here", "a third one that nobody else has ever written down")
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c), (3, None), (3, ""), (4, a + " nine"), (5, c)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __row int")
    got = corpus_pipeline.near(spark, docs, DIR)
    assert got.columns == docs.columns
    assert {rows[r[2]] for r in got.collect()} == {(1, a), (2, b), (3, None), (3, ""), (5, c)}


def test_mix_draws_all_within_the_limit(stages):
    given = {r["doc_id"]: r for r in stages["near"]}
    draws = Counter(r["doc_id"] for r in stages["mix"])
    assert set(draws) == set(given) and all(given[r["doc_id"]] == r for r in stages["mix"])
    tokens, drawn = Counter(), Counter()
    for i, r in given.items():
        n = len((r["text"] or "").split())
        tokens[r["source"]] += n
        drawn[r["source"]] += n * draws[i]
    assert all(drawn[s] <= corpus_pipeline.MAX_REPEAT * tokens[s] * 1.001 for s in tokens)
    assert max(Fraction(drawn[s], tokens[s]) for s in tokens if tokens[s]) > 1


def test_windows_hold_every_id_once(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in stages["near"]}
    draws, held, by_window = Counter(r["doc_id"] for r in stages["mix"]), Counter(), defaultdict(list)
    for p in stages["windows"]:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        held.update((p["doc_id"], k) for k in range(p["start"], p["start"] + p["length"]))
        by_window[p["sequence_id"]].append((p["offset"], p["length"]))
    assert held == Counter({(i, k): n for i, n in draws.items() for k in range(len(ids[i]))})
    for own in by_window.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("rows", [ROWS, []], ids=["odd", "none"])
def test_run_on_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).selectExpr("*", "1 AS line", "2 AS n_tokens", "3 AS component_id", "'x' AS lang_pred")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() >= 0
