"""Line dedup on lines that are alike but not equal, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenarc.llm import line_dedup
from lumenarc.runtime import Workspace


def shingles(line):
    return {line[i : i + 5] for i in range(len(line) - 4)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def groups_of(spark, lines):
    """line -> group, for lines that have one."""
    rows = spark.createDataFrame([(i, line, i) for i, line in enumerate(lines)], "__id long, __text string, __rk long")
    found = line_dedup.similar_lines(rows, Workspace(spark, "test-lines"), 0.8)
    keys = {r["line"]: r["h"] for r in rows.select(F.col("__text").alias("line"), F.xxhash64("__text").alias("h")).collect()}
    grp = {r["lh"]: r["grp"] for r in found.collect()}
    return {line: grp[h] for line, h in keys.items() if h in grp}


def edited(line, at, letters, rng):
    return line[:at] + rng.choice([c for c in letters if c != line[at]]) + line[at + 1 :]


def near_pairs(rng, letters, make, count):
    """Pairs one edit apart with Jaccard 0.8 or more."""
    pairs = []
    while len(pairs) < count:
        a = make(rng)
        b = edited(a, rng.randrange(min(8, len(a))) if len(pairs) % 2 else rng.randrange(len(a)), letters, rng)
        if a != b and jaccard(a, b) >= 0.8:
            pairs.append((a, b))
    return pairs


def test_recall_on_pairs_that_are_not_equal(spark):
    rng = random.Random(5)
    latin, han = "abcdefghijklmnopqrstuvwxyz", [chr(0x4E00 + i) for i in range(3000)]

    def words(n):
        return lambda r: " ".join("".join(r.choices(latin, k=r.randrange(6, 12))) for _ in range(n))

    kinds = {
        "4 words": near_pairs(rng, latin, words(4), 200),
        "8 words": near_pairs(rng, latin, words(8), 200),
        "60 words": near_pairs(rng, latin, words(60), 100),
        "no spaces": near_pairs(rng, han, lambda r: "".join(r.choices(han, k=60)), 200),
    }
    grp = groups_of(spark, [x for pairs in kinds.values() for p in pairs for x in p])
    recall = {k: sum(a in grp and grp[a] == grp.get(b) for a, b in pairs) / len(pairs) for k, pairs in kinds.items()}
    print(recall)
    assert all(share >= 0.95 for share in recall.values()), recall


def brute_groups(lines):
    """Components of two or more lines by all pairs."""
    lines = sorted(set(lines))
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if jaccard(a, b) >= 0.8:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    sizes = {}
    for x in lines:
        sizes.setdefault(find(x), []).append(x)
    return {frozenset(own) for own in sizes.values() if len(own) > 1}


@pytest.mark.parametrize("open_pairs", [10**9, 0], ids=["at once", "by rounds"])
def test_no_pair_of_a_cell_goes_uncompared(spark, monkeypatch, open_pairs):
    monkeypatch.setattr(line_dedup, "band_rows", lambda: [[]])  # all lines in one cell
    monkeypatch.setattr(line_dedup, "OPEN_PAIRS", open_pairs)
    monkeypatch.setattr(line_dedup, "CELL", 2)  # else the one cell is small enough for all pairs
    rng, latin = random.Random(9), "abcdefghijklmnopqrstuvwxyz"
    frame, lines = "the order of this customer was sent on", []
    for _ in range(20):
        line = f"{frame} {''.join(rng.choices(latin, k=16))} {''.join(rng.choices(latin, k=16))}"
        lines += [line, edited(line, rng.randrange(40, len(line)), latin, rng)]
    for _ in range(6):  # chains, whose ends are not alike
        lines.append(edited(lines[-1], rng.randrange(40, len(lines[-1])), latin, rng))
    want = brute_groups(lines)
    assert len(want) >= 15
    found = {}
    for line, grp in groups_of(spark, lines).items():
        found.setdefault(grp, set()).add(line)
    assert {frozenset(x) for x in found.values()} == want


def test_short_lines_take_part(spark):
    rows = [(1, "Les.\n}\n\n今天天气真的很好啊\nabcdefghi"), (2, "Les.\n\n\t\n}\n今天天气真的很好啊"), (3, "abcdefgh\nLes\n\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs).collect()}
    # Blank lines stay; abcdefgh has four of the five shingles of abcdefghi.
    assert got == {1: (rows[0][1], 0), 2: ("\n\t", 3), 3: ("Les\n\t", 1)}


def test_families_of_borderline_lines(spark):
    """Members differ in one of 14 words; all that exact all-pairs joins must be found, and nothing else."""
    rng, latin = random.Random(11), "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(latin, k=rng.randrange(3, 9)))
    lines = []
    for _ in range(150):
        own = [word() for _ in range(14)]
        for _ in range(4):
            lines.append(" ".join(own[:at] + [word()] + own[at + 1 :]) if (at := rng.randrange(14)) else " ".join(own))
    for _ in range(40):  # without spaces: addresses, encoded bytes
        url = "https://example.org/" + "".join(rng.choices(latin, k=100))
        code = "".join(rng.choices(latin + latin.upper() + "0123456789+/", k=76))
        lines += [url, "https://fxample.org/" + url[20:], code, edited(code, 0, latin, rng)]
    # Lines of few different shingles, on both sides of the lengths that are signed whole.
    lines += ["ab" * 95, "ab" * 110, "-" * 300, "-" * 900]
    want, found = brute_groups(lines), {}
    for line, grp in groups_of(spark, lines).items():
        found.setdefault(grp, set()).add(line)
    links = lambda groups: sum(len(g) - 1 for g in groups)
    whole = {x: g for g in want for x in g}
    assert all(len({whole.get(x) for x in g}) == 1 for g in found.values() if len(g) > 1)
    assert links(found.values()) >= 0.98 * links(want)


def test_pairs_that_meet_by_chance_go_no_further(spark, monkeypatch, tmp_path):
    seen, agreeing = [], line_dedup.agreeing
    monkeypatch.setattr(line_dedup, "band_rows", lambda: [[]])  # all lines in one cell
    monkeypatch.setattr(line_dedup, "OPEN_PAIRS", 10**9)
    monkeypatch.setattr(line_dedup, "agreeing", lambda pairs, signed: (seen.append(pairs.count()), agreeing(pairs, signed))[1])
    rng, latin = random.Random(4), "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(rng.choices(latin, k=60)) for _ in range(120)]
    lines += [edited(line, 30, latin, rng) for line in lines[:10]]
    want, found = brute_groups(lines), {}
    for line, grp in groups_of(spark, lines).items():
        found.setdefault(grp, set()).add(line)
    assert len(want) == 10 and {frozenset(x) for x in found.values()} == want
    assert 10 <= sum(seen) <= 40  # of 8,385


def test_pairs_grow_with_the_lines_of_a_family(spark, monkeypatch):
    """Copies of one line, each edited once, meet the least of a cell and not all each other."""
    seen, agreeing = [], line_dedup.agreeing
    monkeypatch.setattr(line_dedup, "agreeing", lambda pairs, done: (found := agreeing(pairs, done), seen.append(found.count()))[0])
    monkeypatch.setattr(line_dedup, "OPEN_PAIRS", 0)
    rng, latin = random.Random(6), "abcdefghijklmnopqrstuvwxyz"
    line = " ".join("".join(rng.choices(latin, k=rng.randrange(4, 9))) for _ in range(40))
    lines = [line] + list({edited(line, rng.randrange(len(line)), latin, rng) for _ in range(62)})
    grp = groups_of(spark, lines)
    assert len({grp[x] for x in lines}) == 1
    assert sum(seen) <= 8 * len(lines)  # of 1,953 or so


def test_lines_just_below_the_threshold_are_not_fetched(spark, monkeypatch):
    """Copies of one line with some words of their own: nearly all pairs are a little less alike than the threshold."""
    seen, agreeing = [], line_dedup.agreeing
    monkeypatch.setattr(line_dedup, "agreeing", lambda pairs, done: (found := agreeing(pairs, done), seen.append(found.count()))[0])
    # All lines in one cell and no judgement by minima: the parities alone must keep all links.
    monkeypatch.setattr(line_dedup, "band_rows", lambda: [[]])
    monkeypatch.setattr(line_dedup, "AGREE", 0)
    rng, latin = random.Random(12), "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choices(latin, k=rng.randrange(4, 9)))
    base = [word() for _ in range(60)]
    lines = [" ".join(word() if rng.random() < 0.07 else x for x in base) for _ in range(120)]
    want, found = brute_groups(lines), {}
    for line, grp in groups_of(spark, lines).items():
        found.setdefault(grp, set()).add(line)
    assert {frozenset(x) for x in found.values()} == want
    assert sum(seen) <= 8 * len(lines), seen  # of 7,140


def test_parities_lose_no_pair(spark):
    rng, latin = random.Random(13), "abcdefghijklmnopqrstuvwxyz"
    lines = ["abcde", "a" * 9, "".join(rng.choices(latin, k=4000))]
    for n in (6, 20, 90, 300, 900, 3000):
        for _ in range(6):
            line = "".join(rng.choices(latin + " ", k=n))
            lines += [line, edited(line, rng.randrange(n), latin, rng), line[: int(n * 0.9)], line[: int(n * 0.7)] + "".join(rng.choices(latin, k=n // 8))]
    rows = line_dedup.parities(spark.createDataFrame(list(enumerate(lines)), "lh long, line string"))
    back = rows.withColumnsRenamed({"lh": "other", "n": "u"} | {f"p{k}": f"q{k}" for k in range(line_dedup.WORDS)})
    got = {(r["lh"], r["other"]) for r in rows.crossJoin(back).filter(line_dedup.may_be_alike(0.8)).select("lh", "other").collect()}
    pairs = [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if min(len(a), len(b)) >= 5]
    alike = {(i, j) for i, j in pairs if jaccard(lines[i], lines[j]) >= 0.8}
    assert alike <= got and len(got) < len(pairs) / 2


def test_grams_are_runs_of_characters(spark):
    lines = ["abcdefg", "日本語の文字列です", "a😀b😀cd", "abcd", "abcde"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    hashes = lambda runs: [r["h"] for r in spark.createDataFrame([(x.encode("utf-32-be"),) for x in runs], "b binary").select(F.xxhash64("b").alias("h")).collect()] if runs else []
    for r in rows.select("line", line_dedup.grams(F.col("line")).alias("g")).collect():
        assert r["g"] == hashes([r["line"][i : i + 5] for i in range(len(r["line"]) - 4)])
