"""The text operators against brute force and on awkward rows."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import brown, exact_dedup, imatch, jaccard_join, language_id, line_dedup, mixing, packing, quality, url_filter
from lumenarc.runtime import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i % 977} und" for i in range(20_000))
ROWS = [(1, "the quick brown fox jumps over the lazy dog\nand runs away from here", "en", "a"), (2, None, None, None), (3, "", "en", ""), (4, "  \n\t ", "de", "a"), (5, "%%% 123", "en", "b"),
        (6, "the quick brown fox jumps over the lazy dog\nand runs away from here", "en", "a"), (6, "the quick brown fox jumps over the lazy dog\nand runs away from here", "en", "a"),
        (None, "der schnelle braune Fuchs springt weit", "de", "b"), (8, LONG, "de", "c"), (9, "the quick brown fox jumps over the lazy dogs\nEND <|endoftext|>", "en", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "t", "region", "shrink"), [(4, Fraction(85, 100), 1024, 0.8), (5, Fraction(8, 10), 1024, 0.8), (4, Fraction(85, 100), 2, 0.8), (4, Fraction(85, 100), 2, 0.0)])
def test_jaccard_join_finds_all_links(spark, monkeypatch, k, t, region, shrink):
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "SHRINK", shrink)  # 0: all large regions end in blocks
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], k, t.numerator, t.denominator)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.near_duplicates(docs, k, t).collect()}
    assert got == want


def test_voronoi_regions_lose_no_link_and_do_divide():
    rng = np.random.default_rng(3)
    sets, families = [], 60
    for f in range(families):
        base = rng.choice(1 << 40, 80, replace=False)
        shared = rng.choice(1 << 20, 40) + (f % 4 << 30)  # families overlap in fours, below the threshold
        for _ in range(int(rng.integers(1, 12))):
            own = np.concatenate([base, shared, rng.choice(1 << 50, int(rng.integers(0, 14)))])
            sets.append(np.unique(own.astype(np.uint64)))
    t = Fraction(85, 100)
    region, called = jaccard_join.Region(sets, t), []
    inner = region.join
    region.join = lambda members, depth=0: (called.append((depth, len(members))), inner(members, depth))[1]
    region.join(np.arange(len(sets)))
    plain = jaccard_join.Forest(len(sets))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            n = np.intersect1d(sets[i], sets[j]).size
            if 100 * n >= 85 * (sets[i].size + sets[j].size - n):
                plain.join(i, j)
    assert [region.forest.find(i) for i in range(len(sets))] == [plain.find(i) for i in range(len(sets))]
    assert max(d for d, _ in called) >= 2 and sum(n for d, n in called if d == 1) < 4 * len(sets)


def test_jaccard_join_odd_rows(odd, none):
    got = sorted(((r[0], r[2]) for r in jaccard_join.near_duplicates(odd, 4, Fraction(85, 100)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (6, 1), (None, None), (8, 8), (9, 9)], key=str)
    assert jaccard_join.near_duplicates(none, 4, Fraction(85, 100)).count() == 0


def test_exact_dedup(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd, capacity=1).collect()}
    assert (1, 6, 3, False) in got and (6, 6, 3, True) in got and (2, 3, 2, False) in got and (None, None, 1, True) in got
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_chains_texts_that_share_a_key(spark):
    rows = [(i, f"text {i % 7}") for i in range(200)] + [(200 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one_key = lambda body: F.shiftleft(F.pmod(F.length(body), F.lit(2)).cast("long"), 60)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, []).append(i)
    for capacity in (1, 1000):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, capacity=capacity, key=one_key).collect()}
        assert got == {i: (max(by_text[t]), len(by_text[t]), i == max(by_text[t])) for i, t in rows}
    index, _, _ = exact_dedup.build_index(docs, capacity=1, key=one_key)
    assert sorted(r["chain"] for r in index.collect()) == [1, 1, 2, 3, 4, 5, 6, 7]


def test_directory_splits_until_buckets_fit():
    slots = exact_dedup.directory({0: 5, 1: 5, 1 << 15: 3}, 6)
    assert len(slots) == 1 << 16 and slots[0] != slots[1] and slots[-1] == slots[1 << 15]
    assert exact_dedup.directory({}, 6) == [0]


def test_url_filter_against_brute_force(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://example.com", "x://a.b.net/fr/", "net/es/", None, "", "http:///", "http://notexample.com/en/", "s://net/es/1#f", "http://com/", "a://b://c/"]
    rules = [*url_filter.RULES, ("a.b.net", "/fr/", "allow"), ("b.net", "/f", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = next((rest[:n] for n, c in enumerate(rest) if c in "/?#"), rest).lower()
        path = rest[len(host) :]
        path = next((path[:n] for n, c in enumerate(path) if c in "?#"), path)
        fit = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert got[i] == (host, path, fit[1], fit[2]), url


def test_url_filter_stack_of_nested_rules(spark):
    rules = [("com", "", "block"), ("example.com", "/q", "allow"), ("example.com", "", "allow"), ("a.example.com", "", "block"), ("a.example.com", "/q/r", "allow"), ("b.c.org", "/x", "block"), ("", "", "block"), ("COM", "", "allow")]
    hosts = ["com", "x.community", "example.com", "a.example.com", "z.a.example.com", "notexample.com", "b.c.org", "q.b.c.org", "c.org", "a\x01b.com", "", "com.", "e.xample.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/q", "/q/r/s", "/x")] * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, table).collect()}
    best = {}
    for h, p, v in rules:
        best[h.lower(), p] = max(v, best.get((h.lower(), p), ""))
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1]
        host, slash, path = rest.partition("/")
        path = slash + path
        fit = max(((len(h + p), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert got[i] == fit[1:], url
    assert url_filter.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, table.limit(0)).collect()} == {"allow"}


def test_imatch_edits_and_equal_texts(odd, none):
    words = imatch.lexicon(odd, min_share=0.1, max_share=0.9)
    got = imatch.with_next(odd, words, parts=3).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        text, half = r[1] or "", len(r[1] or "") // 2
        want[r[0], len(text), hashlib.sha256((text[: len(text) - half] + (after[1] or "")[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[6] != prints[9] and imatch.with_next(none, words).count() == 0


def test_brown_base_score(spark, odd, none):
    model, rest = brown.fit(odd, Workspace(spark, "t"))
    got = brown.scores(odd, model, rest).collect()
    tokens = [w for r in ROWS for w in [*(r[1] or "").encode().lower().split(), None]]
    c, n = Counter(tokens), len(tokens)
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
        import math

        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in [*text.encode().lower().split(), None])
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want)) and r["train_tokens"] == n and r["score"] < 0
    model, rest = brown.fit(none, Workspace(spark, "t"))
    assert brown.scores(odd, model, rest).count() == len(ROWS)


def test_packing_round_trip(odd, none):
    pieces = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, own in by_doc.items():
        ids = b"".join(bytes(p["ids"]) for p in sorted(own, key=lambda p: p["start"]))
        text = next(r[1] for r in ROWS if r[0] == i) or ""
        assert ids == b"".join(x.to_bytes(4, "little") for x in [*tok.encode(text, add_special_tokens=False).ids, 0])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and zlib.crc32(bytes(p["ids"])) >= 0
            at += p["length"]
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_differencing_is_near_equal():
    found = packing.windows_of([200, 180, 256, 90, 256, 31, 77, 256, 256, 256, 120], 1024)
    assert sorted(i for w in found for i in w) == list(range(11)) and len(found) == 2


def test_line_dedup(odd, none, spark):
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(odd).collect()}
    assert got[1] == ROWS[0][1] and got[6] == "" and got[9] == "END <|endoftext|>" and got[2] is None
    assert line_dedup.line_dedup(none).count() == 0
    clash = odd.selectExpr("*", "1 as n_lines", "2 as line")
    assert line_dedup.line_dedup(clash).count() == len(ROWS)


def test_mixing_keeps_to_budget(spark, none):
    rows = [(i, "a b c d", "en", "big" if i % 10 else "small", 7) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs, max_repeat=2.0).groupBy("source").agg({"n_tokens": "sum", "draw": "max", "doc_id": "count"}).collect()
    n = {r["source"]: r["count(doc_id)"] for r in got}
    assert n["big"] == 1800 and 399 <= n["small"] <= 400
    half = mixing.mix_sources(docs, budget=4000.0, max_repeat=None, entropy=1.0).groupBy("source").sum("n_tokens").collect()
    assert all(1990 <= r[1] <= 2000 for r in half)
    assert mixing.mix_sources(none).count() == 0


def test_first_block_over_the_rest(spark, monkeypatch):
    """Draws do not depend on how the sums over blocks are parted."""
    docs = spark.createDataFrame([(i, "a b c " * (i % 5 + 1), "en", "ab"[i % 7 == 0], 9) for i in range(3000)], SCHEMA)
    found = []
    for bits in (1, 12, 40):
        monkeypatch.setattr(mixing, "RANGE_BITS", bits)
        found.append(sorted((r["doc_id"], r["draw"], r["block_order"]) for r in mixing.mix_sources(docs, max_repeat=1.4).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 3000


def test_neighbour_votes_against_brute_force():
    rng = np.random.default_rng(2)
    rows = [(" ".join(rng.choice(["plain", "word", "text", "good", "calm"], 12)), 1) for _ in range(40)] + [("!! " + " ".join(rng.choice(["BUY", "NOW", "$$$", "x1x"], 9)), 0) for _ in range(40)]
    space = quality.fit(rows, 0.7)
    found = np.stack([quality.terms(t.encode()) for t in ("plain text, good words", "BUY $$$ NOW", "", "plain BUY")])
    latent = space.project(found)
    for got, own in zip(space.vote(latent), latent, strict=True):
        near = sorted(((float(own @ v), i) for i, v in enumerate(space.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [(min(1.0, max(0.0, c)) ** 4 * space.weights[i], space.labels[i]) for c, i in near]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total > 1e-9 else space.prior
        assert abs(got - want) < 1e-5
    assert quality.fit_counts(np.zeros((0, quality.TERMS), np.float32), np.zeros(0), 0.5) is None


def test_imatch_fingerprints_against_plain_python(spark, odd):
    words = imatch.lexicon(odd, min_share=0.1, max_share=0.9)
    texts = [r[1] or "" for r in ROWS]
    terms = [set("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.translate({i: i + 32 for i in range(65, 91)})).encode().split()) for t in texts]
    once = dict(zip(texts, terms, strict=True))  # copies count as one document
    df = Counter(x for own in once.values() for x in own)
    assert sorted(words.at) == sorted(t for t, n in df.items() if 1 <= n <= int(0.9 * len(once)))
    prints = [words.fingerprint(t.encode()) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            used = [x & set(words.at) if len(x & set(words.at)) >= imatch.FEW else x for x in (terms[i], terms[j])]
            same = used[0] == used[1] if any(used) else a == b
            assert (prints[i] == prints[j]) == same
            assert (imatch.likeness(prints[i], prints[j]) == 1.0) == same


def test_imatch_copies_and_tiny_tables(spark):
    hot = " ".join(f"hot{i}" for i in range(60))
    own = [" ".join(f"w{n}x{i}" for i in range(20)) + " " + " ".join(f"common{(n * 7 + i) % 90}" for i in range(40)) for n in range(150)]
    docs = spark.createDataFrame(list(enumerate([hot] * 50 + own)), "doc_id long, text string")
    copies = imatch.hot_texts(docs, 200)
    assert list(copies.values()) == [50]
    df = Counter({bytes(r["term"]).decode(): r["df"] for r in imatch.document_frequencies(docs, hot=copies).collect()})
    assert df == Counter(t for text in [hot, *own] for t in set(text.split()))
    # Copies of the hot text, a quarter of all rows, don't take its terms out of the band; a near copy is found.
    words = imatch.lexicon(docs)
    assert b"hot7" in words.at
    edited = hot.replace("hot30 ", "other ")
    assert 0.2 < imatch.likeness(words.fingerprint(hot.encode()), words.fingerprint(edited.encode())) < 1
    assert imatch.likeness(words.fingerprint(hot.encode()), words.fingerprint(own[0].encode())) < 0.1
    # Three texts: no term fits the band, so all terms count.
    few = imatch.lexicon(docs.filter("doc_id >= 197"))
    assert not few.at and 0.2 < imatch.likeness(few.fingerprint(hot.encode()), few.fingerprint(edited.encode())) < 1
    # The bound on the lexicon lifts the low end of the band.
    small = imatch.lexicon(docs, max_share=0.9, most=100)
    assert sorted(small.at) == sorted(f"common{i}".encode() for i in range(90))
    assert imatch.lexicon(docs.limit(0)).at == {} and imatch.hot_texts(docs.limit(0), 0) == {}


def test_packing_of_blanks_that_break_the_fast_encoder():
    encoder = packing.Encoder()
    assert encoder.ids(" " * 2_000_000) == encoder.exact(" " * 2_000_000)


@pytest.mark.parametrize("extra", ["rest", "rounds", "blocks", "cut", "left", "last", "__s", "__text", "__rk", "TEXT2", "tokens", "share", "line", "pos"])
def test_clashing_columns(spark, extra):
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "en", "ab"[i % 2], 9, f"x{i}") for i in range(6)], f"{SCHEMA}, `{extra}` string")
    for found in (mixing.mix_sources(docs, max_repeat=2.0), line_dedup.line_dedup(docs) if extra in ("__rk", "line") else None, language_id.identify(docs, None, keep=("doc_id", extra)), quality.score(docs, None, keep=("doc_id", extra))):
        if found is not None:
            assert {(r["doc_id"], r[extra]) for r in found.collect()} == {(i, f"x{i}") for i in range(6)}


def test_classifiers_odd_rows(odd, none):
    model = language_id.train([(r[1], r[2]) for r in ROWS if r[1] and r[2]] * 40)
    assert np.isfinite(model.weights).all() and np.isfinite(model.bias).all() and np.isfinite(model.temperature)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert all(0 <= score <= 1 for _, score in got.values())
    assert got[2] == got[3] == got[4] == got[5] == ("und", 0.0) and got[8][0] == "de"
    assert language_id.identify(none, None).count() == 0
    space = quality.fit([("good plain words here", 1), ("BAD!! BAD!! %%%", 0)], 0.5)
    scores = [r["score"] for r in quality.score(odd, space).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores) and quality.score(odd, None).first()["score"] == 0.5


def test_sets_with_a_common_passage_do_not_all_meet():
    """Sets with many thin parts met by their first n-grams, so a passage joined all of them to one region that grows with the table."""
    rng, classes = np.random.default_rng(3), jaccard_join.Classes(Fraction(85, 100))
    passage = np.arange(12, dtype=np.uint64) * np.uint64((1 << 35) + 7)  # first in hash order
    draw = lambda n: rng.integers(1 << 40, 1 << 63, n, np.uint64)
    cells = Counter(int(x) for _ in range(1500) for x in set(classes.signatures(np.unique(np.concatenate([passage, draw(200)]))).tolist()))
    assert max(cells.values()) <= 10
    for size in [1, 2, 3, 5, 7, 8, 10, 13, 20, 35, 60, 110, 200, 330, 700] * 60:  # no linked pair is lost
        a = np.unique(draw(size))
        b, gone = a, int(rng.integers(0, max(1, int(0.15 * a.size)) + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], draw(int(rng.integers(0, 1 + int(0.1 * size))))]))
        if 100 * np.intersect1d(a, b).size >= 85 * np.union1d(a, b).size and not np.array_equal(a, b):
            assert np.intersect1d(classes.signatures(a), classes.signatures(b)).size, (size, gone)
