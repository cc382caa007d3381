"""Suffix dedup, packing, Jaccard join, components and the pipeline against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import LONG, texts_of
from tidemark.llm import jaccard, packing, suffixes
from tidemark.llm.bpe import public_path, tokenizer
from tidemark.llm.components import connected_components
from tidemark.llm.queries import ORACLES, QUERIES

WORD_FILE = public_path("word_bpe_49k.json")


def plain_repeats(texts, length):
    data = [t.encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                covered[i : i + length] = True
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[0])
        kept = np.frombuffer(b, np.uint8)[~covered[:-1]].tobytes()
        out.append((len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same_repeats(spark, texts, length, gram, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(d, length, gram, **more).collect()}
    assert [found[i] for i in range(len(texts))] == plain_repeats(texts, length)


@pytest.mark.parametrize("limit", [8 << 20, 300])
def test_repeats_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffixes, "LAST_BYTES", limit)  # a small limit sends groups by single suffixes
    rnd = random.Random(5)
    word = lambda n, a="abcde": "".join(rnd.choice(a) for _ in range(n))
    shared = [word(90) for _ in range(6)]
    texts = ["", "a", "aa" * 60, "ab" * 70 + word(30), "é" * 80, word(40), LONG[:700]]
    for _ in range(60):
        texts.append("".join(rnd.choice([*shared, word(rnd.randint(1, 60)), shared[0][10 : rnd.randint(40, 80)]]) for _ in range(rnd.randint(1, 5))))
    texts += [texts[10], texts[10], texts[11] + "x"]
    same_repeats(spark, texts, 40, 12)


def test_repeats_on_documents(spark, docs):
    texts = [t for _, t in texts_of(docs)]
    same_repeats(spark, texts, 200, 64)


def test_repeats_of_odd_tables(spark, odd, empty):
    rows = suffixes.remove_repeats(odd, keep_text=True).collect()
    assert len(rows) == odd.count() and suffixes.remove_repeats(empty).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [r["n_removed"] for r in by[5]] == [r["n_bytes"] for r in by[5]] and by[6][0]["text"] == ""
    assert by[4][0]["n_removed"] == by[4][0]["n_bytes"] and by[1][0]["n_bytes"] == 0 and None in by
    out = suffixes.strip_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(230)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: root(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_jaccard(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    parent, links = {i: i for i in ids}, Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(set)
    for i in ids:
        for x in sets[i]:
            index[x].add(i)
    for i in ids:
        for j in {j for x in sets[i] for j in index[x] if j > i}:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


def near_copies(rnd, n, words):
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, max(1, words // 25))):
            at = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                w[at] = f"x{rnd.randint(0, 5000)}"
            elif rnd.random() < 0.5:
                w.insert(at, "new")
            elif len(w) > 1:
                del w[at]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, frequent", [(jaccard.BLOCK, jaccard.FREQUENT), (400, jaccard.FREQUENT), (jaccard.BLOCK, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)  # few frequent elements: the order changes, no link does
    rnd = random.Random(11)
    texts = ["", "  ", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e f"]
    for words in (6, 7, 8, 9, 10, 12, 20, 60, 200):
        for _ in range(4):
            texts += near_copies(rnd, 9, words)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"u{rnd.randint(0, 10**6)}" for _ in range(60)) + " " + passage for _ in range(40)]
    texts += texts[20:40]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(d, block).collect()}
    assert found == plain_jaccard(list(enumerate(texts)))


def test_jaccard_on_documents_and_odd_tables(docs, odd, empty):
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.jaccard_components(docs).collect()}
    assert found == plain_jaccard(texts_of(docs))
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and jaccard.jaccard_components(empty).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and by[9]["component_id"] == 8 and by[1]["component_id"] == 1 and by[1]["n_shingles"] == 0
    assert by[None]["component_id"] == 7 == by[7]["component_id"]  # a row without an id joins the group of its text


@pytest.mark.parametrize("heap", [0, jaccard.HEAP])
def test_search_is_exact(monkeypatch, heap):
    monkeypatch.setattr(jaccard, "HEAP", heap)  # 0: all short lists are counted by one array
    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(5, 40)).astype(np.uint64)) for _ in range(120)]
    index = jaccard.Index(sets)
    for x in range(len(sets)):
        found, overlap = index.search(x)
        expected = {y: len(np.intersect1d(sets[x], s)) for y, s in enumerate(sets)}
        assert dict(zip(found.tolist(), overlap.tolist())) == {y: n for y, n in expected.items() if n >= jaccard.least_overlap(len(sets[x]))}


@pytest.mark.parametrize("at", [1, 50, jaccard.COUNT_AT])
def test_frequent_elements_are_counted_in_runs(monkeypatch, at):
    """Runs of any size report each document once; only elements that a run holds LOCAL times are reported by it."""
    monkeypatch.setattr(jaccard, "COUNT_AT", at)
    texts = ["a b c d e f"] * 5 + [f"x{i} a b c d e" for i in range(20)] + [""]
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array(range(len(texts))), jaccard.pa.array(texts)], ["doc_id", "text"])
    rows = [r for out in jaccard._describe(iter([batch, batch]), 7) for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows if r["doc_id"] is not None] == [*range(len(texts))] * 2
    counts = Counter()
    for r in rows:
        if r["element"] is not None:
            assert r["count"] >= jaccard.LOCAL
            counts[r["element"]] += r["count"]
    assert max(counts.values(), default=0) <= 2 * 25
    if at == jaccard.COUNT_AT:
        assert max(counts.values()) == 2 * 25  # a b c d e in every text but the empty one


def test_merge_skip_is_exact():
    rnd = random.Random(2)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(40), rnd.randint(0, 25))) for _ in range(rnd.randint(1, 9))]
        for least in range(1, len(lists) + 1):
            count = Counter(x for y in lists for x in y)
            found, counts = jaccard.merge_skip(lists, least)
            assert list(zip(found.tolist(), counts.tolist())) == sorted((x, n) for x, n in count.items() if n >= least)


def test_products_modulo_the_prime():
    rnd = random.Random(4)
    p = int(suffixes.PRIME)
    a = [0, 1, p - 1, p - 2, 1 << 60, (1 << 32) - 1, 1 << 32, *(rnd.randrange(p) for _ in range(3000))]
    b = a[::-1]
    assert suffixes.multiply(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % p for x, y in zip(a, b)]
    base = suffixes.draw_base()
    data = np.array([rnd.randrange(256) for _ in range(3000)], np.uint8)
    h = suffixes.Strong(data, base)
    for start, size in ((0, 3000), (17, 200), (2999, 1), (5, 0)):
        expected = sum((int(x) + 1) * pow(base, i, p) for i, x in enumerate(data[start : start + size])) % p
        assert h(np.array([start]), np.array([size])).tolist() == [expected]


@pytest.mark.parametrize("depth", [1, 7, 8, 9, 16, 21])
def test_radix_groups_equal_brute_force(depth):
    rnd = random.Random(depth)
    data = np.frombuffer("".join(rnd.choice("ab" if depth > 7 else "abcdefgh") for _ in range(1500)).encode(), np.uint8)
    start = np.arange(len(data) - depth + 1)
    group = np.array([rnd.randrange(3) for _ in start])
    seen = Counter((g, data[i : i + depth].tobytes()) for g, i in zip(group, start))
    assert suffixes.radix_groups(data, start, group, depth).tolist() == [seen[g, data[i : i + depth].tobytes()] > 1 for g, i in zip(group, start)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomials(spark):
    """A Thue-Morse string and its complement share every polynomial hash modulo a power of two."""
    rows = []
    for k in (64, 512, 1024, 4096):
        one = thue_morse(k)
        rows += [one, one.translate(str.maketrans("ab", "ba"))]
    found = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)
    same_repeats(spark, [*rows, "x" + rows[4] + "y"], 200, 64)


def test_words_of_all_lengths():
    words = [b"x" * n + bytes([c]) for n in range(140) for c in b"abcz"] + [b"b" + b"x" * n for n in range(140)]
    words = list(dict.fromkeys(words))
    data = np.frombuffer(b" ".join(words), np.uint8)
    hashes = jaccard._words(data, np.array([0, len(data)]), 5)[0]
    assert len(set(hashes.tolist())) == len(words)
    upper = jaccard._words(np.frombuffer(b" ".join(words).upper(), np.uint8), np.array([0, len(data)]), 5)[0]
    assert (hashes == upper).all()


def check_packing(rows, texts, size):
    t = tokenizer(WORD_FILE)
    expected = Counter()
    for i, text in texts:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END], "<u4")
        for p, at in enumerate(range(0, len(ids), size)):
            expected[i, p, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r["length"] for r in rows) // size)


def test_packing(docs, odd, empty):
    used, least = check_packing(packing.best_fit(docs, WORD_FILE).collect(), texts_of(docs), 2048)
    assert used <= least * 1.03 + 1
    check_packing(packing.best_fit(odd, WORD_FILE, 64).collect(), texts_of(odd), 64)
    assert packing.best_fit(empty, WORD_FILE).count() == 0


def test_plan_places_every_rank_once():
    rnd = random.Random(4)
    for _ in range(60):
        size = rnd.choice([8, 50, 300])
        counts = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, size + 1), rnd.randint(1, size // 2))}
        ranks, fill = defaultdict(set), defaultdict(list)
        for length, low, high, first, at, row in packing.plan(counts, size):
            for r in range(low, high):
                assert r not in ranks[length]
                ranks[length].add(r)
                fill[first + (r - low) // row].append((at + (r - low) % row * length, length))
        assert {n: len(s) for n, s in ranks.items()} == counts
        for places in fill.values():
            end = 0
            for at, length in sorted(places):
                assert at == end
                end += length
            assert end <= size
        bins: list[int] = []  # best fit, one piece after another
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            gap = min((g for g in bins if g >= n), default=None)
            if gap is not None:
                bins.remove(gap)
            bins.append((size if gap is None else gap) - n)
        assert len(fill) <= len(bins) * 1.01 + 1


def test_pipeline(spark, docs):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "secrets", "packing"]
    texts = {}
    now = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = dict(texts_of(now))
        now = stage(spark, now, sf).cache()
        if i < 4:
            assert set(now.columns) == set(docs.columns)
            texts[name] = dict(texts_of(now))
        if name == "near_duplicates":
            groups = plain_jaccard(sorted(before.items()))
            assert set(texts[name]) == {i for i, (_, root, _) in groups.items() if i == root}
        if name == "passages":
            order = sorted(before)
            kept = dict(zip(order, plain_repeats([before[i] for i in order], 200)))
            assert all(len(texts[name][i].encode()) <= kept[i][0] - kept[i][1] for i in order) and set(texts[name]) == set(before)
        if name == "secrets":
            assert set(texts[name]) == set(before)
    check_packing(now.collect(), list(texts["secrets"].items()), 2048)
    assert corpus_pipeline.run(spark, sf).count() == now.count()


def test_pipeline_keeps_rows_apart(spark, odd, empty):
    rnd = random.Random(12)
    say = lambda tag, n: " ".join(f"{tag}{rnd.randint(0, 10**6)}" for _ in range(n))
    twice, alone, passage = say("t", 60), say("n", 60), say("p", 40)
    live = say("k", 30) + " password=Tr0ub4dor-3xyz " + say("l", 30)
    rows = [(20, twice, "s1"), (20, twice, "s1"), (None, alone, "s1"), (None, alone, "s2"), (None, live, "s3"), (21, say("q", 60), "s1"), (21, say("r", 50), "s1")]
    # rows that share an id and a passage, at other places
    rows += [(22, say("v", 30) + passage, "s1"), (22, passage + say("w", 70), "s2"), (None, twice + " end", "s1")]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d = odd.unionByName(more, allowMissingColumns=True).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: stages[name](spark, df, "/root/testdata/sf0.001").cache()
    pairs = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    # linked rows leave one; rows without words all stay
    one = run("near_duplicates", d)
    before, found = pairs(d), pairs(one)
    assert found[20, twice] == 1 == found[None, alone] == found[None, live] and (None, twice + " end") not in found
    gone = {(20, twice): 1, (None, alone): 1, (None, twice + " end"): 1}
    said = next(t for i, t in before if i == 5)
    gone |= {(5, said): 1, (6, said): 1, (None, "a b c d e f g h"): 1, (9, "ONE two\tthree"): 1}
    assert before - found == gone and not found - before and one.columns == d.columns

    # each row loses its own bytes alone
    cut = run("passages", one)
    order = sorted(found.elements(), key=str)
    plain = Counter((i, n - k) for (i, _), (n, k, *_) in zip(order, plain_repeats([t or "" for _, t in order], 200)))
    assert Counter((r["doc_id"], len((r["text"] or "").encode())) for r in cut.collect()) == plain

    clean = run("secrets", cut)
    assert sum("[SECRET]" in (t or "") for _, t in pairs(clean)) == 1 and not any("Tr0ub4dor" in (t or "") for _, t in pairs(clean))
    assert pairs(cut) - pairs(clean) == {(None, live): 1} and clean.columns == d.columns

    rows = run("packing", clean).collect()
    check_packing(rows, [(i, t or "") for i, t in pairs(clean).elements()], 2048)

    for now, n in ((d, None), (empty, 0)):
        for name in stages:
            now = run(name, now)
            assert n is None or now.count() == n
    assert run("near_duplicates", run("quality", empty)).columns == empty.columns


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


def test_long_documents_go_by_stretches(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 9))) for _ in range(900)]
    text = " ".join(rnd.choice(words) for _ in range(4000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = jaccard.shingle_sets(data, np.array([0, len(data)]))[0].tolist()
    monkeypatch.setattr(jaccard, "KERNEL_BYTES", 500)
    assert jaccard.shingle_sets(data, np.array([0, len(data)]))[0].tolist() == whole
    monkeypatch.setattr(suffixes, "KERNEL_BYTES", 300)
    passage = text[1000:1700]
    same_repeats(spark, [text[:5000], "x" + passage, passage[:100] + "y", "zz" * 700], 40, 12)
