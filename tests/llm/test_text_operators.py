"""n-gram join, decontamination, substring dedup and line dedup against brute force and on odd input."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import hot_seeds, substring
from tideline.llm import decontaminate as decontaminate_module
from tideline.llm.decontaminate import decontaminate, find_contamination
from tideline.llm.graph import components
from tideline.llm.line_dedup import line_dedup
from tideline.llm.ngram_join import ngram_components
from tideline.llm.queries import QUERIES
from tideline.llm.substring import chains, drop_passages, passages

DOCS = "doc_id long, text string, source string, n_hit long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, s) in enumerate(sets):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, s) in enumerate(sets):
        known = [x for x in ids[find(i)] if x is not None] if s else [d]
        out.append((d, len(s), min(known) if known else None))
    return sorted(out, key=str)


def corpus(seed=0):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "Ünder"]
    rows, i = [], 0
    passage = [r.choice(vocab) for _ in range(60)]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 12, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.03, 0.06]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w += passage
            rows.append((i, " ".join(w).upper() if r.random() < 0.2 else "\n".join([" ".join(w[:5]), " ".join(w[5:])])))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n\t "), (i + 3, "one"), (i + 4, "One"), (None, rows[0][1]), (None, None), (3, rows[3][1])]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (3, 100)])
def test_ngram_components(spark, k, percent):
    rows = corpus(k + percent)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash"))
    got = ngram_components(df, n_words=k, percent=percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows, k, percent)


def test_ngram_large_groups(spark):
    """Hundreds of near copies with a shared passage: no link is lost between blocks."""
    r = random.Random(5)
    base = [f"v{r.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 9, 20])):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute_components(rows, 3, 90)


def test_ngram_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (7, 7), (None, 4), (5, 9), (3, 1), (2, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 8: 5, 9: 5} | {i: 100 for i in range(100, 141)}


def brute_contamination(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, x in items:
            v = words(x)
            k = min(window, len(v))
            grams = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1 if v else 0):
                if tuple(w[p : p + k]) in grams:
                    hit |= set(range(p, p + k))
                    if i is not None:
                        names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_contamination(spark, block):
    r = random.Random(2)
    vocab = ["a", "b", "c", "der", "é", "10"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([2, 5, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, ""), (52, "?!"), (None, "b b b a a a der der"), (1, "repeat of an id")]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 4, 30, 120])))) for i in range(40)]
    docs += [(90 + i, f"X y, {(t or '').upper()} -- z") for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (90, docs[0][1]), (None, items[3][1]), (202, "word " * 30000 + items[5][1])]
    df = spark.createDataFrame([(d, t, "s", 7) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(df, bench, block_bytes=block)
    got = sorted(((r["row"]["doc_id"], r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
    want = brute_contamination(docs, items)
    assert got == want
    kept = decontaminate(df, bench, block_bytes=block)
    assert kept.columns == df.columns and kept.count() == sum(not h for _, _, h, _ in want)
    for row in found.where("contaminated").collect():  # a match is the same words in both
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(row["row"]["text"]))
        assert row["matches"] and len({m["word"] for m in row["matches"]}) == len(row["matches"])
        for m in row["matches"]:
            texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) for i, t in items if (str(i) if i is not None else None) == m["item_id"]]
            assert any(v[m["item_word"] : m["item_word"] + m["words"]] == w[m["word"] : m["word"] + m["words"]] for v in texts)


def test_longest_matches():
    """Each place's longest match, against all pairs of places."""
    r = random.Random(4)
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.choice([3, 10, 12, 30])))) for i in range(6)]
    docs = [" ".join(r.choice("abcd") for _ in range(200)) + " " + r.choice(items)[1] for _ in range(12)]
    coded = decontaminate_module.Items(items, 4)
    for d, (n, _, names, _, matches) in zip(docs, decontaminate_module.scan_slice(docs, iter([coded])), strict=True):
        w, longest, found = d.split(), {}, set()
        for i, x in items:
            v = x.split()
            for a in range(len(v) - min(4, len(v)) + 1):
                for p in range(n):
                    k = 0
                    while p + k < n and a + k < len(v) and w[p + k] == v[a + k]:
                        k += 1
                    if k >= min(4, len(v)):
                        longest[p] = max(longest.get(p, 0), k)
                        found.add(i)
        assert names == sorted(found)
        assert {(m["word"], m["words"]) for m in matches} == {(p, k) for p, k in longest.items() if longest.get(p - 1, 0) <= k}
        text = dict(items)
        assert all(text[m["item_id"]].split()[m["item_word"] : m["item_word"] + m["words"]] == w[m["word"] : m["word"] + m["words"]] for m in matches)


def test_contamination_of_repetitions():
    """Time and memory grow with the texts, not with their product."""
    began = time.perf_counter()
    items = decontaminate_module.Items([("a", "x " * 2000), ("b", "x y " * 500)], 10)
    ((n, hit, names, bad, matches),) = decontaminate_module.scan_slice(["x " * 32_000], iter([items]))
    assert (n, hit, names, bad, [(m["words"], m["word"]) for m in matches]) == (32_000, 32_000, ["a"], True, [(2000, p) for p in range(30_001)])
    assert time.perf_counter() - began < 10


def test_contamination_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b", "s", 0)], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).count() == 1
    assert find_contamination(spark.createDataFrame([], DOCS), none).collect() == []


def test_chains():
    x, y = np.array([(0, 0), (10, 10), (20, 21), (500, 3), (30, 29), (12, 400), (13, 13), (10, 10)]).T
    k = substring.K
    assert [(0, 0, k), (10, 10, k + 3), (20, 21, k), (30, 29, k)] in chains(x, y)  # anchors that overlap on a diagonal are one block
    far = np.array([0, 1000])
    assert chains(far, far) == []  # the gap costs more than an anchor gains
    assert chains(far[:0], far[:0]) == []
    assert chains(np.array([5]), np.array([9]), np.array([44])) == [[(5, 9, 44)]]


def test_straight():
    """The short way gives what the alignment gives."""
    r = np.random.default_rng(3)
    short = 0
    for _ in range(400):
        a, b = r.integers(0, 1 << 30, (2, 260)).astype(np.uint32)
        x, y, n = int(r.integers(60, 120)), int(r.integers(60, 120)), int(r.integers(7, 80))
        lo, hi = x - int(r.integers(0, 50)), x + n + int(r.integers(0, 50))
        b[lo - x + y : hi - x + y] = a[lo:hi]
        for i in range(lo, hi):
            if not x <= i < x + n and r.random() < r.choice([0, 0.1, 0.3]):
                b[i - x + y] = 1
        got, want = substring.straight(x, y, n, a, 0, b, 0, 50), substring.align([(x, y, n)], a, 0, b, 0)
        assert got is None or got == want
        short += got is not None
    assert short > 200


def test_passages(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    shared, fuzzy = [word() for _ in range(70)], [word() for _ in range(120)]
    rows = []
    for i in range(30):
        w = [word() for _ in range(r.randrange(60, 200))]
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = shared
        if i % 5 == 1:
            f = list(fuzzy)
            f[40], f[80] = word(), word()
            w += f
        rows.append((i, " ".join(w)))
    rows += [(100, rows[2][1]), (101, rows[2][1]), (102, None), (103, ""), (104, "few words"), (None, rows[0][1]), (4, rows[4][1]), (105, "same " * 3000)]
    df = spark.createDataFrame([(d, t, "s", 0) for d, t in rows], DOCS)
    found = passages(df).collect()
    held = {d: set() for d, _ in rows}
    for p in found:
        assert p.end - p.start >= 50 and p.matches >= 0.8 * (p.end - p.start)
        for d in (p.doc_id, p.other):
            held[d].add((p.doc_id, p.other))
    for i in range(30):
        assert bool(held[i]) == (i % 3 == 0 or i % 5 == 1 or i == 2), i
    assert {(100, 2), (101, 2)} <= held[2]
    text = dict(rows[:30])
    for p in found:
        if p.doc_id < 30 and p.doc_id % 5 != 1 and p.other % 5 != 1:
            assert text[p.doc_id].split()[p.start : p.end] == text[p.other].split()[p.other_start : p.other_end]
    cut = {r.doc_id: r.text for r in drop_passages(df, passages(df)).collect() if r.doc_id is not None}
    assert cut[1] == text[1] and cut[101] == "" and cut[102] is None
    assert sum(all(x in t.split() for x in shared) for t in cut.values() if t) == 1


def test_passages_apart(spark):
    """Two exact passages with other text between, in one order, are both found, with their own bounds."""
    r = random.Random(5)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, want = [], set()
    for i, (n, gap) in enumerate([(60, 40), (100, 60), (100, 100), (100, 150)]):
        one, two = words(n), words(n)
        for d in (2 * i, 2 * i + 1):
            rows.append((d, " ".join(words(30) + one + words(gap) + two + words(30)), "s", 0))
            want |= {(d, 30, 30 + n), (d, 30 + n + gap, 30 + 2 * n + gap)}
    found = passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(p.doc_id, p.start, p.end) for p in found} == want
    assert all(p.matches == p.end - p.start for p in found)


def test_passages_copies_in_any_order(spark):
    """The least key of a text has its passages, also where a task reads another copy first."""
    r = random.Random(8)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    shared = words(70)
    rows = [(d, " ".join(words(30) + shared + words(30)), "s", 0) for d in (1, 90)]
    rows = [(d, " ".join(text), "s", 0) for text in [words(40) + shared + words(40)] for d in (17, 12, 15)] + rows
    found = passages(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert {(p.doc_id, p.other) for p in found} >= {(12, 1), (12, 90), (17, 12), (15, 12)}
    assert all((p.start, p.end) == (40, 110) for p in found if p.doc_id == 12)


def test_passages_within_a_document(spark):
    """A passage that stands twice in a text is found at both places, and the text alone is enough."""
    r = random.Random(9)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    own, shared = words(70), words(80)
    rows = [(1, words(20) + own + words(40) + own + words(20)), (2, words(15) + shared + words(15)), (3, words(10) + shared + words(50) + shared + words(10))]
    df = spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)
    found = passages(df)
    got = {(p.doc_id, p.other, p.start, p.end, p.other_start) for p in found.collect()}
    assert {(1, 1, 130, 200, 20), (3, 2, 10, 90, 15), (2, 3, 15, 95, 10)} <= got  # the second place refers to document 2 or to the first one
    assert {(3, 2, 140, 220, 15), (3, 3, 140, 220, 10)} & got
    cut = {p.doc_id: p.text.split() for p in drop_passages(df, found).collect()}
    assert cut[1].count(own[0]) == 1 and shared[0] not in cut[3] and cut[2] == rows[1][1]


def test_passages_of_repetitions(spark):
    """A word or line on and on gives few rows, which cover it."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    line = [word() for _ in range(30)]
    rows = [(i, [word()] * 5 + ["the"] * n + [word()] * 3) for i, n in enumerate((300, 1900, 40, 800))] + [(10, line * 12), (11, [word() for _ in range(70)] + line * 5)]
    found = passages(spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)).collect()
    assert len(found) < 60 and all(p.matches >= 0.8 * (p.end - p.start) for p in found)
    covered = {d: {q for p in found if p.doc_id == d for q in range(p.start, p.end)} for d, _ in rows}
    assert all(set(range(5, 5 + n)) <= covered[i] | set(range(12)) for i, n in ((1, 1900), (3, 800)))
    assert len(covered[10]) >= 330 and set(range(70, 220)) <= covered[11] and len(covered[2] - set(range(48))) == 0


def test_passages_recall(spark):
    """Substituted words, near the thresholds: recall against all pairs that were planted."""
    r = random.Random(10)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, asked = [], {}
    for n, differ in ((50, 5), (80, 12), (100, 15), (100, 18), (150, 30)):
        for _ in range(20):
            one = words(n)
            two = list(one)
            for i in r.sample(range(1, n - 1), differ):
                two[i] = words(1)[0]
            asked.setdefault((n, differ), []).append(len(rows) + 1)
            rows += [(len(rows), words(30) + one + words(30)), (len(rows) + 1, words(30) + two + words(30))]
    for _ in range(20):
        one = words(150)
        asked.setdefault("every 8th", []).append(len(rows) + 1)
        rows += [(len(rows), words(30) + one + words(30)), (len(rows) + 1, words(30) + [words(1)[0] if i % 8 == 7 else w for i, w in enumerate(one)] + words(30))]
    found = {(p.doc_id, p.other) for p in passages(spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)).collect()}
    print({kind: sum((d, d - 1) in found for d in ids) for kind, ids in asked.items()})
    for kind, ids in asked.items():
        assert sum((d, d - 1) in found for d in ids) >= 0.9 * len(ids), kind
    assert all(abs(d - o) == 1 for d, o in found)


def test_passages_of_every_pair(spark):
    """Variants of one passage: each pair has a row, not only those with a first text; so do texts that share more with each other than with many that quote a part."""
    r = random.Random(21)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    base, long = words(120), words(60)
    rows = []
    for d in range(12):
        w = list(base)
        for i in r.sample(range(1, 119), 9):
            w[i] = words(1)[0]
        rows.append((d, words(30) + w + words(30)))
    parts = [(100 + d, words(20) + long[at : at + 30] + words(20)) for d, at in enumerate((0, 10, 20, 30) * 10)]
    rows += parts + [(200, words(30) + long + words(30)), (201, words(30) + long + words(30))]
    df = spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)
    found = {(p.doc_id, p.other) for p in passages(df).collect()}
    assert {(a, b) for a in range(12) for b in range(12) if a != b} <= found
    assert {(200, 201), (201, 200)} <= found
    assert not any((a < 100) != (b < 100) for a, b in found)


@pytest.mark.parametrize("run", [1 << 16, 40])
def test_passages_of_hot_windows(spark, monkeypatch, run):
    """A passage of more texts than are all paired: all hang together, also where a seed's rows come in parts."""
    monkeypatch.setattr(substring, "RUN", run)
    r = random.Random(22)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    long = words(70)
    rows = [(d, " ".join([f"a{d}x{i}" for i in range(25)] + long + [f"b{d}x{i}" for i in range(25)]), "s", 0) for d in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    found = passages(df).collect()
    assert {(p.start, p.end) for p in found} == {(25, 95)}
    links = spark.createDataFrame([(p.doc_id, p.other) for p in found], "a long, b long")
    assert {r.label for r in components(links).collect()} == {0} and {p.doc_id for p in found} == set(range(150))


@pytest.mark.parametrize("block", [1 << 13, 32])
def test_passages_behind_hot_seeds(spark, monkeypatch, block):
    """Two texts whose common seeds are all in more texts than are paired have their passage, with other words or one more in it; so have near copies that share no window."""
    monkeypatch.setattr(substring, "BLOCK", block)
    r = random.Random(31)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, one, two, copied = [], words(90), words(60), words(120)
    for d in range(200):
        at, to = r.randrange(81), r.randrange(51)
        rows.append((1000 + d, words(30) + one[at : at + 10] + words(30) + two[to : to + 10] + words(30)))
    other = [words(1)[0] if i in (30, 60) else w for i, w in enumerate(one)]
    rows += [(1, words(30) + one + words(30)), (2, words(30) + other + words(30))]
    rows += [(3, words(30) + two + words(30)), (4, words(30) + two[:30] + words(1) + two[30:] + words(30))]
    for d in range(100):
        rows.append((10 + d, words(30) + [words(1)[0] if i % 25 == d % 25 else w for i, w in enumerate(copied)] + words(30)))
    found = passages(spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)).collect()
    got = {(p.doc_id, p.other, p.start, p.end) for p in found}
    assert {(1, 2, 30, 120), (2, 1, 30, 120), (3, 4, 30, 90), (4, 3, 30, 91)} <= got
    links = spark.createDataFrame([(p.doc_id, p.other) for p in found], "a long, b long")
    label = {p.id if hasattr(p, "id") else p[0]: p.label for p in components(links).collect()}
    assert {label[10 + d] for d in range(100)} == {10}
    assert not any(d >= 1000 for d in label)


def test_hot_seeds_meet_by_rare_words(monkeypatch):
    """Occurrences of a seed hang together as if each had been compared with every other, whether or not the seed is one word on and on; few of them are."""
    r = np.random.default_rng(33)
    far, k, text, compared = 43, substring.K, 0, []
    on_diagonal = hot_seeds.on_diagonal
    monkeypatch.setattr(hot_seeds, "on_diagonal", lambda a, b, *more: (compared.append(len(a)), on_diagonal(a, b, *more))[1])
    for one_word in (False, True):
        rows, texts = [], []
        while len(rows) < 1500:
            text += 1
            w = r.integers(1, 1 << 16, 2 * far + k)
            if one_word:  # the seed's word on and on between two others
                i, j = r.integers(0, far + 1, 2)
                w[:] = 7
                w[: far - i], w[far + k + j :] = r.integers(20, 60, 2)
                w[r.random(len(w)) < r.choice([0, 0.1])] = 9
            w[far : far + k] = 7 if one_word else range(1, k + 1)
            if r.random() < 0.3:  # beyond the text
                w[: r.integers(0, far)] = 0
            for _ in range(r.choice([1, 1, 1, 2, 5])):
                v = w.copy()
                some = (r.random(len(w)) < r.choice([0, 0.1, 0.25])) & (w > 0)
                some[far : far + k] = False
                v[some] = r.integers(1, 1 << 16, int(some.sum()))
                rows.append(v)
                texts.append(text)
        words, texts = np.array(rows).astype(np.uint16), np.array(texts)
        n, every = len(words), np.arange(len(words))

        def label(found, n=n):
            of = hot_seeds.Labels(n)
            for a, b in found:
                of.unite(a, b)
            return of.of

        alike = [np.flatnonzero(on_diagonal(words, np.broadcast_to(words[i], words.shape), 50, 40)) for i in range(n)]
        want = label((at, np.full(len(at), i)) for i, at in enumerate(alike))
        compared.clear()
        whole = list(hot_seeds.links(words, texts, every, None, far, 50, 0.8))
        assert sum(compared) < 20 * n, sum(compared) / n
        a, b = (np.concatenate(v) for v in zip(*whole, strict=True))
        assert (on_diagonal(words[a], words[b], 50, 40) | hot_seeds.with_gaps(words[a], words[b], far, 40)).all()
        got = label(whole)
        assert len(np.unique(want)) > 100 and all(len(np.unique(got[want == x])) == 1 for x in np.unique(want))
        block, parts = every % 3, []
        for low, high in [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]:
            at = np.flatnonzero((block == low) | (block == high))
            first, second = (np.flatnonzero(block[at] == x) for x in (low, high))
            parts += [(at[a], at[b]) for a, b in hot_seeds.links(words[at], texts[at], first, None if low == high else second, far, 50, 0.8)]
        got = label(parts)
        assert all(len(np.unique(got[want == x])) == 1 for x in np.unique(want))


def test_passages_ship_words_once(spark, monkeypatch):
    """A text's own words go to the alignment of its pairs once, not for each of them, and seeds to no table."""
    r = random.Random(23)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    base, tables, write = words(100), {}, substring.scratch.table

    def table(df, name):
        out = write(df, name)
        tables[name] = out.count()
        return out

    monkeypatch.setattr(substring.scratch, "table", table)
    rows = [(d, " ".join(words(10) + base[:50] + words(1) + base[51:] + words(10)), "s", 0) for d in range(20)]
    found = passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(p.doc_id, p.other) for p in found} == {(a, b) for a in range(20) for b in range(20) if a != b}
    assert tables["wanted"] <= 2 * (190 + 20)  # two tiles of the partner for a pair, and of the text itself
    assert "profiles" not in tables


def test_hashes_of_words():
    """Words of several texts at once: as Python splits them, whatever the runs that are hashed together."""
    r = random.Random(24)
    several = ["a B\tc", "", "  x\x0by ", "\u00e9\u00c9 b", "\n", "ab"] + ["".join(r.choice("ab A\t\n\x0c\r\u00a0") for _ in range(r.randrange(60))) for _ in range(500)]
    want = [x.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split() for x in several]
    for run in (3, 1 << 16):
        substring.WORDS, kept = run, substring.WORDS
        h, many = substring.hashes_of(several)
        substring.WORDS = kept
        assert many.tolist() == substring.words_of(several).tolist() == [len(w) for w in want]
        every = [w for words in want for w in words]
        assert len(set(zip(every, h.tolist(), strict=True))) == len(set(every)) == len(set(h.tolist()))


def test_chains_with_and_without_tree(monkeypatch):
    r = np.random.default_rng(25)
    cases = [(np.sort(r.integers(0, 300, n)), r.integers(0, 300, n), r.choice([substring.K, 44], n)) for n in r.integers(1, 9, 300)]
    got = [chains(*c, 1) for c in cases]
    monkeypatch.setattr(substring, "FEW", 1)
    assert got == [chains(*c, 1) for c in cases]


def test_gaps():
    """Short gaps are aligned by longest common subsequence, long ones from both ends."""
    r = random.Random(6)
    a, b = ([r.randrange(5) for _ in range(n)] for n in (70, 90))
    pairs = substring._between(np.array(a), np.array(b))
    lengths = [[0] * 91 for _ in range(71)]
    for i in range(70):
        for j in range(90):
            lengths[i + 1][j + 1] = lengths[i][j] + 1 if a[i] == b[j] else max(lengths[i][j + 1], lengths[i + 1][j])
    assert len(pairs) == lengths[70][90]
    assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    one, two = np.arange(20_000), np.arange(50_000, 90_000)
    two[:30], two[-40:] = one[:30], one[-40:]
    assert substring._between(one, two) == [(i, i) for i in range(30)] + [(19_960 + i, 39_960 + i) for i in range(40)]


def test_passages_behind_short_quotes(spark):
    """Two texts with a common passage have it, whatever shorter parts of it others quote."""
    r = random.Random(11)
    words = lambda n: ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows, want = [], set()
    for case, (n, most) in enumerate([(60, 44), (60, 45), (80, 49), (120, 49), (60, 48), (90, 46)] * 4):
        one, base = words(n), 100 * case
        quoting = [d for d in range(base, base + 16) if d not in (base + 7, base + 8)]
        for d in quoting:
            size = r.randrange(40, most + 1)
            at = r.randrange(n - size + 1)
            rows.append((d, words(40) + one[at : at + size] + words(40)))
        rows += [(d, words(40) + one + words(40)) for d in (base + 7, base + 8)]
        want |= {(base + 7, 40, 40 + n), (base + 8, 40, 40 + n)}
    found = passages(spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)).collect()
    got = {(p.doc_id, p.start, p.end) for p in found}
    assert len(want & got) == len(want), sorted(want - got)


def test_passages_brute_force(spark):
    """Exact passages of random corpora: every place that a second text has too lies in a found passage, and nothing else does.

    Where the partner's passage is shorter by less than a seed, so is the one found.
    """
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [words(r.randrange(50, 200)) for _ in range(12)]
    rows = []
    for d in range(80):
        w = words(r.randrange(20, 150))
        for _ in range(r.randrange(3)):
            one = r.choice(shared)
            i = r.randrange(len(one) - 49)
            w += one[i : i + r.randrange(50, 201)] + words(r.randrange(60, 120))
        rows.append((d, w))
    at = {}
    for d, w in rows:
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    want = {(d, p) for places in at.values() if len(places) > 1 for d, i in places for p in range(i, i + 50)}
    found = passages(spark.createDataFrame([(d, " ".join(w), "s", 0) for d, w in rows], DOCS)).collect()
    got = {(f.doc_id, p) for f in found for p in range(f.start, f.end)}
    assert all(any((d, q) in got for q in range(p - substring.K, p + substring.K + 1)) for d, p in want - got)
    assert len(want - got) <= 0.01 * len(want)
    assert len(got - want) <= 0.1 * len(want)  # a passage's ends may match a few words more


def test_passages_empty(spark):
    assert passages(spark.createDataFrame([], DOCS)).collect() == []


def test_line_dedup(spark):
    rows = [(i, f"menu\nown line {i}\n\nmenu \n  footer", "a", 1) for i in range(12)]
    rows += [(20 + i, f"own {i}\nmenu", "b", 1) for i in range(40)] + [(60 + i, "copied text\nof many pages", "b", 1) for i in range(30)]
    rows += [(200, "single\npage", "c", 1), (201, "of\nfew", "d", 1), (202, "of\nother", "d", 1)]
    rows += [(100, None, "a", 1), (101, "", "a", 1), (102, "menu", "a", 1), (103, "menu\nmenu", None, 1), (0, rows[0][1], "a", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("clash")).withColumn("kept", F.lit("clash"))
    got = {}
    for r in line_dedup(df).collect():
        got.setdefault(r["row"]["doc_id"], []).append((r.n_lines, r.n_dropped, r.kept))
    assert got[0] == [(5, 4, "")] * 2  # its own line is on two of sixteen pages
    assert got[1] == [(5, 3, "own line 1\n")]
    assert got[25] == [(2, 1, "own 5")]
    assert got[70] == [(2, 2, "")] and got[200] == [(2, 0, "single\npage")] and got[201] == [(2, 1, "few")]
    once = {r["row"]["doc_id"]: (r.n_dropped, r.kept) for r in line_dedup(df, copies_once=True).collect()}
    assert once[70] == (0, "copied text\nof many pages") and once[25] == (1, "own 5") and once[201] == (1, "few")
    assert got[100] == [(0, 0, None)] and got[101] == [(1, 0, "")] and got[102] == [(1, 1, "")] and got[103] == [(2, 0, "menu\nmenu")]
    assert line_dedup(df.limit(0)).collect() == []


def test_op3_digest(spark, sf):
    rows = QUERIES["op3_decontamination"](spark, sf).where("not contaminated").limit(1).collect()
    assert rows[0].items_sha256 == hashlib.sha256(b"").hexdigest()
