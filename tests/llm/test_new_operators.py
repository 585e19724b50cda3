"""Token files, ranked search and cross-tokenizer alignment against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tideline.llm import ranked
from tideline.llm.ranked import build, search
from tideline.llm.token_align import Aligner, align, link_scores
from tideline.llm.token_files import Code, Image, WordEncoder, code_lengths, read_token_files, store_tokens, to_image

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t ", "One", "ONE one\x0bOne\x0ctwo\x1cthree\x85four\xa0five", "I'LL don't they've 'S x's", "Straße ΣΊΣΥΦΟΣ İstanbul ́combining é É", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b",
    "日本語の文章 and 한국어", "\x00\x01 ctrl �", "a" * 5000, "word " * 3000, '."— «quoted» …dots... 3.14 ½ ² ⅷ', "​zero‍width﻿", "👩‍👩‍👧 emoji 👍🏽", "end. Next, one... two!? three;\nfour:", "x.'y a.'s ÀÉ ñandú µ ªº ÷×", "tail　space  line",
]


def test_words_are_encoded_as_the_library_encodes_texts():
    texts = [x or "" for x in ODD] * 2
    ids, counts = WordEncoder(WORDS).encode(pa.array(texts))
    plain = Tokenizer.from_file(WORDS)
    want = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("counts", [[5], [0, 7, 0], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], list(range(1, 700)), [10**12, 1, 1, 1]])
@pytest.mark.parametrize("limit", [4, 10, 16])
def test_code_lengths(counts, limit):
    """Words are no longer than the limit, fill the code space, and cost no more than any plain Huffman code that keeps the limit."""
    import heapq

    lengths = code_lengths(np.array(counts), limit)
    some = [n for n, c in zip(lengths.tolist(), counts, strict=True) if c]
    assert all((n > 0) == (c > 0) for n, c in zip(lengths.tolist(), counts, strict=True))
    assert max(some) <= max(limit, (len(some) - 1).bit_length())
    assert len(some) == 1 or sum(2.0**-n for n in some) == 1
    heap = [(c, i, 0) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = depth = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        depth = max(a[2], b[2]) + 1
        heapq.heappush(heap, (a[0] + b[0], a[1], depth))
    got = sum(n * c for n, c in zip(lengths.tolist(), counts, strict=True))
    assert got >= cost
    if depth and depth <= limit:
        assert got == cost


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1023, 1024, 1025, 70_000, 140_001])
def test_image_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), 5000).astype(np.int64)
    code = Code(code_lengths(np.bincount(ids, minlength=5001)))
    import zlib as z

    counts = np.array([0, n // 3, n - n // 3], np.int64)
    image = Image(to_image([None, -5, 1 << 40], counts, ids, code, z.compress(code.lengths.astype(np.uint8).tobytes())))
    assert image.keys.to_pylist() == [None, -5, 1 << 40] and image.counts.tolist() == counts.tolist()
    assert (image.ids() == ids).all() and image.n_ids == n
    for a, b in ((0, min(n, 5)), (n // 2, n), (min(n, 1024), min(n, 2049))):
        assert (image.ids(a, b) == ids[a:b]).all()


def by_hand(rows, end=2):
    plain, start, out = Tokenizer.from_file(WORDS), 0, []
    for k, x in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = plain.encode(x or "", add_special_tokens=False).ids + ([end] if end is not None else [])
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files(spark):
    """Many small files and ranges, a null id, odd texts, clashing column names."""
    rows = [(i * 7 % 31 - 3, x) for i, x in enumerate(ODD)] + [(None, "no id")] + [(100 + i, "same text here " * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "start": F.lit(1), "image": F.lit("x")}).repartition(3)
    files = store_tokens(df, WORDS, end=2, by_words=True, part_bytes=1000, image_ids=300)
    assert files.count() > 12 and files.select("part").distinct().count() > 5
    got = read_token_files(files)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == by_hand(rows)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]


def test_token_files_of_repeated_ids(spark):
    """Rows of one id follow each other without a gap, in an order that doesn't depend on partitions."""
    rows = [(5, "b c"), (5, "a"), (5, "a"), (1, "x"), (None, None), (5, None)] * 20
    found = []
    for n in (1, 5):
        files = store_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), WORDS, by_words=True)
        found.append(sorted(map(tuple, read_token_files(files, ids=False).collect()), key=lambda r: (r[1], r[2])))
    assert found[0] == found[1] and len(found[0]) == 120
    assert sum(r[2] for r in found[0]) == max(r[1] + r[2] for r in found[0])


def test_token_files_empty_and_other_tokenizer(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_token_files(store_tokens(empty, WORDS, end=2, by_words=True)).collect() == []
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = read_token_files(store_tokens(spark.createDataFrame([(1, "Hello  world"), (0, None)], "doc_id long, text string"), path)).collect()
    want = Tokenizer.from_file(path).encode("Hello  world", add_special_tokens=False).ids
    assert sorted((r["doc_id"], r["start"], r["ids"]) for r in got) == [(0, 0, []), (1, 0, want)]


BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = ["x;\r\ny {\r z\r\r\n w", "tail \r\n", "a ▁ b", "  lead", "trail  ", "a \t\n b\t\tc \n", "one\u2003two\x1cthree", "<s> </s> <unk> <0x41>", "-" * 700 + "=" * 333, "don't I'LL 12345 3.14", "\n\nnew", " ", "\n", "𝔘𝔫𝔦 ñandú naïve"]


def grouped(text, a, b):
    """(groups of ids) of a text by a loop over its bytes, None if it has no tokens."""
    from tideline.llm.token_align import byte_alphabet

    if not text:
        return None
    letters = byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    groups, x, y, at, bt, now = [], [], [], 0, 0, ([], [])
    while ids_a or ids_b:
        if at <= bt and ids_a:
            at += len(bytes_a.pop(0))
            now[0].append(ids_a.pop(0))
        else:
            bt += len(bytes_b.pop(0))
            now[1].append(ids_b.pop(0))
        if at == bt:
            groups.append(now)
            now = ([], [])
    return groups


def links_by_hand(rows):
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    docs = [(k, grouped(x, a, b)) for k, x in rows]
    pairs = [Counter((i, j) for x, y in g or [] for i in x for j in y) for _, g in docs]
    counts = Counter(p for c in pairs for p in c)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (k, g), own in zip(docs, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((k, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(own.values()), sum(t for p, t in own.items() if counts[p] == best[p[0]]), sum(t * counts[p] for p, t in own.items()), sha))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_alignment(spark, frequent):
    """All pairs broadcast, some, none; odd texts; null and repeated ids; clashing names."""
    r = random.Random(frequent)
    vocab = ["the", "The", "unbelievable", "naïve", "日本", "x;", "\r", "\n", "  ", "don't", "1234567", "…", "(a)"]
    rows = list(enumerate([x for x in ODD if x is None or len(x) < 9000] + MORE)) + [(None, "the end"), (3, "the end"), (3, "the end")] + [(100 + i, " ".join(r.choice(vocab) for _ in range(r.randrange(40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pairs": F.lit("clash"), "n": F.lit(1), "row": F.lit("x")}).repartition(3)
    got = link_scores(df, BYTES, PIECES, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(links_by_hand(rows), key=str)


def test_alignment_text_and_empty(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in grouped("Hello world", a, b))
    assert [r["groups"] for r in align(df, BYTES, PIECES, written=True).orderBy("doc_id").collect()] == [want, ""]
    assert link_scores(df.limit(0), BYTES, PIECES).collect() == []


def test_a_long_word():
    """A text without white space, of which groups are long."""
    aligner = Aligner(BYTES, PIECES)
    numbers, _, n, pairs, times = aligner.align(["=" * 100_001 + "é" * 5000])
    assert numbers[3][0] == times.sum() and n[0] == len(pairs)


TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked_by_hand(rows, items, k):
    docs = [(d, Counter(terms_of(x))) for d, x in rows]
    docs = [(d, c) for d, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for i, x in items:
        found = []
        for d, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(x) if c[t])
            if s > 0:
                found.append((s, d))
        found.sort(key=lambda f: (-f[0], f[1] is not None, f[1] or 0))
        out += [(i, r + 1, d, s) for r, (s, d) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("k,segment,block,query", [(20, 1 << 22, 64, 1 << 20), (3, 700, 2, 60), (5, 2000, 7, 1)])
def test_ranked_search(spark, monkeypatch, k, segment, block, query):
    """One and many segments, blocks and blocks of queries; ties, repeated rows and terms, odd texts, clashing names."""
    monkeypatch.setattr(ranked, "QUERY_BYTES", query)
    r = random.Random(k)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ß", "A1"]
    text = lambda n: " ".join(vocab[min(int(r.expovariate(0.08)), len(vocab) - 1)] for _ in range(n))
    rows = [(i, text(r.randrange(1, 60))) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(None, rows[7][1]), (7, rows[7][1]), (500, None), (501, ""), (502, "?! --"), (503, "w1 " * 4000)]
    items = [(i, text(r.randrange(1, 15))) for i in range(12)] + [(50, rows[7][1]), (51, None), (52, "..."), (53, "w0 w0 W0 nowhere"), (None, "w3"), (54, "nowhere else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"segment": F.lit("clash"), "key": F.lit(1)}).repartition(3)
    index = build(docs, segment_bytes=segment, block=block)
    assert segment > 5000 or index.segments.count() > 3
    got = search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit("clash")), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(ranked_by_hand(rows, items, k), key=str)


def test_ranked_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([("x", "b")], "item_id string, text string")
    assert search(build(docs), asked).collect() == []
    assert search(build(some), items).collect() == []
    assert [r["item_id"] for r in search(build(some.unionByName(some)), asked).collect()] == ["x", "x"]
