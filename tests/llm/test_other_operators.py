"""URL filter, quality classifier, sharding, chat formatting, TIFF and BPE: brute force, round trips and odd input."""

import base64
import hashlib
import math
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tideline.llm import bpe, quality
from tideline.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, codec
from tideline.llm.chat_format import preference_pairs
from tideline.llm.queries import QUERIES, RANKS
from tideline.llm.sharding import pack, shard
from tideline.llm.tiff import COMPRESSIONS, DAMAGE, FORMS, encode_tiff, lzw_decode, pad, tiff_digests, tiff_pages, to_tiff, unpack_bits, walk
from tideline.llm.url_filter import RULES, entropy, judge, labelled_by_rules, lexical, parse, train

LONG = "x" * 700 + " " + "йцукен" * 300 + " " + "日本語" * 200
TEXTS = ["", "a", "  two  spaces\n\n\nand 's it's", "12½ Ⅷ ３ ４", "🎉👩‍👩‍👧 !!?? \t end ", LONG, "the quick brown fox " * 50, None]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG/x?y#z", "http://example.org/es/1", "http://www.example.org/en/12", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/a?b=c&d=e",
    "http://x.com", "http://x.org?q", "ftp://ÄB.net/a://b", "http://a.net/\n/x", "http://org/", "http://example.org/en/2", "http://b.net/" + "9" * 5000,
]


def test_url_filter(spark):
    rows = [(i, u, "row") for i, u in enumerate(URLS + [f"http://site{i}.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(60)] + [URLS[4]])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = judge(df, train(labelled_by_rules(df), trees=3)).orderBy("page_id").collect()
    for (i, u, _), r in zip(rows, out, strict=True):
        host, path, best = brute_url(u)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, best[0] if best else None), u
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    empty = df.limit(0)
    assert judge(empty, train(labelled_by_rules(empty))).collect() == []
    assert {r.verdict for r in judge(df.where("page_id = 3"), train(labelled_by_rules(empty))).collect()} == {"allow"}


def test_url_features(spark):
    """The lexical features, by plain Python."""
    df = spark.createDataFrame([(u,) for u in URLS if u], "url string")
    host, path = parse(F.col("url"))
    for r in lexical(df.withColumns({"host": host, "path": path}), "url", "host", "path").collect():
        u, (h, p, _) = r.url, brute_url(r.url)
        shares = [u.count(c) / len(u) for c in set(u)]
        want = {
            "length": len(u), "host_length": len(h), "path_length": len(p), "depth": p.count("/"), "labels": h.count("."), "digit_ratio": sum(c in "0123456789" for c in u) / len(u),
            "dash_count": h.count("-"), "entropy": -sum(s * math.log2(s) for s in shares), "parameters": u.count("="), "fragment": u.count("#"), "suffix": h.split(".")[-1],
        }
        for name, value in want.items():
            assert r[name] == pytest.approx(value) if isinstance(value, float) else r[name] == value, (u, name)


def test_url_trees_learn(spark):
    """Held-out urls are told apart by their digits and parameters."""
    make = lambda a, b: [(f"http://h{i}.net/" + (f"{i * 7919}/{i}?a={i}&b={i}" if i % 2 else "about/us"), i % 2) for i in range(a, b)]
    model = train(spark.createDataFrame(make(0, 300), "url string, blocked int"), trees=5)
    held = spark.createDataFrame(make(300, 400), "url string, blocked int")
    got = judge(held, model, keep=("url", "blocked")).collect()
    assert np.mean([(r.verdict == "block") == bool(r.blocked) for r in got]) > 0.95
    again = judge(held, train(spark.createDataFrame(make(0, 300), "url string, blocked int"), trees=5), keep=("url", "blocked")).collect()
    assert {(r.url, r.verdict, round(r.score, 9)) for r in got} == {(r.url, r.verdict, round(r.score, 9)) for r in again}
    e = spark.createDataFrame([("aabb",), ("",), ("abcd",)], "u string").select(entropy(F.col("u"))).collect()
    assert [round(r[0], 9) for r in e] == [1.0, 0.0, 2.0]


def test_url_labels_of_rules(spark):
    """What trees trained from the rules' verdicts know of urls that they haven't seen, without the rules."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = labelled_by_rules(pages).withColumn("held", F.pmod(F.xxhash64("url"), F.lit(3)) == 0).cache()
    model = train(rows.where("not held"))
    got = judge(rows.where("held"), model, rules=[], keep=("url", "blocked")).toPandas()
    right = float(((got["verdict"] == "block") == (got["blocked"] == 1)).mean())
    usual = float(max(got["blocked"].mean(), 1 - got["blocked"].mean()))
    rank = got["score"].rank()
    bad = got["blocked"] == 1
    auc = float((rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum()))
    print("held-out urls", len(got), "right", right, "always the usual verdict", usual, "auc", auc)
    assert auc > 0.6 and right > usual - 0.05


def test_quality(spark):
    good = [(i, f"the river and the town were quiet that morning {i} and people walked on") for i in range(200)]
    bad = [(1000 + i, f"BUY!! NOW!! $$$ {i} CLICK!! ### CHEAP!!") for i in range(60)]
    odd = [(5000, None), (5001, ""), (5002, "ab"), (None, good[0][1]), (0, good[0][1]), (5003, "the river and the town " * 300)]
    df = spark.createDataFrame([(*r, "x") for r in good + bad + odd], "doc_id long, text string, keep string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(30)] + [(5003, None, None), (7, None, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    rows = quality.classify(df, model).collect()
    assert len(rows) == len(good + bad + odd)
    kept = {r["row"]["doc_id"]: r["keep"] for r in rows}
    assert np.mean([kept[i] for i, _ in good]) > 0.85 and np.mean([kept[i] for i, _ in bad]) < 0.2
    raw, target = np.zeros(quality.BUCKETS), 0
    for _, t in good + bad + odd:
        bucket, n = quality.grams([(t or "").encode()])
        assert len(bucket) == n[0] == max(0, len((t or "").encode()) - 4)
    assert quality.classify(df.limit(0), model).collect() == []
    hot = df.unionByName(spark.range(4000).select((F.col("id") + 9000).alias("doc_id"), F.lit(good[160][1]).alias("text"), F.lit("x").alias("keep")))
    rows = quality.classify(hot, quality.fit(hot, labels)).collect()  # a clean text with nearly all rows stays
    assert np.mean([r["keep"] for r in rows if (r["row"]["doc_id"] or 0) >= 9000]) == 1 and np.mean([r["keep"] for r in rows if 1000 <= (r["row"]["doc_id"] or 0) < 2000]) < 0.2
    every = quality.fit(df, labels.limit(0))
    assert all(r["keep"] for r in quality.classify(df, every).collect())
    del raw, target


def test_kth_largest(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=3000).round(2)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    few, quality.FEW = quality.FEW, 10
    try:
        for k in (1, 2, 500, 2999):
            assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    finally:
        quality.FEW = few
    assert quality.kth_largest(df, "v", 3000) == float("-inf") and quality.kth_largest(df, "v", 0) == float("inf")


def test_quality_weights():
    """A text's weight is the least sum of a passage's ratios, whatever it is cut together with."""
    r = random.Random(3)
    ratio = np.array([r.randrange(-200_000, 60_000) for _ in range(quality.BUCKETS)], np.int64)
    several = ["".join(r.choice("abc é") for _ in range(r.choice([0, 3, 5, 12, 20, 21, 300]))).encode() for _ in range(60)]
    want = []
    for x in several:
        values = ratio[quality.grams([x])[0]].tolist()
        sums = [sum(values[i : i + quality.WINDOW]) for i in range(max(1, len(values) - quality.WINDOW + 1))]
        want.append(min(sums) / quality.SCALE)
    assert quality.weights_of(several, ratio).tolist() == want
    assert [quality.weights_of([x], ratio)[0] for x in several] == want


def test_quality_samples(spark):
    """Near the threshold the noise decides, in proportion to the weights; far from it, it doesn't."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), (-F.col("id") / 2000.0).alias("log_weight"))
    rows = rows.withColumn("value", F.col("log_weight") + quality._gumbel("doc_id"))
    model = quality.Model(np.zeros(0), quality.kth_largest(rows, "value", 10_000), 10_000, rows.withColumnRenamed("doc_id", "__key"))
    got = quality.resampled(model).toPandas().sort_values("doc_id")
    assert got["keep"].sum() == 10_000
    top = got["doc_id"] < 10_000
    assert 500 < (got["keep"] & ~top).sum() < 5000  # not the top k
    share = got.groupby(got["doc_id"] // 2000)["keep"].mean()
    assert share.iloc[0] > 0.99 and share.iloc[-1] < 0.01 and (share.diff().dropna() < 0.03).all()
    expected = 1 - np.exp(-np.exp(got["log_weight"] - model.threshold))
    assert abs(expected.sum() - 10_000) < 300


def test_quality_held_out(spark):
    """On labels that the target model hasn't seen, low quality and most toxic texts go and clean text stays."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_quality_resampling"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {(r.quality, r.toxic): r.kept for r in got.collect()}
    print(kept)
    assert kept[1, 0] > 0.985 and kept[0, 0] < 0.05 and kept[1, 1] < 0.5 and kept[0, 1] < 0.05


def test_sharding(spark):
    rows = [(i, "word " * (i % 97 + 1)) for i in range(3000)] + [(10_000 + i, "hot text " * 30) for i in range(1500)] + [(20_000, None), (20_001, ""), (None, "x"), (5, "word " * 6), (20_002, "long " * 20000)]
    out = shard(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")).toPandas()
    assert len(out) == len(rows) and out["shard"].between(0, 15).all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    without = out[out["size"] < 50_000].groupby("shard")["size"].sum()
    total = out.groupby("shard")["size"].sum()
    assert total.max() - total.min() <= 100_001 and without.max() < 1.2 * total.mean()
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(out["size"], out["text_crc32"], strict=True)) == want
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pack_balances_jointly():
    v = np.random.default_rng(0).lognormal(size=(2000, 3))
    to = pack(v, 16)
    sums = np.stack([np.bincount(to, v[:, k], 16) for k in range(3)])
    assert (sums.max(1) / sums.mean(1) < 1.05).all()
    small = v[:300]  # by plain loops
    shares = small / small.sum(0)
    left, want = [[1 / 16] * 3 for _ in range(16)], [0] * len(small)
    for i in sorted(range(len(small)), key=lambda i: -max(shares[i])):
        dots = [sum(a * b for a, b in zip(c, shares[i], strict=True)) for c in left]
        want[i] = max(range(16), key=lambda s: (dots[s], -s))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], shares[i], strict=True)]
    assert pack(small, 16).tolist() == want


def test_sharding_of_a_hot_group_without_keys(spark):
    """Two thirds of the rows are copies of one text with one key, or none: sizes stay nearly equal, tokens and rows too."""
    r = np.random.default_rng(5)
    rows = [(None if i % 2 else 7, "hot text " * 30) for i in range(6000)] + [(100 + i, "word " * int(r.integers(20, 90))) for i in range(3000)]
    placed = shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum("tokens").alias("tokens")).toPandas()
    assert placed["n"].sum() == 9000 and (placed[["bytes", "n", "tokens"]].max() / placed[["bytes", "n", "tokens"]].mean() < 1.05).all()
    given = shard(spark.createDataFrame([(1, "a b\tc"), (2, None)], "doc_id long, text string"), tokens=F.col("doc_id") * 10).toPandas()
    assert sorted(given["tokens"]) == [10, 20] and sorted(shard(spark.createDataFrame([(1, "a b\tc"), (2, None)], "doc_id long, text string")).toPandas()["tokens"]) == [0, 3]


def test_preference_pairs(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None),
        (2, 1, "assistant", "b"), (2, 0, "system", "s"), (3, 0, "system", "s"), (5, 0, "user", "alone"), (None, 0, "user", "lost"), (6, None, None, "x"), (7, None, None, "x"), (7, None, None, "x"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    p = got[0]
    assert (p.prompt, p.prompt_turns) == ("<|user|>\nq<|end|>\n", 1)
    assert p.chosen == "<|assistant|>\ngood<|end|>\n" and p.chosen_mask == "14:0,12:1"
    assert p.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n" and p.rejected_mask == "14:0,11:1,9:0,8:0"
    assert sum(int(x.split(":")[0]) for x in p.rejected_mask.split(",")) == len(p.rejected)
    assert (got[1].prompt_turns, got[1].rejected, got[1].rejected_mask) == (1, "", "") and got[1].chosen.startswith("<|assistant|>")
    assert (got[2].chosen, got[2].prompt, got[2].chosen_turns) == (None, "", 0)
    assert got[3].prompt_turns == 1 and got[3].chosen == ""
    assert preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).collect() == []


@pytest.mark.parametrize("name", COMPRESSIONS)
@pytest.mark.parametrize("predictor,tile", [(1, 0), (2, 0), (2, 64)])
def test_tiff_round_trip(name, predictor, tile):
    r = np.random.default_rng(4)
    for data in (b"", b"a", b"a" * 577, r.integers(0, 256, 300_000, np.uint8).tobytes(), b"abcab" * 40_000, r.integers(0, 2, 200_000, np.uint8).tobytes()):
        pages = list(walk(encode_tiff(data, COMPRESSIONS[name], predictor, tile)))
        assert b"".join(p.samples.tobytes() for p in pages) == pad(data) and len(pages) == -(-len(pad(data)) // (576 * 256))


def test_tiff_known_codes():
    """PackBits' example of its description, LZW codes packed by hand, and a big-endian RGB page."""
    assert unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = [256, 7, 258, 8, 8, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert lzw_decode(int(bits.ljust(56, "0"), 2).to_bytes(7, "big"), 99) == bytes([7, 7, 7, 8, 8])
    pixels = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    tags = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, 18)]
    data = b"MM\0*" + struct.pack(">I", 26) + pixels.tobytes() + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    (page,) = walk(data)
    assert (page.samples == pixels).all()


def test_tiff_columns(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "é" * 200_000, TEXTS[2]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(b"clash"))
    stored = to_tiff(df, payload="text")
    for r in tiff_digests(stored).collect():
        raw = (rows[r.doc_id][1] or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    pages = tiff_pages(stored).where("doc_id = 8").orderBy("page").collect()
    assert [p.page for p in pages] == [0, 1, 2] and b"".join(bytes(p.samples) for p in pages) == pad(("é" * 200_000).encode())
    whole = bytearray(encode_tiff(b"abc" * 1000))
    broken = [(0, None), (1, b""), (2, b"II*\0"), (3, bytes(whole[:-20])), (4, b"GIF89a"), (5, bytes(whole[:60]) + bytes(200) + bytes(whole[260:]))]
    got = tiff_pages(spark.createDataFrame(broken, "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and all(r.error for r in got)
    digests = {r.doc_id: r for r in tiff_digests(spark.createDataFrame(broken, "doc_id long, media binary"), keep=("doc_id",)).collect()}
    assert (digests[0].media_bytes, digests[0].error) == (None, None) and all(digests[i].error and digests[i].payload_sha256 is None for i in range(1, 6))
    assert digests[4].media_sha256 == hashlib.sha256(b"GIF89a").hexdigest()
    assert tiff_digests(to_tiff(df.limit(0), payload="text")).collect() == []


def patched(data: bytes, tag: int, *, value: int | None = None, count: int | None = None) -> bytes:
    """A little-endian file with another value or count of a tag of its first directory."""
    out = bytearray(data)
    (at,) = struct.unpack_from("<I", out, 4)
    for k in range(struct.unpack_from("<H", out, at)[0]):
        place = at + 2 + 12 * k
        if struct.unpack_from("<H", out, place)[0] == tag:
            if count is not None:
                struct.pack_into("<I", out, place + 4, count)
            if value is not None:
                struct.pack_into("<I", out, place + 8, value)
    return bytes(out)


def test_tiff_damage():
    """Damaged files raise what the operators turn into an error, and no sample is given that the file lacks."""
    r = random.Random(2)
    payload = bytes(r.randrange(256) for _ in range(40_000))
    for form in FORMS:
        whole = encode_tiff(payload, COMPRESSIONS[form[0]], *form[1:])
        cases = [patched(whole, t, value=v) for t in (256, 257, 259, 277, 278, 317, 322, 323) for v in (0, 3, 60_000, 1 << 31)]
        cases += [patched(whole, t, count=c) for t in (256, 257, 273, 278, 279, 322, 324, 325) for c in (0, 1, 1 << 31)]
        cases += [whole[: r.randrange(len(whole))] for _ in range(40)]
        for _ in range(200):
            spoilt = bytearray(whole)
            for _ in range(r.choice([1, 5])):
                spoilt[r.randrange(len(spoilt))] = r.randrange(256)
            cases.append(bytes(spoilt))
        for case in cases:
            try:
                for p in walk(case):
                    assert p.samples.size == p.width * p.height * p.samples.shape[2] <= 1 << 28
            except DAMAGE:
                pass


def test_tiff_forms_and_features(spark):
    """All forms are met; equal texts have equal files and features; features by plain loops."""
    texts = [f"{i} " + "some text " * (i % 60) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    stored = {r.doc_id: bytes(r.media) for r in to_tiff(df, payload="text").collect()}
    assert {next(walk(m)).compression for m in stored.values()} == {5, 8, 32773} and len({zlib.crc32(t.encode()) % len(FORMS) for t in texts}) == len(FORMS)
    for r in tiff_digests(to_tiff(df, payload="text")).collect():
        assert r.media_sha256 == hashlib.sha256(stored[r.doc_id % 40]).hexdigest() and r.media_bytes == len(stored[r.doc_id])
        grey = np.frombuffer(pad(texts[r.doc_id % 40].encode()), np.uint8).reshape(-1, 576)
        n, bits = len(grey), ""
        for i in range(8):
            for j in range(8):
                area = grey[i * n // 8 : max((i + 1) * n // 8, i * n // 8 + 1), j * 72 : j * 72 + 72].astype(int)
                bits += "1" if area.sum() * grey.size > int(grey.sum(dtype=int)) * area.size else "0"
        assert r.feature == f"576x{n}/{int(grey.sum(dtype=int)) // grey.size}/{int(bits, 2):016x}"


def test_bpe(spark):
    c = codec(RANKS, public_tokenizers.PATTERN)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(0)
    texts = [t or "" for t in TEXTS] + ["".join(chr(x) for x in r.choice([*range(32, 127), 9, 10, 233, 0x4E2D, 0x1F600], 400)) for _ in range(100)] + ["ab" * 3000]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == oracle.encode_ordinary(t) and c.decode(ids.tolist()) == t.encode()
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = bpe_encode(df, RANKS, public_tokenizers.PATTERN, check="whole")
    back = {r.doc_id: bytes(r.decoded) for r in bpe_decode(coded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in rows} and coded.where("not whole").count() == 0
    for r in bpe_round_trip(df, RANKS, public_tokenizers.PATTERN).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = oracle.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe_round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_bpe_long_pieces_agree(monkeypatch):
    """Rounds that are taken together give the ids of rounds one by one, and texts may come in several lots of pieces."""
    c = codec(RANKS, public_tokenizers.PATTERN)
    r = random.Random(1)
    several = [b"the" * 100, bytes(range(256)), "слово".encode() * 40, b"a" * 400, *(bytes(r.choice(b"aabcnrest") for _ in range(300)) for _ in range(60))]
    for p in several:
        assert (c._merge_long(p) == c.matrix([p])[0]).all()
    texts = [" ".join(f"word{i}" for i in range(50)), "x", "", "naïve text! " * 30]
    want = [x.tolist() for x in c.encode(texts)]
    monkeypatch.setattr(bpe, "PIECES", 7)
    assert [x.tolist() for x in c.encode(texts)] == want
    began = time.perf_counter()
    assert c.decode(c.encode(["hello" * 20_000])[0].tolist()) == b"hello" * 20_000 and time.perf_counter() - began < 20


def test_sharding_of_large_texts(spark):
    """Texts beyond a bucket's share of a shard don't leave their shards over."""
    r = np.random.default_rng(4)
    rows = [(i, f"{i} " + "word " * int(r.integers(10, 30))) for i in range(3200)] + [(5000 + i, str(i) + " text" * 3000) for i in range(3)]
    placed = shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert len(placed) == 16 and sum(p.n for p in placed) == len(rows) and all(p.last == p.n - 1 for p in placed)
    sizes = [p.bytes for p in placed]
    assert max(sizes) / np.mean(sizes) < 1.2
