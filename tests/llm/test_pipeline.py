"""The pipeline against a brute-force version of its five stages, and on odd input."""

import base64
import math
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_text_operators import brute_components, brute_contamination
from tideline.llm import quality
from tideline.llm.queries import RANKS


def brute_quality(spark, docs, labels):
    """Rows that stay. Noise and the labels' parts are hashes that Spark gives; all else is counted here."""
    part = {r["__key"]: r["__part"] for r in quality._labelled(labels, "doc_id").collect()}
    noise = {r[0]: r[1] for r in docs.select("doc_id", quality._gumbel("doc_id")).collect()}
    rows = docs.collect()

    def grams(text):
        b = (text or "").encode()
        out = []
        for i in range(len(b) - 4):
            h = 0
            for c in b[i : i + 5]:
                h = h * 257 + c
            out.append((h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - quality.BITS)
        return out

    raw, target, of = Counter(), Counter(), []
    copies = Counter(r.text for r in rows)
    for r in rows:
        of.append(grams(r.text))
        for g, n in Counter(of[-1]).items():  # in so small a table every copy is one of many
            raw[g] += n / copies[r.text]
            if part.get(r.doc_id) == 1:
                target[g] += n / copies[r.text]
    share = sum(target.values()) / sum(raw.values())
    ratio = {g: round(quality.SCALE * math.log((target[g] + quality.PRIOR) / (c * share + quality.PRIOR))) for g, c in raw.items()}
    weights = [min(sum(ratio[g] for g in x[i : i + quality.WINDOW]) for i in range(max(1, len(x) - quality.WINDOW + 1))) / quality.SCALE for x in of]
    held = sorted(w for r, w in zip(rows, weights, strict=True) if part.get(r.doc_id) == 2)
    low = held[max(0, math.ceil(quality.LOSS * len(held)) - 1)]
    k = sum(w >= low for w in weights)
    values = [w + noise[r.doc_id] for r, w in zip(rows, weights, strict=True)]
    limit = sorted(values, reverse=True)[k - 1] if k < len(values) else -math.inf
    return [r for r, v in zip(rows, values, strict=True) if v >= limit - 1e-9]


def brute_lines(rows):
    pages, counts = defaultdict(set), defaultdict(set)
    for r in rows:
        if r.source is not None:
            pages[r.source].add(r.text)
            for x in (r.text or "").split("\n"):
                if x.strip(" "):
                    counts[r.source, x.strip(" ")].add(r.text)
    bad = {k for k, v in counts.items() if len(v) >= 2 and len(v) > len(pages[k[0]]) * 0.1}
    return [(r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)) for r in rows]


def test_pipeline_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = brute_lines(brute_quality(spark, docs, labels))
    stays = {d for d, _, c in brute_components(rows, 5, 80) if d == c}
    rows = [(d, t) for d, t in rows if d in stays]
    clean = {d for d, _, h, _ in brute_contamination(rows, items) if not h}
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: oracle.encode_ordinary(t) for d, t in rows if d in clean}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) < docs.count()
    assert all(r.whole and r.n_tokens == len(r.ids) for r in got)


def test_stages_on_odd_input(spark, sf, tmp_path):
    """Nulls, empty and repeated rows and an extra column pass every stage; an empty table stays empty."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(i, f"row {i} says that the day was fine and the road was long {i}", "en", "s", 50, "x") for i in range(30)]
    rows += [(None, None, None, None, None, None), (None, "text", None, None, None, None), (100, None, "en", "s", 0, None), (101, "", "en", "s", 0, None), (3, rows[3][1], "en", "s", 50, "x"), (102, "w " * 50_000, "en", "s", 1, None)]
    for k, docs in enumerate((spark.createDataFrame(rows, schema), spark.createDataFrame([], schema))):
        out = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, out, sf).write.parquet(path := str(tmp_path / f"{k}-{name}"))
            before, out = out, spark.read.parquet(path)
            assert out.columns == docs.columns and out.count() <= before.count()
        n = out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, out, sf).count() == n and (n > 0) == (docs.count() > 0)
