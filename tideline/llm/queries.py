"""The queries opN of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.bpe import bpe_round_trip
from tideline.llm.chat_format import preference_pairs
from tideline.llm.decontaminate import find_contamination
from tideline.llm.line_dedup import line_dedup
from tideline.llm.ngram_join import ngram_components
from tideline.llm.quality import fit, resampled
from tideline.llm.ranked import build, search
from tideline.llm.sharding import shard
from tideline.llm.substring import passages
from tideline.llm.token_align import link_scores
from tideline.llm.token_files import read_token_files, store_tokens
from tideline.llm.tiff import tiff_digests, to_tiff
from tideline.llm.url_filter import judge, labelled_by_rules, train

#: The rank file that op9 encodes with.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The tokenizer that op12 encodes with.
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: The tokenizers that op13 aligns.
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, train(labelled_by_rules(pages)))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_components(documents, n_words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(documents, benchmark)
    sha = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha, "contaminated")


def op4_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return passages(documents).withColumnRenamed("other", "other_id")


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resampled(fit(documents, labels))


def op6_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard(documents, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 i and 2 i + 1 are a pair; the even one is the chosen one."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return preference_pairs(conversations, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)) == 0)


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tiff_digests(to_tiff(documents, payload="text"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(documents, RANKS, public_tokenizers.PATTERN)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(documents).select("row.doc_id", "n_lines", "n_dropped", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build(documents), benchmark, k=20)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(store_tokens(documents, WORDS, end=2, by_words=True), ids=False)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_scores(documents, BYTES, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_substring_chains": op4_substring_chains,
    "op5_quality_resampling": op5_quality_resampling,
    "op6_shard_packing": op6_shard_packing,
    "op7_preference_format": op7_preference_format,
    "op8_tiff_media": op8_tiff_media,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_files": op12_token_files,
    "op13_token_alignment": op13_token_alignment,
}

_OP3_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_OP2_WORDS}, []) AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT r, len(g) AS n, unnest(g) AS t FROM s),
p AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (n + m - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.g)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.a = s.r JOIN s o ON o.r = reach.b GROUP BY s.r""",
    "op3_decontamination": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_OP3_WORDS.format("text")}, []) AS w FROM documents),
items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_OP3_WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
found AS (SELECT g.r, g.k, g.i, x.item_id FROM grams g JOIN windows x ON g.s = x.s AND g.k = x.k),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)""",
    "op7_preference_format": """
WITH t AS (SELECT conv_id >> 1 AS pair_id, conv_id % 2 = 0 AS good, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (good) AS a, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) FILTER (NOT good) AS b FROM t GROUP BY pair_id),
u AS (SELECT pair_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s),
k AS (SELECT *, coalesce(list_min([i - 1 FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]), least(len(a), len(b))) AS k FROM u),
r AS (SELECT *, a[k + 1:] AS ra, b[k + 1:] AS rb FROM k)
SELECT pair_id, array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN a[1:k]], '') AS prompt, CAST(k AS BIGINT) AS prompt_turns,
  CASE WHEN len(a) > 0 THEN array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN ra], '') END AS chosen,
  CASE WHEN len(b) > 0 THEN array_to_string(['<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10) FOR x IN rb], '') END AS rejected,
  CASE WHEN len(a) > 0 THEN array_to_string([(length(x.role) + 5) || ':0,' || (length(x.text) + 8) || ':' || CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END FOR x IN ra], ',') END AS chosen_mask,
  CASE WHEN len(b) > 0 THEN array_to_string([(length(x.role) + 5) || ':0,' || (length(x.text) + 8) || ':' || CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END FOR x IN rb], ',') END AS rejected_mask,
  CAST(len(a) AS BIGINT) AS chosen_turns, CAST(len(b) AS BIGINT) AS rejected_turns
FROM r""",
    "op10_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT source, r, trim(line) AS line FROM (SELECT source, r, unnest(ls) AS line FROM d WHERE source IS NOT NULL) WHERE trim(line) <> ''),
n AS (SELECT source, count(*) AS n FROM d WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT source, list(line) AS bad FROM (SELECT l.source, l.line, count(*) AS c, any_value(n.n) AS n FROM l JOIN n ON l.source = n.source GROUP BY l.source, l.line) WHERE c >= 2 AND c > n * 0.1 GROUP BY source),
k AS (SELECT d.*, bad, [x FOR x IN ls IF trim(x) = '' OR NOT list_contains(bad, trim(x))] AS kept_lines FROM d LEFT JOIN b ON d.source = b.source)
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(CASE WHEN bad IS NULL OR text IS NULL THEN 0 ELSE len(ls) - len(kept_lines) END AS BIGINT) AS n_dropped,
  CASE WHEN bad IS NULL THEN text ELSE array_to_string(kept_lines, chr(10)) END AS kept
FROM k""",
    "op11_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP3_WORDS.format("text")} AS w FROM documents),
t AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
c AS (SELECT CAST(count(DISTINCT r) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS terms FROM t),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM t GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY term),
i AS (SELECT row_number() OVER () AS q, item_id, {_OP3_WORDS.format("text")} AS w FROM benchmark),
s AS (SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS repeats FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY q, item_id, term),
g AS (SELECT q, any_value(item_id) AS item_id, any_value(f.doc_id) AS doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))))) AS BIGINT) AS score
  FROM s JOIN f USING (term) JOIN w USING (term), c GROUP BY q, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM g WHERE score > 0) WHERE rank <= 20""",
}
