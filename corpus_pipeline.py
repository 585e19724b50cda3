"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes the documents that the one before kept, and its decision takes
effect: the quality classifier's rejects go, boilerplate lines go, one document
of each group of near-duplicates stays, contaminated documents go, and the rest
is encoded. All but the last return the columns of ``documents``.

``run`` writes a stage's result before the next stage reads it, and then deletes
the stage's working tables and its input. The documents that the last stage
encodes stay until ``tideline.llm.scratch.release``, as the result reads them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import scratch
from tideline.llm.bpe import bpe_encode
from tideline.llm.decontaminate import decontaminate
from tideline.llm.line_dedup import line_dedup
from tideline.llm.ngram_join import ngram_components
from tideline.llm.quality import classify, fit

#: Near-duplicates share this percentage of their shingles of five words.
WORDS, PERCENT = 5, 80
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, model).where("keep").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars follows the text.

    Copies count as one page: they are still there, and the lines of a document
    with many copies would all go before the next stage can find them.
    """
    row = F.col("row").withField("text", F.col("kept")).withField("n_chars", F.length("kept").cast("long"))
    return line_dedup(docs, copies_once=True).select(row.alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group. Rows without an id stay; rows with one id and one text count once."""
    found = ngram_components(docs, n_words=WORDS, percent=PERCENT)
    kept = scratch.table(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    known = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and whether decoding the ids gives the text's bytes back."""
    coded = bpe_encode(docs, RANKS, public_tokenizers.PATTERN, check="whole")
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", encode),
]

#: Scores of learnt models and tokens can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.scope() as used:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.delete(spark, [used.pop(0) for _ in used[:-1]])  # all but what was just written
    return STAGES[-1][1](spark, docs, sf_dir)
