"""Quality classifier by importance resampling.

Two hashed n-gram models are counted: one of the target texts (labelled good),
one of all raw texts. The log weight of a passage is the sum, over its n-grams
of bytes, of log(target / raw); a text's is that of its worst passage of
``WINDOW`` n-grams, as a mean over the whole text would let a few bad words in
a long good text pass. Gumbel noise is added as it is (temperature 1), and the
k largest stay, which samples k texts without replacement in proportion to
their weights: far from the threshold that decides nothing, near it by chance.
k is the number of texts whose weight is not below that of nearly all good
texts of a held-out part of the labels.

The models count every n-gram of every text; copies of a text that make up more
than ``HOT`` of all rows count as one text together, or the n-grams of a text
with a third of all rows would look as if there were too many of them. Each task adds up its own
counts, so a shuffle carries at most the number of buckets from each task, and
the driver gets the sums of the buckets only. A bucket's ratio is drawn to 1 by
``PRIOR`` expected grams, so that rare n-grams tell little. Ratios are whole
multiples of 1 / ``SCALE``, so that sums don't depend on how texts are cut into slices. The k-th largest value is found
by counting in bins and narrowing them, without a sort; ties with it stay.

Labels are joined from a bounded sample (``LABELLED``, a documented bound): half
of it for the target model, half for k. A label counts as good if quality is 1
and toxic is not; null quality counts as none. Null texts count as empty; texts
shorter than an n-gram have weight 0. Without labels all texts stay. Repeated
rows have equal values and stay or go together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import scratch
from tideline.llm.batches import slices, texts, with_row

#: Bytes of an n-gram; hash buckets; labelled rows used at most, about.
N, BITS, LABELLED = 5, 20, 50_000
BUCKETS = 1 << BITS
#: Grams of a passage; expected grams that draw a ratio to 1; steps of a ratio; share of good texts that k leaves out.
WINDOW, PRIOR, SCALE, LOSS = 16, 2.0, 1 << 16, 0.005
#: Share of all rows beyond which a text's copies count as one; so there are fewer than 1 / HOT such texts.
HOT = 1e-4
#: Bytes of texts whose n-grams are looked at together; a gram takes some 60 bytes meanwhile.
SLICE = 1 << 20
#: Bins of one narrowing step, and values that are looked at one by one.
BINS, FEW = 1024, 10_000


def grams(several: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, how many each text has)."""
    data = np.frombuffer(b"".join(several), np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in several], np.int64)
    counts = np.maximum(sizes - N + 1, 0)
    if len(data) < N:
        return np.empty(0, np.int64), counts
    h = np.zeros(len(data) - N + 1, np.uint64)
    for i in range(N):
        h = h * np.uint64(257) + data[i : len(data) - N + 1 + i]
    begin = np.cumsum(sizes) - sizes
    inside = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return ((h[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64), counts


def _bytes(batch: pa.RecordBatch, column: str = "__text") -> list[bytes]:
    return [x.encode() for x in texts(batch, column)]


@dataclass
class Model:
    """SCALE * log(target / raw) of each bucket, the least value that stays, how many that are, and all rows' weights (__key, log_weight, value)."""

    ratio: np.ndarray
    threshold: float
    k: int
    weights: DataFrame


def _labelled(labels: DataFrame, key: str) -> DataFrame:
    """(__key, __part): 1 target, 2 held out; at most about LABELLED rows, one per key, good ones only."""
    rows = labels.where("quality is not null").groupBy(F.col(key).alias("__key")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)).cast("int")).alias("good"))
    n = rows.count()
    some = F.xxhash64("__key") < F.lit(min(int(LABELLED / max(1, n) * 2**64) - 2**63, 2**63 - 1))  # a 64-bit threshold, whatever n is
    return rows.where(some & (F.col("good") == 1) & F.col("__key").isNotNull()).select("__key", (F.pmod(F.xxhash64(F.lit("part"), "__key"), F.lit(2)) + 1).cast("int").alias("__part"))


def _gumbel(key: str) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Count both models, weigh all texts, find k and the k-th largest value."""
    part = F.broadcast(scratch.table(_labelled(labels, key), "labelled"))  # LABELLED rows at most, about
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"))
    of_text = F.xxhash64("__text").alias("__copy")
    copies = source.select(of_text).groupBy("__copy").agg(F.count("*").alias("__n"))
    many = copies.where(F.col("__n") > F.greatest(F.lit(1.0), F.lit(HOT * docs.count())))
    hot = F.broadcast(scratch.table(many, "hot"))  # fewer than 1 / HOT rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in slices(batches, "__text", SLICE):
            bucket, n = grams(_bytes(b))
            worth = np.repeat([1 / (x or 1) for x in b.column("__n").to_pylist()], n)
            raw += np.bincount(bucket, worth, BUCKETS)
            good = np.repeat([x == 1 for x in b.column("__part").to_pylist()], n).astype(bool)
            target += np.bincount(bucket[good], worth[good], BUCKETS)
        kept = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(raw[kept]), pa.array(target[kept])], ["bucket", "raw", "target"])

    joined = source.withColumn("__copy", of_text).join(part, "__key", "left").join(hot, "__copy", "left")
    counted = joined.select("__text", "__part", "__n").mapInArrow(count, "bucket long, raw double, target double")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    share = target.sum() / max(raw.sum(), 1)
    ratio = np.round(SCALE * np.log((target + PRIOR) / (raw * share + PRIOR))).astype(np.int64) if share else np.zeros(BUCKETS, np.int64)
    weights = scratch.table(_weigh(source, ratio).withColumn("value", F.col("log_weight") + _gumbel("__key")), "weights")
    held = weights.join(part.where("__part = 2"), "__key")
    low = held.agg(F.percentile_approx("log_weight", F.lit(LOSS), F.lit(100_000)).alias("low")).first()["low"] if share else None
    if low is None:
        return Model(ratio, -np.inf, weights.count(), weights)
    k = weights.where(F.col("log_weight") >= low).count()
    return Model(ratio, kth_largest(weights, "value", k), k, weights)


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest value, exactly, by narrowing bins; -inf if k is not below the number of rows."""
    v = F.col(value)
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.count(v).alias("n")).first()
    if k >= ends["n"]:
        return float("-inf")
    if k <= 0:
        return float("inf")
    low, high, above, inside = ends["a"], ends["b"], 0, ends["n"]
    while inside > FEW and low < high:
        width = (high - low) / BINS
        place = F.least(F.floor((v - low) / width), F.lit(BINS - 1))
        bins = df.where((v >= low) & (v <= high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).orderBy(F.desc("bin")).collect()
        for r in bins:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] == inside and r["a"] == low and r["b"] == high:
            break
        low, high, inside = r["a"], r["b"], r["n"]
    if low == high:
        return low
    few = sorted((r[0] for r in df.where((v >= low) & (v <= high)).select(v).toLocalIterator()), reverse=True)
    return few[k - above - 1]


def _weigh(source: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``source`` (__key, __text) as (__key, log_weight)."""
    shared = source.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(weights_of(_bytes(b), shared.value))], ["__key", "log_weight"])

    return source.mapInArrow(run, T.StructType([source.schema["__key"], T.StructField("log_weight", T.DoubleType())]))


def weights_of(several: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """The log weight of each text's worst passage."""
    bucket, n = grams(several)
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(ratio[bucket])])
    begin = np.cumsum(n) - n
    out = sums[begin + n] - sums[begin]  # texts of one passage
    long = np.flatnonzero(n > WINDOW)
    if len(long):
        passages = np.append(sums[WINDOW:] - sums[:-WINDOW], 0)
        ends = np.stack([begin[long], begin[long] + n[long] - WINDOW + 1], 1).ravel()
        out[long] = np.minimum.reduceat(passages, ends)[::2]
    return out / SCALE


def resampled(model: Model, key: str = "doc_id") -> DataFrame:
    """One row per document: the key, log_weight, value (with Gumbel noise), keep; without its text."""
    return model.weights.select(F.col("__key").alias(key), "log_weight", "value", (F.col("value") >= model.threshold).alias("keep"))


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``row`` (struct of all its columns), log_weight, value (with Gumbel noise), keep."""
    source, at = with_row(docs, text, _gumbel(key).alias("noise"))
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, SLICE):
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("noise"), pa.array(weights_of(_bytes(b, at), shared.value))], ["row", "noise", "log_weight"])

    weighed = source.mapInArrow(run, T.StructType([source.schema["row"], T.StructField("noise", T.DoubleType()), T.StructField("log_weight", T.DoubleType())]))
    value = F.col("log_weight") + F.col("noise")
    return weighed.select("row", "log_weight", value.alias("value"), (value >= model.threshold).alias("keep"))
