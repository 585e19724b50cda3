"""Sharding by vector bin packing.

Documents with the same text are a group; a group is a vector of rows, bytes
and tokens. Each group goes to the shard where the dot product of its vector
with the shard's residual capacity is highest, largest groups first.

Groups of more than a small share of a shard are split into pieces by a number
of each row, whatever its key, each with its own measured vector; such groups are few, as
their shares add up to 1. Groups are dealt to buckets by hash; a bucket has a
capacity of its share in every shard, and is packed by one task in bounded
memory. So no task sees all groups. Pieces of more than ``LARGE`` of a bucket's
share of a shard would leave the shard over in their bucket; they are few, as
their shares add up to 1, and are packed first, all together. Buckets share
what capacity they leave, so that balance in each is balance of the whole.
Slots number a shard's rows without gaps: a running number within the bucket, on top of the rows that earlier buckets put into the shard.

The law that holds is ``bytes``: shards' sizes are nearly equal. Size is the
text's UTF-8 bytes plus 1; tokens are words unless the caller has other counts. Null texts count as empty. Repeated rows and null
keys are placed like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm import scratch

#: Pieces above this part of a bucket's share of a shard are packed before all others.
LARGE = 1 / 8
#: A piece of a group has at most about this share of a shard; rows of a bucket, at least and at most, about.
PIECE, LEAST_ROWS, MOST_ROWS, FEW_BUCKETS = 1 / 64, 800, 50_000, 64


def pack(vectors: np.ndarray, shards: int, first: int = 0, capacity: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
    """The shard of each item (a row of ``vectors``): largest first, to the highest dot product with residual capacity; ties go on from shard ``first``. Shards have equal shares, or those of ``capacity``, of ``total`` or else of all items."""
    total = vectors.sum(0) if total is None else total
    v = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, v.shape[1]), 1 / shards) if capacity is None else np.roll(capacity, -first, 0)
    out = np.empty(len(v), np.int32)
    for i in np.argsort(-v.max(1), kind="stable"):
        s = int((residual @ v[i]).argmax())
        residual[s] -= v[i]
        out[i] = (s + first) % shards
    return out


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, tokens: Column | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, tokens, shard, slot. ``tokens``: each row's number of tokens; else its words are counted."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")) if tokens is None else F.coalesce(tokens, F.lit(0))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), tokens.cast("long").alias("tokens"), F.xxhash64(body).alias("group"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.table(rows, "digests")
    group = ["group", "crc", "size"]
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    piece = total["bytes"] / shards * PIECE
    large = rows.groupBy(*group).agg((F.count("*") * F.col("size")).alias("bytes")).where(F.col("bytes") > piece)
    large = large.select(*group, F.ceil(F.col("bytes") / (piece or 1)).alias("pieces"))  # fewer than shards / PIECE rows
    buckets = int(max(1, min(FEW_BUCKETS, total["n"] // LEAST_ROWS), total["n"] // MOST_ROWS))
    rows = rows.join(F.broadcast(large), group, "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(0))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group", "crc", "piece"), F.lit(buckets))).drop("pieces", "row")
    capacity = None
    rows = rows.withColumn("to", F.lit(None).cast("int"))
    if buckets > 1:
        pieces = rows.groupBy(*group, "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
        first = pieces.where(F.col("bytes") > total["bytes"] / shards / buckets * LARGE).orderBy(*group, "piece").collect()  # fewer than shards * buckets / LARGE rows
        if first:
            whole = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
            vectors = np.array([(r["n"], r["bytes"], r["tokens"]) for r in first], float)
            to = pack(vectors, shards, total=np.array(whole, float))
            left = np.maximum(1 / shards - np.stack([np.bincount(to, v, shards) for v in (vectors / np.array(whole, float)).T], 1), 0)
            capacity = np.where(left.sum(0) > 0, left / np.where(left.sum(0) > 0, left.sum(0), 1), 1 / shards)
            known = rows.sparkSession.createDataFrame([(r["group"], r["crc"], r["size"], r["piece"], int(s)) for r, s in zip(first, to, strict=True)], "group long, crc long, size long, piece long, to int")
            rows = rows.drop("to").join(F.broadcast(known), [*group, "piece"], "left")

    def place(t: pa.Table) -> pa.Table:
        order = t.sort_by([("group", "ascending"), ("crc", "ascending"), ("size", "ascending"), ("piece", "ascending"), ("key", "ascending")])
        parts = np.stack([order.column(c).to_numpy() for c in ("group", "crc", "size", "piece")])
        fresh = np.concatenate([[True], (np.diff(parts, axis=1) != 0).any(0)])
        item = np.cumsum(fresh) - 1
        size, tokens = order.column("size").to_numpy(), order.column("tokens").to_numpy()
        vectors = np.stack([np.bincount(item), np.bincount(item, size), np.bincount(item, tokens)], 1).astype(float)
        known = order.column("to").fill_null(-1).to_numpy()[fresh]
        packed, free = known.copy(), known < 0
        packed[free] = pack(vectors[free], shards, int(order.column("bucket")[0].as_py()) % shards, capacity)
        to = packed[item]
        slot = np.empty(len(to), np.int64)
        for s in range(shards):
            at = np.flatnonzero(to == s)
            slot[at] = np.arange(len(at))
        return pa.table([order.column("key"), order.column("size"), order.column("crc"), order.column("tokens"), order.column("bucket"), pa.array(to), pa.array(slot)], ["key", "size", "text_crc32", "tokens", "bucket", "shard", "slot"])

    fields = [T.StructField("key", rows.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("size", "text_crc32", "tokens", "bucket")), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())]
    placed = scratch.table(rows.groupBy("bucket").applyInArrow(place, T.StructType(fields)), "placed")
    counts = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    out = placed.join(offsets, ["bucket", "shard"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "tokens", "shard", (F.col("slot") + F.col("before")).alias("slot"))
