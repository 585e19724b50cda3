"""Weighted first and second moments of columns, in one pass.

A task adds up its rows in NumPy and sends one row per resample (and group);
those are added in two levels of at most LEVEL at a time, so that no task holds
the matrices of all tasks. The driver gets one matrix per resample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of the first level; tasks whose matrices one of them adds are their number over this.
LEVEL = 1024
_STEP = 1 << 14


def poisson_weights(keys: np.ndarray, resample: int, seed: int) -> np.ndarray:
    """Poisson(1) counts from a hash of 64-bit row keys; independent of partitions."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((resample + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    p = np.exp(-1.0) / np.array([1.0, *np.cumprod(np.arange(1, 16, dtype=float))])
    return np.searchsorted(np.cumsum(p), u).astype(float)


def moments(df: DataFrame, columns: list[str], resamples: int = 0, keys: list[str] | None = None, seed: int = 12345, expand=None, centre: list[float] | None = None, weights: Column | None = None) -> np.ndarray:
    """Sums of (1, x)(1, x)' over all rows: [0] unweighted, [1 ..] one per resample. Rows with a null are left out.

    ``expand``: function of the rows' matrix that gives the matrix to sum instead.
    ``weights``: an array of the resamples' counts, instead of counts from a hash of the keys.
    ``centre``: what is taken from the columns first, so that large offsets don't cancel.
    """
    found = moments_by(df, F.lit("").alias("g"), columns, {"": expand}, resamples, keys, seed, centre, weights)
    if "" in found:
        return found[""]
    p = len(columns) + 1
    return np.zeros((resamples + 1, p, p))


def moments_by(df: DataFrame, group: Column, columns: list[str], expand: dict[str, Callable | None], resamples: int = 0, keys: list[str] | None = None, seed: int = 12345, centre: list[float] | None = None, weights: Column | None = None) -> dict[str, np.ndarray]:
    """The moments of each group that ``expand`` names, all in one pass; groups without rows are left out."""
    row_key = F.xxhash64(*(keys or columns)).alias("__key")
    source = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)), row_key, group.cast("string").alias("__group"), *([] if weights is None else [weights.alias("__weights")])).dropna()
    source = source.where(F.col("__group").isin(list(expand)))
    offset = np.array(centre, float) if centre is not None else 0.0
    given = weights is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            every = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            every_key = b.column(len(columns)).to_numpy()
            drawn = None if not given else b.column(len(columns) + 2).flatten().to_numpy().reshape(-1, resamples)
            codes = b.column(len(columns) + 1).dictionary_encode()
            for g, name in enumerate(codes.dictionary.to_pylist()):
                mine = codes.indices.to_numpy() == g if len(codes.dictionary) > 1 else slice(None)
                x, key, f = every[mine] - offset, every_key[mine], expand[name]
                for at in range(0, len(x), _STEP):
                    part = x[at : at + _STEP]
                    m = np.column_stack([np.ones(len(part)), f(part) if f else part])
                    if name not in sums:
                        sums[name] = np.zeros((resamples + 1, m.shape[1], m.shape[1]))
                    sums[name][0] += m.T @ m
                    for r in range(resamples):
                        w = poisson_weights(key[at : at + _STEP], r, seed) if drawn is None else drawn[mine][at : at + _STEP, r]
                        sums[name][r + 1] += (m * w[:, None]).T @ m
        task = TaskContext.get().partitionId() % LEVEL
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(range(len(s)), pa.int32()), pa.array([task] * len(s), pa.int32()), pa.array([x.tobytes() for x in s], pa.binary())], ["g", "resample", "part", "sums"])

    schema = "g string, resample int, part int, sums binary"

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in t.column("sums").to_pylist())
        return t.slice(0, 1).set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    rows = source.mapInArrow(run, schema).groupBy("g", "resample", "part").applyInArrow(add, schema)
    rows = rows.groupBy("g", "resample").applyInArrow(add, schema).collect()
    out: dict[str, dict[int, np.ndarray]] = {}
    for r in rows:
        out.setdefault(r["g"], {})[r["resample"]] = np.frombuffer(bytes(r["sums"]), float)
    return {g: np.stack([found[r].reshape(int(np.sqrt(found[r].size)), -1) for r in range(resamples + 1)]) for g, found in out.items()}


def covariance(sums: np.ndarray, ddof: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, means, covariances) of summed moments."""
    n = sums[0, 0]
    mean = sums[0, 1:] / n
    return n, mean, (sums[1:, 1:] - n * np.outer(mean, mean)) / (n - ddof)


def column_means(df: DataFrame, columns: list[str]) -> list[float]:
    """Means over the values that are there; 0 for a column without any."""
    means = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return [means[c] or 0.0 for c in columns]


def fill_with_means(df: DataFrame, columns: list[str], means: list[float] | None = None) -> DataFrame:
    """Null cells get their column's mean over the others."""
    means = column_means(df, columns) if means is None else means
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(columns, means, strict=True)})
