"""Samples and splits that depend on keys and a seed only, never on partitions."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lineage import cut

#: Labels up to which the place where a label's rows are split is broadcast, some 50 bytes each; Spark chooses beyond that.
MOST_LABELS = 50_000


def order_key(*keys: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, *keys: str, seed: int = 42, ranges: int = 65536) -> DataFrame:
    """n rows without replacement, in no order: those of the least order keys. Only ranges of keys that begin below n are ranked, each by itself."""
    return sample_balanced(df.withColumn("__one", F.lit(1)), "__one", n, *keys, seed=seed, ranges=ranges).drop("__one")


def sample_fraction(df: DataFrame, fraction: float, *keys: str, seed: int = 42) -> DataFrame:
    """Rows whose order key, 128 bits in hex, is below the fraction."""
    if fraction >= 1:
        return df
    return df.where(order_key(*keys, seed=seed) < F.lit(hash_limit(fraction)))


def hash_limit(fraction: float) -> str:
    """The order key that the fraction of all keys is below."""
    return format(int(max(fraction, 0.0) * 2**64) << 64, "032x")


def _in_ranges(df: DataFrame, label: str, keys: tuple[str, ...], seed: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(``df`` with its order key and the key's range, per label and range the rows of the label before and in all)."""
    ordered = df.withColumn("__key", order_key(*keys, seed=seed))
    ordered = ordered.withColumn("__range", F.floor(F.conv(F.substring("__key", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    sizes = ordered.groupBy(label, "__range").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered, sizes.select(F.col(label).alias("__label"), F.col("__range").alias("__r"), "__n", before.alias("__before"), F.sum("__n").over(w).alias("__all"))


def _ranked(ordered: DataFrame, sizes: DataFrame, label: str, keys: tuple[str, ...], ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``__place``, their rank within the label: within the range, on top of the ranges before. No task sorts a whole label."""
    rows = ordered.join(sizes, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__range") == F.col("__r")))
    rank = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__key", *keys, *ties))
    return rows.withColumn("__place", rank + F.col("__before"))


def sample_balanced(df: DataFrame, label: str, n: int, *keys: str, seed: int = 42, ranges: int = 65536) -> DataFrame:
    """Exactly n rows of each label, or all if it has fewer; rows without a label are left out. Rows of equal keys go by their other columns. Only ranges that begin below n are ranked."""
    ordered, sizes = _in_ranges(df.where(F.col(label).isNotNull()), label, keys, seed, ranges)
    return _ranked(ordered, sizes.where(F.col("__before") < n), label, keys, tuple(c for c in df.columns if c not in keys)).where(F.col("__place") <= n).select(*df.columns)


def stratified_split(df: DataFrame, label: str, *keys: str, fraction: float = 0.8, seed: int = 42, salts: int = 1024) -> DataFrame:
    """Add ``split``: exactly floor(fraction x n) rows of each label are train, the rest valid.

    Ranges of order keys are counted first. All but one range of a label lie on one side of its last train row, so only the
    rows of that range are shuffled and ranked. ``df`` is read three times; persist it if it is dear.
    """
    ordered, sizes = _in_ranges(df, label, keys, seed, salts)
    quota = F.floor(F.col("__all") * fraction)
    edges = cut(sizes.withColumn("__quota", quota).where((F.col("__before") <= F.col("__quota")) & (F.col("__quota") < F.col("__before") + F.col("__n"))))
    if edges.count() <= MOST_LABELS:
        edges = F.broadcast(edges)  # a row a label
    split = lambda train: F.when(train, "train").otherwise("valid")
    beside = ordered.join(edges, F.col(label).eqNullSafe(F.col("__label")), "left")
    beside = beside.where(F.col("__r").isNull() | (F.col("__range") != F.col("__r"))).withColumn("split", split(F.coalesce(F.col("__range") < F.col("__r"), F.lit(True))))
    within = _ranked(ordered, edges, label, keys)
    within = within.withColumn("split", split(F.col("__place") <= F.col("__quota")))
    return beside.select(*df.columns, "split").unionByName(within.select(*df.columns, "split"))


def poisson_weight(b: Column | int, *keys: str) -> Column:
    """A Poisson(1) count for a row in resample ``b``, by inverse distribution of a hash: cheaper than an MD5, but SQL can't repeat it."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(b) if isinstance(b, int) else b, *keys), 11).cast("double") + 0.5) / float(1 << 53)
    return reduce(add, ((u > p).cast("int") for p in POISSON))


#: The distribution of Poisson(1), P(X <= k) for k = 0, 1, ..
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


def _poisson(digits: Column) -> Column:
    """A Poisson(1) count from eight hexadecimal digits d: how many p of ``POISSON`` are below (d + 0.5) / 2^32.

    Digits of one length are ordered as their numbers are, so they are compared as text with the least digits
    above each p, which takes a few comparisons instead of a conversion for each p.
    """
    least = [math.floor(Fraction(p) * (1 << 32) - Fraction(1, 2)) + 1 for p in POISSON]
    out = F.when(digits < F.lit(f"{least[0]:08x}"), 0)
    for k, d in enumerate(least[1:], 1):
        out = out.when(digits < F.lit(f"{d:08x}"), k)
    return out.when(digits.isNotNull(), len(least))


def _digits(keys: tuple[str, ...], block: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), block.cast("string"), F.lit(str(seed))))


def poisson_resamples(df: DataFrame, resamples: int, *keys: str, seed: int = 42) -> DataFrame:
    """Each row once for every resample (0 ..) that draws it, with ``weight``, how often: Poisson(1) counts from an MD5 of the keys.

    A digest of 32 digits serves four resamples. Callers aggregate by ``resample`` at once, so that tasks send sums only.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1)))
    rows = df.withColumn("__block", block).withColumn("__digits", _digits(keys, F.col("__block"), seed))
    four = F.array(*(F.struct((4 * F.col("__block") + i).alias("b"), _poisson(F.substring("__digits", 8 * i + 1, 8)).alias("w")) for i in range(4)))
    rows = rows.withColumn("__s", F.explode(four)).where((F.col("__s.w") > 0) & (F.col("__s.b") < resamples))
    return rows.withColumns({"resample": F.col("__s.b"), "weight": F.col("__s.w")}).drop("__block", "__digits", "__s")


def poisson_sums(df: DataFrame, resamples: int, values: dict[str, Column], *keys: str, seed: int = 42) -> DataFrame:
    """resample (0 ..), weight, and each of ``values`` (long) summed by weight, with the counts of ``poisson_resamples``: a row for each resample that draws a row.

    The four resamples of a digest are summed side by side, so a row is aggregated once for four of them. As digests take far
    longer than reading their keys, rows are dealt out evenly first: a small file would else be one task.
    """
    spark = df.sparkSession
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lit(""))  # the keys' part of the digest's text, with the bar after it
    rows = df.select(text.alias("__text"), *(v.cast("long").alias(f"__v{j}") for j, v in enumerate(values.values()))).repartition(4 * spark.sparkContext.defaultParallelism)
    blocks = F.array(*(F.struct(F.lit(g).alias("block"), F.lit(f"{g}|{seed}").alias("rest")) for g in range(-(-resamples // 4))))
    rows = rows.withColumn("__b", F.explode(blocks)).withColumn("__digits", F.md5(F.concat("__text", "__b.rest")))
    # digits are columns of their own, as each is compared several times
    rows = rows.select(F.col("__b.block").alias("__block"), *(f"__v{j}" for j in range(len(values))), *(F.substring("__digits", 8 * i + 1, 8).alias(f"__d{i}") for i in range(4)))
    rows = rows.withColumns({f"__w{i}": _poisson(F.col(f"__d{i}")) for i in range(4)})
    sums = [F.sum(f"__w{i}").alias(f"__w{i}") for i in range(4)] + [F.sum(F.col(f"__w{i}") * F.col(f"__v{j}")).alias(f"__s{i}_{j}") for i in range(4) for j in range(len(values))]
    four = F.array(*(F.struct((4 * F.col("__block") + i).alias("resample"), F.col(f"__w{i}").alias("weight"), *(F.col(f"__s{i}_{j}").alias(c) for j, c in enumerate(values))) for i in range(4)))
    return rows.groupBy("__block").agg(*sums).select(F.explode(four).alias("__s")).select("__s.*").where((F.col("weight") > 0) & (F.col("resample") < resamples))


def poisson_array(resamples: int, *keys: str, seed: int = 42) -> Column:
    """The same counts as an array, one for each resample."""
    four = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(-(-resamples // 4) - 1)), lambda g: F.transform(F.array(_digits(keys, g, seed)), lambda d: F.array(*(_poisson(F.substring(d, 8 * i + 1, 8)).cast("tinyint") for i in range(4))))[0]))
    return F.slice(four, 1, resamples)
