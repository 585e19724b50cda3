"""Boosted-tree classification, its sweep, and the bootstrap of its accuracy."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.sampling import poisson_sums, stratified_split

#: Bins of a feature, as Spark's trees have; steps an octave in which values are counted to place them.
BINS, STEPS = 32, 4096
#: Distinct cells up to which each setting's trees grow in one task; settings that are fit side by side beyond that.
CELLS, BESIDE = 1 << 22, 4
#: Weighted rows at most that a cell's rows become for Spark's trees, and those that are worth a task.
PARTS, PART_ROWS = 4, 20_000


def fit_trees(train: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 4, rate: float = 0.1, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    """Spark's boosted trees over bins of the features, on rows counted by cell (a bin of each feature) and label.

    Trees over bins can't tell rows of one cell apart, so a cell's rows are given as ``PARTS`` weighted rows at most, which a tree
    draws or leaves out: one for each row where there are so few, else equal shares. So a tree's passes grow with the distinct
    cells, not with the rows. Rows are in a fixed order in partitions of about ``PART_ROWS``, as each level of a tree is a job.
    """
    names = [f"__bin{i}" for i in range(len(features))]
    whole = train.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in features), F.col(label).cast("double").alias("__y"))
    whole = whole.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features))
    ends = [[-np.inf, *(t or [0.0]), np.inf] for t in thresholds(whole, features)]  # a feature of one value isn't split on, wherever it is cut
    binned = Bucketizer(inputCols=features, outputCols=names, splitsArray=ends, handleInvalid="skip")
    cells = binned.transform(whole).groupBy(*names, "__y").agg(F.count("*").alias("__n"))
    parts = F.least("__n", F.lit(PARTS))
    ordinals = ((F.col(n) + F.lit(0.0)).alias(n) for n in names)  # without the bucketizer's attributes, by which bins would be categories
    rows = cells.select(*ordinals, "__y", (F.col("__n") / parts).alias("__weight"), F.explode(F.sequence(F.lit(1).cast("long"), parts)).alias("__part")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tasks = max(1, min(train.sparkSession.sparkContext.defaultParallelism, rows.count() // PART_ROWS))
        dealt = rows.repartition(tasks, *names, "__y", "__part").sortWithinPartitions(*names, "__y", "__part").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            assembler = VectorAssembler(inputCols=names, outputCol="__x")
            fitted = GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed).fit(assembler.transform(dealt))
        finally:
            dealt.unpersist()
    finally:
        rows.unpersist()
    return PipelineModel([binned, assembler, fitted])


def predict(model: PipelineModel, df: DataFrame, features: list[str], out: str = "prediction") -> DataFrame:
    """Rows that have all features, with the class that the trees tell."""
    rows = model.transform(df)
    rows = rows.withColumn(out, F.col("prediction").cast("int"))
    return rows.select(*df.columns, out)


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: -x[1])


def accuracy(df: DataFrame, label: str, prediction: str = "prediction") -> float:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).first()[0] or 0.0


def evaluate(df: DataFrame, features: list[str], label: str, keys: list[str], fraction: float = 0.8, **options) -> tuple[PipelineModel, DataFrame]:
    """Fit on a stratified split; the other rows come back with their predictions. The split is persisted while the trees grow."""
    split = stratified_split(df, label, *keys, fraction=fraction)
    train = split.where("split = 'train'").select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_trees(train, features, label, **options)
    finally:
        train.unpersist()
    return model, predict(model, split.where("split = 'valid'"), features)


def sweep(df: DataFrame, features: list[str], label: str, keys: list[str], depths=(2, 4, 6, 8), rates=(0.01, 0.05, 0.1, 0.3), trees: int = 100) -> list[dict]:
    """Accuracy of every depth and rate, best first; ties in the grid's order.

    Trees over bins can't tell rows of equal bins apart, so all rows are counted
    by cell (a bin of each feature) once, and each setting grows all of its trees
    on the counted cells in a task of its own: a job for the grid instead of one
    for each level of each tree. Where there are more than ``CELLS``
    of them, Spark's trees are fit on the rows, ``BESIDE`` settings at a time.
    """
    grid = [(depth, rate) for depth in depths for rate in rates]
    split = stratified_split(df, label, *keys).where(F.col(label).isNotNull()).select(*(F.col(c).cast("double").alias(c) for c in features), label, "split").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = _sweep_cells(split, features, label, grid, trees)
        if found is None:
            found = _sweep_rows(split, features, label, grid, trees)
    finally:
        split.unpersist()
    return sorted(({"depth": d, "rate": r, "accuracy": a} for (d, r), a in zip(grid, found, strict=True)), key=lambda x: -x["accuracy"])


def _sweep_rows(split: DataFrame, features: list[str], label: str, grid: list[tuple[int, float]], trees: int) -> list[float]:
    train, valid = split.where("split = 'train'"), split.where("split = 'valid'")
    with ThreadPool(BESIDE) as pool:
        return pool.map(lambda g: accuracy(predict(fit_trees(train, features, label, trees, *g), valid, features), label), grid, 1)


def _sweep_cells(split: DataFrame, features: list[str], label: str, grid: list[tuple[int, float]], trees: int) -> list[float] | None:
    """Each setting's accuracy, or None if there are too many cells."""
    counted = cells_of(split, features, label)
    if counted is None:
        return None
    bins, train, valid = counted
    sc = split.sparkSession.sparkContext
    shared = sc.broadcast((bins, train, valid))

    def fit(setting: tuple[int, int, float]) -> tuple[int, float]:
        (bins, train, valid), (at, depth, rate) = shared.value, setting
        says = grow(bins, train, trees, depth, rate) > 0
        return at, float(np.where(says, valid[0], valid[1]).sum() / max(1, valid.sum()))

    settings = sorted(((i, *g) for i, g in enumerate(grid)), key=lambda x: -x[1])  # the longest first
    try:
        return [a for _, a in sorted(sc.parallelize(settings, len(settings)).map(fit).collect())] if settings else []
    finally:
        shared.destroy()


def thresholds(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Where each feature's bins begin, ``BINS`` - 1 values at most.

    Between any two values if there are few, else at even ranks; values are
    counted by the logarithm of their distance from the least, to 1 in ``STEPS``.
    """
    low = rows.agg(*(F.min(c) for c in features)).first()
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(c).alias("v"), (F.col(c) - F.lit(m)).alias("d")) for i, (c, m) in enumerate(zip(features, low, strict=True))))).alias("s")).select("s.*")
    step = F.when(F.col("d") > 0, F.floor(F.log2("d") * STEPS))
    counted = pairs.groupBy("f", step.alias("step")).agg(F.min("v").alias("v"), F.count("*").alias("n")).orderBy("f", "v").toArrow()
    f, v, n = (counted.column(c).to_numpy() for c in ("f", "v", "n"))
    out = []
    for i in range(len(features)):
        values, before = v[f == i], np.cumsum(n[f == i])
        if len(values) > BINS:  # a rank falls where the values up to it are nearest to its share of all rows
            ranks = before[-1] * np.arange(1, BINS) / BINS
            after = np.searchsorted(before, ranks)
            at = np.where((after > 0) & (ranks - before[after - 1] < before[after] - ranks), after - 1, after) + 1
            values = values[np.unique(np.concatenate([[0], at[at < len(values)]]))]
        out.append(values[1:].tolist())
    return out


def cells_of(split: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bins by feature, train rows of label 1 and 0, valid rows of label 1 and 0) of every cell, in the bins' order; None beyond ``CELLS``.

    As with Spark's trees, rows that lack a feature are left out, and labels are 0 and 1.
    """
    whole = split.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in features))
    train = F.col("split") == "train"
    names = [f"__bin{i}" for i in range(len(features))]
    ends = [[-np.inf, *t, np.inf] for t in thresholds(whole.where(train), features)]
    some = [i for i, e in enumerate(ends) if len(e) > 2]  # others have one value
    if some:
        whole = Bucketizer(inputCols=[features[i] for i in some], outputCols=[names[i] for i in some], splitsArray=[ends[i] for i in some]).transform(whole)
    whole = whole.select(*(F.col(n).cast("byte") if i in some else F.lit(0).cast("byte").alias(n) for i, n in enumerate(names)), F.col(label).cast("double").alias("__y"), train.alias("__train"))
    counts = [F.count_if((F.col("__y") == y) & (F.col("__train") == t)) for t in (True, False) for y in (1, 0)]
    cells = whole.groupBy(*names).agg(*(c.alias(f"__n{i}") for i, c in enumerate(counts)), F.count_if(~F.col("__y").isin(0.0, 1.0)).alias("__other")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, other, fit = cells.agg(F.count("*"), F.sum("__other"), F.sum(F.col("__n0") + F.col("__n1"))).first()
        if other or not fit:
            raise ValueError("labels have to be 0 and 1" if other else "no rows to fit on")
        if n > CELLS:
            return None
        got = cells.drop("__other").toArrow()
    finally:
        cells.unpersist()
    columns = [got.column(c).to_numpy() for c in got.column_names]
    order = np.lexsort(columns[: len(features)][::-1])
    bins, counted = np.stack(columns[: len(features)])[:, order], np.stack(columns[len(features) :])[:, order]
    return bins, counted[:2], counted[2:]


def grow(bins: np.ndarray, counts: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.1, subsample: float = 0.8, seed: int = 42) -> np.ndarray:
    """Every cell's score by boosted trees on the rows counted in ``counts`` (of label 1, of label 0); above 0 says 1.

    As Spark's: the loss is 2 log(1 + exp(-2 y score)) of y = 1 and -1, the first tree
    fits y with weight 1, others the loss's gradient with weight ``rate``; splits
    have the greatest gain of variance, leaves the mean. A tree draws each row
    with probability ``subsample``: of a cell's rows a binomial number.
    """
    random, every = np.random.default_rng(seed), np.arange(bins.shape[1])
    score, single = np.zeros(len(every)), counts == 1
    more = np.nonzero(counts > 1)
    for tree in range(trees):
        if subsample < 1:
            drawn = ((random.random(counts.shape) < subsample) & single).astype(float)
            drawn[more] = random.binomial(counts[more], subsample)
        else:
            drawn = counts.astype(float)
        up, down = (4 / (1 + np.exp(np.clip(2 * y * score, -700, 700))) for y in (1, -1)) if tree else (1.0, 1.0)
        weight, total = drawn[0] + drawn[1], drawn[0] * up - drawn[1] * down
        node, mean = np.zeros(len(every), np.int64), np.zeros(1)
        for level in range(depth):
            feature, cut, mean = _splits(bins, node, weight, total, 1 << level)
            node = 2 * node + (bins[feature[node], every] > cut[node])
        if not depth:
            mean = np.array([total.sum() / max(1, weight.sum())])
        score += (rate if tree else 1.0) * mean[node]
    return score


def _splits(bins: np.ndarray, node: np.ndarray, weight: np.ndarray, total: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin to the left, both sides' means one after the other) of each node's best split; a node without a gain goes left as a whole."""
    start, best = node * BINS, np.zeros(nodes)
    feature, cut, mean = np.zeros(nodes, np.int64), np.full(nodes, BINS), np.zeros((nodes, 2))
    for f, own in enumerate(bins):
        at = start + own
        w, s = (np.bincount(at, v, nodes * BINS).reshape(nodes, BINS).cumsum(1) for v in (weight, total))
        if not f:
            whole_w, whole_s = w[:, -1], s[:, -1]
            mean[:, 0] = whole_s / np.maximum(whole_w, 1)
            none = whole_s * mean[:, 0]
            least = 1e-12 * none
        right_w, right_s = whole_w[:, None] - w, whole_s[:, None] - s
        gain = np.where((w > 0.5) & (right_w > 0.5), s * s / np.maximum(w, 1) + right_s * right_s / np.maximum(right_w, 1) - none[:, None], 0)
        at = gain.argmax(1)
        every = np.arange(nodes)
        hit = (gain[every, at] > np.maximum(best, least)).nonzero()[0]
        at = at[hit]
        best[hit], feature[hit], cut[hit] = gain[hit, at], f, at
        mean[hit, 0], mean[hit, 1] = s[hit, at] / w[hit, at], right_s[hit, at] / right_w[hit, at]
    return feature, cut, mean.ravel()


def accuracy_bootstrap(df: DataFrame, label: str, prediction: str, keys: list[str], resamples: int = 100, seed: int = 42) -> DataFrame:
    """mean, std (n), low, high (2.5 and 97.5 %) of the accuracy over Poisson resamples, from one pass over the rows."""
    each = poisson_sums(df, resamples, {"hits": F.col(label) == F.col(prediction)}, *keys, seed=seed).select((F.col("hits") / F.col("weight")).alias("a"))
    p = F.percentile("a", F.array(F.lit(0.025), F.lit(0.975)))  # a value a resample
    return each.agg(F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"), p[0].alias("low"), p[1].alias("high"))
