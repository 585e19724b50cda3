"""Grouped quantiles, distribution functions, densities, boxes, tests of spread, normal scores, distances, resamples, splines, months, components."""

import math
import random
import statistics
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions.sizes import format_size, parse_size, percent, percent_text, size_of, size_text
from tideline.functions.special import beta_i, chi2_sf, f_sf, gamma_q, normal_quantile
from tideline.functions.splines import spline_basis
from tideline.models import distributions as driver
from tideline.models.gam import Gam, Linear, Smooth, basis
from tideline.models.power import leading_components
from tideline.models.trees import accuracy_bootstrap
from tideline.operators import distributions as dist
from tideline.operators import quantiles
from tideline.operators.quantiles import grouped_quantiles
from tideline.operators.sampling import POISSON, _poisson, poisson_array, poisson_resamples, poisson_sums
from tideline.sources.months import read_months, with_path_month, write_months


@pytest.fixture(scope="module")
def groups(spark):
    """Three groups (one null) of very different scales and sizes, ties, nulls, NaN."""
    r = random.Random(5)
    rows = [("a", r.gauss(0, 1)) for _ in range(300)] + [("b", r.lognormvariate(0, 3)) for _ in range(501)] + [(None, float(r.randrange(4))) for _ in range(90)]
    rows += [("a", None), ("b", float("nan")), ("c", None), ("d", 7.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(3)


def values_of(rows):
    out = {}
    for g, v in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("bins", [4096, 40])
def test_grouped_quantiles(groups, monkeypatch, bins):
    rows, df = groups
    monkeypatch.setattr(quantiles, "BINS", bins)
    q = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    got = {(r["g"], r["column"]): (r["n"], r["quantiles"]) for r in grouped_quantiles(df.withColumn("w", -F.col("v")), ["g"], ["v", "w"], q).collect()}
    want = values_of(rows)
    assert set(got) == {(g, c) for g in want for c in "vw"}
    for g, v in want.items():
        for c, sign in (("v", 1), ("w", -1)):
            n, found = got[g, c]
            assert n == len(v)
            np.testing.assert_allclose(found, np.quantile([sign * x for x in v], q), rtol=1e-12, atol=1e-300)


def test_grouped_quantiles_of_extremes(spark):
    df = spark.createDataFrame([(1.7e308,), (-1.7e308,), (float("inf"),), (5e-324,), (0.0,)], "v double")
    assert grouped_quantiles(df, [], ["v"], [0.0, 0.5, 1.0]).first()["quantiles"] == [-1.7e308, 5e-324, 1.7976931348623157e308]
    assert grouped_quantiles(df.limit(0), [], ["v"], [0.5]).collect() == []


def test_distribution_functions(spark):
    """Against the driver's series and fractions, which are other code, and known values."""
    cases = [(x, float(a), float(b)) for x in (1e-3, 0.2, 0.5, 0.9, 1.0, 2.5, 10.0, 60.0) for a, b in ((1, 1), (1, 10), (2, 57), (5, 3000), (23, 552), (0.5, 0.5))]
    df = spark.createDataFrame(cases, "x double, a double, b double")
    row = df.select("x", "a", "b", chi2_sf(F.col("x"), F.col("a")).alias("c"), f_sf(F.col("x"), F.col("a"), F.col("b")).alias("f"), gamma_q(F.col("a"), F.col("x")).alias("q"), beta_i(F.col("x") / 61, F.col("a"), F.col("b")).alias("i"))
    for r in row.collect():
        assert r["c"] == pytest.approx(driver.chi2_sf(r["x"], r["a"]), rel=1e-9, abs=1e-13)
        assert r["f"] == pytest.approx(driver.f_sf(r["x"], r["a"], r["b"]), rel=1e-9, abs=1e-13)
        assert r["i"] == pytest.approx(driver.beta_cdf(r["x"] / 61, r["a"], r["b"]), rel=1e-9, abs=1e-13)
    one = spark.range(1).select(chi2_sf(F.lit(3.841458820694124), F.lit(1)).alias("a"), f_sf(F.lit(3.0), F.lit(2), F.lit(1e9)).alias("b"), chi2_sf(F.lit(None).cast("double"), F.lit(1)).alias("c"), normal_quantile(F.lit(0.0)).alias("d")).first()
    assert one["a"] == pytest.approx(0.05) and one["b"] == pytest.approx(math.exp(-3)) and one["c"] is None and one["d"] is None
    p = [1e-12, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.99, 1 - 1e-9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(normal_quantile(F.col("p"))).collect()]
    np.testing.assert_allclose(got, [NormalDist().inv_cdf(x) for x in p], rtol=2e-9, atol=1e-12)


def test_spread_tests(groups, spark):
    rows, df = groups
    want = [v for v in values_of(rows).values() if len(v) > 1]
    got = {r["test"]: r for r in dist.spread_tests(df, "g", "v").collect()}
    for name, f in (("bartlett", driver.bartlett), ("levene", driver.levene)):
        statistic, p = f(want)
        assert got[name]["statistic"] == pytest.approx(statistic, rel=1e-9) and got[name]["p"] == pytest.approx(p, rel=1e-6, abs=1e-12)
        assert got[name]["groups"] == 3 and got[name]["n"] == 891 and got[name]["reject"] == (p < 0.05)
    alone = dist.spread_tests(df.where("g = 'a'"), "g", "v").collect()
    assert [r["statistic"] for r in alone] == [None, None]
    flat = dist.spread_tests(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, v double"), "g", "v").collect()
    assert [r["statistic"] for r in flat] == [None, None]
    assert dist.spread_tests(df.limit(0), "g", "v").collect() == []


def test_density(groups):
    """The binned curve is within a bound of the plain sum over all values, and has a mass of about 1."""
    rows, df = groups
    kept = df.where("g = 'a' or g is null or g = 'd'")
    got = dist.density(kept, ["g"], "v", points=101, cut=3).orderBy("point").collect()
    assert {r["g"] for r in got} == {"a", None}
    for g in ("a", None):
        v = np.array(values_of(rows)[g])
        h = statistics.stdev(v) * len(v) ** -0.2
        x = np.array([r["x"] for r in got if r["g"] == g])
        y = np.array([r["density"] for r in got if r["g"] == g])
        assert x[0] == pytest.approx(v.min() - 3 * h) and x[-1] == pytest.approx(v.max() + 3 * h)
        plain = np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        step = (v.max() - v.min()) / 1023
        assert np.abs(y - plain).max() <= (step / h) ** 2 / 8 / (h * math.sqrt(2 * math.pi)) * 1.01 + 1e-12
        assert np.trapezoid(y, x) == pytest.approx(1, abs=0.01)
    assert dist.density(df.limit(0), ["g"], "v").collect() == []


def test_boxes(groups):
    rows, df = groups
    got = {r["g"]: r for r in dist.box_whiskers(df, ["g"], "v").collect()}
    beyond = sorted((r["g"], r["v"], r["fence"]) for r in dist.box_outliers(df.where("g is not null"), ["g"], "v").collect())
    want = []
    for g, v in values_of(rows).items():
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = [x for x in v if lo <= x <= hi]
        r = got.pop(g)
        np.testing.assert_allclose([r["q1"], r["median"], r["q3"], r["low"], r["high"]], [q1, q2, q3, min(inside), max(inside)], rtol=1e-12)
        assert (r["n"], r["below"], r["above"]) == (len(v), sum(x < lo for x in v), sum(x > hi for x in v))
        want += [(g, x, lo if x < lo else hi) for x in v if not lo <= x <= hi and g is not None]
    assert not got and len(beyond) == len(want) > 0
    for a, b in zip(beyond, sorted(want), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert dist.box_whiskers(df.limit(0), ["g"], "v").collect() == dist.box_outliers(df.limit(0), ["g"], "v").collect() == []


@pytest.mark.parametrize("ranges,spread", [(1024, 10_000), (4, 7)])
def test_normal_scores(groups, monkeypatch, ranges, spread):
    rows, df = groups
    monkeypatch.setattr(dist, "SPREAD", spread)
    got = {}
    for r in dist.normal_scores(df, ["g"], "v", ranges=ranges).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["x"], r["score"]))
    for g, v in values_of(rows).items():
        n = len(v)
        p = [0.5] if n == 1 else [1 - 0.5 ** (1 / n), *((i - 0.3175) / (n + 0.365) for i in range(2, n)), 0.5 ** (1 / n)]
        found = sorted(got.pop(g))
        assert [f[:2] for f in found] == list(enumerate(sorted(v), 1))
        np.testing.assert_allclose([f[2] for f in found], [NormalDist().inv_cdf(x) for x in p], rtol=1e-8, atol=1e-9)
    assert not got
    assert dist.normal_scores(df.limit(0), ["g"], "v").collect() == []


def test_normality(groups):
    """W' is the square of a correlation, near 1 for normal values; its p tells normal from lognormal."""
    rows, df = groups
    got = {r["g"]: r for r in dist.normality(df, ["g"], "v").collect()}
    v = sorted(values_of(rows)["a"])
    m = [NormalDist().inv_cdf((i - 0.375) / (len(v) + 0.25)) for i in range(1, len(v) + 1)]
    assert got["a"]["w"] == pytest.approx(np.corrcoef(v, m)[0, 1] ** 2, rel=1e-8)
    assert got["a"]["p"] > 0.01 > got["b"]["p"] and got["d"]["p"] is None


def test_mahalanobis(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 3)) @ np.array([[1, 0.5, 0], [0, 2, 0.1], [0, 0, 0.01]]) + [5, -3, 1e4]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, 1.0, float("nan"), 1.0)], "id long, a double, b double, c double").repartition(3)
    for ranges in (1024, 5):
        got = {r["id"]: r for r in dist.mahalanobis(df, ["a", "b", "c"], ranges=ranges).collect()}
        cov = np.cov(x.T)
        cov = 0.9 * cov + 0.1 * np.trace(cov) / 3 * np.eye(3)
        d2 = np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0))
        assert sorted(got) == list(range(400))
        np.testing.assert_allclose([got[i]["d2"] for i in range(400)], d2, rtol=1e-6)
        assert sorted(range(400), key=lambda i: got[i]["rank"]) == np.argsort(-d2, kind="stable").tolist()
        assert [got[i]["outlier_95"] for i in range(400)] == (d2 > driver.chi2_quantile(0.95, 3)).tolist()
    empty = dist.mahalanobis(df.limit(0), ["a", "b", "c"])
    assert empty.collect() == [] and empty.columns == ["id", "a", "b", "c", "d2", "outlier_95", "outlier_99", "outlier_999", "rank"]


def test_poisson_resamples(spark):
    """Mean and variance about 1, the same however rows are partitioned, and the array has the same counts."""
    df = spark.range(3000).repartition(5)
    rows = poisson_resamples(df, 6, "id").groupBy("id", "resample").agg(F.sum("weight").alias("w"))
    got = {(r["id"], r["resample"]): r["w"] for r in rows.collect()}
    every = np.array([[got.get((i, b), 0) for b in range(6)] for i in range(3000)])
    arrays = {r["id"]: list(r["w"]) for r in df.coalesce(1).select("id", poisson_array(6, "id").alias("w")).collect()}
    assert [arrays[i] for i in range(3000)] == every.tolist()
    assert np.abs(every.mean(0) - 1).max() < 0.1 and np.abs(every.var(0) - 1).max() < 0.15
    assert np.abs(np.corrcoef(every.T) - np.eye(6)).max() < 0.1
    hits = df.select("id", (F.col("id") % 5 == 0).cast("int").alias("y"), F.lit(1).alias("p"))
    one = accuracy_bootstrap(hits, "y", "p", ["id"], 40).first()
    assert one["low"] < one["mean"] < one["high"] and one["mean"] == pytest.approx(0.2, abs=0.01) and one["std"] == pytest.approx(math.sqrt(0.16 / 3000), rel=0.5)


def test_poisson_sums(spark):
    """The sums are those of the rows' counts, null keys included; a file of one partition is dealt out; digits beside each limit count as their numbers do."""
    df = spark.createDataFrame([(None if i % 7 == 0 else i, None if i % 5 == 0 else "k", i % 3 == 0 if i % 11 else None) for i in range(500)], "a int, b string, hit boolean").coalesce(1)
    want = {r[0]: r[1:] for r in poisson_resamples(df, 6, "a", "b").groupBy("resample").agg(F.sum("weight"), F.sum(F.col("weight") * F.col("hit").cast("int"))).collect()}
    sums = poisson_sums(df, 6, {"hits": F.col("hit")}, "a", "b")
    assert {r[0]: r[1:] for r in sums.collect()} == want and len(want) == 6
    assert "RoundRobinPartitioning" in sums._jdf.queryExecution().toString()
    digits = sorted({max(0, min((1 << 32) - 1, math.floor(p * (1 << 32)) + k)) for p in POISSON for k in range(-2, 3)} | {0})
    got = [r[0] for r in spark.createDataFrame([(f"{d:08x}",) for d in digits], "d string").coalesce(1).select(_poisson(F.col("d"))).collect()]
    assert got == [sum((d + 0.5) / 4294967296.0 > p for p in POISSON) for d in digits]


@pytest.mark.parametrize("order,splines", [(3, 7), (1, 4), (2, 12), (3, 24)])
def test_splines(spark, order, splines):
    x = [-5.0, 0.0, 0.1, 1.0, 3.3333, 9.999, 10.0, 20.0]
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in [*x, None]], "x double").select("x", spline_basis(F.col("x"), 0.0, 10.0, splines, order).alias("b")).collect()]
    np.testing.assert_allclose(np.array(got[:-1]), basis(np.array(x), 0.0, 10.0, splines, order), atol=1e-12)
    assert got[-1] is None and all(sum(b) == pytest.approx(1) for b in got[:-1])


def test_native_prediction(spark):
    """The expressions give what NumPy gives; null and NaN inputs give null."""
    r = np.random.default_rng(1)
    rows = [(float(a), float(b), float(np.sin(a) + 0.5 * b + e)) for a, b, e in zip(r.uniform(0, 6, 500), r.normal(size=500), r.normal(size=500) * 0.1, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = Gam([Smooth("a"), Linear("b")], "y").fit(df)
    got = model.transform(df.unionByName(spark.createDataFrame([(None, 1.0, 0.0), (1.0, float("nan"), 0.0)], df.schema)), effects=True).collect()
    x = np.array([v[:2] for v in rows])
    np.testing.assert_allclose([g["prediction"] for g in got[:500]], model.predict(x), atol=1e-9)
    np.testing.assert_allclose([g["effect_a"] for g in got[:500]], model.effect(x, 0), atol=1e-9)
    assert [g["prediction"] for g in got[500:]] == [None, None]
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_months(spark, tmp_path):
    """One month is redone: its folders are replaced or go, the others stay; only named months are read."""
    path = str(tmp_path / "months-2019-07")
    rows = [("yellow", 2023, 1, 5), ("green", 2023, 1, 6), ("yellow", 2023, 2, 7), ("fhvhv", 2024, 1, 8)]
    schema = "taxi_type string, year int, month int, n int"
    write_months(spark.createDataFrame(rows, schema), path)
    write_months(spark.createDataFrame([("yellow", 2023, 1, 50)], schema), path, redo=[(2023, 1)])
    every = with_path_month(read_months(spark, path), path)
    got = sorted((r["path_type"], r["path_year"], r["path_month"], r["n"]) for r in every.collect())
    assert got == [("fhvhv", 2024, 1, 8), ("yellow", 2023, 1, 50), ("yellow", 2023, 2, 7)]
    some = read_months(spark, path, [(2023, 2), (2024, 1)])
    assert sorted(r["n"] for r in some.collect()) == [7, 8]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(some.inputFiles()) == 2 or "year" in plan
    write_months(spark.createDataFrame([], schema), path, redo=[(2023, 2)])
    assert sorted(r["n"] for r in read_months(spark, path).collect()) == [8, 50]
    assert read_months(spark, path, []).collect() == []


def test_leading_components(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4)) * [5, 3, 1, 0.5]
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(*map(float, v),) for v in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = leading_components(df, list("abcd"), 2).collect()
    values, vectors = np.linalg.eigh(np.cov(x.T, ddof=0))
    for r, k in zip(got, (-1, -2), strict=True):
        v = vectors[:, k] * (1 if np.abs(vectors[:, k]).max() in vectors[:, k] else -1)
        assert r["variance"] == pytest.approx(values[k], rel=1e-6)
        np.testing.assert_allclose(r["loadings"], v, atol=1e-5)
    assert leading_components(df.limit(0), list("abcd")).collect() == []


def test_size_columns(spark):
    n = [0, 1, 1023, 1024, 1536, 17536, 1048576, 5 << 30, 3 << 40]
    rows = spark.createDataFrame([(v,) for v in n], "n long").select("n", size_text(F.col("n")).alias("t"), percent_text(F.col("n"), F.lit(1 << 41)).alias("p")).withColumn("b", size_of(F.col("t")))
    for r in rows.collect():
        assert r["t"] == format_size(r["n"]) and r["p"] == percent(r["n"], 1 << 41) and r["b"] == (parse_size(r["t"]) if r["n"] else None)
    bad = spark.createDataFrame([("12",), ("x MB",), (None,), (" 1.5 gb ",)], "t string").select(size_of(F.col("t"))).collect()
    assert [b[0] for b in bad] == [None, None, None, 1610612736]
    assert spark.range(1).select(percent_text(F.lit(1), F.lit(0))).first()[0] == "N/A"
