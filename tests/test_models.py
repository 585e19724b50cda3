"""Components, distributions, splines and trees against direct computation."""

import inspect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.models import distributions as D
from tideline.models.gam import Gam, Linear, Smooth, basis, fit_by_group
from tideline.models.gram import covariance, moments, poisson_weights
from tideline.models.pca import Pca, affinity, bootstrap_stability, diagnostics, fit_pca, procrustes, qq_points, scores_by_place, tail_analysis
from tideline.models.trees import accuracy, accuracy_bootstrap, evaluate, importances, sweep

HOURS = [f"hour_{h}" for h in range(24)]


@pytest.fixture(scope="module")
def wide(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(120):
        base = 5 + 3 * np.sin(np.arange(24) / 24 * 2 * np.pi + i % 7) * (1 + i % 3) + r.normal(0, 0.1, 24)
        rows.append(("yellow", i, i % 5, *(float(v) for v in base)))
    return spark.createDataFrame(rows, "taxi_type string, day int, pickup_place int, " + ", ".join(f"{h} double" for h in HOURS)).cache()


def test_pca(spark, wide, tmp_path):
    x = np.array(wide.select(*HOURS).collect())
    model = fit_pca(wide)
    values = np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False, ddof=0)))[::-1]
    assert np.allclose(model.variances, np.maximum(values, 0), atol=1e-8) and model.n == 120 and math.isclose(model.ratios.sum(), 1)
    v = model.matrix()
    assert np.abs(v.T @ v - np.eye(24)).max() < 1e-9 and (v[np.abs(v).argmax(0), np.arange(24)] > 0).all()
    scores = {r.pickup_place: r.pc1 for r in scores_by_place(wide, model).collect()}
    direct = (x - x.mean(0)) @ v[:, 0]
    place = np.array([r[0] for r in wide.select("pickup_place").collect()])
    assert all(math.isclose(scores[p], direct[place == p].mean(), abs_tol=1e-9) for p in scores)
    model.save(str(tmp_path / "m.json"), spark)
    assert Pca.load(str(tmp_path / "m.json"), spark) == model
    assert model.loadings_frame(spark).count() == 576
    with pytest.raises(ValueError):
        fit_pca(wide.select("taxi_type"))
    holes = wide.withColumn("hour_3", F.when(F.col("day") % 4 == 0, None).otherwise(F.col("hour_3")))
    filled = x.copy()
    bad = np.array([r[0] % 4 == 0 for r in wide.select("day").collect()])
    filled[bad, 3] = x[~bad, 3].mean()
    assert np.allclose(fit_pca(holes).variances[:3], np.sort(np.linalg.eigvalsh(np.cov(filled, rowvar=False, ddof=0)))[::-1][:3])


def test_stability_and_diagnostics(wide):
    found = bootstrap_stability(wide, ["day"], 10, 2)
    assert found["B"] == 10 and 0.9 < found["affinity_mean"] <= 1 + 1e-9 and found["procrustes_mean"] < 1
    again = bootstrap_stability(wide.repartition(5), ["day"], 10, 2)
    assert math.isclose(found["affinity_mean"], again["affinity_mean"], rel_tol=1e-9)
    d = diagnostics(fit_pca(wide))
    assert d["orthogonality"] < 1e-9 and 1 <= d["effective_rank"] <= 24 and [h["d2"] for h in d["mahalanobis"]] == sorted((h["d2"] for h in d["mahalanobis"]), reverse=True)
    assert [round(d["chi2_limits"][q], 3) for q in (0.95, 0.99, 0.999)] == [36.415, 42.98, 51.179]
    tail = tail_analysis(fit_pca(wide))
    assert tail["tail_points"] == 29 and tail["classification"] in ("heavy_tail", "light_tail")
    a = np.linalg.qr(np.random.default_rng(1).normal(size=(24, 2)))[0]
    assert math.isclose(affinity(a, a), 1) and procrustes(a, a[:, ::-1]) < 1e-9
    assert len(qq_points(a[:, 0])) == 24


def test_poisson_resamples():
    keys = np.arange(20000)
    w = np.array([poisson_weights(keys, b, 1) for b in range(5)])
    assert np.allclose(w.mean(1), 1, atol=0.05) and np.allclose(w.var(1), 1, atol=0.08) and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03


def test_moments_empty(spark, wide):
    assert moments(wide.limit(0), HOURS).sum() == 0
    n, mean, cov = covariance(moments(wide, HOURS[:2])[0], 1)
    x = np.array(wide.select(*HOURS[:2]).collect())
    assert n == 120 and np.allclose(cov, np.cov(x, rowvar=False))


def test_distributions():
    assert math.isclose(D.chi2_sf(3.841459, 1), 0.05, rel_tol=1e-5) and math.isclose(D.f_sf(4.9646, 1, 10), 0.05, rel_tol=1e-3)
    assert math.isclose(D.beta_cdf(0.3, 2, 5), 0.579825, rel_tol=1e-5)
    r = random.Random(0)
    w, p = D.shapiro_wilk([r.gauss(0, 1) for _ in range(100)])
    assert w > 0.97 and p > 0.05
    w, p = D.shapiro_wilk([r.expovariate(1) for _ in range(100)])
    assert p < 1e-4
    same, other = [[r.gauss(0, 1) for _ in range(50)] for _ in range(3)], [[r.gauss(0, s) for _ in range(50)] for s in (1, 1, 5)]
    assert D.bartlett(same)[1] > 0.01 > D.bartlett(other)[1] and D.levene(same)[1] > 0.01 > D.levene(other)[1]


@pytest.fixture(scope="module")
def curve(spark):
    r = np.random.default_rng(3)
    x, z = r.uniform(0, 10, 4000), r.uniform(0, 1, 4000)
    y = np.sin(x) * 3 + 2 * z + r.normal(0, 0.1, 4000)
    return spark.createDataFrame([(i, float(a), float(b), float(c), "a" if i % 3 else "b") for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "id int, x double, z double, y double, g string").cache()


def test_splines(curve):
    b = basis(np.linspace(0, 1, 50), 0, 1, 12, 3)
    assert np.allclose(b.sum(1), 1) and b.shape == (50, 12) and (b >= -1e-12).all()
    model = Gam([Smooth("x", 20), Linear("z")], "y").fit(curve, resamples=15, keys=["id"])
    assert model.n == 4000 and abs(model.beta[-1] - 2) < 0.05
    x = np.array(curve.select("x", "z").collect())
    y = np.array([r[0] for r in curve.select("y").collect()])
    d = model.design(x)
    d, centred = d - d.mean(0), y - y.mean()
    direct = np.linalg.solve(d.T @ d + model.lam * model.penalty + 1e-6 * np.eye(21), d.T @ centred)
    assert np.allclose(model.predict(x), y.mean() + d @ direct, atol=1e-6)
    for p, q in zip(model.partial_dependence(0, 30), model.bootstrap_band(0, 30), strict=True):
        assert p["low"] < p["effect"] < p["high"] and q["low"] <= q["median"] <= q["high"]
    out = model.transform(curve, effects=True).select(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert out < 0.02
    parts = {r.term: r.mean_abs_effect for r in model.breakdown(curve).collect()}
    assert parts["x"] > parts["z"] and set(parts) == {"x", "z", "intercept"}
    assert set(fit_by_group(curve, "g", [Smooth("x")], "y", ["a", "b", "c"], 2000)) == {"a"}


def test_trees(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, r.random(), r.random()) for i in range(600)], "id int, a double, b double").withColumn("label", (F.col("a") > 0.6).cast("int")).cache()
    model, held = evaluate(df, ["a", "b"], "label", ["id"], trees=3)
    assert accuracy(held, "label") > 0.95
    assert importances(model, ["a", "b"])[0][0] == "a" and math.isclose(sum(v for _, v in importances(model, ["a", "b"])), 1)
    b = accuracy_bootstrap(held, "label", "prediction", ["id"], 20).first()
    assert b.low <= b["mean"] <= b.high
    assert len(sweep(df, ["a", "b"], "label", ["id"], (2,), (0.1, 0.3), 2)) == 2


def test_sweep_grows_the_same_trees_without_a_job_each(spark):
    """Trees on counted cells score as Spark's on the rows; a grid takes as many jobs as one setting."""
    from tideline.models import trees

    r = random.Random(4)
    rows = [(i, r.randrange(12), r.randrange(30), float(r.randrange(5))) for i in range(3000)]
    rows = [(i, a, b, c, int(a + (b > 20) * 6 + c * r.random() > 8)) for i, a, b, c in rows]
    rows += [(3000, None, 3, 1.0, 1), (3001, 4, 5, math.nan, 0), (3002, 4, 5, 1.0, None)]  # lack a feature or the label
    features = ["a", "b", "c"]
    df = spark.createDataFrame(rows, "id int, a int, b int, c double, label int").cache()
    known = df.where("id < 3000")
    bins, train, _ = trees.cells_of(df.where("label IS NOT NULL").withColumn("split", F.lit("train")), features, "label")
    assert train.sum() == 3000 and bins.shape[1] < 12 * 30 * 5 + 1
    model = trees.fit_trees(known, features, "label", 8, 3, 0.3, subsample=1.0)
    at = {tuple(c): i for i, c in enumerate(zip(*(b.tolist() for b in bins), strict=True))}
    score = trees.grow(bins, train, 8, 3, 0.3, subsample=1.0)
    for p in trees.predict(model, known, features).select(*features, "prediction").distinct().collect():
        assert p.prediction == (score[at[p.a, p.b, int(p.c)]] > 0)

    def jobs(rates):
        spark.sparkContext.setJobGroup(f"sweep {len(rates)}", "")
        try:
            found = sweep(df, features, "label", ["id"], (2, 3), rates, 4)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep {len(rates)}"))

    (one, few), (four, many) = jobs((0.3,)), jobs((0.01, 0.1, 0.3, 0.5))
    assert few == many < 30 and all(x in four for x in one)
    assert four[0]["accuracy"] > 0.85


def test_trees_grow_on_counted_cells(spark, monkeypatch):
    """Copies of rows add weight, not rows to fit on; bins are ordered, not categories; the model takes the features as they are."""
    from tideline.models import trees

    seen = []

    class Fitted(trees.GBTClassifier):
        def _fit(self, data):
            seen.append(data.agg(F.count("*"), F.sum("__weight")).first())
            return super()._fit(data)

    monkeypatch.setattr(trees, "GBTClassifier", Fitted)
    df = spark.range(40000).selectExpr("cast(id % 40 as double) a", "cast(id % 7 as int) b", "cast(id % 40 > 25 as int) label")
    model = trees.fit_trees(df, ["a", "b"], "label", 2, 2)
    assert seen[0][1] == 40000 and seen[0][0] <= 2 * 32 * 7 * trees.PARTS and " in {" not in model.stages[-1].toDebugString
    held = spark.createDataFrame([(12.0, 3, 0), (39.0, 6, 1), (None, 1, 1)], "a double, b int, label int")
    assert [r.prediction for r in trees.predict(model, held, ["a", "b"]).orderBy("a").collect()] == [0, 1]


def test_sweep_beyond_the_cells(spark, monkeypatch):
    """Too many cells: Spark's trees on the rows, to the same result but for the draws."""
    from tideline.models import trees

    df = spark.range(900).selectExpr("cast(id as int) id", "cast(id * 37 % 101 as double) a", "cast(id * 37 % 101 > 60 as int) label").cache()
    want = sweep(df, ["a"], "label", ["id"], (1, 2), (0.3,), 3)
    monkeypatch.setattr(trees, "CELLS", 10)
    monkeypatch.setattr(trees, "_sweep_rows", lambda *a, f=trees._sweep_rows: called.append(1) or f(*a))
    called = []
    assert sweep(df, ["a"], "label", ["id"], (1, 2), (0.3,), 3) == want and called
    assert want[0]["accuracy"] > 0.95
    with pytest.raises(ValueError):
        sweep(df.withColumn("label", F.lit(2)), ["a"], "label", ["id"], (1,), (0.3,), 3)


def test_thresholds(spark):
    """Even shares of the rows, also where one value lies far off; all values if there are few."""
    from tideline.models import trees

    df = spark.range(20000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "if(id = 0, 1e15, cast(id as double)) c", "1.0D d")
    a, b, c, d = trees.thresholds(df, ["a", "b", "c", "d"])
    assert b == [1, 2, 3, 4, 5, 6] and d == [] and len(a) == len(c) == trees.BINS - 1
    assert all(abs(x - 625 * (i + 1)) < 25 for t in (a, c) for i, x in enumerate(t))


def test_queries_run_the_whole_models(spark, sf, monkeypatch):
    """The registered queries fit with the reference's trees, grid and resamples."""
    from tideline.models import trees
    from tideline.plans import catalogue

    class Seen(Exception):
        pass

    def fitted(name):
        got = []

        def see(f):
            def run(*args, **options):
                bound = inspect.signature(f).bind(*args, **options)
                bound.apply_defaults()
                got.append(bound.arguments)
                raise Seen

            return run

        monkeypatch.setattr(trees, "fit_trees", see(FIT))
        monkeypatch.setattr(catalogue, "sweep", see(sweep) if name == "gbt_sweep" else sweep)
        monkeypatch.setattr(Gam, "fit", see(GAM))
        with pytest.raises(Seen):
            catalogue.QUERIES[name](spark, sf)
        return got[0]

    FIT, GAM = trees.fit_trees, Gam.fit
    grid = fitted("gbt_sweep")
    assert (grid["depths"], grid["rates"], grid["trees"]) == ((2, 4, 6, 8), (0.01, 0.05, 0.1, 0.3), 100)
    assert all(fitted(q)["trees"] == 100 for q in ("gbt_accuracy", "gbt_profiles"))
    assert fitted("gam_partial_dependence")["resamples"] == 50
