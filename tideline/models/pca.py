"""Principal components of wide tables from one pass of moments, and what is read off them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.columns import hour_columns
from tideline.models import distributions as dist
from tideline.models.gram import column_means, covariance, fill_with_means, moments
from tideline.operators.sampling import poisson_array
from tideline.sources.sinks import read_text, write_text


@dataclass
class Pca:
    """Components are columns of ``loadings``, largest variance first; the largest loading of each is positive."""

    columns: list[str]
    mean: list[float]
    variances: list[float]
    loadings: list[list[float]]
    n: int
    total: float

    @property
    def ratios(self) -> np.ndarray:
        return np.array(self.variances) / self.total

    def matrix(self) -> np.ndarray:
        return np.array(self.loadings)

    def save(self, path: str, spark: SparkSession) -> None:
        """As JSON, to any place that Spark writes to."""
        write_text(spark, path, json.dumps(asdict(self)))

    @staticmethod
    def load(path: str, spark: SparkSession) -> Pca:
        return Pca(**json.loads(read_text(spark, path)))

    def loadings_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k + 1, c, float(self.loadings[i][k])) for k in range(len(self.variances)) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component int, feature string, loading double")

    def score(self, k: int) -> Column:
        """The centred score on component k, counted from 0."""
        return reduce(lambda a, b: a + b, [(F.col(c).cast("double") - m) * float(row[k]) for c, m, row in zip(self.columns, self.mean, self.loadings, strict=True)])


def from_moments(sums: np.ndarray, columns: list[str], k: int | None = None, centre: list[float] | None = None) -> Pca:
    n, mean, cov = covariance(sums)
    mean = mean + (0 if centre is None else np.array(centre))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[: k or len(values)]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    return Pca(columns, mean.tolist(), np.maximum(values[order], 0).tolist(), vectors.tolist(), int(round(n)), float(np.trace(cov)))


def fit_pca(wide: DataFrame, k: int | None = None, columns: list[str] | None = None) -> Pca:
    """Covariance with n in the denominator; nulls get the column's mean."""
    columns = columns or hour_columns(wide.columns)
    if not columns:
        raise ValueError("no hour columns")
    means = column_means(wide, columns)
    return from_moments(moments(fill_with_means(wide, columns, means), columns, centre=means)[0], columns, k, means)


def scores_by_place(wide: DataFrame, model: Pca, place: str = "pickup_place") -> DataFrame:
    """Mean centred score per place on every component: pc1 ..."""
    filled = fill_with_means(wide, model.columns)
    return filled.groupBy(place).agg(*(F.avg(model.score(k)).alias(f"pc{k + 1}") for k in range(len(model.variances))))


def affinity(u: np.ndarray, v: np.ndarray) -> float:
    return float((np.linalg.svd(u.T @ v, compute_uv=False) ** 2).mean())


def procrustes(a: np.ndarray, b: np.ndarray) -> float:
    """Frobenius distance of b, turned as well as it can be, from a."""
    x, _, y = np.linalg.svd(b.T @ a)
    return float(np.linalg.norm(b @ (x @ y) - a))


def component_correlations(a: np.ndarray, b: np.ndarray) -> list[float]:
    return [abs(float(np.corrcoef(a[:, k], b[:, k])[0, 1])) for k in range(a.shape[1])]


def bootstrap_stability(wide: DataFrame, keys: list[str], resamples: int = 100, k: int = 2, seed: int = 12345) -> dict:
    """Affinity, Procrustes distance and correlations of resamples' components with the whole table's; PC1's median and quartile band.

    All resamples are Poisson weights on the same rows, summed in one pass.
    """
    columns = hour_columns(wide.columns)
    means = column_means(wide, columns)
    sums = moments(fill_with_means(wide, columns, means), columns, resamples, keys, seed, centre=means, weights=poisson_array(resamples, *keys, seed=seed))
    base = from_moments(sums[0], columns, k).matrix()
    fits = [from_moments(s, columns, k).matrix() for s in sums[1:] if s[0, 0] > 1]
    near = [affinity(base, m) for m in fits]
    far = [procrustes(base, m) for m in fits]
    alike = np.array([component_correlations(base, m) for m in fits])
    first = np.array([m[:, 0] for m in fits])
    q1, q2, q3 = np.percentile(first, [25, 50, 75], axis=0)
    return {
        "B": len(fits), "k": k, "affinity_mean": float(np.mean(near)), "affinity_std": float(np.std(near)), "procrustes_mean": float(np.mean(far)), "procrustes_std": float(np.std(far)),
        "correlation_mean": alike.mean(0).tolist(), "correlation_std": alike.std(0).tolist(), "pc1_median": q2.tolist(), "pc1_low": q1.tolist(), "pc1_high": q3.tolist(),
    }


def tail_analysis(model: Pca) -> dict:
    """Power-law fit of the largest max(10, ceil(5 %)) absolute loadings' survival."""
    x = np.sort(np.abs(model.matrix()).ravel())[::-1]
    x = x[x > 0]
    k = min(len(x), max(10, int(np.ceil(0.05 * len(x)))))
    s = np.arange(1, len(x) + 1) / max(1, len(x))
    if k < 5:
        return {"classification": "insufficient_data", "tail_points": k}
    a, b = np.log10(x[:k]), np.log10(s[:k])
    slope, _ = np.polyfit(a, b, 1)
    r2 = float(np.corrcoef(a, b)[0, 1] ** 2)
    return {"alpha": float(-slope), "r2": r2, "tail_points": k, "n": len(x), "classification": "heavy_tail" if r2 > 0.85 and 0 < -slope < 5 else "light_tail"}


def qq_points(values: np.ndarray) -> list[tuple[float, float]]:
    """(normal quantile, value) pairs of a plot against the normal distribution."""
    from statistics import NormalDist

    x = np.sort(np.asarray(values, float))
    return [(NormalDist().inv_cdf((i + 0.5) / len(x)), float(v)) for i, v in enumerate(x)]


def diagnostics(model: Pca) -> dict:
    """Normality, equal variances, log-linear profiles, outlying hours and summary numbers of the loadings."""
    v, lam = model.matrix(), np.array(model.variances)
    p = v.shape[0]
    normal = [dict(zip(("W", "p"), dist.shapiro_wilk(v[:, k]), strict=True)) for k in range(v.shape[1])]
    pooled = dist.shapiro_wilk(v.ravel())
    spread = {f"{name}_{what}": dict(zip(("statistic", "p"), f([list(g) for g in m]), strict=True)) for what, m in (("hours", v), ("components", v.T)) for name, f in (("bartlett", dist.bartlett), ("levene", dist.levene))}
    profiles = []
    for row in v:
        y = np.log(np.abs(row[np.abs(row) > 1e-10]))
        profiles.append(0.0 if len(y) < 5 or np.ptp(y) == 0 else float(np.corrcoef(np.arange(len(y)), y)[0, 1] ** 2))
    x = v * np.sqrt(lam)
    cov = np.cov(x, rowvar=False)
    cov = 0.9 * cov + 0.1 * np.trace(cov) / len(cov) * np.eye(len(cov))
    centred = x - x.mean(0)
    d2 = np.einsum("ij,jk,ik->i", centred, np.linalg.inv(cov), centred)
    limits = {q: dist.chi2_quantile(q, v.shape[1]) for q in (0.95, 0.99, 0.999)}
    hours = [{"hour": c, "d2": float(d), "p": dist.chi2_sf(float(d), v.shape[1]), **{f"above_{q}": bool(d > t) for q, t in limits.items()}} for c, d in zip(model.columns, d2, strict=True)]
    part = (v**2 * lam).sum(1)
    z = (part - part.mean()) / (part.std() or 1)
    return {
        "shapiro": normal, "shapiro_pooled": {"W": pooled[0], "p": pooled[1]}, "variances": spread, "heteroscedastic": bool(spread["levene_hours"]["p"] < 0.05),
        "profile_r2": profiles, "vandermonde": bool(np.mean(profiles) > 0.95), "mahalanobis": sorted(hours, key=lambda h: -h["d2"]), "chi2_limits": limits,
        "contribution": {c: {"total": float(a), "z": float(b), "outlier": bool(abs(b) > 2)} for c, a, b in zip(model.columns, part, z, strict=True)},
        "peak_hour": model.columns[int(part.argmax())], "quiet_hour": model.columns[int(part.argmin())],
        "condition_number": float(lam[0] / lam[-1]) if lam[-1] > 0 else float("inf"), "effective_rank": float(lam.sum() ** 2 / (lam**2).sum()), "kaiser": int((lam / lam[0] > 1 / p).sum()),
        "orthogonality": float(np.abs(v.T @ v - np.eye(v.shape[1])).max()), "ratios": model.ratios.tolist(), "cumulative": np.cumsum(model.ratios).tolist(),
    }
