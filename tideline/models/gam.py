"""Additive spline regression from one pass of moments.

Each smooth is a cubic (or given order) B-spline basis with a second-difference
penalty; its columns are centred, so the intercept is the mean. The rows are
summed once into X'X and X'y; every candidate penalty, resample and refit is
then a small solve on the driver. Penalties are chosen by generalised cross
validation over GRID, one for all smooths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.splines import spline_place, spline_sum
from tideline.models.gram import moments, moments_by

GRID = tuple(10.0**k for k in np.linspace(-3, 3, 11))


@dataclass(frozen=True)
class Smooth:
    column: str
    splines: int = 20
    order: int = 3


@dataclass(frozen=True)
class Linear:
    column: str


def basis(x: np.ndarray, low: float, high: float, splines: int, order: int) -> np.ndarray:
    """B-splines on equal knots; values outside count as the ends."""
    inner = splines - order
    step = (high - low) / inner if high > low else 1.0
    t = low + step * np.arange(-order, inner + order + 1)
    x = np.clip(x, low, low + step * inner - 1e-12 * max(1.0, abs(step)))
    b = ((x[:, None] >= t[:-1]) & (x[:, None] < t[1:])).astype(float)
    for k in range(1, order + 1):
        left = (x[:, None] - t[: -k - 1]) / (t[k:-1] - t[: -k - 1])
        right = (t[k + 1 :] - x[:, None]) / (t[k + 1 :] - t[1:-k])
        b = left * b[:, :-1] + right * b[:, 1:]
    return b


class Gam:
    def __init__(self, terms: list[Smooth | Linear], target: str):
        self.terms, self.target = terms, target

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([basis(x[:, i], *self.ranges[i], t.splines, t.order) if isinstance(t, Smooth) else x[:, i] for i, t in enumerate(self.terms)])

    def _penalty(self) -> np.ndarray:
        parts = []
        for t in self.terms:
            if isinstance(t, Smooth):
                d = np.diff(np.eye(t.splines), 2, axis=0)
                parts.append(d.T @ d)
            else:
                parts.append(np.zeros((1, 1)))
        n = sum(len(p) for p in parts)
        out, at = np.zeros((n, n)), 0
        self.blocks = []
        for p in parts:
            out[at : at + len(p), at : at + len(p)] = p
            self.blocks.append(slice(at, at + len(p)))
            at += len(p)
        return out

    def _solve(self, sums: np.ndarray, lam: float) -> tuple[np.ndarray, float, np.ndarray, float]:
        """(coefficients, intercept, covariance of coefficients, GCV) of moments of (1, X, y)."""
        n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
        c = sums[1:, 1:] - n * np.outer(mean, mean)
        a = c[:-1, :-1] + lam * self.penalty + 1e-6 * np.eye(len(c) - 1)
        inverse = np.linalg.inv(a)
        beta = inverse @ c[:-1, -1]
        rss = c[-1, -1] - 2 * beta @ c[:-1, -1] + beta @ c[:-1, :-1] @ beta
        edof = 1 + float(np.trace(inverse @ c[:-1, :-1]))
        sigma2 = max(rss, 0.0) / max(n - edof, 1.0)
        return beta, float(mean[-1] - mean[:-1] @ beta), inverse * sigma2, float(n * rss / max(n - edof, 1e-9) ** 2)

    def fit(self, df: DataFrame, lam: float | None = None, resamples: int = 0, keys: list[str] | None = None, seed: int = 42) -> Gam:
        columns = [t.column for t in self.terms]
        ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max)))).first()
        return self._use(moments(df, [*columns, self.target], resamples, keys, seed, expand=self._expand(ends)), lam)

    def _expand(self, ends):
        """Set the terms' ranges; the function that turns rows into the columns to sum."""
        self.ranges = [(ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0) for i in range(len(self.terms))]
        self.penalty = self._penalty()
        return lambda x: np.column_stack([self.design(x[:, :-1]), x[:, -1]])

    def _use(self, sums: np.ndarray, lam: float | None) -> Gam:
        self.n = int(round(sums[0, 0, 0]))
        self.centre = sums[0, 0, 1:-1] / sums[0, 0, 0]
        self.lam = lam if lam is not None else min(GRID, key=lambda v: self._solve(sums[0], v)[3])
        self.beta, self.intercept, self.cov, self.gcv = self._solve(sums[0], self.lam)
        self.boot = []
        for s in sums[1:]:
            try:
                self.boot.append(self._solve(s, self.lam)[0])
            except np.linalg.LinAlgError:
                continue
        return self

    def effect(self, x: np.ndarray, term: int) -> np.ndarray:
        """A term's centred part of the prediction."""
        b = self.blocks[term]
        return (self.design(x)[:, b] - self.centre[b]) @ self.beta[b]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + self.design(x) @ self.beta

    def grid(self, term: int, points: int = 100) -> np.ndarray:
        x = np.zeros((points, len(self.terms)))
        x[:, term] = np.linspace(*self.ranges[term], points)
        return x

    def partial_dependence(self, term: int, points: int = 100) -> list[dict]:
        """x, effect and its 95 % interval along a term's range."""
        x, b = self.grid(term, points), self.blocks[term]
        d = self.design(x)[:, b] - self.centre[b]
        y, e = d @ self.beta[b], 1.959963984540054 * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, self.cov[b, b], d), 0))
        return [{"x": float(v), "effect": float(m), "low": float(m - w), "high": float(m + w)} for v, m, w in zip(x[:, term], y, e, strict=True)]

    def bootstrap_band(self, term: int, points: int = 100) -> list[dict]:
        """x and the 2.5, 50 and 97.5 percentiles of the resamples' effects; the penalty is the fit's."""
        x, b = self.grid(term, points), self.blocks[term]
        d = self.design(x)[:, b] - self.centre[b]
        low, middle, high = np.percentile([d @ beta[b] for beta in self.boot], [2.5, 50, 97.5], axis=0)
        return [{"x": float(v), "low": float(p), "median": float(q), "high": float(r)} for v, p, q, r in zip(x[:, term], low, middle, high, strict=True)]

    def transform(self, df: DataFrame, out: str = "prediction", effects: bool = False) -> DataFrame:
        """Add the prediction, and with ``effects`` each term's part as effect_<column>, as expressions. Null and NaN inputs give null."""
        smooth = [(i, t) for i, t in enumerate(self.terms) if isinstance(t, Smooth)]
        rows = df
        for i, t in smooth:  # places and parts are columns of their own, as they are used several times
            first, at = spline_place(F.col(f"`{t.column}`"), *self.ranges[i], t.splines, t.order)
            rows = rows.withColumns({f"__first{i}": first, f"__at{i}": at})
        parts = {}
        for i, t in enumerate(self.terms):
            x, beta = F.col(f"`{t.column}`").cast("double"), self.beta[self.blocks[i]]
            whole = spline_sum(F.col(f"__first{i}"), F.col(f"__at{i}"), beta.tolist(), t.order) if isinstance(t, Smooth) else x * F.lit(float(beta[0]))
            parts[f"__part{i}"] = F.when(x.isNotNull() & ~F.isnan(x), whole - F.lit(float(self.centre[self.blocks[i]] @ beta)))
        rows = rows.withColumns(parts)
        mean = self.intercept + float(self.centre @ self.beta)
        more = {out: reduce(lambda a, c: a + F.col(c), parts, F.lit(mean))}
        if effects:
            more |= {f"effect_{t.column}": F.col(f"__part{i}") for i, t in enumerate(self.terms)}
        return rows.withColumns(more).drop(*parts, *(f"__{n}{i}" for i, _ in smooth for n in ("first", "at")))

    def breakdown(self, df: DataFrame) -> DataFrame:
        """term, mean_abs_effect over the rows, largest first; the intercept has its own value."""
        rows = self.transform(df, effects=True)
        cells = [F.struct(F.lit(t.column).alias("term"), F.avg(F.abs(f"effect_{t.column}")).alias("mean_abs_effect")) for t in self.terms]
        cells.append(F.struct(F.lit("intercept").alias("term"), F.lit(self.intercept).alias("mean_abs_effect")))
        return rows.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*").orderBy(F.desc("mean_abs_effect"))


def fit_by_group(df: DataFrame, by: str, terms: list[Smooth | Linear], target: str, groups: list, least_rows: int = 200, lam: float = 0.6) -> dict:
    """A model per group of at least ``least_rows`` rows, all with one penalty: one scan for sizes and ranges, one for the moments of all groups."""
    columns = [t.column for t in terms]
    rows = df.where(F.col(by).isin(groups))
    ends = rows.groupBy(by).agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max)))).collect()
    models = {r[by]: Gam(terms, target) for r in ends if r["n"] >= least_rows}
    expand = {str(r[by]): models[r[by]]._expand(r) for r in ends if r[by] in models}
    sums = moments_by(rows, F.col(by), [*columns, target], expand) if expand else {}
    return {g: models[g]._use(sums[str(g)], lam) for g in groups if str(g) in sums}
