"""B-splines on equal knots as Column expressions: the Cox-de Boor recursion over the few splines that a value meets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spline_place(x: Column, low: float, high: float, splines: int, order: int = 3) -> tuple[Column, Column]:
    """(number of the first spline that is not 0 at x, how far x is from its knot to the next, 0 to 1).

    Values outside [low, high] count as the ends.
    """
    inner = splines - order
    step = (high - low) / inner if high > low else 1.0
    x = F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(low + step * inner - 1e-12 * max(1.0, abs(step))))
    u = (x - F.lit(float(low))) / F.lit(float(step))
    first = F.least(F.greatest(F.floor(u), F.lit(0)), F.lit(inner - 1))
    return first.cast("int"), u - first


def spline_values(t: Column, order: int = 3) -> list[Column]:
    """The ``order`` + 1 splines that are not 0 between two knots. ``t`` is used many times: a column, not an expression, keeps the plan small."""
    values = [F.lit(1.0)]
    for k in range(1, order + 1):
        rising = [F.lit(0.0)] + [(t + F.lit(float(k - r))) / k * values[r - 1] for r in range(1, k + 1)]
        falling = [(F.lit(float(r + 1)) - t) / k * values[r] for r in range(k)] + [F.lit(0.0)]
        values = [a + b for a, b in zip(rising, falling, strict=True)]
    return values


def spline_basis(x: Column, low: float, high: float, splines: int, order: int = 3) -> Column:
    """The array of all ``splines`` values at x, null for null."""
    first, t = spline_place(x, low, high, splines, order)

    def spread(s: Column) -> Column:
        at = lambda j: F.when((j >= s["first"]) & (j <= s["first"] + order), F.element_at(s["values"], j - s["first"] + 1)).otherwise(F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(splines - 1)), at)

    placed = F.transform(F.array(F.struct(first.alias("first"), t.alias("t"))), lambda s: F.struct(s["first"].alias("first"), F.array(*spline_values(s["t"], order)).alias("values")))
    return F.when(x.isNotNull(), F.transform(placed, spread)[0])


def spline_sum(first: Column, t: Column, weights: list[float], order: int = 3) -> Column:
    """The sum of the splines, each times its weight, at a place that ``spline_place`` gave."""
    every = F.array(*(F.lit(float(w)) for w in weights))
    out = F.lit(0.0)
    for r, v in enumerate(spline_values(t, order)):
        out = out + v * F.element_at(every, first + r + 1)
    return out
