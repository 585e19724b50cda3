"""Leading principal components by power iteration and deflation.

One pass gives the covariances; the iteration is an expression over the one row
that holds them, with a fixed number of steps, so that SQL can repeat it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.models.gram import column_means, covariance, moments


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: _dot(row, v))


def _unit(v: Column) -> Column:
    return _let(F.sqrt(_dot(v, v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def leading_components(df: DataFrame, columns: list[str], components: int = 2, steps: int = 300) -> DataFrame:
    """component (1 ..), variance, loadings (array): the largest in absolute value is positive. Rows with a null cell are left out; without rows there are none."""
    spark, found = df.sparkSession, []
    sums = moments(df, columns, centre=column_means(df, columns))[0]
    if sums[0, 0] > 0:
        m = covariance(sums)[2]
        start = F.array(*(F.lit(1 + i / 100) for i in range(len(columns))))  # no component is likely to be at right angles to it
        for k in range(components):  # a row of the size of the matrix
            row = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")
            step = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _unit(start), lambda v, _: _let(_times(F.col("m"), v), _unit))
            v = np.array(row.select(step.alias("v")).first()["v"])
            v = v if np.abs(v).max() in v else -v
            variance = float(v @ m @ v)
            found.append((k + 1, variance, v.tolist()))
            m = m - variance * np.outer(v, v)
    return spark.createDataFrame(found, "component int, variance double, loadings array<double>")
