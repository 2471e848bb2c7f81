"""Robust scaling, the first principal component, and contamination."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions import clip
from riskweave.functions.scalar import finite_or_zero
from riskweave.operators.ordering import exact_quantiles
from riskweave.session import written_table

# Fixed values of the calibration.
FENCE = 3.0
MIN_ROWS = 20
SMALL_SAMPLE_CONTAMINATION = 0.05
CONTAMINATION_RANGE = (0.01, 0.15)


@dataclass(frozen=True)
class RobustScaler:
    """(x - median) / IQR per column; a column without spread is only centred.

    NULL, NaN and infinite values count as 0, when fitting and when scaling.
    """

    columns: tuple[str, ...]
    median: tuple[float, ...]
    iqr: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], n: int | None = None) -> RobustScaler:
        # Never NULL, and known not to be: that saves a count.
        finite = {c: F.coalesce(finite_or_zero(F.col(c).cast("double")), F.lit(0.0)) for c in columns}
        doubles = df.select(*[v.alias(c) for c, v in finite.items()])
        q = exact_quantiles(doubles, columns, [0.25, 0.5, 0.75], n)
        return cls(
            tuple(columns),
            tuple(q[c][1] for c in columns),
            tuple(q[c][2] - q[c][0] for c in columns),
        )

    def scaled(self, column: str) -> Column:
        i = self.columns.index(column)
        return (finite_or_zero(F.col(column).cast("double")) - self.median[i]) / (self.iqr[i] or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.columns, self.median, self.iqr)),
            "feature string, median double, iqr double",
        )


def _joined(a: tuple, b: tuple) -> tuple:
    """Rows, means and centred products of two sets of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    products = a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)
    return n, a[1] + apart * (b[0] / n), products


def first_component(df: DataFrame, columns: Sequence[str]) -> Column:
    """Projection on the first principal component.

    Each task sums its rows' products in one pass; the driver adds up one small matrix a
    task and decomposes the sum. The column is not centred, which neither a fence nor a
    rank notices.
    """
    width = len(columns)

    def moments(batches):
        """Rows, means and centred products of a task."""
        total = (0, np.zeros(width), np.zeros((width, width)))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                mean = x.mean(axis=0)
                total = _joined(total, (len(x), mean, (x - mean).T @ (x - mean)))
        parts = [pa.array([total[0]], pa.int64())]
        parts += [pa.array([m.ravel().tolist()], pa.list_(pa.float64())) for m in total[1:]]
        yield pa.RecordBatch.from_arrays(parts, ["n", "mean", "products"])

    doubles = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    total = (0, np.zeros(width), np.zeros((width, width)))
    found = doubles.mapInArrow(moments, "n long, mean array<double>, products array<double>")
    for r in found.filter("n > 0").collect():
        total = _joined(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(width, width)))
    if not np.isfinite(total[2]).all():
        raise ValueError("NULL, NaN or infinite values have no principal component")
    weights = np.linalg.eigh(total[2])[1][:, -1]
    # The sign of a component is arbitrary: make its largest weight positive.
    if weights[abs(weights).argmax()] < 0:
        weights = -weights
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + F.col(c).cast("double") * float(w)
    return total


def tukey_outliers(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """One row: the fences of a column and how many values lie strictly outside."""
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75], n)[column]
    low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
    c = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(low).alias("low"),
        F.lit(high).alias("high"),
        F.count_if((c < low) | (c > high)).alias("outliers"),
    )


def contamination_from(outliers: int, n: int) -> float:
    if n < MIN_ROWS:
        return SMALL_SAMPLE_CONTAMINATION
    return min(max(outliers / n, CONTAMINATION_RANGE[0]), CONTAMINATION_RANGE[1])


def contamination_column(outliers: Column, n: Column) -> Column:
    share = clip(outliers / n, *CONTAMINATION_RANGE)
    return F.when(n < MIN_ROWS, F.lit(SMALL_SAMPLE_CONTAMINATION)).otherwise(share)


def calibrate_contamination(
    scaled: DataFrame, columns: Sequence[str], n: int | None = None
) -> float:
    """Share of rows far out on the first component, within [0.01, 0.15]."""
    if n is None:
        n = scaled.count()
    if n < MIN_ROWS:
        return SMALL_SAMPLE_CONTAMINATION
    # Written once: each pass over the values would project all columns anew.
    pc1 = written_table(scaled.select(first_component(scaled, columns).alias("pc1")), "pc1")
    return contamination_from(tukey_outliers(pc1, "pc1", n).first()["outliers"], n)
