"""A stored forest as a column expression: nested CASE per tree, inside generated code.

The scorer of ``forest`` walks arrays in Arrow batches. Small forests, up to
``MAX_NODES`` nodes, need no Python at all: each tree becomes an expression over the
scaled features, and the score is one more expression over the trees.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.forest import ON_BOUNDARY, ForestModel, average_path

#: Larger forests would make expressions that no compiler takes in good time.
MAX_NODES = 4096


def tree_expression(nodes: pd.DataFrame, features: list[Column]) -> Column:
    """The path length that one tree gives a row; ``nodes`` has its heap-numbered nodes."""
    table = {int(r.node): r for r in nodes.itertuples(index=False)}

    def walk(node: int) -> Column:
        at = table[node]
        if at.feature < 0:
            return F.lit(float(at.path))
        left, right = walk(2 * node + 1), walk(2 * node + 2)
        return F.when(features[int(at.feature)] >= float(at.threshold), right).otherwise(left)

    return walk(0)


def raw_expression(model: ForestModel, features: list[Column] | None = None) -> Column:
    """The forest score of a row. ``features`` are its scaled features, if already columns."""
    if len(model.nodes) > MAX_NODES:
        raise ValueError(f"{len(model.nodes)} nodes; at most {MAX_NODES} are compiled")
    features = features or [model.scaler.scaled(c) for c in model.columns]
    trees = [tree_expression(t, features) for _, t in model.nodes.groupby("tree")]
    norm = average_path(model.sample)
    if not norm:
        return F.lit(0.5)
    total = reduce(lambda a, b: a + b, trees)
    return F.pow(F.lit(2.0), -(total / len(trees)) / norm)


def marks_reached(grid: list[float], score: Column) -> Column:
    """How many of the ascending marks are at most ``score``, by halving steps."""
    steps = [1 << k for k in reversed(range(len(grid).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        # Beyond the last mark there is none, and NULL isn't reached.
        return F.when(F.get(F.lit(grid), at + step - 1) <= score, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def score_natively(df: DataFrame, model: ForestModel) -> DataFrame:
    """``df`` with raw_score, score_pct, anomaly_score and risk_flag, as ``model.transform``."""
    scaled = {f"_x{i}": model.scaler.scaled(c) for i, c in enumerate(model.columns)}
    # Scaled features are columns of their own, else every node would scale anew.
    rows = df.withColumns(scaled)
    rows = rows.withColumn("raw_score", raw_expression(model, [F.col(x) for x in scaled]))
    grid = model.grid
    reached = marks_reached(grid, F.col("raw_score"))
    share = (reached - 1) / F.lit(float(len(grid) - 1))
    return rows.drop(*scaled).withColumns(
        {
            "score_pct": F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)),
            "anomaly_score": F.least(
                F.greatest(F.col("raw_score") - model.threshold, F.lit(0.0)), F.lit(1.0)
            ),
            "risk_flag": F.col("raw_score") > model.threshold + ON_BOUNDARY,
        }
    )
