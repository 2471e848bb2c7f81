"""A small forest given by a rule, for queries whose result SQL can repeat.

Its trees are complete, DEPTH levels deep. Paths are multiples of a quarter, so sums of
them are exact in every engine; cuts lie off the values that scaled features often have.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from riskweave.operators.forest import ForestModel
from riskweave.operators.scaling import RobustScaler
from riskweave.schema import FEATURE_COLUMNS

TREES = 16
DEPTH = 3
SAMPLE = 256
CONTAMINATION = 0.05


def node_rule(tree: int, node: int) -> tuple[int, float, float]:
    """Feature, threshold and path length of a node; the feature of a leaf is -1."""
    if node >= 2**DEPTH - 1:
        leaf = node - (2**DEPTH - 1)
        return -1, 0.0, DEPTH + ((7 * tree + 5 * leaf) % 29) / 4
    return (5 * tree + 3 * node) % len(FEATURE_COLUMNS), ((7 * tree + 4 * node) % 13) / 4 - 1.13, 0.0


def nodes() -> pd.DataFrame:
    rows = [(t, n, *node_rule(t, n)) for t in range(TREES) for n in range(2 ** (DEPTH + 1) - 1)]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "path"])


def stored_forest(train: DataFrame) -> ForestModel:
    """The forest with its scaler, boundary and score marks taken from ``train``."""
    n = train.count()
    scaler = RobustScaler.fit(train, FEATURE_COLUMNS, n)
    model = ForestModel(
        list(FEATURE_COLUMNS), scaler, nodes(), SAMPLE, CONTAMINATION, 0.0, [0.0, 1.0], n
    )
    return model.calibrate(train)
