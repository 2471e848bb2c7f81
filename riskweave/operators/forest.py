"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs.

Trees grow in parallel, one small group of sampled rows each; scoring is an
Arrow-batched column function with the node arrays broadcast. The model is at
most ``trees * (2 * sample - 1)`` nodes, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions import clip
from riskweave.operators.ordering import exact_quantiles
from riskweave.operators.scaling import RobustScaler, calibrate_contamination
from riskweave.operators.split import present_features
from riskweave.session import written_table

TREES = 200
SAMPLE = 256
SEED = 42
EULER_GAMMA = 0.5772156649015329
#: A score this close to the boundary lies on it: scorers differ in the last bit of a power.
ON_BOUNDARY = 1e-12

#: Cells of the histogram of training scores, which lie in (0, 1).
SCORE_CELLS = 1 << 17
#: Steps of the stored distribution of training scores.
GRID = 1000
#: Rows scored at a time inside a batch: rows x trees working arrays that stay in cache.
SCORE_ROWS = 128

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


@dataclass
class ForestModel:
    """A fitted forest: scaler, nodes, and where its training scores lie."""

    columns: list[str]
    scaler: RobustScaler
    nodes: pd.DataFrame
    sample: int
    contamination: float
    threshold: float
    grid: list[float]
    trained_rows: int
    metrics: dict[str, float] = field(default_factory=dict)
    _shared: tuple | None = field(default=None, repr=False, compare=False)

    def _arrays(self) -> dict[str, np.ndarray]:
        """Complete trees, level by level: a leaf hands its path down to the left."""
        trees = int(self.nodes["tree"].max()) + 1
        depth = int(np.ceil(np.log2(max(self.sample, 2))))
        size = 2 ** (depth + 1) - 1
        feature = np.zeros((trees, size), dtype=np.int32)
        threshold = np.full((trees, size), np.inf)
        path = np.zeros((trees, size))
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        split = self.nodes["feature"].to_numpy() >= 0
        feature[at] = np.where(split, self.nodes["feature"].to_numpy(), 0)
        threshold[at] = np.where(split, self.nodes["threshold"].to_numpy(), np.inf)
        path[at] = self.nodes["path"].to_numpy()
        is_leaf = np.zeros((trees, size), dtype=bool)
        is_leaf[at] = ~split
        for node in range(2**depth - 1):
            down = is_leaf[:, node]
            path[down, 2 * node + 1] = path[down, node]
            is_leaf[down, 2 * node + 1] = True
        return {"feature": feature, "threshold": threshold, "path": path, "depth": depth}

    def raw_scorer(self, df: DataFrame):
        """A column of structs (raw, pct) over the scaled feature columns."""
        context = df.sparkSession.sparkContext
        # One broadcast per model and context: a stream scores batch after batch.
        if self._shared is None or self._shared[:2] != (context, self.grid):
            arrays = {**self._arrays(), "norm": average_path(self.sample)}
            sent = context.broadcast({**arrays, "grid": np.asarray(self.grid)})
            self._shared = (context, self.grid, sent)
        shared = self._shared[2]

        @F.pandas_udf("raw double, pct double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            m = shared.value
            for series in batches:
                x = np.column_stack([s.to_numpy(dtype=np.float64) for s in series])
                raw = np.concatenate(
                    [_score(x[i : i + SCORE_ROWS], m) for i in range(0, len(x), SCORE_ROWS)]
                    or [np.empty(0)]
                )
                at = np.searchsorted(m["grid"], raw, side="right")
                pct = np.clip((at - 1) / (len(m["grid"]) - 1), 0.0, 1.0)
                yield pd.DataFrame({"raw": raw, "pct": pct})

        return score(*[self.scaler.scaled(c) for c in self.columns])

    def calibrate(self, train: DataFrame) -> ForestModel:
        """Set the boundary and the score marks from the scores of the training rows."""
        scores = train.select(self.raw_scorer(train).getField("raw").alias("raw"))
        scores = written_table(scores, "scores")
        marks = [1.0 - self.contamination]
        self.threshold = exact_quantiles(scores, ["raw"], marks, self.trained_rows)["raw"][0]
        self.grid = score_grid(scores)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Add raw_score, anomaly_score, score_pct and risk_flag.

        ``raw_score`` is the forest score in (0, 1). ``anomaly_score`` is its
        excess over the training quantile that the contamination implies,
        clipped to [0, 1]. ``score_pct`` is the share of training scores it
        reaches, in steps of 1/1000. ``risk_flag`` marks scores over the boundary.
        """
        scored = df.withColumn("_s", self.raw_scorer(df))
        return (
            scored.withColumn("raw_score", F.col("_s.raw"))
            .withColumn("score_pct", F.col("_s.pct"))
            .withColumn("anomaly_score", clip(F.col("raw_score") - self.threshold, 0.0, 1.0))
            .withColumn("risk_flag", F.col("raw_score") > self.threshold + ON_BOUNDARY)
            .drop("_s")
        )

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: 1 for an anomaly, else 0."""
        return self.transform(df).withColumn("prediction", F.col("risk_flag").cast("int"))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``p_normal`` and ``p_anomaly``."""
        return self.transform(df).withColumns(
            {"p_normal": 1 - F.col("anomaly_score"), "p_anomaly": F.col("anomaly_score")}
        )


def _score(x: np.ndarray, m: dict) -> np.ndarray:
    trees, size = m["feature"].shape
    feature, threshold = m["feature"].ravel(), m["threshold"].ravel()
    base = np.arange(trees, dtype=np.int32)[None, :] * size
    row = np.arange(len(x), dtype=np.int32)[:, None] * x.shape[1]
    flat = np.ascontiguousarray(x).ravel()
    node = np.zeros((len(x), trees), dtype=np.int32)
    for _ in range(m["depth"]):
        at = base + node
        right = flat.take(row + feature.take(at)) >= threshold.take(at)
        node = 2 * node + 1 + right
    depth = m["path"].ravel().take(base + node).mean(axis=1)
    return np.power(2.0, -depth / m["norm"]) if m["norm"] else np.full(len(x), 0.5)


def score_grid(scores: DataFrame) -> list[float]:
    """Marks of the distribution of ``raw`` in steps of 1/GRID, by one rule at every size.

    Scores are counted in SCORE_CELLS cells of equal width, so at most so many rows reach
    the driver; a mark is the lower edge of the cell that holds its rank.
    """
    cell = F.least(F.floor(F.col("raw") * SCORE_CELLS), F.lit(SCORE_CELLS - 1)).cast("int")
    cells = scores.groupBy(cell.alias("cell")).count().toPandas().sort_values("cell")
    upto = cells["count"].to_numpy().cumsum()
    ranks = np.arange(GRID + 1) / GRID * (upto[-1] - 1)
    at = np.searchsorted(upto, np.floor(ranks), side="right")
    return (cells["cell"].to_numpy()[at] / SCORE_CELLS).tolist()


class IsolationForest:
    """Estimator: ``IsolationForest(...).fit(features).transform(features)``."""

    def __init__(
        self,
        contamination: float | None = None,
        trees: int = TREES,
        sample: int = SAMPLE,
        seed: int = SEED,
        pool_factor: float = 2.0,
    ):
        self.contamination, self.trees, self.sample, self.seed = contamination, trees, sample, seed
        #: Trees draw their rows from a pool of about this many times ``trees * sample`` rows.
        self.pool_factor = pool_factor

    def fit(self, df: DataFrame, columns: Sequence[str] | None = None) -> ForestModel:
        """Fit on all rows of ``df``, which is read several times: pass a table."""
        columns = list(columns or present_features(df))
        n = df.count()
        if n == 0:
            raise ValueError("cannot fit a forest on no rows")
        scaler = RobustScaler.fit(df, columns, n)
        scaled = scaler.transform(df)
        contamination = self.contamination
        if contamination is None:
            contamination = calibrate_contamination(scaled, columns, n)
        sample = min(self.sample, n)
        nodes = self.grow(scaled, columns, n, sample).toPandas()
        nodes = nodes.sort_values(["tree", "node"]).reset_index(drop=True)
        model = ForestModel(columns, scaler, nodes, sample, contamination, 0.0, [0.0, 1.0], n)
        return model.calibrate(df)

    def fit_predict(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        return self.fit(df, columns).predict(df)

    def grow(self, scaled: DataFrame, columns: Sequence[str], n: int, sample: int) -> DataFrame:
        """The node table, at most ``trees * (2 * sample - 1)`` rows."""
        pool = self.pool(scaled, columns, n, sample)
        size = pool.count()
        spark = scaled.sparkSession
        seed, limit = self.seed, int(np.ceil(np.log2(max(sample, 2))))
        names, take = list(columns), min(sample, size)
        tasks = min(self.trees, spark.sparkContext.defaultParallelism)

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for t in batch["id"]:
                    at = np.random.default_rng([seed, int(t)]).choice(size, take, replace=False)
                    yield pd.DataFrame({"tree": np.full(take, t, dtype=np.int32), "_i": at})

        picks = spark.range(0, self.trees, 1, tasks).mapInPandas(draw, "tree int, _i long")

        def grow_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("_i")
            return grow_tree(int(key[0]), rows[names].to_numpy(dtype=np.float64), seed, limit)

        # The picks have a fixed size: trees * sample rows. The sample is small
        # enough to be merged into one partition, which would grow all trees in a row.
        drawn = pool.join(F.broadcast(picks), "_i").repartition(tasks, "tree")
        return drawn.groupBy("tree").applyInPandas(grow_group, NODE_SCHEMA)

    def pool(self, scaled: DataFrame, columns: Sequence[str], n: int, sample: int) -> DataFrame:
        """A uniform sample of rows to draw the trees' samples from, numbered ``_i``.

        Each row has a pseudo-random number from its own content and the seed,
        so the same rows are drawn however they are partitioned. Only rows below
        a bound that lets through about ``pool_factor * trees * sample`` are ranked.
        """
        wanted = self.trees * sample
        keys = [c for c in ("hash", "account", "ledger_index", "close_time") if c in scaled.columns]
        identity = [F.col(c) for c in [*keys, *columns]]
        if "hash" not in keys:
            # Without a row key equal rows would be drawn all or none: number them.
            identity.append(F.monotonically_increasing_id())
        draw = F.xxhash64(F.lit(self.seed), *identity)
        rows = scaled.select(draw.alias("_draw"), *keys, *columns)
        # xxhash64 is uniform on the signed 64-bit range.
        share = min(1.0, self.pool_factor * wanted / n)
        bound = min(int(-(2**63) + 2**64 * share), 2**63 - 1)
        rows = rows.filter(F.col("_draw") <= F.lit(bound))
        order = W.orderBy("_draw", *keys, *columns)
        numbered = rows.select(
            (F.row_number().over(order) - 1).cast("bigint").alias("_i"), *columns
        )
        return written_table(numbered, "pool")


def grow_tree(tree: int, x: np.ndarray, seed: int, limit: int) -> pd.DataFrame:
    """Random cuts of one small sample; nodes numbered as in a binary heap."""
    rng = np.random.default_rng([seed, 1, tree])
    nodes: list[tuple] = []
    pending = [(0, 0, np.arange(len(x)))]
    while pending:
        node, depth, rows = pending.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth == limit or len(rows) <= 1 or len(varied) == 0:
            nodes.append((tree, node, -1, 0.0, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        right = x[rows, f] >= cut
        if right.all() or not right.any():
            # The cut fell on an end of the range: split off the smallest values.
            cut = float(x[rows, f][x[rows, f] > low[f]].min())
            right = x[rows, f] >= cut
        nodes.append((tree, node, f, cut, 0.0))
        pending.append((2 * node + 2, depth + 1, rows[right]))
        pending.append((2 * node + 1, depth + 1, rows[~right]))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path"])
