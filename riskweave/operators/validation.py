"""Checks of an unsupervised model without labels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.operators.forest import SEED, IsolationForest
from riskweave.operators.ordering import (
    SELECTION_LIMIT,
    exact_quantiles,
    ordered_blocks,
    running_totals,
)
from riskweave.operators.split import with_segment
from riskweave.session import written_table

# Fixed values of the verdicts.
MAX_DRIFT = 0.05
MIN_P_VALUE = 0.05
MIN_SEPARATION = 0.1
MAX_RATE_STD = 0.025


def kolmogorov_p(statistic: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided p-value of a two-sample KS statistic."""
    scale = F.sqrt(n_a.cast("double") * n_b.cast("double") / (n_a + n_b).cast("double"))
    lam = statistic * scale
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    p = F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0))
    # The series converges too slowly near 0, where the probability is 1.
    return F.when(lam < 0.1, F.lit(1.0)).otherwise(p)


#: Samples of up to so many rows each get an exact p-value by ``method='auto'``.
EXACT_ROWS = 10_000
#: Chances below this are taken as 0: near it doubles lose their digits.
LEAST_CHANCE = 1e-300


def exact_kolmogorov_p(distance: float, n_a: int, n_b: int) -> float:
    """Two-sided p-value of a two-sample KS statistic, by counting lattice paths.

    Shuffling both samples together is a random path from (0, 0) to (n_a, n_b); the
    statistic reaches ``distance`` if the path leaves the band around the diagonal.
    The chance to be at each point of a step's line, inside so far, is carried along,
    and what leaves the band is added up, so that small values keep their precision.
    Only points inside the band that a double can tell from 0 are held: at most some 38
    deviations each way, so work grows as the rows to the power of 1.5 for samples of
    any size.
    """
    whole = math.lcm(n_a, n_b)
    reach = round(distance * whole)
    if reach <= 0:
        return 1.0
    up_a, up_b = whole // n_a, whole // n_b
    turn = up_a + up_b
    untaken = np.arange(n_a, -2, -1, dtype=float)  # of sample a, by those taken
    at = np.ones(1)  # chance to have taken low, low + 1, ... of sample a after the steps so far
    low = 0
    left = 0.0
    for step in range(1, n_a + n_b + 1):
        take = untaken[low : low + len(at)] / (n_a + n_b - step + 1)
        after = np.zeros(len(at) + 1)
        np.multiply(at, take, out=after[1:])
        after[:-1] += at - after[1:]
        # Points a with |a * up_a - (step - a) * up_b| < reach are inside.
        first = max((step * up_b - reach) // turn + 1 - low, 0)
        end = min(-((-step * up_b - reach) // turn) - low, len(after))
        if first or end < len(after):
            left += float(after[:first].sum() + after[max(first, end) :].sum())
        while first < end and after[first] < LEAST_CHANCE:
            first += 1
        while first < end and after[end - 1] < LEAST_CHANCE:
            end -= 1
        if first >= end:
            break
        at = after[first:end]
        low += first
    return min(max(left, 0.0), 1.0)


def ks_two_sample(
    a: DataFrame, b: DataFrame, column: str, limit: int = SELECTION_LIMIT, method: str = "asymptotic"
) -> DataFrame:
    """One row: the largest distance of the two distribution functions, and its p-value.

    ``method`` 'asymptotic' takes the p-value from the limiting distribution, 'exact' from
    a count of lattice paths, 'auto' from that count for samples of up to EXACT_ROWS rows.
    Equal values are counted first; the cumulative counts then run over the
    distinct values, in one task if they are few and over blocks otherwise.
    """
    side = lambda df, x, y: df.select(
        F.col(column).cast("double").alias("v"), F.lit(x).alias("a"), F.lit(y).alias("b")
    )
    cells = (
        side(a, 1, 0)
        .unionByName(side(b, 0, 1))
        .groupBy("v")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    cells = written_table(cells, "ks")
    size = cells.agg(
        F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")
    ).first()
    if not size["a"] or not size["b"]:
        # Nothing to compare with: the counts are known, the rest is NULL.
        counts = (size["a"] or 0, size["b"] or 0, None, None)
        return cells.sparkSession.createDataFrame(
            [counts], "n_a long, n_b long, ks_stat double, ks_p_value double"
        )
    n_a, n_b = F.lit(size["a"]).cast("bigint"), F.lit(size["b"]).cast("bigint")
    if size["n"] <= limit:
        upto = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
        running = cells.select(F.sum("a").over(upto).alias("ra"), F.sum("b").over(upto).alias("rb"))
    else:
        running = running_totals(
            ordered_blocks(cells, ["v"], "ks-order"),
            [],
            {"ra": F.col("a"), "rb": F.col("b")},
            keys_lead_order=True,
        ).select("ra", "rb")
    stat = running.agg(F.max(F.abs(F.col("ra") / n_a - F.col("rb") / n_b)).alias("ks_stat"))
    small = max(size["a"], size["b"]) <= EXACT_ROWS
    p_value = kolmogorov_p(F.col("ks_stat"), n_a, n_b)
    if method == "exact" or method != "asymptotic" and small:
        n = (size["a"], size["b"])
        exact = F.udf(lambda d: exact_kolmogorov_p(d, *n), "double")  # called for one row
        p_value = exact("ks_stat")
    return stat.select(n_a.alias("n_a"), n_b.alias("n_b"), "ks_stat", p_value.alias("ks_p_value"))


def score_separation(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """One row: 95th percentile minus median, mean and population deviation."""
    p50, p95 = exact_quantiles(df, [column], [0.5, 0.95], n)[column]
    return df.agg(
        F.lit(None if p95 is None else float(p95 - p50)).cast("double").alias("score_separation"),
        F.avg(column).alias("score_mean"),
        F.stddev_pop(column).alias("score_std"),
    )


def flag_rate(flag: str = "risk_flag") -> Column:
    return F.avg(F.col(flag).cast("double"))


def validate(
    train_scored: DataFrame,
    test_scored: DataFrame,
    score: str = "anomaly_score",
    ks_method: str = "auto",
) -> DataFrame:
    """One row of eight metrics, rounded to 4 places.

    Scoring is the costly part, so each side's score and flag are written once.
    """
    train = written_table(train_scored.select(score, "risk_flag"), "train-scores")
    test = written_table(test_scored.select(score, "risk_flag"), "test-scores")
    ks = ks_two_sample(train, test, score, method=ks_method).first()
    sep = score_separation(test, score).first()
    train_rate, test_rate = (side.agg(flag_rate().alias("r")).first()["r"] for side in (train, test))
    metrics = {
        "train_flag_rate": train_rate,
        "test_flag_rate": test_rate,
        "rate_drift": None if None in (train_rate, test_rate) else abs(train_rate - test_rate),
        "ks_stat": ks["ks_stat"],
        "ks_p_value": ks["ks_p_value"],
        "score_separation": sep["score_separation"],
        "test_score_mean": sep["score_mean"],
        "test_score_std": sep["score_std"],
    }
    row = train.sparkSession.createDataFrame(
        [tuple(metrics.values())], ", ".join(f"{m} double" for m in metrics)
    )
    return row.select(*[F.round(m, 4).alias(m) for m in metrics])


def verdicts(metrics: DataFrame, min_separation: float = MIN_SEPARATION) -> DataFrame:
    """Add one boolean per warning: drift, distribution shift, weak separation."""
    return metrics.withColumns(
        {
            "high_drift": F.col("rate_drift") > MAX_DRIFT,
            "distribution_shift": F.col("ks_p_value") <= MIN_P_VALUE,
            "low_separation": F.col("score_separation") < min_separation,
        }
    )


def cv_folds(df: DataFrame, n_splits: int = 5, seed: int = SEED, trees: int = 200) -> DataFrame:
    """One row per expanding-window fold: calibrated contamination and test flag rate.

    The folds follow ledger order. Each fold is a sequence of Spark jobs over
    its own rows; only its two numbers reach the driver.
    """
    segmented = written_table(with_segment(df, n_splits), "folds")
    out = []
    for fold in range(1, n_splits + 1):
        model = IsolationForest(seed=seed, trees=trees).fit(segmented.filter(F.col("segment") < fold))
        test = model.transform(segmented.filter(F.col("segment") == fold))
        rate = test.agg(flag_rate().alias("r")).first()["r"]
        out.append((fold, float(model.contamination), float(rate)))
    return df.sparkSession.createDataFrame(
        out, "fold int, contamination double, test_flag_rate double"
    )


def timeseries_cv(df: DataFrame, n_splits: int = 5, seed: int = SEED, trees: int = 200) -> DataFrame:
    """One row: mean and deviation of both fold numbers, and whether they are stable."""
    return cv_summary(cv_folds(df, n_splits, seed, trees))


def cv_summary(folds: DataFrame) -> DataFrame:
    c, r = "contamination", "test_flag_rate"
    return folds.agg(
        F.round(F.avg(c), 4).alias("mean_contamination"),
        F.round(F.stddev_pop(c), 4).alias("std_contamination"),
        F.round(F.avg(r), 4).alias("mean_flag_rate"),
        F.round(F.stddev_pop(r), 4).alias("std_flag_rate"),
        (F.stddev_pop(r) < MAX_RATE_STD).alias("stable"),
    )
