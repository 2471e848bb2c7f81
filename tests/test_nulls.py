"""NULLs in order columns and in quantile columns, and odd values at the model's door."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.forest import IsolationForest
from riskweave.operators.ordering import exact_quantiles
from riskweave.operators.scaling import RobustScaler
from riskweave.operators.split import temporal_split, with_segment, with_split
from riskweave.operators.validation import ks_two_sample


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (None if i % 10 == 3 else i // 4, None if i % 7 == 0 else f"h{i:03d}", i) for i in range(100)
    ]
    return spark.createDataFrame(data, "ledger_index long, hash string, i int")


def test_split_keeps_rows_with_null_keys(rows):
    train, test = temporal_split(rows)
    assert train.count() + test.count() == 100
    assert train.count() == 80
    # NULL ledgers come last.
    assert train.filter("ledger_index IS NULL").count() == 0


def test_tags_and_segments_cover_all_rows(rows):
    assert with_split(rows).filter("split IS NULL").count() == 0
    seg = {r["segment"]: r["count"] for r in with_segment(rows, 4).groupBy("segment").count().collect()}
    assert sum(seg.values()) == 100 and set(seg) == set(range(5))


@pytest.mark.parametrize("limit", [10, 100_000])
def test_quantiles_ignore_nulls_on_both_paths(spark, limit):
    df = spark.range(1000).select(
        F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("a"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("b"),
        F.lit(None).cast("double").alias("c"),
    )
    got = exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 1.0], limit=limit)
    a = [i for i in range(1000) if i % 4]
    assert got["a"] == pytest.approx(list(np.quantile(a, [0.25, 0.5, 1.0])))
    assert got["b"] == pytest.approx(list(np.quantile(range(0, 1000, 3), [0.25, 0.5, 1.0])))
    assert got["c"] == [None, None, None]


def test_odd_values_count_as_zero(spark):
    odd = [(None, 1.0), (float("nan"), 2.0), (float("inf"), 3.0), (4.0, 4.0)] * 10
    plain = [(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (4.0, 4.0)] * 10
    frames = [spark.createDataFrame(x, "a double, b double") for x in (odd, plain)]
    assert RobustScaler.fit(frames[0], ["a", "b"]) == RobustScaler.fit(frames[1], ["a", "b"])
    model = IsolationForest(contamination=0.1, trees=5, sample=16).fit(frames[1], ["a", "b"])
    got = [
        sorted(r["raw_score"] for r in model.transform(f).select("raw_score").collect())
        for f in frames
    ]
    assert got[0] == got[1]


def test_ks_of_an_empty_side_is_null(spark):
    full = spark.range(5).select(F.col("id").cast("double").alias("v"))
    row = ks_two_sample(full, full.limit(0), "v").first()
    assert (row["n_a"], row["n_b"], row["ks_stat"], row["ks_p_value"]) == (5, 0, None, None)
