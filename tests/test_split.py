"""Splits and folds."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators.ordering import cut_keys
from riskweave.operators.split import (
    class_quota,
    feature_vector,
    fold_profile,
    fold_starts,
    split_xy,
    stratified_split,
    temporal_split,
    with_segment,
    with_split,
)


def ledger_rows(spark, n, ledgers=4, seed=1):
    """Few ledgers with equal times: the cut falls among ties."""
    rng = random.Random(seed)
    rows = [(f"h{i:04d}", rng.randrange(ledgers)) for i in range(n)]
    df = spark.createDataFrame(rows, "hash string, ledger_index long")
    return df.withColumn("close_time", F.timestamp_seconds(F.col("ledger_index") * 10)), rows


def test_temporal_split_is_exact(spark):
    for n in (1, 2, 11, 200):
        df, rows = ledger_rows(spark, n)
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        train, test = temporal_split(df)
        cut = int(n * 0.8)
        assert sorted(r["hash"] for r in train.collect()) == sorted(r[0] for r in order[:cut])
        assert sorted(r["hash"] for r in test.collect()) == sorted(r[0] for r in order[cut:])


def test_split_with_copies(spark):
    """Copies of one key are counted, not sorted, and fall on one side."""
    df, rows = ledger_rows(spark, 60, ledgers=1)
    more = df.unionByName(df.filter("hash = 'h0030'").crossJoin(spark.range(40)).drop("id"))
    keys = cut_keys(more.select("ledger_index", "hash"), ["ledger_index", "hash"], [29, 35, 75], 100, limit=10)
    assert keys == {29: (0, "h0029"), 35: (0, "h0030"), 75: (0, "h0035")}
    train, test = temporal_split(more, 0.5)
    assert train.count() == 30 and test.count() == 70


def test_split_tag_needs_no_shuffle(spark):
    df, _ = ledger_rows(spark, 50)
    plan = with_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_folds(spark):
    assert fold_starts(20) == [5, 8, 11, 14, 17]
    with pytest.raises(ValueError):
        fold_starts(5, 5)
    df, rows = ledger_rows(spark, 20)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    seg = {r["hash"]: r["segment"] for r in with_segment(df).collect()}
    starts = fold_starts(20)
    for i, (h, _) in enumerate(order):
        assert seg[h] == sum(i >= s for s in starts)
    profile = {(r["fold"], r["side"]): r["n"] for r in fold_profile(with_segment(df)).collect()}
    assert profile == {(f, s): n for f in range(1, 6) for s, n in (("test", 3), ("train", 2 + 3 * f))}


def test_stratified(spark):
    rows = [(i, i % 10 == 0) for i in range(400)]
    df = spark.createDataFrame([(i, int(b)) for i, b in rows], "id long, label int")
    out = stratified_split(df, key="id").collect()
    test = [r for r in out if r["split"] == "test"]
    assert len(test) == 80 and sum(r["label"] for r in test) == 8
    again = stratified_split(df.repartition(7), key="id").collect()
    assert sorted(out) == sorted(again)
    other = stratified_split(df, key="id", seed=1).collect()
    assert sorted(out) != sorted(other)
    one = stratified_split(df.withColumn("label", F.lit(1)), key="id")
    assert one.filter("split = 'test'").count() == 80
    assert class_quota({0: 3, 1: 2}, 0.5) in ({0: 2, 1: 1}, {0: 1, 1: 2})


def test_xy_and_vector(spark):
    df = spark.createDataFrame(
        [("h", float("nan"), float("inf"), 1)], "hash string, fee_rate double, memo_length double, label int"
    )
    assert feature_vector(df).first()["features"] == [0.0, 0.0]
    x, y = split_xy(df)
    assert x.columns == ["hash", "fee_rate", "memo_length"] and y.first()["label"] == 1
    with pytest.raises(ValueError, match="label"):
        split_xy(df.drop("label"))
