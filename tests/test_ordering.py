"""Selection, quantiles, indices and running totals against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.ordering import (
    before_key,
    cut_keys,
    exact_quantiles,
    ordered_blocks,
    row_index,
    running_totals,
    select_ranks,
)


def numbers(kind, n=3000):
    rng = random.Random(7)
    if kind == "distinct":
        return [rng.gauss(0, 10) for _ in range(n)]
    if kind == "third_equal":
        return [5.0 if rng.random() < 0.34 else rng.gauss(0, 10) for _ in range(n)]
    if kind == "two_values":
        return [float(rng.random() < 0.5) for _ in range(n)]
    return [1.0] * n


@pytest.mark.parametrize("kind", ["distinct", "third_equal", "two_values", "constant"])
def test_select_ranks(spark, kind):
    values = numbers(kind)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    s = sorted(values)
    ranks = [0, 1, 2, 749, 750, 1500, 2250, 2998, 2999]
    found = select_ranks(df, {"v": ranks}, len(s), limit=50)
    for r in ranks:
        value, below, equal = found[("v", r)]
        assert value == s[r]
        assert below == s.index(value) and equal == s.count(value)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_exact_quantiles(spark, limit):
    a, b = numbers("distinct"), numbers("third_equal")
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, limit=limit)
    for name, values in (("a", a), ("b", b)):
        assert got[name] == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)


@pytest.mark.parametrize("limit", [10, 10**6])
def test_cut_keys_through_ties(spark, limit):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(3), f"h{i:05d}") for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long, c string")
    order = ["a", "b", "c"]
    s = sorted(rows)
    ranks = [1, 100, 250, 400, 499]
    keys = cut_keys(df, order, ranks, len(rows), limit)
    for r in ranks:
        got = sorted(tuple(x) for x in df.filter(before_key(order, keys[r])).collect())
        assert got == s[:r]


def test_row_index_and_running_totals(spark):
    rng = random.Random(5)
    # One key holds most rows.
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.randrange(4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, m long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordered_blocks(df, ["k", "i"])
        assert blocks.select("_block").distinct().count() > 1
        assert blocks.filter("k = 'hot'").select("_block").distinct().count() > 1
        lead = running_totals(blocks, ["k"], {"t": F.col("i")}, keys_lead_order=True)
        other = running_totals(blocks, ["m"], {"u": F.lit(1)}, keys_lead_order=False)
        whole = running_totals(blocks, [], {"w": F.lit(1)}, keys_lead_order=True)
        got_t = {(r["k"], r["i"]): r["t"] for r in lead.collect()}
        got_u = {(r["k"], r["i"]): r["u"] for r in other.collect()}
        got_w = {(r["k"], r["i"]): r["w"] for r in whole.collect()}
        got_r = {(r["k"], r["i"]): r["_row"] for r in row_index(blocks).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums, seen = {}, {}
    for n, (k, i, m) in enumerate(sorted(rows)):
        sums[k] = sums.get(k, 0) + i
        seen[m] = seen.get(m, 0) + 1
        assert got_t[(k, i)] == sums[k]
        assert got_u[(k, i)] == seen[m]
        assert got_w[(k, i)] == n + 1 and got_r[(k, i)] == n


def test_many_aggregates_run_in_several_plans_of_one_job(spark):
    from riskweave.operators.ordering import _aggregated

    df = spark.range(1000).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(18)])
    aggs = [F.count_if(F.col(f"c{i}") == k) for i in range(18) for k in range(4)]
    want = list(df.agg(*[a.alias(f"x{i}") for i, a in enumerate(aggs)]).first())
    assert [_aggregated(df, aggs, n) for n in (5, 24, 100)] == [want] * 3
