"""Ranks among the rows so far, mergeable sketches, and the compiled forest."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.operators import amount_sketch as sk
from riskweave.operators.asof_rank import amounts_so_far, dominated
from riskweave.operators.compiled_forest import MAX_NODES, raw_expression, score_natively
from riskweave.operators.features import ROW_ORDER, FeatureOptions, build_features, prepare
from riskweave.operators.forest import IsolationForest
from riskweave.plans.stored_forest import stored_forest
from riskweave.schema import FEATURE_COLUMNS
from test_features import SCHEMA, random_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=130))
def test_dominated_counts(values):
    v = np.array(values, dtype=np.int64)
    assert dominated(v).tolist() == [sum(x < values[i] for x in values[:i]) for i in range(len(v))]


def brute_asof(rows):
    out = {}
    for account in {r[1] for r in rows}:
        rs = sorted((r for r in rows if r[1] == account), key=lambda r: (r[3], r[4], r[0]))
        for i, r in enumerate(rs):
            before = [q[5] for q in rs[: i + 1]]
            less, same = sum(x < r[5] for x in before), sum(x == r[5] for x in before)
            out[r[0]] = (less + (same + 1) / 2) / (i + 1)
    return out


@pytest.mark.parametrize("amounts", ["varied", "constant"])
def test_asof_rank_by_brute_force(spark, amounts):
    """One account over many blocks of places and of amounts."""
    rows = random_rows(600, 21)
    if amounts == "constant":
        rows = [(*r[:5], 7.0, *r[6:]) for r in rows]
    base = prepare(spark.createDataFrame(rows, SCHEMA), FeatureOptions(300_000_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = amounts_so_far(base, ["account"], ROW_ORDER).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute_asof(rows)
    assert {r["hash"]: pytest.approx(r["_asof"], abs=1e-12) for r in got} == want


def test_asof_rank_of_ordinary_accounts_takes_one_exchange(spark, monkeypatch):
    """Stretches of whole accounts, and the plan through blocks for the larger ones beside them."""
    rows = random_rows(600, 24)
    base = prepare(spark.createDataFrame(rows, SCHEMA), FeatureOptions(300_000_000))
    want = {h: pytest.approx(v, abs=1e-12) for h, v in brute_asof(rows).items()}
    monkeypatch.setattr("riskweave.operators.asof_rank.STRETCH_ROWS", 50)
    plain = amounts_so_far(base, ["account"], ROW_ORDER)
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["hash"]: r["_asof"] for r in plain.collect()} == want
    some = sorted(base.groupBy("account").count().collect(), key=lambda r: r["count"])
    for hot_rows in (1, some[len(some) // 2]["count"]):
        split = amounts_so_far(base, ["account"], ROW_ORDER, hot_rows)
        assert split.columns == plain.columns
        assert {r["hash"]: r["_asof"] for r in split.collect()} == want


def test_features_without_look_ahead(spark):
    rows = random_rows(300, 22)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute_asof(rows)
    for hot_rows in (100_000, 60):
        got = {r["hash"]: r for r in build_features(df, look_ahead=False, hot_rows=hot_rows).collect()}
        assert {h: pytest.approx(r["tx_size_percentile_local"], abs=1e-12) for h, r in got.items()} == want
        assert all(r["is_large_tx"] == int(want[h] >= 0.95) for h, r in got.items())


def test_asof_of_copies_and_no_rows(spark):
    base = prepare(spark.createDataFrame(random_rows(5, 23), SCHEMA), FeatureOptions(300_000_000))
    twice = base.limit(1).union(base.limit(1))
    assert sorted(r["_asof"] for r in amounts_so_far(twice, ["account"], ROW_ORDER).collect()) == [0.75, 1.0]
    assert amounts_so_far(base.limit(0), ["account"], ROW_ORDER).count() == 0


def test_sketches_merge_alike_for_any_cut(spark, tmp_path):
    rows = random_rows(300, 24)
    whole = {tuple(r) for r in sk.sketch_amounts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for files in (1, 4):
        path, out = str(tmp_path / f"in{files}"), str(tmp_path / f"out{files}")
        rng = random.Random(files)
        part = [rng.randrange(files) for _ in rows]
        for i in range(files):
            some = [r for r, p in zip(rows, part) if p == i]
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        schema = spark.read.parquet(path).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = sk.add_to_sketch(stream, out, str(tmp_path / f"state{files}"), available_now=True)
        query.awaitTermination()
        merged = spark.read.schema("account string, cell int, n long, batch int").parquet(out)
        assert {tuple(r) for r in sk.merge_sketches(merged).collect()} == whole


def test_sketched_rank_is_within_its_bound(spark):
    rng = random.Random(25)
    amounts = [round(rng.expovariate(0.01), 2) for _ in range(2000)] + [0.0, -5.0]
    history = spark.createDataFrame([("A", a) for a in amounts], "account string, amount_value double")
    sketch = sk.as_cells(sk.sketch_amounts(history))
    probe = history.union(spark.createDataFrame([("B", 1.0), ("A", 1e9)], history.schema))
    got = sk.with_sketched_rank(probe, sketch).collect()
    cells = {tuple(r) for r in sk.sketch_amounts(history).select("cell", "n").collect()}
    widest = max(n for _, n in cells) / len(amounts)
    for r in got:
        if r["account"] == "B" or r["amount_value"] == 1e9:
            assert r["tx_size_percentile_local"] == 1.0
            continue
        below = sum(a < r["amount_value"] for a in amounts)
        same = sum(a == r["amount_value"] for a in amounts)
        exact = (below + (same + 1) / 2) / len(amounts)
        assert abs(r["tx_size_percentile_local"] - exact) <= widest / 2 + 1 / len(amounts)


def test_compiled_forest_scores_like_the_arrays(spark):
    f = build_features(spark.createDataFrame(random_rows(300, 26), SCHEMA)).cache()
    grown = IsolationForest(trees=8, sample=32, contamination=0.1).fit(f)
    for model in (grown, stored_forest(f)):
        names = ["raw_score", "score_pct", "anomaly_score", "risk_flag"]
        a = {r["hash"]: [r[c] for c in names] for r in model.transform(f).collect()}
        b = {r["hash"]: [r[c] for c in names] for r in score_natively(f, model).collect()}
        assert a.keys() == b.keys()
        for h in a:
            assert a[h][:3] == pytest.approx(b[h][:3], abs=1e-9) and a[h][3] == b[h][3]


def test_large_forests_are_not_compiled(spark):
    f = spark.createDataFrame([tuple(float(i) for i in range(len(FEATURE_COLUMNS)))], FEATURE_COLUMNS)
    model = stored_forest(f)
    model.nodes = pd.concat([model.nodes] * (MAX_NODES // len(model.nodes) + 1))
    with pytest.raises(ValueError):
        raw_expression(model)
