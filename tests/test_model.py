"""Scaler, contamination, forest, validation, persistence."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.forest import IsolationForest, average_path, grow_tree
from riskweave.operators.scaling import RobustScaler, calibrate_contamination, contamination_from
from riskweave.operators.validation import (
    cv_summary,
    exact_kolmogorov_p,
    ks_two_sample,
    timeseries_cv,
    validate,
    verdicts,
)
from riskweave.plans.pipeline import ranked, run_pipeline, score, train
from riskweave.sources.adapters import events_as_raw
from riskweave.sources.sinks import load_model

COLUMNS = ["total_volume_5m", "fee_rate", "contains_url"]


@pytest.fixture(scope="module")
def points(spark):
    """A cloud and ten rows far outside it; one column is almost always zero."""
    rng = np.random.default_rng(0)
    rows = [(f"h{i:04d}", i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    rows += [(f"x{i:04d}", 600 + i, 25.0 + i, -30.0, 1) for i in range(10)]
    df = spark.createDataFrame(
        rows, "hash string, ledger_index long, total_volume_5m double, fee_rate double, contains_url int"
    )
    return df.withColumn("close_time", F.timestamp_seconds("ledger_index")).withColumn("account", F.lit("A")).cache()


@pytest.fixture(scope="module")
def model(points):
    return IsolationForest(contamination=0.02, trees=60).fit(points, COLUMNS)


def test_average_path():
    assert [average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_scaler_keeps_sparse_columns(spark, points):
    scaler = RobustScaler.fit(points, COLUMNS)
    x = np.array([[r[c] for c in COLUMNS] for r in points.orderBy("hash").collect()], dtype=float)
    q = np.percentile(x, [25, 50, 75], axis=0)
    iqr = np.where(q[2] == q[0], 1, q[2] - q[0])
    got = np.array([[r[c] for c in COLUMNS] for r in scaler.transform(points).orderBy("hash").collect()])
    assert np.allclose(got, (x - q[1]) / iqr)
    assert got[:, 2].max() == 1.0


def test_contamination(spark, points):
    assert contamination_from(5, 19) == 0.05
    assert contamination_from(0, 100) == 0.01
    assert contamination_from(50, 100) == 0.15
    assert contamination_from(5, 100) == 0.05
    scaled = RobustScaler.fit(points, COLUMNS).transform(points)
    assert calibrate_contamination(scaled, COLUMNS) == pytest.approx(10 / 610)
    assert calibrate_contamination(scaled.limit(10), COLUMNS) == 0.05


def test_tree_isolates_every_row():
    x = np.random.default_rng(1).normal(size=(16, 3))
    t = grow_tree(0, x, 42, 50)
    assert (t["feature"] < 0).sum() == 16
    same = grow_tree(0, np.ones((8, 3)), 42, 3)
    assert len(same) == 1 and same["path"][0] == average_path(8)


def test_outliers_rank_first(points, model):
    top = model.transform(points).orderBy(F.desc("raw_score")).limit(10).collect()
    assert all(r["hash"].startswith("x") for r in top)
    scored = model.transform(points)
    assert scored.filter("raw_score <= 0 or raw_score >= 1").count() == 0
    assert scored.filter("(anomaly_score > 0) <> risk_flag").count() == 0
    assert scored.filter("risk_flag").count() == pytest.approx(0.02 * 610, abs=1)
    proba = model.predict_proba(points).first()
    assert proba["p_normal"] + proba["p_anomaly"] == 1.0
    assert {r[0] for r in model.predict(points).select("prediction").distinct().collect()} == {0, 1}


def test_scores_match_tree_walk(points, model):
    """The vectorised descent against a plain walk over the node table."""
    nodes = {(r.tree, r.node): r for r in model.nodes.itertuples()}
    trees = model.nodes["tree"].nunique()
    scaled = {r["hash"]: r for r in model.scaler.transform(points).collect()}
    for r in model.transform(points).limit(25).collect():
        depth = 0.0
        for t in range(trees):
            at = nodes[(t, 0)]
            while at.feature >= 0:
                x = scaled[r["hash"]][COLUMNS[at.feature]]
                at = nodes[(t, 2 * at.node + 1 + (x >= at.threshold))]
            depth += at.path
        assert r["raw_score"] == pytest.approx(2 ** (-depth / trees / average_path(256)))


def test_same_seed_same_scores(points, model):
    again = IsolationForest(contamination=0.02, trees=60).fit(points.repartition(7), COLUMNS)
    a = model.transform(points).select("hash", "raw_score").collect()
    b = again.transform(points).select("hash", "raw_score").collect()
    assert sorted(a) == sorted(b)
    other = IsolationForest(contamination=0.02, trees=60, seed=1).fit(points, COLUMNS)
    assert sorted(other.transform(points).select("hash", "raw_score").collect()) != sorted(a)


def test_pool_is_bounded_and_complete(points):
    f = IsolationForest(trees=2, sample=16)
    pool = f.pool(points, COLUMNS, 610, 16)
    assert 32 <= pool.count() < 150
    assert IsolationForest().pool(points, COLUMNS, 610, 256).count() == 610


def brute_ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    cdf = lambda s: np.searchsorted(np.sort(s), grid, side="right") / len(s)
    return np.abs(cdf(a) - cdf(b)).max()


@pytest.mark.parametrize("limit", [10**6, 5])
def test_ks(spark, limit):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.4, 1, size=200), 1)
    da = spark.createDataFrame([(float(x),) for x in a], "v double")
    db = spark.createDataFrame([(float(x),) for x in b], "v double")
    r = ks_two_sample(da, db, "v", limit=limit).first()
    assert r["ks_stat"] == pytest.approx(brute_ks(a, b))
    assert 0 <= r["ks_p_value"] < 0.05
    assert ks_two_sample(da, da, "v").first()["ks_p_value"] == 1.0


@pytest.mark.parametrize("shift", [150, 2000])
def test_exact_ks_of_large_samples(spark, shift):
    """Equal sizes beyond 10 000 rows have a closed form: paths mirrored at the band's edges."""
    n = 12_000
    a = spark.range(n).select(F.col("id").alias("v"))
    r = ks_two_sample(a, a.select((F.col("v") + shift).alias("v")), "v", method="exact").first()
    share = lambda k: math.exp(2 * math.lgamma(n + 1) - math.lgamma(n + k + 1) - math.lgamma(n - k + 1))
    expected = 2 * sum((-1) ** (k - 1) * share(k * shift) for k in range(1, n // shift + 1))
    assert (r["n_a"], r["n_b"]) == (n, n)
    assert r["ks_stat"] == pytest.approx(shift / n)
    assert r["ks_p_value"] == pytest.approx(expected, rel=1e-6)


def test_exact_ks_counts_paths():
    """Every order of two samples of unequal sizes, one by one."""
    n, m = 5, 7
    gaps = []
    for taken in itertools.combinations(range(n + m), n):
        a = [sum(t < s for t in taken) for s in range(n + m + 1)]
        gaps.append(max(abs(a[s] * m - (s - a[s]) * n) for s in range(n + m + 1)))
    for reach in range(n * m + 1):
        expected = sum(g >= reach for g in gaps) / len(gaps)
        assert exact_kolmogorov_p(reach / (n * m), n, m) == pytest.approx(expected, rel=1e-9)


def test_validation_and_cv(spark, points, model):
    v = verdicts(validate(model.transform(points.filter("ledger_index < 480")), model.transform(points.filter("ledger_index >= 480"))))
    r = v.first()
    assert r["train_flag_rate"] < r["test_flag_rate"] and r["rate_drift"] > 0.05 and r["high_drift"]
    cv = timeseries_cv(points.select("hash", "account", "ledger_index", "close_time", *COLUMNS), 2, trees=20).first()
    assert set(cv.asDict()) == {"mean_contamination", "std_contamination", "mean_flag_rate", "std_flag_rate", "stable"}
    folds = spark.createDataFrame([(1, 0.1, 0.02), (2, 0.2, 0.04)], "fold int, contamination double, test_flag_rate double")
    s = cv_summary(folds).first()
    assert (s["mean_contamination"], s["std_contamination"], s["std_flag_rate"], s["stable"]) == (0.15, 0.05, 0.01, True)


def test_pipeline_end_to_end(spark, sf_dir, tmp_path):
    raw = events_as_raw(spark, sf_dir)
    from riskweave.plans.checks import raw_messages

    source, out, saved = (str(tmp_path / n) for n in ("raw.jsonl", "alerts.csv", "model"))
    raw_messages(raw).write.text(source)
    found = run_pipeline(spark, source, out_path=out, save_model_path=saved, n_splits=0, window="7 days").collect()
    assert found and {r["severity"] for r in found} <= {"HIGH", "MEDIUM", "LOW"}
    flat = spark.read.option("header", "true").csv(out)
    assert flat.count() == len(found) and "feat_dormancy_gap" in flat.columns
    loaded = load_model(spark, saved)
    assert "ks_stat" in loaded.metrics and len(loaded.columns) == 18
    everything = run_pipeline(spark, source, load_model_path=saved, window="7 days")
    assert everything.count() >= len(found)


def test_train_and_score(spark, points):
    m, test_df = train(points.select("hash", "account", "ledger_index", "close_time", *COLUMNS), n_splits=0,
                       forest=IsolationForest(trees=20))
    assert test_df.count() == 122 and "score_separation" in m.metrics
    top = ranked(score(points, m, from_features=True)).first()
    assert top["hash"].startswith("x")


def test_marks_reached_by_halving(spark):
    """As many steps as the number of marks has binary digits, equal to a look at every mark."""
    from riskweave.operators.compiled_forest import marks_reached

    for n in (1, 2, 3, 1000, 1001, 1024):
        grid = sorted([k // 3 / n for k in range(n)])
        values = [-1.0, 2.0, *grid[:: max(1, n // 50)], *[g + 1e-9 for g in grid[:: max(1, n // 50)]]]
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        got = {r["v"]: r["n"] for r in rows.select("v", marks_reached(grid, F.col("v")).alias("n")).collect()}
        assert got == {v: sum(g <= v for g in grid) for v in values}


def test_first_component_in_one_pass(spark):
    """Rows of several tasks far from zero; the direction of numpy's covariance."""
    from riskweave.operators.scaling import _joined, first_component

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]]) + 1e6
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    got = rows.select("a", first_component(rows, ["a", "b", "c"]).alias("pc1")).collect()
    want = np.linalg.eigh(np.cov(x.T))[1][:, -1]
    want = want * np.sign(want[np.abs(want).argmax()])
    pc1 = {float(r[0]): float(r @ want) for r in x}
    assert all(r["pc1"] == pytest.approx(pc1[r["a"]], rel=1e-9) for r in got)
    nothing = (0, np.zeros(3), np.zeros((3, 3)))
    assert _joined(nothing, nothing) == nothing
