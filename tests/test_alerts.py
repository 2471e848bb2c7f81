"""Severity, labels, signal texts, alert rows and files."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.operators.alerts import (
    SIGNAL_RULES,
    alerts,
    by_urgency,
    fixed,
    flatten_alerts,
    risk_label,
    severity,
    signals,
    top_features,
    topk_flagged,
)
from riskweave.schema import FEATURE_COLUMNS
from riskweave.sources.sinks import write_alerts


def test_severity_cut_points(spark):
    rows = [(0.99, True, "HIGH"), (0.9899, True, "MEDIUM"), (0.95, True, "MEDIUM"), (0.9499, True, "LOW"), (1.0, False, None)]
    df = spark.createDataFrame(rows, "s double, f boolean, want string")
    assert df.filter(~severity(F.col("s"), F.col("f"), 0.05).eqNullSafe(F.col("want"))).count() == 0


def test_risk_label_cut_points(spark):
    rows = [(0.8, "Extreme"), (0.6, "Very high"), (0.4, "High"), (0.2, "Moderate"), (0.1999, "Low"), (-1.0, "Low")]
    df = spark.createDataFrame(rows, "s double, want string")
    assert df.filter(risk_label(F.col("s")) != F.col("want")).count() == 0


def test_fixed_rounds_like_exact_binary(spark):
    rng = random.Random(1)
    values = [62.5, 63.5, 0.025, 2.675, 0.125, 0.375, 5.35, 0.0, 1 / 3, 1e6 + 0.5]
    values += [1 / n for n in range(1, 200)] + [k / 200 for k in range(400)] + [rng.gauss(0, 5) + 20 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        for r in df.select("v", fixed(F.col("v"), digits).alias("t")).collect():
            assert r["t"] == f"{r['v']:.{digits}f}"


def feature_row(spark, **values):
    base = {c: 0.0 for c in FEATURE_COLUMNS} | {"dest_concentration": 1.0} | values
    schema = ", ".join(f"{c} double" for c in FEATURE_COLUMNS)
    return spark.createDataFrame([tuple(float(base[c]) for c in FEATURE_COLUMNS)], schema)


CASES = [
    ({"tx_rate_z_score": 2.0}, []),
    ({"tx_rate_z_score": 2.01}, ["Tx rate 2.0σ above account's normal"]),
    ({"tx_rate_z_score": -2.5}, ["Tx rate -2.5σ above account's normal"]),
    ({"tx_rate_mad_z": 3.25}, ["Tx rate MAD z-score 3.2 (robust spike)"]),
    ({"volume_spike_ratio": 5.01}, ["Volume 5.0× above 5-min baseline"]),
    ({"offer_cancel_ratio": 0.625}, ["Offer cancel ratio 62% — possible spoofing"]),
    ({"dest_concentration": 0.3}, []),
    ({"dest_concentration": 0.29}, ["Fan-out to many destinations (conc=0.29)"]),
    ({"failed_tx_ratio": 0.21}, ["Failed tx ratio 21% — probing or bot"]),
    ({"dormancy_gap": 2001}, ["Dormant 2001 ledgers then suddenly active"]),
    ({"memo_entropy": 0.0}, []),
    ({"memo_entropy": 0.49}, ["Memo entropy 0.49 — repetitive spam content"]),
    ({"memo_entropy": 4.51}, ["Memo entropy 4.51 — possible encoded payload"]),
    ({"contains_url": 1}, ["Memo contains URL"]),
    ({"duplicate_memo_count": 4}, ["Same memo repeated 4 times"]),
    ({"tx_size_percentile_local": 0.96}, ["Tx size at 96% of this account's history"]),
    ({"fee_rate": 0.0011}, ["Fee rate 0.0011 — disproportionate to amount"]),
    ({"fee_rate": 0.5, "tx_rate_z_score": 3}, ["Tx rate 3.0σ above account's normal", "Fee rate 0.5000 — disproportionate to amount"]),
]


@pytest.mark.parametrize("values,want", CASES)
def test_signal_texts(spark, values, want):
    df = feature_row(spark, **values)
    assert df.select(signals(df.columns).alias("s")).first()["s"] == want


def scored(spark):
    df = feature_row(spark, volume_spike_ratio=6.0).unionByName(feature_row(spark)).unionByName(feature_row(spark))
    w = df.withColumn("ledger_index", F.monotonically_increasing_id() % 7 + F.spark_partition_id())
    return w.select(
        "*",
        F.lit("rA").alias("account"),
        F.lit("2024-01-05 12:34:50").cast("timestamp").alias("close_time"),
        F.when(F.col("volume_spike_ratio") > 5, 0.9951).otherwise(0.4).alias("score_pct"),
        F.lit(True).alias("risk_flag"),
    )


def test_alert_rows(spark):
    rows = by_urgency(alerts(scored(spark), 0.05)).collect()
    assert [r["severity"] for r in rows] == ["HIGH", "LOW", "LOW"]
    a, b = rows[0], rows[1]
    assert (a["risk_label"], a["anomaly_score"], a["close_time"]) == ("Extreme", 0.9951, "2024-01-05 12:34:50+00:00")
    assert a["action"].endswith("/rA") and a["explorer_url"].endswith("/rA") and "{" not in a["action"]
    assert a["signals"] == ["Volume 6.0× above 5-min baseline"]
    assert b["signals"] == ["Multivariate anomaly — score 0.400 (unusual combination of 18 features)"]
    keys = by_urgency(alerts(scored(spark), 0.05)).select(F.map_keys("features").alias("k")).first()["k"]
    assert keys == FEATURE_COLUMNS and a["features"]["volume_spike_ratio"] == 6.0
    assert top_features(alerts(scored(spark), 0.05)).filter("severity = 'HIGH'").first()["top_features"] == (
        "volume_spike_ratio=6.0  dest_concentration=1.0"
    )
    assert topk_flagged(scored(spark), 1, "score_pct").first()["score_pct"] == 0.9951


def test_rules_can_be_extended(spark):
    from riskweave.operators.alerts import SignalRule

    own = SignalRule("long_memo", "memo_length", lambda v: v > 10, "Memo of {} characters")
    df = feature_row(spark, memo_length=12)
    assert df.select(signals(df.columns, (*SIGNAL_RULES, own)).alias("s")).first()["s"] == ["Memo of 12 characters"]


def test_files(spark, tmp_path):
    found = alerts(scored(spark), 0.05)
    write_alerts(found, str(tmp_path / "a.csv"))
    write_alerts(found, str(tmp_path / "a.json"))
    flat = spark.read.option("header", "true").csv(str(tmp_path / "a.csv"))
    assert flat.columns == flatten_alerts(found).columns
    assert flat.columns[-18:] == [f"feat_{c}" for c in FEATURE_COLUMNS]
    back = spark.read.schema(found.schema).json(str(tmp_path / "a.json"))
    key = lambda r: (r["severity"], r["ledger_index"], r["anomaly_score"], tuple(r["signals"]), tuple(sorted(r["features"].items())))
    assert sorted(map(key, back.collect())) == sorted(map(key, found.collect()))
