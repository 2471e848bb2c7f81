"""Features against a brute-force restatement, skewed accounts, and plan shape."""

import datetime as dt
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskweave.functions import contains_url, safe_div, shannon_entropy
from riskweave.operators.features import (
    FeatureOptions,
    build_features,
    feature_quality,
    grouped_features,
    ledger_activity,
    prepare,
    project,
    special_entities,
)
from riskweave.operators.hot_features import split_features
from riskweave.operators.normalize import unify_schema
from riskweave.schema import FEATURE_COLUMNS

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = (
    "hash string, account string, destination string, ledger_index long, close_time timestamp, amount_value double, "
    "fee double, transaction_type string, success boolean, memo_text string"
)


def random_rows(n, seed, accounts=("hot", "hot", "hot", "a", "b"), seconds=4000):
    """One account holds most rows; times, amounts and memos repeat."""
    rng = random.Random(seed)
    times = sorted(rng.randrange(seconds) for _ in range(n))
    rows = []
    for i, t in enumerate(times):
        rows.append(
            (
                f"h{i:05d}",
                rng.choice(accounts),
                rng.choice([None, "d1", "d2", "d3", "d4"]),
                1000 + t // 4,
                START + dt.timedelta(seconds=t),
                rng.choice([0.0, 1.0, 2.5, 10.0, round(rng.random() * 100, 2)]),
                rng.choice([10.0, 5000.0]),
                rng.choice(["Payment", "OfferCreate", "OfferCancel"]),
                rng.random() < 0.8,
                rng.choice(["", "", "hello", "see http://x.y now", "aaaa", "Ünïcode 🙂"]),
            )
        )
    return rows


def brute_force(rows, window_s=300, size=20, least=3, positional=False):
    """The definitions, row by row."""
    out = {}
    by_account = {}
    for r in rows:
        by_account.setdefault(r[1], []).append(r)
    for account, rs in by_account.items():
        rs = sorted(rs, key=lambda r: (r[3], r[4], r[0]))
        amounts = [r[5] for r in rs]
        volumes, rates, memos = [], [], Counter()
        for i, r in enumerate(rs):
            inside = [
                q
                for j, q in enumerate(rs)
                if r[4] - dt.timedelta(seconds=window_s) < q[4] <= r[4]
                and not (positional and q[4] == r[4] and j > i)
            ]
            volume, count = math.fsum(q[5] for q in inside), len(inside)
            dests = max(1, len({q[2] or "" for q in inside}))
            volumes.append(volume)
            rates.append(count / (window_s / 60))
            vs, xs = volumes[-size:], rates[-size:]
            enough = len(xs) >= least
            mean = statistics.fmean(vs) if enough else 0.0
            if enough:
                sd = statistics.stdev(xs)
                z = 0.0 if sd < 1e-12 else (xs[-1] - statistics.fmean(xs)) / sd
                med = statistics.median(xs)
                mad = statistics.median(abs(x - med) for x in xs)
                mz = 0.0 if mad < 1e-12 else max(-10, min(10, (xs[-1] - med) / (1.4826 * mad)))
            else:
                z, mz = xs[-1], 0.0
            memo = r[9]
            counts = Counter(memo)
            offers = [q for q in inside if q[7] in ("OfferCreate", "OfferCancel")]
            less, same = sum(a < r[5] for a in amounts), amounts.count(r[5])
            pct = (less + (same + 1) / 2) / len(amounts)
            out[r[0]] = {
                "tx_size_percentile_local": pct,
                "is_large_tx": int(pct >= 0.95),
                "total_volume_5m": volume,
                "volume_spike_ratio": volume / mean if mean else 0.0,
                "fee_rate": r[6] / (r[5] * 1e6) if r[5] > 0 else 0.0,
                "rolling_tx_count_5m": count,
                "tx_per_minute": rates[-1],
                "tx_rate_z_score": z,
                "tx_rate_mad_z": mz,
                "memo_entropy": -sum(c / len(memo) * math.log2(c / len(memo)) for c in counts.values()),
                "memo_length": len(memo),
                "duplicate_memo_count": memos[memo],
                "contains_url": int("http://" in memo),
                "dest_concentration": 1 / dests,
                "unique_dest_ratio": dests / max(count, 1),
                "offer_cancel_ratio": sum(q[7] == "OfferCancel" for q in inside) / max(len(offers), 1),
                "failed_tx_ratio": sum(not q[8] for q in inside) / max(count, 1),
                "dormancy_gap": min(r[3] - rs[i - 1][3], 100_000) if i else 0,
            }
            memos[memo] += 1
    return out


def assert_same(df, expected):
    got = {r["hash"]: r for r in df.collect()}
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        for name, value in want.items():
            assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)


@pytest.mark.parametrize("ties", ["peers", "positional"])
def test_grouped_plan_matches_brute_force(spark, ties):
    rows = random_rows(400, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    assert_same(build_features(df, ties=ties), brute_force(rows, positional=ties == "positional"))


@pytest.mark.parametrize("ties", ["peers", "positional"])
@pytest.mark.parametrize("chunk_rows", [20, 64])
def test_split_plan_matches_brute_force(spark, ties, chunk_rows):
    """Every cut goes through the account: small chunks, small blocks."""
    rows = random_rows(400, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    opts = FeatureOptions(300_000_000, ties=ties)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = project(split_features(prepare(df, opts), opts, chunk_rows=chunk_rows))
        assert_same(got, brute_force(rows, positional=ties == "positional"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("ties", ["peers", "positional"])
@pytest.mark.parametrize("seconds", [400, 40_000])
def test_linear_plan_matches_brute_force(spark, ties, seconds):
    """Dense and sparse accounts; rows at exactly one window length from each other."""
    rows = random_rows(400, 12, seconds=seconds)
    df = spark.createDataFrame(rows, SCHEMA)
    opts = FeatureOptions(300_000_000, ties=ties)
    got = project(grouped_features(prepare(df, opts), opts, linear=True))
    assert_same(got, brute_force(rows, positional=ties == "positional"))


def test_dense_accounts_take_the_linear_plan(spark, monkeypatch):
    rows = random_rows(420, 13, accounts=("dense", "dense", "dense", "a"), seconds=1200)
    sparse = random_rows(320, 14, accounts=("sparse",), seconds=4_000_000)
    rows += [(f"s{r[0]}", *r[1:]) for r in sparse]
    df = spark.createDataFrame(rows, SCHEMA)
    opts = FeatureOptions(300_000_000)
    special, plans = special_entities(unify_schema(df), opts, 100_000)
    assert plans == {"linear": 1} and [tuple(r) for r in special.collect()] == [("dense", "linear")]
    for hot_rows in (100_000, 310):
        assert_same(build_features(df, hot_rows=hot_rows), brute_force(rows))


def test_linear_plan_has_one_exchange(spark):
    opts = FeatureOptions(300_000_000)
    df = spark.createDataFrame(random_rows(50, 7), SCHEMA)
    made = grouped_features(prepare(df, opts), opts, linear=True)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_missing_ledger_becomes_zero(spark):
    df = spark.createDataFrame([("h", "A", START)], "hash string, account string, close_time timestamp")
    got = build_features(df.withColumn("ledger_index", F.lit(None).cast("long"))).first()
    assert got["ledger_index"] == 0


def test_hot_and_ordinary_accounts_together(spark):
    rows = random_rows(300, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert_same(build_features(df, hot_rows=100), brute_force(rows))


def test_one_burst_at_one_time(spark):
    """A third of all rows share account, time and destination."""
    rows = random_rows(120, 4)
    burst = [
        (f"x{i:03d}", "hot", "d1", 1500, START + dt.timedelta(seconds=2000), 1.0, 10.0, "Payment", True, "")
        for i in range(60)
    ]
    rows += burst
    df = spark.createDataFrame(rows, SCHEMA)
    assert_same(build_features(df, hot_rows=50), brute_force(rows))


@pytest.mark.parametrize("ties", ["peers", "positional"])
def test_copies_of_one_transaction(spark, ties):
    """A third of all rows are the same row; both plans give the same values, whichever copy has them."""
    rows = random_rows(120, 10)
    rows += [rows[60]] * 60
    df = spark.createDataFrame(rows, SCHEMA)
    a = build_features(df, ties=ties)
    b = build_features(df, ties=ties, hot_rows=20)
    rounded = lambda f: sorted(
        (r["hash"], *(round(r[c], 9) for c in FEATURE_COLUMNS)) for r in f.collect()
    )
    assert rounded(a) == rounded(b)
    assert a.filter("hash = 'h00060'").count() == 61


def test_tie_example(spark):
    at = [0, 300, 300, 360]
    rows = [
        (f"h{i}", "A", "d", i, START + dt.timedelta(seconds=s), float(2**i), 0.0, "Payment", True, "")
        for i, s in enumerate(at)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot_rows in (1, 100):
        for ties, want in (("peers", [1, 6, 6, 14]), ("positional", [1, 2, 6, 14])):
            f = build_features(df, ties=ties, hot_rows=hot_rows).orderBy("hash").collect()
            assert [r["total_volume_5m"] for r in f] == want
    ranks = build_features(
        df.withColumn("amount_value", F.element_at(F.array(*map(F.lit, [1.0, 1.0, 2.0, 5.0])), F.col("ledger_index").cast("int") + 1))
    ).orderBy("hash")
    assert [r["tx_size_percentile_local"] for r in ranks.collect()] == [0.375, 0.375, 0.75, 1.0]


def test_result_does_not_depend_on_partitioning(spark):
    rows = random_rows(200, 5)
    a = build_features(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    random.Random(1).shuffle(rows)
    b = build_features(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())


def test_properties(spark):
    f = build_features(spark.createDataFrame(random_rows(300, 6), SCHEMA))
    ratios = ["tx_size_percentile_local", "dest_concentration", "unique_dest_ratio", "offer_cancel_ratio", "failed_tx_ratio"]
    for c in ratios:
        assert f.filter(~F.col(c).between(0, 1)).count() == 0
    assert f.filter(F.abs("tx_rate_mad_z") > 10).count() == 0
    q = feature_quality(f).first()
    assert (q["nan_count"], q["inf_count"], q["feature_rows"]) == (0, 0, 300)


def test_one_exchange(spark):
    opts = FeatureOptions(300_000_000)
    df = spark.createDataFrame(random_rows(50, 7), SCHEMA)
    plan = grouped_features(prepare(df, opts), opts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(account") == 1
    assert plan.count("Exchange") == 1


def test_options(spark):
    rows = random_rows(100, 8)
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "currency", F.when(F.col("ledger_index") % 2 == 0, "USD").otherwise("EUR")
    )
    kept = build_features(df, ignore_empty_memo=True).join(df.select("hash", "memo_text"), "hash")
    assert kept.filter("memo_text = '' and duplicate_memo_count > 0").count() == 0
    apart = build_features(df, entity=("account", "currency"))
    usd = build_features(df.filter("currency = 'USD'"))
    hot = build_features(df, entity=("account", "currency"), hot_rows=5)
    by_hash = {r["hash"]: r for r in apart.collect()}
    hot_by_hash = {r["hash"]: r for r in hot.collect()}
    for r in usd.collect():
        for c in FEATURE_COLUMNS:
            assert r[c] == pytest.approx(by_hash[r["hash"]][c], abs=1e-9)
            assert r[c] == pytest.approx(hot_by_hash[r["hash"]][c], abs=1e-9)
    with pytest.raises(ValueError):
        build_features(df, ties="other")
    labelled = build_features(df.withColumn("label", F.lit(1)))
    assert labelled.columns[-1] == "label"
    assert build_features(df, keep=()).columns[:3] == ["account", "ledger_index", "close_time"]


def test_ledger_activity_across_slices(spark):
    rng = random.Random(9)
    ledgers = [4090 + rng.randrange(30) for _ in range(200)] + [8191, 8192, 8193, 8210, 8211]
    df = spark.createDataFrame(
        [(f"h{i}", "A", x, START) for i, x in enumerate(ledgers)],
        "hash string, account string, ledger_index long, close_time timestamp",
    )
    got = {r["ledger_index"]: r for r in ledger_activity(df).collect()}
    assert got.keys() == set(ledgers)
    for x in set(ledgers):
        assert got[x]["tx_count_last_5_ledgers"] == sum(x - 5 < y <= x for y in ledgers)
        assert got[x]["tx_count_last_20_ledgers"] == sum(x - 20 < y <= x for y in ledgers)


def test_scalar_functions(spark):
    texts = ["", "a", "aaaa", "ab", "aab\nb", "🙂🙂x", "((..))\\", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(shannon_entropy("t")).collect()]
    for t, e in zip(texts, got):
        n = len(t or "")
        want = -sum(c / n * math.log2(c / n) for c in Counter(t).values()) if n else 0.0
        assert e == pytest.approx(want, abs=1e-12)
        if t and len(set(t)) == 1:
            assert e == 0.0
    urls = ["HTTP://x", "see https://y", "WWW.z", "http:/x", "", None]
    df = spark.createDataFrame([(t,) for t in urls], "t string")
    assert [r[0] for r in df.select(contains_url("t")).collect()] == [1, 1, 1, 0, 0, 0]
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0)], "n double, d double")
    assert [r[0] for r in df.select(safe_div("n", "d")).collect()] == [0.0, 0.25]


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Whatever the session's number of shuffle partitions, a task gets a bounded number of rows."""
    from riskweave.operators import ordering

    df = spark.createDataFrame(random_rows(400, 31), SCHEMA)
    want = sorted(build_features(df).collect())
    monkeypatch.setattr(ordering, "ENTITY_TASK_ROWS", 20)
    made = build_features(df)
    assert "hashpartitioning(account#" in (plan := made._jdf.queryExecution().executedPlan().toString())
    assert ", 20), REPARTITION_BY_NUM" in plan
    assert sorted(made.collect()) == want
    hot = build_features(df, hot_rows=20)
    assert "REPARTITION_BY_NUM" in hot._jdf.queryExecution().executedPlan().toString()
    got = {r["hash"]: r for r in hot.collect()}
    for r in want:
        assert list(got[r["hash"]])[4:] == pytest.approx(list(r)[4:])
