"""Golden raw records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskweave.functions import parse_amount, parse_time
from riskweave.operators.normalize import drop_incomplete, normalize, unify_schema
from riskweave.schema import NORMALISED_SCHEMA
from riskweave.sources.readers import conform_raw, read_raw

AMOUNTS = [
    (None, None, "XRP", None),
    ("NaN", None, "XRP", None),
    ("1000000", 1.0, "XRP", None),
    (" 12 ", 0.000012, "XRP", None),
    ("-5", -0.000005, "XRP", None),
    ("1.5", None, "XRP", None),
    ("", None, "XRP", None),
    ("abc", None, "XRP", None),
    ("1_000", None, "XRP", None),
    ('{"value":"5","currency":"USD","issuer":"r1"}', 5.0, "USD", "r1"),
    ('{"value":"x","currency":"USD","issuer":"r1"}', None, "USD", "r1"),
    ('{"value":"5000000","currency":"XRP"}', 5.0, "XRP", None),
    ('{"value":5000000}', 5.0, "XRP", None),
    ('{"value":"1e3","currency":"EUR"}', 1000.0, "EUR", None),
    ("{bad", None, "XRP", None),
]


@pytest.mark.parametrize("i", range(len(AMOUNTS)))
def test_amount(spark, i):
    raw, value, currency, issuer = AMOUNTS[i]
    df = spark.createDataFrame([(raw,)], "amount string")
    r = df.select(parse_amount("amount").alias("a")).select("a.*").first()
    assert (r["currency"], r["issuer"]) == (currency, issuer)
    assert r["value"] == (pytest.approx(value) if value is not None else None)
    assert r["rejected"] == (raw == "{bad")


def test_times(spark):
    rows = [
        ("2024-Jan-05 12:34:50.000000000 UTC", dt.datetime(2024, 1, 5, 12, 34, 50)),
        ("2024-Jan-05 12:34:50 UTC", dt.datetime(2024, 1, 5, 12, 34, 50)),
        ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1)),
        ("2024-01-01 03:00:00+03:00", dt.datetime(2024, 1, 1)),
        ("bad", None),
        ("", None),
        ("1700000000", None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    got = [r["us"] for r in df.select(F.unix_micros(parse_time("t")).alias("us")).collect()]
    epoch = dt.datetime(1970, 1, 1)
    assert got == [w and int((w - epoch) / dt.timedelta(microseconds=1)) for _, w in rows]
    seconds = df.select(F.unix_micros(parse_time("t", "unix_s")).alias("us")).collect()[-1]["us"]
    assert seconds == 1_700_000_000_000_000


def raw_frame(spark, rows):
    names = sorted({k for r in rows for k in r})
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).toDF(*names)


def test_amount_pick_and_aliases(spark):
    df = raw_frame(
        spark,
        [
            {"deliver_max": "7", "taker_gets": "9", "Account": "A", "date": "2024-01-01T00:00:00Z", "tx_hash": "t",
             "TransactionType": "Payment", "Fee": "12", "ledger_index": "5"},
            {"amount": "", "deliver_max": "7", "account": "B", "date": "bad", "hash": "", "txn_signature": "s",
             "fee": "x"},
            {"amount": "1", "account": "", "Account": "C", "timestamp": "2024-01-01T00:00:00Z", "hash": "NaN"},
        ],
    )
    rows = normalize(df, keep_rejects=True).collect()
    a, b, c = rows
    assert (a["amount_xrp"], a["account"], a["tx_hash"], a["tx_type"], a["fee"], a["ledger_index"]) == (
        pytest.approx(7e-6), "A", "t", "Payment", 12, 5)
    assert (b["amount_xrp"], b["tx_hash"], b["fee"], b["timestamp"]) == (None, "s", 0, None)
    assert sorted(b["_rejects"]) == ["fee", "time"]
    assert (c["account"], c["tx_hash"], c["ledger_index"]) == ("C", None, 0)
    assert normalize(df).schema == NORMALISED_SCHEMA or [
        (f.name, f.dataType) for f in normalize(df).schema
    ] == [(f.name, f.dataType) for f in NORMALISED_SCHEMA]
    assert drop_incomplete(normalize(df)).count() == 2


def test_csv_with_both_spellings(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "hash,account,Account,amount,date\n"
        'h1,,A,"{""value"":""5"",""currency"":""USD"",""issuer"":""r""}",2024-01-01T00:00:00Z\n'
        "h2,B,,1000000,2024-01-01T00:00:00Z\n"
    )
    rows = {r["tx_hash"]: r for r in normalize(read_raw(spark, str(path))).collect()}
    assert (rows["h1"]["account"], rows["h1"]["amount_xrp"], rows["h1"]["currency"]) == ("A", 5.0, "USD")
    assert (rows["h2"]["account"], rows["h2"]["amount_xrp"]) == ("B", 1.0)


def test_json_messages(spark, tmp_path):
    path = tmp_path / "raw.jsonl"
    path.write_text(
        '{"hash":"h1","Account":"A","amount":{"value":"5","currency":"USD","issuer":"r"},"date":"2024-01-01T00:00:00Z"}\n'
        '{"hash":"h2","account":"B","deliver_max":"1000000","ledger_index":7}\n'
    )
    rows = {r["tx_hash"]: r for r in normalize(read_raw(spark, str(path))).collect()}
    assert (rows["h1"]["account"], rows["h1"]["amount_xrp"], rows["h1"]["issuer"]) == ("A", 5.0, "r")
    assert (rows["h2"]["account"], rows["h2"]["amount_xrp"], rows["h2"]["ledger_index"]) == ("B", 1.0, 7)


def test_unify_defaults(spark):
    df = spark.createDataFrame(
        [("A", 1, "2024-01-01 00:00:00", float("nan"), "tesSUCCESS"), ("A", 2, "x", 2.0, None)],
        "account string, ledger_index long, timestamp string, amount_xrp double, result string",
    ).withColumn("tx_hash", F.lit("h"))
    a, b = unify_schema(df).collect()
    assert (a["amount_value"], a["success"], a["memo_text"], a["fee"], a["destination"]) == (0.0, True, "", 0.0, "")
    assert (b["close_time"], b["success"]) == (None, False)


def test_conform_is_idempotent(spark):
    df = raw_frame(spark, [{"account": "A", "amount": "1"}])
    once = conform_raw(df)
    assert conform_raw(once).collect() == once.collect()
