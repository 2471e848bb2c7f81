"""Views of the star-schema and event tables as ledger transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_transactions(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None
) -> DataFrame:
    """One transaction per event: users are accounts, event ids are ledgers.

    ``events`` may be a stream of the same rows.
    """
    if events is None:
        events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = (
        F.when(F.col("event_type") == "click", "OfferCreate")
        .when(F.col("event_type") == "view", "OfferCancel")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        F.col("event_id").cast("string").alias("hash"),
        F.col("user_id").cast("string").alias("account"),
        k.alias("destination"),
        F.col("event_id").alias("ledger_index"),
        F.col("ts").cast("timestamp").alias("close_time"),
        F.col("value").alias("amount_value"),
        F.lit("XRP").alias("currency"),
        k.cast("double").alias("fee"),
        kind.alias("transaction_type"),
        (F.col("event_type") != "error").alias("success"),
        F.col("props").alias("memo_text"),
    )


def orders_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order; dates are whole days, so ties are common."""
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("hash"),
        F.col("o_custkey").cast("string").alias("account"),
        F.col("o_orderpriority").alias("destination"),
        F.unix_date(day.cast("date")).cast("bigint").alias("ledger_index"),
        day.alias("close_time"),
        F.col("o_totalprice").alias("amount_value"),
        F.lit("XRP").alias("currency"),
        F.lit(0.0).alias("fee"),
        F.col("o_orderstatus").alias("transaction_type"),
        (F.col("o_orderstatus") != "F").alias("success"),
        F.lit("").alias("memo_text"),
    )


def lineitem_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order line: suppliers are accounts with many rows on few days."""
    day = F.col("l_shipdate").cast("timestamp")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in parts]).alias("hash"),
        F.col("l_suppkey").cast("string").alias("account"),
        (F.col("l_partkey") % 97).cast("string").alias("destination"),
        F.unix_date(day.cast("date")).cast("bigint").alias("ledger_index"),
        day.alias("close_time"),
        F.col("l_extendedprice").alias("amount_value"),
        F.lit("XRP").alias("currency"),
        F.col("l_quantity").alias("fee"),
        F.when(F.col("l_returnflag") == "R", "OfferCancel").when(F.col("l_returnflag") == "A", "OfferCreate")
        .otherwise("Payment").alias("transaction_type"),
        (F.col("l_linestatus") != "F").alias("success"),
        F.col("l_returnflag").alias("memo_text"),
    )


def events_as_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text records derived from events, cycling through every input shape."""
    e = F.col("event_id")
    value, drops = F.col("value"), F.round(F.col("value") * 1_000_000).cast("bigint")
    digits, text = drops.cast("string"), F.format_string("%.2f", value)
    q = F.pmod(e, F.lit(8))
    quoted = lambda v, rest: F.concat(F.lit('{"value":"'), v, F.lit('"'), F.lit(rest), F.lit("}"))
    amount = (
        F.when(q == 0, digits)
        .when(q == 1, F.concat(F.lit(" "), digits, F.lit(" ")))
        .when(q == 2, text)
        .when(q == 3, quoted(text, ',"currency":"USD","issuer":"r1"'))
        .when(q == 4, quoted(digits, ',"currency":"XRP"'))
        .when(q == 5, quoted(digits, ""))
        .when(q == 6, F.lit(""))
    )
    ts = F.col("ts").cast("timestamp")
    human = F.date_format(ts, "yyyy-MMM-dd HH:mm:ss.SSSSSS'000 UTC'")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    t, h, n = F.pmod(e, F.lit(4)), F.pmod(e, F.lit(3)), F.pmod(e, F.lit(5))
    account, kind = F.col("user_id").cast("string"), F.col("event_type")
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        amount.alias("amount"),
        F.when(F.pmod(e, F.lit(16)) == 7, digits).alias("deliver_max"),
        F.when(q == 7, quoted(text, ',"currency":"EUR","issuer":"r2"')).alias("taker_gets"),
        F.when(t == 0, human).when(t == 1, "").alias("ledger_close_time_human"),
        F.when(t == 1, iso).when(t == 3, "bad").alias("date"),
        F.when(t == 2, iso).alias("timestamp"),
        F.when(n != 4, e.cast("string")).alias("ledger_index"),
        F.when(h == 0, F.concat(F.lit("h"), e)).when(h == 1, "").alias("hash"),
        F.when(h == 1, F.concat(F.lit("x"), e)).alias("tx_hash"),
        F.concat(F.lit("s"), e).alias("txn_signature"),
        F.when(n != 0, kind).alias("transaction_type"),
        F.when(n == 0, kind).alias("TransactionType"),
        F.when(n != 1, account).alias("account"),
        F.when(n == 1, F.when(F.pmod(e, F.lit(2)) == 0, account)).alias("Account"),
        F.when(n == 2, k).otherwise("").alias("destination"),
        F.when(n == 3, k).alias("Destination"),
        F.when(h == 0, k).alias("fee"),
        F.when(h == 1, k).when(h == 2, "none").alias("Fee"),
    )
