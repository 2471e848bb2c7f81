"""Raw text records to the flat, typed transaction schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import first_filled, parse_time, pick_amount
from riskweave.functions.amounts import amount_object, amount_struct
from riskweave.schema import SUCCESS_RESULT
from riskweave.sources.readers import conform_raw

# Fields of a raw record, the first that is present counts.
AMOUNT_FIELDS = ["amount", "deliver_max", "taker_gets"]
TIME_FIELDS = ["ledger_close_time_human", "date", "timestamp"]


def normalize(
    df: DataFrame,
    numeric_time: str = "null",
    keep_rejects: bool = False,
    extras: bool = False,
) -> DataFrame:
    """One projection over raw records; batch and streaming frames alike.

    With ``keep_rejects`` an array column ``_rejects`` names the fields that were
    present but could not be parsed. With ``extras`` the columns success (from
    the field result; true where there is none) and memo_text come along, for
    the features that need them.
    """
    memo = "memo_text" if "memo_text" in df.columns else None
    raw = conform_raw(df, also=[memo] if memo else [])
    texts = raw.select(
        *[F.col(c) for c in raw.columns if c not in AMOUNT_FIELDS + TIME_FIELDS],
        F.trim(pick_amount(*AMOUNT_FIELDS)).alias("_text"),
        first_filled(*TIME_FIELDS).alias("_time_text"),
    )
    # Parsed once here; the columns below only read the result.
    staged = texts.select(
        "*",
        amount_object(F.col("_text")).alias("_object"),
        parse_time("_time_text", numeric_time).alias("_time"),
    ).withColumn("_amount", amount_struct(F.col("_text"), F.col("_object")))
    whole = lambda c: F.trim(F.col(c)).try_cast("bigint")
    out = [
        F.col("_time").alias("timestamp"),
        F.coalesce(whole("ledger_index"), F.lit(0).cast("bigint")).alias("ledger_index"),
        first_filled("hash", "tx_hash", "txn_signature").alias("tx_hash"),
        first_filled("transaction_type").alias("tx_type"),
        first_filled("account").alias("account"),
        first_filled("destination").alias("destination"),
        F.coalesce(whole("fee"), F.lit(0).cast("bigint")).alias("fee"),
        F.col("_amount.value").alias("amount_xrp"),
        F.col("_amount.currency").alias("currency"),
        F.col("_amount.issuer").alias("issuer"),
    ]
    if extras:
        result = first_filled("result")
        out += [
            F.coalesce(result == SUCCESS_RESULT, F.lit(True)).alias("success"),
            F.coalesce(F.col(memo) if memo else F.lit(None).cast("string"), F.lit("")).alias("memo_text"),
        ]
    if keep_rejects:
        failed = lambda c, name: F.when(c, F.lit(name))
        present = lambda c: first_filled(c).isNotNull()
        out.append(
            F.array_compact(
                F.array(
                    failed(F.col("_amount.unread"), "amount"),
                    failed(F.col("_time_text").isNotNull() & F.col("_time").isNull(), "time"),
                    failed(present("ledger_index") & whole("ledger_index").isNull(), "ledger_index"),
                    failed(present("fee") & whole("fee").isNull(), "fee"),
                )
            ).alias("_rejects")
        )
    return staged.select(*out)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep rows that name an account and a time."""
    return df.dropna(subset=["account", "timestamp"])


def profile_load(raw: DataFrame) -> DataFrame:
    """One row, in one pass: raw and kept counts, column count, time range, accounts."""
    kept = F.col("account").isNotNull() & F.col("timestamp").isNotNull()
    return normalize(raw).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.lit(len(raw.columns)).cast("bigint").alias("raw_columns"),
        F.count_if(kept).alias("kept_rows"),
        F.min(F.when(kept, F.col("timestamp"))).alias("first_time"),
        F.max(F.when(kept, F.col("timestamp"))).alias("last_time"),
        F.count_distinct(F.when(kept, F.col("account"))).alias("accounts"),
    )


def profile_types(kept: DataFrame) -> DataFrame:
    return kept.groupBy("tx_type").agg(F.count(F.lit(1)).alias("n"))


def unify_schema(df: DataFrame) -> DataFrame:
    """Canonical feature input from either the normalised or the table schema.

    Column presence decides: each canonical column comes from its own name, else
    from its counterpart in the other schema, else from a default. Every text
    and number column ends up non-null.
    """
    have = set(df.columns)

    def pick(name, *others):
        for n in (name, *others):
            if n in have:
                return F.col(n)
        return None

    def text(c):
        return F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")

    def number(c):
        if c is None:
            return F.lit(0.0)
        d = c.try_cast("double")
        return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)

    if "success" in have:
        success = F.coalesce(F.col("success").try_cast("boolean"), F.lit(True))
    elif "result" in have:
        success = F.coalesce(F.col("result") == SUCCESS_RESULT, F.lit(False))
    else:
        success = F.lit(True)
    time = pick("close_time", "timestamp")
    row_hash = pick("hash", "tx_hash")
    out = [
        F.col("account").cast("string").alias("account"),
        pick("ledger_index").cast("bigint").alias("ledger_index"),
        time.try_cast("timestamp").alias("close_time"),
        row_hash.cast("string").alias("hash"),
        number(pick("amount_value", "amount_xrp")).alias("amount_value"),
        text(pick("currency")).alias("currency"),
        number(pick("fee")).alias("fee"),
        text(pick("destination")).alias("destination"),
        text(pick("transaction_type", "tx_type")).alias("transaction_type"),
        success.alias("success"),
        text(pick("memo_text")).alias("memo_text"),
    ]
    if "label" in have:
        out.append(F.col("label").cast("int").alias("label"))
    return df.select(*out)
