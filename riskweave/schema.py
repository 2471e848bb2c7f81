"""Column names, row types and fixed values shared by every stage."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must match the data contract exactly.
# ---------------------------------------------------------------------------
NATIVE_CURRENCY = "XRP"
DROPS_PER_NATIVE = 1_000_000
SUCCESS_RESULT = "tesSUCCESS"
OFFER_CREATE = "OfferCreate"
OFFER_CANCEL = "OfferCancel"
URL_PATTERN = r"(?i)(https?://|www\.)"
EXPLORER_URL = "https://livenet.xrpl.org/accounts/{account}"
MAD_TO_SIGMA = 1.4826
Z_CLIP = 10.0
DORMANCY_CAP = 100_000
LARGE_TX_PERCENTILE = 0.95

FEATURE_COLUMNS = [
    "tx_size_percentile_local",
    "is_large_tx",
    "total_volume_5m",
    "volume_spike_ratio",
    "fee_rate",
    "rolling_tx_count_5m",
    "tx_per_minute",
    "tx_rate_z_score",
    "tx_rate_mad_z",
    "memo_entropy",
    "memo_length",
    "duplicate_memo_count",
    "contains_url",
    "dest_concentration",
    "unique_dest_ratio",
    "offer_cancel_ratio",
    "failed_tx_ratio",
    "dormancy_gap",
]

RISK_LABELS = [
    (0.8, "Extreme"),
    (0.6, "Very high"),
    (0.4, "High"),
    (0.2, "Moderate"),
]
LOWEST_RISK_LABEL = "Low"

ACTIONS = {
    "HIGH": "Investigate immediately → " + EXPLORER_URL,
    "MEDIUM": "Monitor closely. Flag for review if pattern persists in next 30 minutes.",
    "LOW": "Note for context. No immediate action required.",
}

# ---------------------------------------------------------------------------
# Row types
# ---------------------------------------------------------------------------
#: The order in which rows of one account follow each other.
LEDGER_ORDER = ["ledger_index", "close_time", "hash"]

INT_FEATURES = {"is_large_tx", "contains_url"}

RAW_COLUMNS = [
    "amount",
    "deliver_max",
    "taker_gets",
    "ledger_close_time_human",
    "date",
    "timestamp",
    "ledger_index",
    "hash",
    "tx_hash",
    "txn_signature",
    "transaction_type",
    "account",
    "destination",
    "fee",
    "result",
]

#: Raw records arrive as text; every column is read as a string and parsed later.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

AMOUNT_TYPE = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("issuer", T.StringType()),
    ]
)

NORMALISED_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("ledger_index", T.LongType()),
        T.StructField("tx_hash", T.StringType()),
        T.StructField("tx_type", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("fee", T.LongType()),
        T.StructField("amount_xrp", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("issuer", T.StringType()),
    ]
)

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("destination", T.StringType()),
        T.StructField("ledger_index", T.LongType()),
        T.StructField("close_time", T.TimestampType()),
        T.StructField("amount_value", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("memo_text", T.StringType()),
        T.StructField("balance_xrp", T.DoubleType()),
        T.StructField("label", T.IntegerType()),
    ]
)

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("ledger_index", T.LongType()),
        T.StructField("close_time", T.TimestampType()),
    ]
    + [
        T.StructField(c, T.IntegerType() if c in INT_FEATURES else T.DoubleType())
        for c in FEATURE_COLUMNS
    ]
)
