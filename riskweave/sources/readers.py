"""Batch sources: raw files, transaction tables, JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import first_filled
from riskweave.functions.amounts import number_as_amount, number_as_whole
from riskweave.schema import RAW_SCHEMA, TRANSACTION_SCHEMA

TRANSACTION_COLUMNS = TRANSACTION_SCHEMA.fieldNames()


CSV_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "escape": '"', "inferSchema": "false"}

#: Second spelling of a raw column, used where the first is missing or empty.
RAW_ALIASES = {
    "transaction_type": "TransactionType",
    "account": "Account",
    "destination": "Destination",
    "fee": "Fee",
}


#: Raw fields that may be numbers in typed sources: amounts in drops, and whole numbers.
AMOUNT_FIELDS = ("amount", "deliver_max", "taker_gets")
WHOLE_FIELDS = ("ledger_index", "fee", "Fee")


def read_raw(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw records from CSV (with a header) or JSON lines, every column as text.

    Columns are matched by name, so files with any subset or order of the known
    columns load; absent ones are NULL.
    """
    fmt = fmt or ("json" if path.endswith((".json", ".jsonl")) else "csv")
    if fmt == "json":
        return raw_from_json(spark.read.text(path))
    if fmt == "csv":
        return conform_raw(spark.read.options(**CSV_OPTIONS).csv(path))
    return conform_raw(spark.read.format(fmt).load(path))


def raw_from_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Raw records from a column of JSON messages (a text file or a message bus).

    The two spellings of a field differ only in case, which one struct cannot
    hold, so each spelling is parsed with its own schema. Fields that may be a
    number are looked at as variants: a JSON number isn't the text of it.
    """
    second = T.StructType([T.StructField(a, T.StringType()) for a in RAW_ALIASES.values()])
    message = F.col(column).cast("string")
    parsed = df.select(
        F.from_json(message, RAW_SCHEMA).alias("a"),
        F.from_json(message, second).alias("b"),
        F.try_parse_json(message).alias("v"),
    )

    def field(side: str, name: str) -> Column:
        text = F.col(f"{side}.{name}")
        if name in AMOUNT_FIELDS:
            as_number = number_as_amount
        elif name in WHOLE_FIELDS:
            as_number = number_as_whole
        else:
            return text
        kind = F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
        fractional = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        return F.when(fractional, as_number(F.try_variant_get("v", f"$.{name}", "double"))).otherwise(text)

    return parsed.select(
        *[
            first_filled(field("a", c), field("b", RAW_ALIASES[c])).alias(c)
            if c in RAW_ALIASES
            else field("a", c).alias(c)
            for c in RAW_SCHEMA.fieldNames()
        ]
    )


def conform_raw(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Bring a raw frame to the raw schema: merge spellings, cast to text, add NULLs.

    Columns are renamed by position first, because names that differ only in
    case cannot be told apart by reference. The CSV reader marks such names by
    appending their position. A column of a number type is read by its type: an
    amount is a number of drops, ledger and fee lose their fraction. Columns named
    in ``also`` come along as text.
    """
    if not also and df.schema == RAW_SCHEMA:
        return df
    kinds = [f.dataType for f in df.schema]
    known = {*RAW_SCHEMA.fieldNames(), *RAW_ALIASES.values(), *also}
    position = {}
    for i, name in enumerate(df.columns):
        base = name.removesuffix(str(i))
        position[name if name in known or base not in known else base] = i
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def column(name):
        if name not in position:
            return F.lit(None).cast("string")
        value, kind = F.col(f"c{position[name]}"), kinds[position[name]]
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            if name in AMOUNT_FIELDS:
                return number_as_amount(value)
            if name in WHOLE_FIELDS:
                return number_as_whole(value)
        return value.cast("string")

    return df.select(
        *[
            (first_filled(column(c), column(RAW_ALIASES[c])) if c in RAW_ALIASES else column(c)).alias(c)
            for c in [*RAW_SCHEMA.fieldNames(), *also]
        ]
    )


def read_transactions(
    spark: SparkSession,
    source: str | DataFrame,
    limit: int | None = None,
    newest: bool = False,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """The eleven transaction columns of a table, oldest first when limited.

    ``source`` is a path, a catalog table name (``fmt='table'``), a JDBC table
    (``fmt='jdbc'`` with the usual ``url``, ``partitionColumn``, ... options) or a
    DataFrame. ``limit`` of 0 or None means everything, and then no global sort
    is done: later stages order by their own keys.
    """
    if isinstance(source, DataFrame):
        df = source
    elif fmt == "table":
        df = spark.read.table(source)
    elif fmt == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=source, **options).load()
    else:
        df = spark.read.format(fmt).options(**options).load(source)
    df = df.select(*[c for c in TRANSACTION_COLUMNS if c in df.columns])
    if not limit:
        return df
    keys = [c for c in ("ledger_index", "close_time", "hash") if c in df.columns]
    order = [F.col(k).desc() if newest else F.col(k).asc() for k in keys]
    return df.orderBy(*order).limit(int(limit))
