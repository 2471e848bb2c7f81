"""Parsing of polymorphic raw fields into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schema import DROPS_PER_NATIVE, NATIVE_CURRENCY

#: Ledger style, such as ``2024-Jan-05 12:34:50.000000000 UTC``; the fraction may be absent.
LEDGER_TIME_PATTERN = r"^[0-9]{4}-[A-Za-z]{3}-"
LEDGER_TIME_FORMAT = "yyyy-MMM-dd HH:mm:ss[.SSSSSSSSS] z"

_AMOUNT_JSON = "value string, currency string, issuer string, _corrupt_record string"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_filled(*cols) -> Column:
    """First column that is neither NULL nor empty (text ``NaN`` counts as empty)."""
    return F.coalesce(
        *[F.when(~_col(c).isin("", "NaN", "nan"), _col(c)) for c in cols]
    )


def pick_amount(*cols) -> Column:
    """First amount field that is present; an empty string *is* present."""
    return F.coalesce(*[F.when(~_col(c).isin("NaN", "nan"), _col(c)) for c in cols])


def parse_amount(raw) -> Column:
    """Struct ``(value, currency, issuer, rejected, unread)`` from a raw amount string.

    A whole number is a count of drops. A JSON object carries its own currency;
    the native one (also assumed when the key is missing) is again in drops.
    """
    text = F.trim(_col(raw))
    return amount_struct(text, amount_object(text))


def amount_object(text: Column) -> Column:
    """The parsed object of an amount that is JSON, else NULL."""
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    return F.from_json(F.when(text.startswith("{"), text), _AMOUNT_JSON, options)


def amount_struct(text: Column, obj: Column) -> Column:
    """The amount from its trimmed text and, if that is JSON, its object.

    ``rejected`` marks broken JSON. ``unread`` marks all text that is there but has no
    value: that, an object whose value is no number, plain text that isn't a whole number.
    """
    malformed = obj["_corrupt_record"].isNotNull()
    good = obj.isNotNull() & ~malformed
    currency = F.coalesce(obj["currency"], F.lit(NATIVE_CURRENCY))
    native = currency == NATIVE_CURRENCY
    drops = F.lit(float(DROPS_PER_NATIVE))
    obj_value = obj["value"].try_cast("double") / F.when(native, drops).otherwise(F.lit(1.0))
    value = F.when(good, obj_value).when(
        obj.isNull() & text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint") / drops
    )
    given = F.when(good, obj["value"]).otherwise(text)
    unread = value.isNull() & given.isNotNull() & (F.trim(given) != "")
    return F.struct(
        value.alias("value"),
        F.when(good, currency).otherwise(F.lit(NATIVE_CURRENCY)).alias("currency"),
        F.when(good & ~native, obj["issuer"]).alias("issuer"),
        F.coalesce(malformed, F.lit(False)).alias("rejected"),
        F.coalesce(malformed | unread, F.lit(False)).alias("unread"),
    )


def number_as_amount(number: Column) -> Column:
    """A number of drops as amount text: an object, as only whole text counts as drops."""
    d = number.cast("double")
    finite = ~(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")))
    return F.when(finite, F.concat(F.lit('{"value":"'), d.cast("string"), F.lit('"}')))


def number_as_whole(number: Column) -> Column:
    """A number as text of its whole part."""
    d = number.cast("double")
    return F.when(F.abs(d) < float(1 << 63), d.cast("bigint").cast("string"))


def parse_time(text, numeric_time: str = "null") -> Column:
    """Timestamp from ledger-style or ISO-8601 text; unparsable text is NULL.

    ``numeric_time`` says what a bare number means: ``'null'`` (reject),
    ``'unix_s'`` or ``'unix_ns'``.
    """
    t = F.trim(_col(text))
    numeric = t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    parsed = F.when(
        t.rlike(LEDGER_TIME_PATTERN), F.try_to_timestamp(t, F.lit(LEDGER_TIME_FORMAT))
    ).otherwise(t.try_cast("timestamp"))
    if numeric_time == "null":
        number = F.lit(None).cast("timestamp")
    elif numeric_time == "unix_s":
        number = F.timestamp_micros((t.try_cast("decimal(38,6)") * 1_000_000).cast("bigint"))
    elif numeric_time == "unix_ns":
        number = F.timestamp_micros(F.floor(t.try_cast("decimal(38,6)") / 1000).cast("bigint"))
    else:
        raise ValueError(f"numeric_time must be null, unix_s or unix_ns, got {numeric_time!r}")
    return F.when(numeric, number).otherwise(parsed)
