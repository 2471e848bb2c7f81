"""Scores to severity-graded, explained alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.schema import ACTIONS, EXPLORER_URL, FEATURE_COLUMNS, LOWEST_RISK_LABEL, RISK_LABELS


@dataclass(frozen=True)
class SignalRule:
    """When ``fires`` holds for the value of ``feature``, ``message`` explains it.

    ``message`` may hold one ``{}``, filled with ``scale * value`` to ``digits``
    decimals.
    """

    code: str
    feature: str
    fires: Callable[[Column], Column]
    message: str
    digits: int = 0
    scale: float = 1.0


# ---------------------------------------------------------------------------
# Thresholds and texts of the explanations, in output order.
# ---------------------------------------------------------------------------
SIGNAL_RULES = (
    SignalRule("tx_rate_z_score", "tx_rate_z_score", lambda v: F.abs(v) > 2,
               "Tx rate {}σ above account's normal", 1),
    SignalRule("tx_rate_mad_z", "tx_rate_mad_z", lambda v: F.abs(v) > 2,
               "Tx rate MAD z-score {} (robust spike)", 1),
    SignalRule("volume_spike_ratio", "volume_spike_ratio", lambda v: v > 5,
               "Volume {}× above 5-min baseline", 1),
    SignalRule("offer_cancel_ratio", "offer_cancel_ratio", lambda v: v > 0.5,
               "Offer cancel ratio {}% — possible spoofing", 0, 100),
    SignalRule("dest_concentration", "dest_concentration", lambda v: v < 0.3,
               "Fan-out to many destinations (conc={})", 2),
    SignalRule("failed_tx_ratio", "failed_tx_ratio", lambda v: v > 0.2,
               "Failed tx ratio {}% — probing or bot", 0, 100),
    SignalRule("dormancy_gap", "dormancy_gap", lambda v: v > 2000,
               "Dormant {} ledgers then suddenly active", 0),
    SignalRule("memo_entropy_low", "memo_entropy", lambda v: (v > 0) & (v < 0.5),
               "Memo entropy {} — repetitive spam content", 2),
    SignalRule("memo_entropy_high", "memo_entropy", lambda v: v > 4.5,
               "Memo entropy {} — possible encoded payload", 2),
    SignalRule("contains_url", "contains_url", lambda v: v == 1,
               "Memo contains URL"),
    SignalRule("duplicate_memo_count", "duplicate_memo_count", lambda v: v > 3,
               "Same memo repeated {} times", 0),
    SignalRule("tx_size_percentile_local", "tx_size_percentile_local", lambda v: v > 0.95,
               "Tx size at {}% of this account's history", 0, 100),
    SignalRule("fee_rate", "fee_rate", lambda v: v > 0.001,
               "Fee rate {} — disproportionate to amount", 4),
)
FALLBACK_MESSAGE = "Multivariate anomaly — score {} (unusual combination of {} features)"
SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def fixed(value: Column, digits: int) -> Column:
    """A number as text with exactly ``digits`` decimals.

    Rounds the exact binary value, halves to the even digit. Spark's own
    rounding looks at the shortest decimal text instead, and so takes 0.025 for
    a half although the double lies above it; near a half, the exact side is
    found from the rounding error of the scaling product.
    """
    steps = 2.0 * 10**digits
    p = value * steps
    # Exact product: value * steps = p + error, by splitting value in two.
    wide = value * 134217729.0
    high = wide - (wide - value)
    error = (high * steps - p) + (value - high) * steps
    half = F.floor(p / 2).cast("double") * 2 + 1
    side = (p - half) + error
    even = F.floor((half + 1) / 4).cast("double") * 2
    near_half = (
        F.when(side > 0, (half + 1) / 2).when(side < 0, (half - 1) / 2).otherwise(even)
    ) / float(10**digits)
    rounded = F.when(F.abs(p - half) < 1e-6, near_half).otherwise(F.bround(value, digits))
    return F.format_string(f"%.{digits}f", rounded)


def severity(score: Column, flagged: Column, contamination: float | Column) -> Column:
    """HIGH, MEDIUM or LOW for flagged rows, NULL for the others."""
    c = F.lit(contamination) if isinstance(contamination, float) else contamination
    return (
        F.when(~flagged, F.lit(None).cast("string"))
        .when(score >= 1 - c * 0.2, "HIGH")
        .when(score >= 1 - c, "MEDIUM")
        .otherwise("LOW")
    )


def severity_rank(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    rank = F.when(c == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        rank = rank.when(c == s, i)
    return rank


def risk_label(score: Column) -> Column:
    label = None
    for bound, name in RISK_LABELS:
        label = F.when(score >= bound, name) if label is None else label.when(score >= bound, name)
    return label.otherwise(LOWEST_RISK_LABEL)


def _rules_for(columns: Sequence[str], rules: Sequence[SignalRule]) -> list[SignalRule]:
    have = set(columns)
    return [r for r in rules if r.feature in have]


def signals(columns: Sequence[str], rules: Sequence[SignalRule] = SIGNAL_RULES) -> Column:
    """Explanations that apply to a row, for the feature columns it has."""
    texts = []
    for r in _rules_for(columns, rules):
        v = F.col(r.feature).cast("double")
        before, hole, after = r.message.partition("{}")
        text = F.lit(before)
        if hole:
            text = F.concat(F.lit(before), fixed(v * r.scale, r.digits), F.lit(after))
        texts.append(F.when(r.fires(v), text))
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def signal_codes(columns: Sequence[str], rules: Sequence[SignalRule] = SIGNAL_RULES) -> Column:
    """Codes of the rules that fire, in rule order."""
    codes = [
        F.when(r.fires(F.col(r.feature).cast("double")), F.lit(r.code))
        for r in _rules_for(columns, rules)
    ]
    return F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")


def for_account(template: str, account: Column) -> Column:
    before, hole, after = template.partition("{account}")
    return F.concat(F.lit(before), account, F.lit(after)) if hole else F.lit(before)


def time_text(ts: Column) -> Column:
    """UTC time as text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS"))
    return F.concat(whole, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def alerts(
    scored: DataFrame,
    contamination: float,
    score_col: str = "score_pct",
    flag_col: str = "risk_flag",
    rules: Sequence[SignalRule] = SIGNAL_RULES,
    explorer_url: str = EXPLORER_URL,
    actions: dict[str, str] = ACTIONS,
) -> DataFrame:
    """One row per flagged transaction: severity, reasons, action, features.

    The contamination bounds are shares of the score's range, which ``score_pct``
    spreads evenly; ``anomaly_score`` may be named instead.
    """
    have = [c for c in FEATURE_COLUMNS if c in scored.columns]
    score = F.col(score_col)
    flagged = scored.withColumn(
        "severity", severity(score, F.col(flag_col), float(contamination))
    ).filter("severity is not null")
    reasons = signals(have, rules)
    head, _, tail = FALLBACK_MESSAGE.partition("{}")
    middle, _, tail = tail.partition("{}")
    fallback = F.array(
        F.concat(F.lit(head), fixed(score, 3), F.lit(f"{middle}{len(FEATURE_COLUMNS)}{tail}"))
    )
    account = F.col("account").cast("string")
    action = None
    for s in SEVERITIES:
        text = for_account(actions[s], account)
        is_s = F.col("severity") == s
        action = F.when(is_s, text) if action is None else action.when(is_s, text)
    features = [
        x for c in have for x in (F.lit(c), F.round(F.col(c).cast("double"), 4))
    ]
    return flagged.withColumn("_reasons", reasons).select(
        "severity",
        F.round(score, 4).alias("anomaly_score"),
        risk_label(score).alias("risk_label"),
        account.alias("account"),
        F.coalesce(F.col("ledger_index").cast("bigint"), F.lit(0)).alias("ledger_index"),
        time_text(F.col("close_time")).alias("close_time"),
        F.when(F.size("_reasons") == 0, fallback).otherwise(F.col("_reasons")).alias("signals"),
        action.alias("action"),
        for_account(explorer_url, account).alias("explorer_url"),
        F.create_map(*features).alias("features"),
    )


def by_urgency(alert_rows: DataFrame) -> DataFrame:
    """HIGH first, then by falling score."""
    return alert_rows.orderBy(
        severity_rank("severity"), F.desc("anomaly_score"), "account", "ledger_index", "close_time"
    )


def alert_summary(alert_rows: DataFrame) -> DataFrame:
    """Alerts per severity."""
    return alert_rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def top_features(alert_rows: DataFrame, k: int = 6) -> DataFrame:
    """Add the first ``k`` features that are not zero, as ``name=value`` text."""
    shown = F.filter(F.map_entries("features"), lambda e: e["value"] != 0.0)
    texts = F.transform(
        F.slice(shown, 1, k), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return alert_rows.withColumn("top_features", F.concat_ws("  ", texts))


def flatten_alerts(alert_rows: DataFrame) -> DataFrame:
    """Flat columns for CSV: signals joined by `` | ``, one ``feat_`` column per feature."""
    plain = [c for c in alert_rows.columns if c not in ("features", "signals")]
    at = plain.index("close_time") + 1 if "close_time" in plain else len(plain)
    joined = F.array_join("signals", " | ").alias("signals")
    columns = [F.col(c) for c in plain]
    columns.insert(at, joined)
    return alert_rows.select(
        *columns, *[F.col("features")[c].alias(f"feat_{c}") for c in FEATURE_COLUMNS]
    )


def topk_flagged(
    scored: DataFrame, k: int = 20, score_col: str = "anomaly_score", flag_col: str = "risk_flag"
) -> DataFrame:
    """The ``k`` flagged rows with the highest scores."""
    keys = [c for c in ("account", "ledger_index", "hash") if c in scored.columns]
    return scored.filter(F.col(flag_col)).orderBy(F.desc(score_col), *keys).limit(k)
