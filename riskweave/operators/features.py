"""Behavioural features of each transaction, from its account's history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.functions import (
    clip,
    contains_url,
    duration_us,
    finite_or_zero,
    safe_div,
    shannon_entropy,
)
from riskweave.operators.linear_windows import with_window_measures
from riskweave.operators.normalize import unify_schema
from riskweave.operators.ordering import by_entity
from riskweave.schema import (
    DORMANCY_CAP,
    FEATURE_COLUMNS,
    INT_FEATURES,
    LARGE_TX_PERCENTILE,
    MAD_TO_SIGMA,
    OFFER_CANCEL,
    OFFER_CREATE,
    Z_CLIP,
)
from riskweave.session import written_table

#: Accounts with more rows than this take the split plan of ``hot_features``.
HOT_ROWS = 100_000
#: Windows of an account with more rows than this are measured before a plan is chosen ...
SMALL_ROWS = 256
#: ... and if a row's window holds so many rows on average, they run in linear time.
DENSE_ROWS = 64
#: A list of special accounts up to this long is broadcast; a longer one is shuffled.
BROADCAST_ACCOUNTS = 50_000

#: Order of one entity's rows, with the time as microseconds.
ROW_ORDER = ["ledger_index", "_us", "hash"]


@dataclass(frozen=True)
class FeatureOptions:
    """Parameters of :func:`build_features`."""

    window_us: int
    rows: int = 20
    min_rows: int = 3
    ties: str = "peers"
    entity: tuple[str, ...] = ("account",)
    ignore_empty_memo: bool = False

    def __post_init__(self):
        if self.ties not in ("peers", "positional"):
            raise ValueError(f"ties must be peers or positional, got {self.ties!r}")
        if self.rows < 2 or self.min_rows < 1:
            raise ValueError("rows must be at least 2 and min_rows at least 1")

    @property
    def minutes(self) -> float:
        return self.window_us / 60_000_000


def build_features(
    df: DataFrame,
    window: str = "5 minutes",
    rows: int = 20,
    min_rows: int = 3,
    ties: str = "peers",
    entity: Sequence[str] = ("account",),
    ignore_empty_memo: bool = False,
    hot_rows: int = HOT_ROWS,
    keep: Sequence[str] = ("hash",),
    look_ahead: bool = True,
) -> DataFrame:
    """The 18 features of every transaction that has an account and a time.

    Accounts of ordinary size are grouped by one exchange, in which every window
    runs. Accounts whose windows hold many rows are grouped alike, but their
    windows are running sums instead of sliding frames (see ``linear_windows``).
    Accounts beyond ``hot_rows`` would overload the task they hash to; they are
    computed by plans that cut through the account (see ``hot_features``). All
    plans give the same values; with neither kind the plan is the single exchange.

    ``ties`` decides whether rows with an equal time see each other (``peers``)
    or only the ones before them in ledger order (``positional``). ``entity``
    ``('account', 'currency')`` keeps the currencies of an account apart. An amount is
    ranked in its account's whole history; without ``look_ahead`` among the rows so far,
    itself included (see ``asof_rank``), as a live scorer would see it.
    """
    opts = FeatureOptions(
        duration_us(window), rows, min_rows, ties, tuple(entity), ignore_empty_memo
    )
    rows = unify_schema(df).dropna(subset=["account", "close_time"])
    special, plans, total = _plans(rows, opts, hot_rows)
    if not plans:
        base = _ranked_so_far(prepare(df, opts), opts, look_ahead, hot_rows)
        return project(grouped_features(base, opts, total), keep)
    from riskweave.operators.hot_features import split_features

    if sum(plans.values()) <= BROADCAST_ACCOUNTS:
        special = F.broadcast(special)
    marked = rows.join(special, list(opts.entity), "left")

    def part(condition: Column, features) -> DataFrame:
        base = prepare(marked.filter(condition).drop("_plan"), opts)
        base = _ranked_so_far(base, opts, look_ahead, hot_rows)
        return features(base, opts).select(*_staged(base))

    out = part(F.col("_plan").isNull(), lambda base, o: grouped_features(base, o, total))
    if LINEAR in plans:
        linear = part(F.col("_plan") == LINEAR, lambda base, o: grouped_features(base, o, total, linear=True))
        out = out.unionByName(linear)
    if SPLIT in plans:
        out = out.unionByName(part(F.col("_plan") == SPLIT, split_features))
    return project(out, keep)


LINEAR, SPLIT = "linear", "split"


def _ranked_so_far(base: DataFrame, opts: FeatureOptions, look_ahead: bool, hot_rows: int) -> DataFrame:
    """``base``, with the rank of each amount so far unless the whole history counts."""
    if look_ahead:
        return base
    from riskweave.operators.asof_rank import amounts_so_far

    return amounts_so_far(base, opts.entity, ROW_ORDER, hot_rows)


def special_entities(
    rows: DataFrame, opts: FeatureOptions, hot_rows: int
) -> tuple[DataFrame | None, dict[str, int]]:
    """Entities with another plan than the sliding frames, and how many have which.

    A table of the entities is written, as it is read for every plan. How many rows a
    window holds is counted only where there are entities of more than SMALL_ROWS rows.
    """
    return _plans(rows, opts, hot_rows)[:2]


def _plans(
    rows: DataFrame, opts: FeatureOptions, hot_rows: int
) -> tuple[DataFrame | None, dict[str, int], int]:
    """``special_entities``, and the number of rows."""
    keys = list(opts.entity)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.agg(
        F.sum("_n").alias("rows"),
        F.count_if(F.col("_n") > hot_rows).alias("hot"),
        F.count_if(F.col("_n") > SMALL_ROWS).alias("large"),
    ).first()
    if not found["large"] and not found["hot"]:
        return None, {}, found["rows"] or 0
    special = counts.filter(F.col("_n") > hot_rows).select(*keys, F.lit(SPLIT).alias("_plan"))
    if found["large"]:
        large = counts.filter((F.col("_n") > SMALL_ROWS) & (F.col("_n") <= hot_rows)).select(*keys)
        if found["large"] <= BROADCAST_ACCOUNTS:
            large = F.broadcast(large)
        block = F.floor(F.unix_micros("close_time") / opts.window_us)
        cells = rows.join(large, keys, "left_semi").groupBy(*keys, block.alias("_b")).count()
        # Rows of one block see each other, about; a block's square is the work of its frames.
        work = cells.groupBy(*keys).agg(
            F.sum(F.col("count").cast("double") * F.col("count")).alias("_work"),
            F.sum("count").alias("_n"),
        )
        dense = work.filter(F.col("_work") > DENSE_ROWS * F.col("_n"))
        special = special.unionByName(dense.select(*keys, F.lit(LINEAR).alias("_plan")))
    special = written_table(special, "plans")
    plans = {r["_plan"]: r["count"] for r in special.groupBy("_plan").count().collect()}
    return special, plans, found["rows"]


def prepare(df: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Unified rows that have an account and a time, with everything that one row alone decides.

    The memo text itself goes no further than this: windows compare a key that
    is never longer than a digest.
    """
    rows = unify_schema(df).dropna(subset=["account", "close_time"])
    memo, amount = F.col("memo_text"), F.col("amount_value")
    # A digest key has 65 characters, so it never equals a short memo kept as is.
    memo_key = F.when(F.char_length(memo) <= 64, memo).otherwise(
        F.concat(F.lit("#"), F.sha2(memo, 256))
    )
    kind = F.col("transaction_type")
    return rows.select(
        "account",
        *[c for c in opts.entity if c != "account"],
        "ledger_index",
        "close_time",
        "hash",
        *(["label"] if "label" in rows.columns else []),
        F.unix_micros("close_time").alias("_us"),
        "amount_value",
        "destination",
        memo_key.alias("_memo"),
        (kind == OFFER_CANCEL).cast("int").alias("_cancel"),
        kind.isin(OFFER_CREATE, OFFER_CANCEL).cast("int").alias("_offer"),
        (~F.col("success")).cast("int").alias("_failed"),
        F.when(amount > 0, F.col("fee") / (amount * 1e6)).otherwise(F.lit(0.0)).alias("fee_rate"),
        shannon_entropy(memo).alias("memo_entropy"),
        F.char_length(memo).cast("double").alias("memo_length"),
        contains_url(memo).alias("contains_url"),
    )


def grouped_features(
    base: DataFrame, opts: FeatureOptions, total: int = 0, linear: bool = False
) -> DataFrame:
    """All window features with one exchange on the entity, in tasks that ``total`` rows ask for.

    ``linear`` takes the trailing-time measures from running sums, not sliding frames.
    """
    keys = list(opts.entity)
    entity = W.partitionBy(*keys)
    by_amount = entity.orderBy("amount_value")
    same_amount = W.partitionBy(*keys, "amount_value")
    same_memo = W.partitionBy(*keys, "_memo").orderBy(*ROW_ORDER)
    measures = []
    base = by_entity(base, keys, total)
    if linear:
        base = with_window_measures(base, keys, opts.window_us, opts.ties)
    else:
        trailing = entity.orderBy("_us").rangeBetween(-(opts.window_us - 1), 0)
        volume, count, dests, cancels, offers, failed = trailing_measures(trailing, opts)
        measures = [
            volume.alias("total_volume_5m"),
            count.cast("double").alias("rolling_tx_count_5m"),
            dests.alias("_dests"),
            cancels.alias("_cancels"),
            offers.alias("_offers"),
            failed.alias("_fails"),
        ]
    timed = base.select(
        "*",
        *measures,
        (
            (F.rank().over(by_amount) + (F.count(F.lit(1)).over(same_amount) - 1) / 2)
            / F.count(F.lit(1)).over(entity)
        ).alias("tx_size_percentile_local"),
        (F.row_number().over(same_memo) - 1).cast("double").alias("_memo_seen"),
    )
    ordered = entity.orderBy(*ROW_ORDER)
    return row_measures(timed, ordered, opts)


def trailing_measures(trailing, opts: FeatureOptions) -> list[Column]:
    """Sums, counts and distinct destinations of the trailing time window."""
    inputs = [
        F.sum("amount_value"),
        F.count("hash"),
        F.sum("_cancel"),
        F.sum("_offer"),
        F.sum("_failed"),
    ]
    if opts.ties == "peers":
        volume, count, cancels, offers, failed = [a.over(trailing) for a in inputs]
        dests = F.size(F.collect_set("destination").over(trailing))
        return [volume, count, dests, cancels, offers, failed]
    # Positional: what lies strictly earlier, plus the equal-time rows so far.
    keys = list(opts.entity)
    earlier = W.partitionBy(*keys).orderBy("_us").rangeBetween(-(opts.window_us - 1), -1)
    peers = (
        W.partitionBy(*keys, "_us")
        .orderBy("ledger_index", "hash")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    volume, count, cancels, offers, failed = [
        F.coalesce(a.over(earlier), F.lit(0)) + a.over(peers) for a in inputs
    ]
    dests = F.size(
        F.array_union(
            F.collect_set("destination").over(earlier), F.collect_set("destination").over(peers)
        )
    )
    return [volume, count, dests, cancels, offers, failed]


def row_measures(timed: DataFrame, ordered, opts: FeatureOptions) -> DataFrame:
    """Features over the trailing rows of an entity, given the trailing-time ones."""
    last = ordered.rowsBetween(-(opts.rows - 1), 0)
    rate = F.col("rolling_tx_count_5m") / opts.minutes
    staged = timed.select(
        "*",
        rate.alias("tx_per_minute"),
        F.count(F.lit(1)).over(last).alias("_n"),
        F.avg("total_volume_5m").over(last).alias("_volume_mean"),
        F.avg(rate).over(last).alias("_rate_mean"),
        F.stddev_samp(rate).over(last).alias("_rate_std"),
        F.sort_array(F.collect_list(rate).over(last)).alias("_rates"),
        F.lag("ledger_index").over(ordered).alias("_previous"),
    )
    return finish(staged, opts)


def finish(staged: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Features from the measures of the trailing windows; each row by itself."""
    enough = F.col("_n") >= opts.min_rows
    median = _middle(F.col("_rates"))
    x = F.col("tx_per_minute")
    std = F.when(enough, F.coalesce("_rate_std", F.lit(1.0))).otherwise(F.lit(1.0))
    mean = F.when(enough, F.col("_rate_mean")).otherwise(F.lit(0.0))
    staged = staged.select("*", median.alias("_median")).select(
        "*",
        _middle(
            F.sort_array(F.transform("_rates", lambda v: F.abs(v - F.col("_median"))))
        ).alias("_mad"),
    )
    mad_z = (x - F.col("_median")) / (MAD_TO_SIGMA * F.col("_mad"))
    baseline = F.when(enough, F.col("_volume_mean")).otherwise(F.lit(0.0))
    gap = F.col("ledger_index") - F.col("_previous")
    seen = F.col("_memo_seen")
    if opts.ignore_empty_memo:
        seen = F.when(F.col("_memo") == "", F.lit(0.0)).otherwise(seen)
    dests = F.greatest(F.col("_dests"), F.lit(1))
    per_tx = F.greatest(F.col("rolling_tx_count_5m"), F.lit(1.0))
    working = {"_n", "_volume_mean", "_rate_mean", "_rate_std", "_rates", "_previous"}
    return staged.select(
        *[c for c in staged.columns if c not in working | {"_median", "_mad"}],
        (F.col("tx_size_percentile_local") >= LARGE_TX_PERCENTILE).cast("int").alias("is_large_tx"),
        safe_div(F.col("total_volume_5m"), baseline).alias("volume_spike_ratio"),
        F.when(F.abs(std) < 1e-12, F.lit(0.0)).otherwise((x - mean) / std).alias("tx_rate_z_score"),
        F.when(enough & (F.col("_mad") > 1e-12), clip(mad_z, -Z_CLIP, Z_CLIP))
        .otherwise(F.lit(0.0))
        .alias("tx_rate_mad_z"),
        seen.alias("duplicate_memo_count"),
        (F.lit(1.0) / dests).alias("dest_concentration"),
        (dests / per_tx).alias("unique_dest_ratio"),
        (F.col("_cancels") / F.greatest(F.col("_offers"), F.lit(1))).alias("offer_cancel_ratio"),
        (F.col("_fails") / per_tx).alias("failed_tx_ratio"),
        F.least(F.coalesce(gap, F.lit(0)), F.lit(DORMANCY_CAP)).cast("double").alias("dormancy_gap"),
    )


def _middle(sorted_values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(sorted_values)
    low = F.floor((n - 1) / 2).cast("int")
    high = F.floor(n / 2).cast("int")
    return (F.get(sorted_values, low) + F.get(sorted_values, high)) / 2


def _staged(base: DataFrame) -> list[str]:
    carried = [c for c in base.columns if c not in ("_us", "_memo", "_cancel", "_offer", "_failed")]
    return list(dict.fromkeys(carried + FEATURE_COLUMNS))


def project(df: DataFrame, keep: Sequence[str] = ("hash",)) -> DataFrame:
    """Keys, the 18 features without NaN, infinity or NULL, and the label if any."""
    if "_asof" in df.columns:
        large = (F.col("_asof") >= LARGE_TX_PERCENTILE).cast("int")
        df = df.withColumns({"tx_size_percentile_local": F.col("_asof"), "is_large_tx": large})
    features = [
        F.col(c).cast("int").alias(c) if c in INT_FEATURES else finite_or_zero(F.col(c)).alias(c)
        for c in FEATURE_COLUMNS
    ]
    label = [F.coalesce("label", F.lit(0)).alias("label")] if "label" in df.columns else []
    filled = {"ledger_index": F.coalesce("ledger_index", F.lit(0)).alias("ledger_index")}
    keys = list(dict.fromkeys([*keep, "account", "ledger_index", "close_time"]))
    return df.select(*[filled.get(c, c) for c in keys], *features, *label)


def feature_quality(df: DataFrame) -> DataFrame:
    """One row: how many feature values are NaN or NULL, and how many infinite."""
    cols = [c for c in FEATURE_COLUMNS if c in df.columns]
    nan, inf = F.lit(0), F.lit(0)
    for c in cols:
        d = F.col(c).cast("double")
        nan = nan + F.coalesce((d.isNull() | F.isnan(d)).cast("int"), F.lit(0))
        inf = inf + F.coalesce((F.abs(d) == float("inf")).cast("int"), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("feature_rows"),
        F.coalesce(F.sum(nan), F.lit(0)).alias("nan_count"),
        F.coalesce(F.sum(inf), F.lit(0)).alias("inf_count"),
    )


#: Ledgers per slice of the trailing-ledger counts.
LEDGER_SLICE = 4096


def ledger_activity(df: DataFrame, spans: Sequence[int] = (5, 20)) -> DataFrame:
    """Transactions of each account in its trailing ledgers, per (account, ledger).

    Counted per ledger first, so a busy ledger costs one row. A long-lived
    account is cut into slices of ledgers, each with a copy of the few ledgers
    before it: no group exceeds one slice.
    """
    rows = unify_schema(df).dropna(subset=["account", "close_time"])
    cells = rows.groupBy("account", "ledger_index").agg(F.count(F.lit(1)).alias("_n"))
    slice_ = F.floor(F.col("ledger_index") / LEDGER_SLICE)
    reach = max(spans) - 1
    late = F.pmod(F.col("ledger_index"), F.lit(LEDGER_SLICE)) >= LEDGER_SLICE - reach
    copies = F.when(late, F.array(slice_, slice_ + 1)).otherwise(F.array(slice_))
    by = W.partitionBy("account", "_slice").orderBy("ledger_index")
    return (
        cells.withColumn("_slice", F.explode(copies))
        .select(
            "account",
            "ledger_index",
            "_slice",
            *[
                F.sum("_n").over(by.rangeBetween(-(s - 1), 0)).alias(f"tx_count_last_{s}_ledgers")
                for s in spans
            ],
        )
        .filter(F.col("_slice") == slice_)
        .drop("_slice")
    )
