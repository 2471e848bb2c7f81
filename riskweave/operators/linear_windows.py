"""Trailing-time measures in linear time, for accounts whose windows hold many rows.

A sliding frame is added up anew for every row, so its cost is rows times frame. Here a
row enters the window at its own time and leaves it one window length later. Time is cut
into blocks as long as the window: a window is the head of its own block up to now and
the tail of the block before, the rows of which leave within this block, later than now.
Both are running sums, so only additions occur and no precision is lost. A destination
counts from a use until its next use or its expiry, whichever comes first: the number in
the window is a running sum of +1 and -1. All of it runs in the one exchange on the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Measures of the window and what a row adds to each.
SUMS = {
    "_vol": "amount_value",
    "_cnt": "_present",
    "_can": "_cancel",
    "_off": "_offer",
    "_fal": "_failed",
}
ENTER, LEAVE, EXPIRE = 0, 1, 2


def with_window_measures(base: DataFrame, keys: list[str], window_us: int, ties: str) -> DataFrame:
    """``base`` (output of ``prepare``, grouped by entity) with the measures of its trailing windows.

    Adds total_volume_5m, rolling_tx_count_5m, _dests, _cancels, _offers and _fails, equal
    to those of a sliding frame with the same ``ties``.
    """
    of_destination = W.partitionBy(*keys, "destination").orderBy("_us", "ledger_index", "hash")
    previous = F.lag("_us").over(of_destination)
    used = base.select(
        "*",
        F.col("hash").isNotNull().cast("int").alias("_present"),
        F.lead("_us").over(of_destination).alias("_next_use"),
        # The first use in the window of a destination, rows of one time in ledger order.
        F.coalesce(previous <= F.col("_us") - window_us, F.lit(True)).cast("int").alias("_new"),
    )
    if ties == "positional":
        peers = W.partitionBy(*keys, "_us").orderBy("ledger_index", "hash")
        so_far = peers.rowsBetween(W.unboundedPreceding, 0)
        used = used.select(
            "*",
            *[F.sum(src).over(so_far).alias(f"_peer{n}") for n, src in SUMS.items()],
            (
                F.sum("_new").over(so_far) - F.sum("_new").over(W.partitionBy(*keys, "_us"))
            ).alias("_later_new"),
        )
    marks = used.select(*keys, F.explode(_marks(used, window_us)).alias("_m")).select(*keys, "_m.*")
    block = W.partitionBy(*keys, "_b")
    last = 0 if ties == "peers" else -1
    head = block.orderBy("_us").rangeBetween(W.unboundedPreceding, last)
    tail = block.orderBy(F.desc("_us")).rangeBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*keys).orderBy("_us").rangeBetween(W.unboundedPreceding, 0)
    measured = marks.select(
        *keys,
        "_row",
        *[
            (
                F.coalesce(F.sum(n).over(head), F.lit(0))
                + F.coalesce(F.sum(f"_old{n}").over(tail), F.lit(0))
            ).alias(n)
            for n in SUMS
        ],
        F.sum("_d").over(upto).alias("_dst"),
        "_kind",
    ).filter(F.col("_kind") == ENTER)
    sums = {n: F.col(n) for n in SUMS}
    dests = F.col("_dst")
    if ties == "positional":
        sums = {n: F.col(n) + F.col(f"_row._peer{n}") for n in SUMS}
        dests = dests + F.col("_row._later_new")
    return measured.select(
        # The keys are the columns that the exchange went by, so that no second one follows.
        *[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in base.columns],
        sums["_vol"].alias("total_volume_5m"),
        sums["_cnt"].cast("double").alias("rolling_tx_count_5m"),
        dests.alias("_dests"),
        sums["_can"].alias("_cancels"),
        sums["_off"].alias("_offers"),
        sums["_fal"].alias("_fails"),
    )


def _marks(used: DataFrame, window_us: int) -> Column:
    """The marks of a row: it enters, leaves, and its destination expires."""
    types = dict(used.dtypes)
    row_type = f"struct<{','.join(f'`{n}`:{t}' for n, t in used.dtypes)}>"
    row = F.struct(*[F.col(c) for c in used.columns])
    block = F.floor(F.col("_us") / window_us)
    expiry = F.col("_us") + window_us

    def mark(kind: int, us: Column, at: Column, filled: str | None, d: int) -> Column:
        return F.struct(
            F.lit(kind).alias("_kind"),
            us.alias("_us"),
            at.alias("_b"),
            (row if kind == ENTER else F.lit(None).cast(row_type)).alias("_row"),
            *[
                (F.col(src) if side == filled else F.lit(None).cast(types[src])).alias(f"{side}{n}")
                for side in ("", "_old")
                for n, src in SUMS.items()
            ],
            F.lit(d).alias("_d"),
        )

    end = F.least(expiry, F.col("_next_use"))
    return F.array(
        mark(ENTER, F.col("_us"), block, "", 1),
        mark(LEAVE, expiry, block + 1, "_old", 0),
        mark(EXPIRE, end, F.floor(end / window_us), None, -1),
    )
