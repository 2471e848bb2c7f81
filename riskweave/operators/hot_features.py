"""The window features of accounts too large for one task.

Every step cuts *through* the account, never around it, and gives the values
the single-exchange plan would:

* trailing-time sums: rows are first added up per (account, time); a window of
  length L = K * b is the cells of its own time block up to now, plus the K - 1
  whole blocks before, plus the late end of the block L ago. Only additions, so
  no precision is lost, and each group is one block of length b;
* trailing distinct destinations: a destination counts from one use until its
  next use or its expiry, so the number in the window is a running sum of +1/-1
  marks, taken per block with a carry;
* ranks and repeat counts: running sums over balanced blocks of a written,
  range-partitioned table;
* trailing rows: balanced chunks of the row order, each with a copy of the few
  rows before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.operators.features import ROW_ORDER, FeatureOptions, row_measures
from riskweave.operators.ordering import by_entity, ordered_blocks, row_index, running_totals
from riskweave.session import written_table

#: Rows per chunk of the trailing-row windows.
CHUNK_ROWS = 65_536
#: Most time blocks per window.
BLOCKS = 64

_SUMS = {
    "_vol": "amount_value",
    "_cnt": "_present",
    "_can": "_cancel",
    "_off": "_offer",
    "_fal": "_failed",
}


def split_features(hot: DataFrame, opts: FeatureOptions, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Window features of ``hot`` (output of ``prepare``), whatever the skew."""
    keys = list(opts.entity)
    present = F.col("hash").isNotNull().cast("int")
    # Copies of a transaction agree in every order column; the written number tells them apart.
    numbered = hot.withColumn("_present", present).withColumn("_copy", F.monotonically_increasing_id())
    rows = written_table(numbered, "hot")
    total = rows.count()
    cells = trailing_sums(rows, opts).join(trailing_distinct(rows, opts), [*keys, "_us"])
    ranked = rows.join(amount_percentile(rows, keys, total), [*keys, "amount_value"])
    timed = ranked.join(cells, [*keys, "_us"])
    if opts.ties == "positional":
        timed = _positional(timed, rows, opts, total)
    blocks = ordered_blocks(timed, [*keys, *ROW_ORDER, "_copy"], "ledger-order", total)
    seen = running_totals(blocks, [*keys, "_memo"], {"_seen": F.lit(1)}, keys_lead_order=False, rows=total)
    named = row_index(seen).select(
        *[c for c in hot.columns],
        "_row",
        F.col("_vol").alias("total_volume_5m"),
        F.col("_cnt").cast("double").alias("rolling_tx_count_5m"),
        F.col("_dst").alias("_dests"),
        F.col("_can").alias("_cancels"),
        F.col("_off").alias("_offers"),
        F.col("_fal").alias("_fails"),
        "tx_size_percentile_local",
        (F.col("_seen") - 1).cast("double").alias("_memo_seen"),
    )
    # A chunk also gets the last rows of the chunk before it.
    size = max(chunk_rows, opts.rows)
    chunk = F.floor(F.col("_row") / size)
    late = F.pmod(F.col("_row"), F.lit(size)) >= size - (opts.rows - 1)
    copies = F.when(late, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    chunked = by_entity(named.withColumn("_chunk", F.explode(copies)), ["_chunk", *keys], total)
    ordered = W.partitionBy("_chunk", *keys).orderBy("_row")
    return row_measures(chunked, ordered, opts).filter(F.col("_chunk") == chunk)


def _block_length(window_us: int) -> tuple[int, int]:
    """Block length and count so that the blocks divide the window exactly."""
    count = next(k for k in range(BLOCKS, 0, -1) if window_us % k == 0)
    return window_us // count, count


def trailing_sums(rows: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Per (entity, time): window sums with (``_vol``...) and without
    (``_vol_before``...) the rows at that very time."""
    keys = list(opts.entity)
    length, count = _block_length(opts.window_us)
    block = F.floor(F.col("_us") / length)
    cells = (
        rows.groupBy(*keys, "_us")
        .agg(*[F.sum(src).alias(name) for name, src in _SUMS.items()])
        .withColumn("_b", block)
    )
    names, types = list(_SUMS), dict(cells.dtypes)
    # A cell enters at its own time and leaves one window length later: there it is old.
    enters = F.struct(
        F.col("_b").alias("_b"),
        F.col("_us").alias("_us"),
        F.lit(1).alias("_now"),
        *[F.col(n) for n in names],
        *[F.lit(0).cast(types[n]).alias(f"_old{n}") for n in names],
    )
    leaves = F.struct(
        (F.col("_b") + count).alias("_b"),
        (F.col("_us") + opts.window_us).alias("_us"),
        F.lit(0).alias("_now"),
        *[F.lit(0).cast(types[n]).alias(n) for n in names],
        *[F.col(n).alias(f"_old{n}") for n in names],
    )
    marks = cells.select(*keys, F.explode(F.array(enters, leaves)).alias("_m")).select(*keys, "_m.*")
    in_block = W.partitionBy(*keys, "_b")
    head = in_block.orderBy("_us", F.desc("_now")).rowsBetween(W.unboundedPreceding, -1)
    # Later first; at the same time the reader comes before the leaver.
    tail = in_block.orderBy(F.desc("_us"), F.desc("_now")).rowsBetween(W.unboundedPreceding, 0)
    ends = (
        marks.select(
            *keys,
            "_b",
            "_us",
            "_now",
            *names,
            *[F.coalesce(F.sum(n).over(head), F.lit(0)).alias(f"_head{n}") for n in names],
            *[F.sum(f"_old{n}").over(tail).alias(f"_tail{n}") for n in names],
        )
        .filter("_now = 1")
    )
    # Whole blocks in between; an entity has at most (history / block length) blocks.
    between = W.partitionBy(*keys).orderBy("_b").rangeBetween(-(count - 1), -1)
    middle = (
        cells.groupBy(*keys, "_b")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(*keys, "_b", *[F.coalesce(F.sum(n).over(between), F.lit(0)).alias(f"_mid{n}") for n in names])
    )
    before = {n: F.col(f"_tail{n}") + F.col(f"_mid{n}") + F.col(f"_head{n}") for n in names}
    return ends.join(middle, [*keys, "_b"]).select(
        *keys,
        "_us",
        *[(before[n] + F.col(n)).alias(n) for n in names],
        *[before[n].alias(f"{n}_before") for n in names],
    )


def destination_uses(rows: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Each (entity, destination, time) with the times of its previous and next use.

    Neighbours are found inside a time block first, and across blocks from the
    first and last use in each block.
    """
    keys = [*opts.entity, "destination"]
    length, _ = _block_length(opts.window_us)
    uses = rows.select(*keys, "_us").distinct().withColumn("_b", F.floor(F.col("_us") / length))
    near = W.partitionBy(*keys, "_b").orderBy("_us")
    far = W.partitionBy(*keys).orderBy("_b")
    across = (
        uses.groupBy(*keys, "_b")
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
        .select(
            *keys,
            "_b",
            F.lead("_first").over(far).alias("_far_next"),
            F.lag("_last").over(far).alias("_far_previous"),
        )
    )
    return (
        uses.withColumn("_near_next", F.lead("_us").over(near))
        .withColumn("_near_previous", F.lag("_us").over(near))
        .join(across, [*keys, "_b"])
        .select(
            *keys,
            "_us",
            F.coalesce("_near_next", "_far_next").alias("_next"),
            F.coalesce("_near_previous", "_far_previous").alias("_previous_use"),
        )
    )


def trailing_distinct(rows: DataFrame, opts: FeatureOptions) -> DataFrame:
    """Per (entity, time): distinct destinations in the window (``_dst``) and
    those of them first seen at that time (``_fresh``)."""
    keys = list(opts.entity)
    length, _ = _block_length(opts.window_us)
    uses = destination_uses(rows, opts)
    expiry = F.col("_us") + opts.window_us
    fresh = F.coalesce(F.col("_previous_use") <= F.col("_us") - opts.window_us, F.lit(True))
    mark = lambda us, d, now, new: F.struct(
        us.alias("_us"), F.lit(d).alias("_d"), F.lit(now).alias("_now"), new.alias("_fresh")
    )
    starts = mark(F.col("_us"), 1, 1, fresh.cast("int"))
    ends = mark(F.least(expiry, F.col("_next")), -1, 0, F.lit(0))
    marks = (
        uses.select(*keys, F.explode(F.array(starts, ends)).alias("_m"))
        .select(*keys, "_m.*")
        .groupBy(*keys, "_us")
        .agg(F.sum("_d").alias("_d"), F.max("_now").alias("_now"), F.sum("_fresh").alias("_fresh"))
        .withColumn("_b", F.floor(F.col("_us") / length))
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_us").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        marks.groupBy(*keys, "_b")
        .agg(F.sum("_d").alias("_d"))
        .select(*keys, "_b", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_carry"))
    )
    return (
        marks.withColumn("_run", F.sum("_d").over(inside))
        .filter("_now = 1")
        .join(carry, [*keys, "_b"])
        .select(*keys, "_us", (F.col("_run") + F.col("_carry")).alias("_dst"), "_fresh")
    )


def amount_percentile(rows: DataFrame, keys: list[str], total: int = 0) -> DataFrame:
    """Average-tie percentile rank of each distinct amount of an entity."""
    counts = rows.groupBy(*keys, "amount_value").agg(F.count(F.lit(1)).alias("_n"))
    blocks = ordered_blocks(counts, [*keys, "amount_value"], "amounts", total)
    upto = running_totals(blocks, keys, {"_upto": F.col("_n")}, keys_lead_order=True, rows=total)
    totals = blocks.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    rank = F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2
    return upto.join(totals, keys).select(
        *keys, "amount_value", (rank / F.col("_all")).alias("tx_size_percentile_local")
    )


def _positional(timed: DataFrame, rows: DataFrame, opts: FeatureOptions, total: int) -> DataFrame:
    """Replace the equal-time part of each measure by that of the rows so far."""
    keys = list(opts.entity)
    at_time = [*keys, "_us"]
    blocks = ordered_blocks(timed, [*at_time, "ledger_index", "hash", "_copy"], "time-order", total)
    so_far = running_totals(
        blocks,
        at_time,
        {f"_peer{n}": F.col(src) for n, src in _SUMS.items()},
        keys_lead_order=True,
    )
    nth = running_totals(so_far, [*at_time, "destination"], {"_nth": F.lit(1)}, keys_lead_order=False)
    fresh = F.coalesce(F.col("_previous_use") <= F.col("_us") - opts.window_us, F.lit(True))
    uses = destination_uses(rows, opts).select(*at_time, "destination", fresh.alias("_is_fresh"))
    marked = nth.join(uses, [*at_time, "destination"])
    newly = (F.col("_is_fresh") & (F.col("_nth") == 1)).cast("int")
    counted = running_totals(marked, at_time, {"_newly": newly}, keys_lead_order=True)
    drop = ["_block", "_pos", "_nth", "_is_fresh", "_newly", *[f"_peer{n}" for n in _SUMS]]
    for n in _SUMS:
        counted = counted.withColumn(n, F.col(f"{n}_before") + F.col(f"_peer{n}"))
    return counted.withColumn("_dst", F.col("_dst") - F.col("_fresh") + F.col("_newly")).drop(*drop)
