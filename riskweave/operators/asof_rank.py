"""Rank of an amount among its account's amounts so far, for accounts of any size.

The number of earlier rows with a smaller or equal amount is a count of dominated points
in the plane of (place in the account, amount). Accounts of ordinary size are grouped by
one exchange, and points are counted in stretches of whole accounts. The rows of larger
accounts are cut twice: into blocks of
consecutive places, and into blocks of consecutive amounts. An earlier, smaller row is

* in the same block of places: counted inside that block;
* in an earlier block of places and the same block of amounts: counted inside the latter;
* in an earlier block of places and a lower block of amounts: whole cells of the table of
  both blocks, summed up from their counts.

So two cuts by range and one small table suffice, and an account that holds a third of
all rows is many blocks. Inside a block, points are counted by merging sorted halves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from riskweave.operators.ordering import by_entity, ordered_blocks, row_index, running_totals
from riskweave.session import written_table

#: Accounts with more rows than this are cut into blocks.
HOT_ROWS = 100_000
#: Rows of whole accounts that are counted together, about.
STRETCH_ROWS = 100_000
#: Blocks of one account at most; its table of cells is that long and wide.
MAX_BLOCKS = 4000


def dominated(values: np.ndarray) -> np.ndarray:
    """For each place, how many places before it hold a smaller value; values are distinct.

    Halves of ever longer stretches are merged: a stretch is sorted, and each member of
    its right half counts the members of the left half below it.
    """
    n = len(values)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    levels = int(n - 1).bit_length()
    size = 1 << levels
    rank = np.full(size, n, dtype=np.int64)
    rank[np.argsort(values, kind="stable")] = np.arange(n)
    rank[n:] = np.arange(n, size)
    counts = np.zeros(size, dtype=np.int64)
    for level in range(levels):
        half = 1 << level
        shape = (size >> (level + 1), 2 * half)
        order = np.argsort(rank.reshape(shape), axis=1, kind="stable")
        left = order < half
        below = np.cumsum(left, axis=1)
        found = np.zeros(shape, dtype=np.int64)
        np.put_along_axis(found, order, np.where(left, 0, below), axis=1)
        counts += found.reshape(-1)
    return counts[:n]


def _starts(groups: np.ndarray) -> np.ndarray:
    """Place where the run of equal values around each place begins."""
    begins = np.append(True, groups[1:] != groups[:-1])
    return np.maximum.accumulate(np.where(begins, np.arange(len(groups)), 0))


def amounts_so_far(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``rows`` with ``_asof``: the average-tie percentile of ``amount_value`` so far.

    Rows are placed by ``order`` within ``keys``; a row sees itself and those before it.
    Copies of a row are told apart by a number in the order they are read. NULL amounts
    come first, as equal ones. Accounts beyond ``hot_rows`` are cut into blocks.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.agg(F.sum("_n").alias("rows"), F.count_if(F.col("_n") > hot_rows).alias("hot")).first()
    total = found["rows"] or 0
    if not found["hot"]:
        return _within_accounts(rows, keys, order, total)
    special = sizes.filter(F.col("_n") > hot_rows).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_hot")
    )
    special = written_table(special, "asof-hot")
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    marked = rows.join(special, same, "left")
    ordinary = marked.filter("_hot IS NULL").select(*rows.columns)
    hot = marked.filter("_hot").select(*rows.columns)
    return _within_accounts(ordinary, keys, order, total).unionByName(_through_blocks(hot, keys, order))


def _within_accounts(rows: DataFrame, keys: list[str], order: Sequence[str], total: int) -> DataFrame:
    """Each account whole in one task; points are counted over stretches of accounts."""
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    level = F.dense_rank().over(W.partitionBy(*keys).orderBy("amount_value"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order, "_copy"))
    placed = by_entity(numbered, keys, total).withColumn("_level", level).withColumn("_nth", nth).drop("_copy")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            # Stretches end where an account begins.
            first = np.flatnonzero(b.column("_nth").to_numpy() == 1)
            if len(first) and size + first[-1] >= STRETCH_ROWS:
                yield from _with_percentiles([*held, b.slice(0, first[-1])])
                b, held, size = b.slice(first[-1]), [], 0
            held.append(b)
            size += b.num_rows
        if size:
            yield from _with_percentiles(held)

    return placed.mapInArrow(ranks, StructType([*rows.schema.fields, StructField("_asof", DoubleType())]))


def _with_percentiles(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Percentiles so far of whole accounts, one after the other in their order."""
    rows = pa.Table.from_batches(held)
    nth, level = rows["_nth"].to_numpy().astype(np.int64), rows["_level"].to_numpy()
    places = np.arange(len(nth))
    start = places - (nth - 1)
    by_amount = np.lexsort((places, level, start))
    rank = np.empty(len(nth), dtype=np.int64)
    rank[by_amount] = places
    # Earlier rows of the account that are smaller or equal: rows of earlier accounts all are.
    reached = dominated(rank) - start
    at, of = start[by_amount], level[by_amount]
    begins = np.append(True, (at[1:] != at[:-1]) | (of[1:] != of[:-1]))
    equal = np.empty(len(nth), dtype=np.int64)
    equal[by_amount] = places - np.maximum.accumulate(np.where(begins, places, 0))
    asof = (reached - equal + (equal + 2) / 2) / nth
    return rows.drop_columns(["_nth", "_level"]).append_column("_asof", pa.array(asof)).to_batches()


def _through_blocks(rows: DataFrame, keys: list[str], order: Sequence[str]) -> DataFrame:
    """Cuts through the accounts, by places and by amounts."""
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id())
    blocks = ordered_blocks(numbered, [*keys, *order, "_copy"], "asof-places")
    seen = running_totals(blocks, [*keys, "amount_value"], {"_equal": F.lit(1)}, keys_lead_order=False)
    placed = running_totals(seen, keys, {"_nth": F.lit(1)}, keys_lead_order=True)
    placed = row_index(placed, "_place").withColumnRenamed("_block", "_time_block").drop("_pos")
    cut = ordered_blocks(placed, [*keys, "amount_value", "_place"], "asof-amounts")
    # The place of a row in the order of accounts and amounts, and in that of accounts.
    cut = row_index(cut, "_by_amount").withColumnRenamed("_block", "_amount_block").drop("_pos")
    cut = cut.withColumn("_group", F.to_json(F.struct(*keys)))
    points = cut.select("_place", "_by_amount", "_time_block", "_amount_block", "_group")

    def within_time(block: pd.DataFrame) -> pd.DataFrame:
        b = block.sort_values("_place")
        before = dominated(b["_by_amount"].to_numpy()) - _starts(b["_group"].to_numpy())
        return pd.DataFrame({"_place": b["_place"], "_near": before})

    def within_amounts(block: pd.DataFrame) -> pd.DataFrame:
        b = block.sort_values("_by_amount")
        start = _starts(b["_group"].to_numpy())
        # Rows of one block of places don't count: of equal ones the later comes lower.
        value = pd.DataFrame({"g": start, "t": b["_time_block"].to_numpy(), "i": -np.arange(len(b))})
        ranks = np.empty(len(b), dtype=np.int64)
        ranks[np.lexsort((value["i"], value["t"], value["g"]))] = np.arange(len(b))
        return pd.DataFrame({"_place": b["_place"], "_level": dominated(ranks) - start})

    def whole_cells(cells: pd.DataFrame) -> pd.DataFrame:
        times, t = np.unique(cells["_time_block"], return_inverse=True)
        amounts, a = np.unique(cells["_amount_block"], return_inverse=True)
        if max(len(times), len(amounts)) > MAX_BLOCKS:
            raise ValueError(f"an account of more than {MAX_BLOCKS} blocks: use larger ones")
        table = np.zeros((len(times) + 1, len(amounts) + 1), dtype=np.int64)
        np.add.at(table, (t + 1, a + 1), cells["n"].to_numpy())
        below = table.cumsum(axis=0).cumsum(axis=1)
        return cells[["_group", "_time_block", "_amount_block"]].assign(_far=below[t, a])

    near = points.groupBy("_time_block").applyInPandas(within_time, "_place long, _near long")
    level = points.groupBy("_amount_block").applyInPandas(within_amounts, "_place long, _level long")
    cells = points.groupBy("_group", "_time_block", "_amount_block").agg(F.count(F.lit(1)).alias("n"))
    far = cells.groupBy("_group").applyInPandas(
        whole_cells, "_group string, _time_block int, _amount_block int, _far long"
    )
    counted = (
        cut.join(far, ["_group", "_time_block", "_amount_block"])
        .join(near, "_place")
        .join(level, "_place")
    )
    # Earlier rows that are smaller or equal, the equal ones among them, and the row itself.
    reached = F.col("_far") + F.col("_near") + F.col("_level")
    equal = F.col("_equal") - 1
    rank = reached - equal + (equal + 2) / 2
    return counted.select(*rows.columns, (rank / F.col("_nth")).alias("_asof"))
