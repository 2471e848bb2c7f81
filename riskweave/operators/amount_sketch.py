"""Per-account distributions of amounts that batches of a stream add to.

An amount falls in one of STEPS cells to each doubling, and a sketch is the number of
amounts in each cell. Adding counts is all that merging does, so a sketch is the same for
any cut of the stream into batches and any partitioning. A rank looked up from it is off
by at most half the share of amounts in the cell of the amount asked for: cells span
100 / STEPS * ln 2, some two percent, of an amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Cells to each doubling of the amount.
STEPS = 32
#: Cell of amounts that aren't above 0, below all others.
LOWEST = -(1 << 20)


def amount_cell(amount: Column) -> Column:
    """Number of an amount's cell; NULL and NaN have none."""
    d = amount.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(None).cast("int")).otherwise(
        F.when(d > 0, F.floor(F.log2(d) * STEPS).cast("int")).otherwise(F.lit(LOWEST))
    )


def sketch_amounts(df: DataFrame) -> DataFrame:
    """account, cell and n of the amounts in ``df``, combined on the map side."""
    cells = df.select("account", amount_cell(F.col("amount_value")).alias("cell"))
    return cells.dropna().groupBy("account", "cell").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("account", "cell").agg(F.sum("n").alias("n"))


def add_to_sketch(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Add every batch of a stream to the sketches stored at ``path``.

    A batch has a folder of its own and replaces it when it is run again, so each
    transaction counts once.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        sketch_amounts(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_sketch(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all batches so far, as one row per account: its cells in order."""
    cells = merge_sketches(spark.read.schema("account string, cell int, n long, batch int").parquet(path))
    return as_cells(cells)


def as_cells(cells: DataFrame) -> DataFrame:
    """One row per account; an account has at most a few hundred cells."""
    return cells.groupBy("account").agg(
        F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("_cells")
    )


def with_sketched_rank(df: DataFrame, sketch: DataFrame) -> DataFrame:
    """``df`` with tx_size_percentile_local looked up in its account's sketch.

    The rank is the middle of the amount's cell: amounts in lower cells, and half of those
    in its own. An account without a sketch has rank 1, as in a history of one.
    """
    add = lambda cells: F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    cell = amount_cell(F.col("amount_value"))
    below = add(F.filter("_cells", lambda c: c["cell"] < F.col("_cell")))
    same = add(F.filter("_cells", lambda c: c["cell"] == F.col("_cell")))
    rank = (below + (same + F.least(same, F.lit(1))) / 2) / add(F.col("_cells"))
    return (
        df.withColumn("_cell", cell)
        .join(sketch, "account", "left")
        .withColumn("tx_size_percentile_local", F.coalesce(rank, F.lit(1.0)))
        .drop("_cell", "_cells")
    )
