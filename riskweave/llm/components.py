"""Connected components of a table of links, as a few joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import written_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours move to the smallest neighbour of a node.

    The large step moves the larger neighbours of each node, the small step the node and
    its smaller neighbours. Minima are combined on the map side, and the move is a join
    with one row per node, so a node with very many links needs no task of its own.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least.withColumn("m", F.least("a", "m")), "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (long columns a, b); root is its smallest node.

    Large and small star steps alternate until the links no longer change; then each node
    is linked with its root alone. Every step is written, so a lost executor costs one step.
    An empty table gives no rows; repeated links and links of a node with itself do no harm.
    """
    edges = written_table(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    seen = None
    while True:
        # The sum of hashes tells two sets of links apart; order doesn't matter.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = written_table(_star(_star(edges, large=True), large=False), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
