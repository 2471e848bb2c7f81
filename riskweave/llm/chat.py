"""Chat formatting of logged conversations, after collapsing cumulative snapshots.

A log often holds a conversation several times, each time a few turns longer. A rolling
hash over the turns names every prefix of a conversation; a conversation whose last hash
is a shorter prefix of another one is dropped by an anti-join, and so are copies.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import written_table


def _turn_hash(role, text):
    """A hash of one turn; lengths and NULL marks keep different turns apart."""
    known = [
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c), F.lit(":"), c))
        for c in (role, text)
    ]
    return F.sha2(F.concat(*known), 256)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies, n_snapshots, chat.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Turns of a
    conversation are ordered by turn, then role and text (NULLs first); repeated rows are
    turns too. Of conversations with equal turns the smallest conv_id stays, with n_copies
    of them; n_snapshots counts the different shorter conversations that it contains.
    Rows with a NULL conv_id form one conversation. NULL roles and texts count as such in
    the hashes and are rendered empty. An empty table gives no rows. A conversation is one
    output row, so its turns are gathered; what many conversations share (a first turn, a
    whole conversation) is combined before it is shuffled.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "_h")))
    turn = turns.select(
        "conv_id", "turn", "role", "text", _turn_hash(F.col("role"), F.col("text")).alias("_h")
    )
    grouped = turn.groupBy("conv_id").agg(ordered.alias("turns"))
    prefixes = F.aggregate(
        F.col("turns._h"),
        F.array().cast("array<string>"),
        lambda seen, h: F.concat(
            seen,
            F.array(F.sha2(F.concat(F.coalesce(F.element_at(F.when(F.size(seen) > 0, seen), -1), F.lit("")), h), 256)),
        ),
    )
    hashed = written_table(grouped.withColumn("prefixes", prefixes), "conversations")
    whole = (
        hashed.select("conv_id", F.element_at("prefixes", -1).alias("full"))
        .groupBy("full")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    shorter = hashed.select(
        F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("full")
    ).distinct()
    maximal = whole.join(shorter, "full", "left_anti")
    rendered = F.array_join(
        F.transform(
            "turns",
            lambda t: F.concat(
                F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"),
                F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"),
            ),
        ),
        "",
    )
    kept = hashed.alias("h").join(
        maximal.select(F.col("conv_id").alias("_id"), "n_copies"),
        F.col("conv_id").eqNullSafe(F.col("_id")),
    )
    kept = written_table(kept.drop("_id"), "maximal")
    # Snapshots of a kept conversation: its proper prefixes that were logged themselves.
    logged = whole.select("full", F.lit(1).alias("_one"))
    counted = (
        kept.select(
            "conv_id",
            F.explode(F.slice("prefixes", F.lit(1), F.size("prefixes") - 1)).alias("full"),
        )
        .join(logged, "full")
        .groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counted = counted.withColumnRenamed("conv_id", "_id")
    return kept.join(counted, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "n_copies",
        F.coalesce("_n", F.lit(0)).alias("n_snapshots"),
        rendered.alias("chat"),
    )

