"""Order-dependent work without a single task: blocks, running totals, selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave.session import written_table

#: Up to this many distinct values are ranked in one task.
SELECTION_LIMIT = 200_000
#: Relative rank error of the sketch that narrows a selection.
SKETCH_ACCURACY = 10_000
#: Aggregates of one plan at most, counts and sketches.
COMPILED_COUNTS, COMPILED_SKETCHES = 24, 4
#: Rows of a task that holds whole entities, about.
ENTITY_TASK_ROWS = 100_000


def by_entity(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` grouped by ``keys``, in as many tasks as its number of ``rows`` asks for.

    A session's number of shuffle partitions doesn't grow with the tables, and with them
    the memory of a task would.
    """
    tasks = -(-rows // ENTITY_TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > 1 else df.repartition(*keys)


def ordered_blocks(df: DataFrame, order: Sequence[str], label: str = "blocks", rows: int = 0) -> DataFrame:
    """Rows cut into balanced, consecutive ranges of ``order``.

    Adds ``_block`` (range number) and ``_pos`` (position inside it). ``order``
    should end in a row key: then even one account, or one value, that holds a
    third of all rows is spread over many blocks. The result is a written table,
    because range bounds are sampled and must not change between two reads. If the number
    of ``rows`` is given, there are as many blocks as it asks for.
    """
    cols = [F.col(c) for c in order]
    tasks = -(-rows // ENTITY_TASK_ROWS)
    # Without a fixed number, adaptive execution merges ranges that turn out small.
    ranged = df.repartitionByRange(tasks, *cols) if tasks > 1 else df.repartitionByRange(*cols)
    ranged = ranged.sortWithinPartitions(*cols)
    # The id is (partition << 33) + position, in the order just sorted.
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    return written_table(
        placed.withColumn("_block", F.shiftright("_id", 33).cast("int"))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id"),
        label,
    )


def row_index(blocks: DataFrame, name: str = "_row") -> DataFrame:
    """Dense 0-based position of every row of ``ordered_blocks`` output.

    The offsets table has one row per block, so it is safe to broadcast.
    """
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        blocks.join(F.broadcast(offsets), "_block")
        .withColumn(name, F.col("_offset") + F.col("_pos"))
        .drop("_offset")
    )


def running_totals(
    blocks: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    keys_lead_order: bool,
    rows: int = 0,
) -> DataFrame:
    """Inclusive running sums of each key in block order.

    Inside a block a plain running window; across blocks, the totals of the
    earlier blocks that hold the same key. When the keys lead the block order
    (``keys_lead_order``), a key that continues into a block is that block's
    first key, so at most one carry row per block exists and it is broadcast;
    otherwise the carries are joined by shuffle on (block, keys). ``rows`` is the number
    of rows, where it is known: tasks follow it.
    """
    keys = list(keys)
    placed = by_entity(blocks, ["_block", *keys], rows) if rows else blocks
    local = W.partitionBy("_block", *keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    inner = placed.select("*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        blocks.groupBy("_block", *keys)
        .agg(*[F.sum(c).alias(f"_c_{n}") for n, c in sums.items()])
        .select(
            F.col("_block").alias("_b"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            F.lag(F.lit(1)).over(W.partitionBy(*keys).orderBy("_block")).alias("_has"),
            *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        )
        .filter("_has = 1")
        .drop("_has")
    )
    if keys_lead_order:
        carry = F.broadcast(carry)
    on = [F.col("_block") == F.col("_b")]
    on += [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = inner.join(carry, on, "left")
    total = [
        (F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums
    ]
    return joined.select(*[c for c in blocks.columns], *total)


@dataclass
class _Search:
    """Ranks of one column known to lie among ``inside`` rows of an open value range."""

    column: str
    ranks: list[int]
    inside: int
    below: int = 0
    low: object = None
    high: object = None

    def rows(self) -> Column:
        c = F.col(self.column)
        cond = c.isNotNull()
        if self.low is not None:
            cond = cond & (c > F.lit(self.low))
        if self.high is not None:
            cond = cond & (c < F.lit(self.high))
        return cond


def select_ranks(
    df: DataFrame, wanted: dict[str, Sequence[int]], n: int, limit: int = SELECTION_LIMIT
) -> dict[tuple[str, int], tuple]:
    """Exact order statistics of numeric columns, all in the same few passes.

    ``wanted`` maps each column to 0-based ranks among its ``n`` non-null values
    (columns of one call share a type). Returns ``{(column, rank): (value,
    rows_below, rows_equal)}``.

    Nothing is sorted or moved as a whole: a mergeable sketch brackets each rank,
    a second aggregation counts what lies at and between the marks, and the open
    range between them, some ten-thousandth of the rows, is searched again until
    it fits one small ranking.
    """
    found: dict[tuple[str, int], tuple] = {}
    searches = []
    for column, ranks in wanted.items():
        ranks = sorted({int(r) for r in ranks})
        if ranks and not 0 <= ranks[0] <= ranks[-1] < n:
            raise ValueError(f"ranks {ranks} outside 0..{n - 1}")
        # Neighbouring ranks are searched together.
        while ranks:
            group = [ranks.pop(0)]
            while ranks and ranks[0] == group[-1] + 1:
                group.append(ranks.pop(0))
            searches.append(_Search(column, group, n))
    while any(s.inside > limit for s in searches):
        large = [s for s in searches if s.inside > limit]
        searches = [s for s in searches if s.inside <= limit] + _narrow(df, large, found)
    if searches:
        found.update(_rank_small(df, searches))
    return found


def _aggregated(df: DataFrame, aggs: list[Column], together: int) -> list:
    """Values of aggregates of one type, ``together`` at most in one plan, all in one job.

    Code of hundreds of aggregates is too long to be compiled and runs many times slower;
    each plan reads only its own columns.
    """
    if len(aggs) <= together:
        return list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
    parts = [
        df.agg(F.array(*aggs[i : i + together]).alias("found")).select(F.lit(i).alias("at"), "found")
        for i in range(0, len(aggs), together)
    ]
    rows = reduce(DataFrame.union, parts).collect()
    return [v for r in sorted(rows, key=lambda r: r["at"]) for v in r["found"]]


def _narrow(df: DataFrame, searches: list[_Search], found: dict) -> list[_Search]:
    eps = 2.0 / SKETCH_ACCURACY
    probs = [
        [
            max((s.ranks[0] - s.below) / s.inside - eps, 0.0),
            min((s.ranks[-1] - s.below) / s.inside + eps, 1.0),
        ]
        for s in searches
    ]
    # Searches over the same rows share one sketch.
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(searches):
        shared.setdefault((s.column, s.low, s.high), []).append(i)
    sketches = [
        F.percentile_approx(
            F.when(searches[ids[0]].rows(), F.col(key[0])),
            [p for i in ids for p in probs[i]],
            SKETCH_ACCURACY,
        )
        for key, ids in shared.items()
    ]
    found_marks = _aggregated(df, sketches, COMPILED_SKETCHES)
    marks: dict[int, tuple] = {}
    for j, ids in enumerate(shared.values()):
        for at, i in enumerate(ids):
            marks[i] = (found_marks[j][2 * at], found_marks[j][2 * at + 1])
    aggs = []
    for i, s in enumerate(searches):
        c, (low, high), here = F.col(s.column), marks[i], s.rows()
        aggs += [
            F.count_if(here & (c < F.lit(low))),
            F.count_if(here & (c == F.lit(low))),
            F.count_if(here & (c > F.lit(low)) & (c < F.lit(high))),
            F.count_if(here & (c == F.lit(high))),
        ]
    counts = _aggregated(df, aggs, COMPILED_COUNTS)
    row = {f"{kind}{i}": counts[4 * i + k] for i in range(len(searches)) for k, kind in enumerate("ulbh")}
    left = []
    for i, s in enumerate(searches):
        low, high = marks[i]
        edges = [s.below + row[f"u{i}"]]
        edges.append(edges[0] + row[f"l{i}"])
        edges.append(edges[1] + row[f"b{i}"])
        edges.append(edges[2] + (row[f"h{i}"] if high != low else 0))
        # Value ranges in order: below the low mark, at it, between, at the high mark, above.
        spans = {
            "under": ([], _Search(s.column, [], row[f"u{i}"], s.below, s.low, low)),
            "between": ([], _Search(s.column, [], row[f"b{i}"], edges[1], low, high)),
            "over": (
                [],
                _Search(s.column, [], s.below + s.inside - edges[3], edges[3], high, s.high),
            ),
        }
        for rank in s.ranks:
            if rank < edges[0]:
                spans["under"][0].append(rank)
            elif rank < edges[1]:
                found[(s.column, rank)] = (low, edges[0], row[f"l{i}"])
            elif rank < edges[2]:
                spans["between"][0].append(rank)
            elif rank < edges[3]:
                found[(s.column, rank)] = (high, edges[2], row[f"h{i}"])
            else:
                spans["over"][0].append(rank)
        for ranks, search in spans.values():
            if ranks:
                search.ranks = ranks
                left.append(search)
    return left


def _rank_small(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], tuple]:
    """Rank the values of searches whose rows are few; one group per search."""
    tagged = [
        F.when(s.rows(), F.struct(F.lit(i).alias("s"), F.col(s.column).alias("v")))
        for i, s in enumerate(searches)
    ]
    counts = (
        df.select(F.explode(F.array_compact(F.array(*tagged))).alias("x"))
        .groupBy("x.s", "x.v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = W.partitionBy("s").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto))
    hit = F.lit(False)
    for i, s in enumerate(searches):
        for rank in s.ranks:
            r = F.lit(rank - s.below)
            hit = hit | ((F.col("s") == i) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r))
    out = {}
    for row in ranked.filter(hit).collect():
        s = searches[row["s"]]
        first = s.below + row["upto"] - row["n"]
        for rank in s.ranks:
            if first <= rank < first + row["n"]:
                out[(s.column, rank)] = (row["v"], first, row["n"])
    return out


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    n: int | None = None,
    limit: int = SELECTION_LIMIT,
) -> dict[str, list[float]]:
    """Quantiles with linear interpolation of all columns at once.

    Few rows: the built-in exact aggregate, whose state grows with the distinct
    values. Many rows: order statistics by :func:`select_ranks`, equally exact.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    if n is None:
        n = df.count()
    if n == 0:
        return {c: [None] * len(probs) for c in columns}
    if n <= limit:
        row = df.agg(*[F.percentile(c, F.lit(probs)).alias(c) for c in columns]).first()
        return {c: list(row[c] or [None] * len(probs)) for c in columns}
    # NULLs have no rank, and columns may differ in how many they have.
    sizes = dict.fromkeys(columns, n)
    if nullable := [c for c in columns if df.schema[c].nullable]:
        sizes |= df.agg(*[F.count(c).alias(c) for c in nullable]).first().asDict()
    out: dict[str, list] = {c: [None] * len(probs) for c in columns}
    for size in sorted(set(sizes.values()) - {0}):
        same = [c for c in columns if sizes[c] == size]
        at = [divmod((size - 1) * p, 1) for p in probs]
        ranks = {int(k) for k, _ in at} | {min(int(k) + 1, size - 1) for k, _ in at}
        found = select_ranks(df, {c: ranks for c in same}, size, limit)
        for c in same:
            for i, (k, f) in enumerate(at):
                a, b = found[(c, int(k))][0], found[(c, min(int(k) + 1, size - 1))][0]
                out[c][i] = a if f == 0 or a == b else a + (b - a) * f
    return out


def cut_keys(
    df: DataFrame,
    order: Sequence[str],
    ranks: Sequence[int],
    n: int,
    limit: int = SELECTION_LIMIT,
) -> dict[int, tuple]:
    """The sort key of the row at each 0-based rank of a total order.

    Selects on the first column, then, among the ties only, on the next. The
    last column may be text and should be unique among rows that tie so far.
    """
    first, rest = order[0], list(order[1:])
    ranks = sorted({int(r) for r in ranks})
    if dict(df.dtypes)[first] == "string":
        return _cut_text(df, order, ranks, n, limit)
    found = select_ranks(df, {first: ranks}, n, limit)
    out: dict[int, tuple] = {}
    few: dict[tuple, int] = {}
    for rank in ranks:
        value, below, equal = found[(first, rank)]
        # A rank at the first of its ties is cut by the value alone.
        if not rest or rank == below:
            out[rank] = (value,)
        elif equal <= limit:
            few[(value, rank - below)] = rank
        else:
            ties = df.filter(F.col(first) == F.lit(value)).select(*rest)
            out[rank] = (value, *cut_keys(ties, rest, [rank - below], equal, limit)[rank - below])
    if few:
        # Small groups of ties are all ranked in one job.
        nth = F.row_number().over(W.partitionBy(first).orderBy(*rest)) - 1
        ties = df.filter(F.col(first).isin([v for v, _ in few])).select(*order, nth.alias("_nth"))
        hit = F.lit(False)
        for value, at in few:
            hit = hit | ((F.col(first) == F.lit(value)) & (F.col("_nth") == at))
        for r in ties.filter(hit).collect():
            out[few[(r[first], r["_nth"])]] = tuple(r[c] for c in order)
    return out


def _cut_text(
    df: DataFrame, order: Sequence[str], ranks: Sequence[int], n: int, limit: int
) -> dict[int, tuple]:
    """Ranks by text columns; copies of a key are counted, not sorted."""
    cells = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    if n <= limit:
        upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        running = cells.withColumn("_upto", F.sum("_n").over(upto))
    else:
        blocks = ordered_blocks(cells, order, "ties")
        running = running_totals(blocks, [], {"_upto": F.col("_n")}, keys_lead_order=True)
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank))
    out = {}
    for row in running.filter(hit).collect():
        for rank in ranks:
            if row["_upto"] - row["_n"] <= rank < row["_upto"]:
                out[rank] = tuple(row[c] for c in order)
    return out


def before_key(
    order: Sequence[str], key: Sequence, columns: dict[str, Column] | None = None
) -> Column:
    """True for rows that sort strictly before ``key``, which may be a leading part.

    ``columns`` gives the expression of an order column that the frame lacks.
    """
    cond = None
    for name, v in reversed(list(zip(order, key))):
        c = (columns or {}).get(name)
        c = F.col(name) if c is None else c
        cond = (c < F.lit(v)) if cond is None else (c < F.lit(v)) | ((c == F.lit(v)) & cond)
    return cond
