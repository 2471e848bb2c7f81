"""Train/test splits, time folds and the feature matrix."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions import finite_or_zero
from riskweave.operators.ordering import before_key, cut_keys
from riskweave.schema import FEATURE_COLUMNS
from riskweave.session import written_table

#: Row order of a split: by ledger, then time, then hash.
SPLIT_ORDER = ["ledger_index", "_us", "hash"]
#: What a NULL is in the split order: it sorts after all values.
LAST_NUMBER, LAST_TEXT = 2**63 - 1, "\U0010ffff"


def _with_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = _sort_keys(df)
    return df.select(*[c.alias(name) for name, c in keys.items()]), list(keys)


def _sort_keys(df: DataFrame) -> dict[str, Column]:
    """Order columns without NULLs: a NULL sorts after all values."""
    keys = {}
    for name in SPLIT_ORDER:
        if name == "_us" and "close_time" in df.columns:
            keys[name] = F.coalesce(F.unix_micros("close_time"), F.lit(LAST_NUMBER))
        elif name in df.columns:
            text = df.schema[name].dataType.typeName() == "string"
            kind = "string" if text else "bigint"
            last = F.lit(LAST_TEXT if text else LAST_NUMBER)
            keys[name] = F.coalesce(F.col(name).cast(kind), last)
    return keys


def _cuts(df: DataFrame, ranks: Sequence[int], n: int) -> list[Column]:
    """For each rank, the condition 'this row comes before the row at that rank'.

    The condition is true or false for every row, also where order columns are NULL.
    """
    staged, order = _with_order(df)
    inside = [r for r in ranks if 0 < r < n]
    keys = cut_keys(staged, order, inside, n) if inside else {}
    columns = _sort_keys(df)
    out = []
    for r in ranks:
        if r <= 0 or r >= n:
            out.append(F.lit(r >= n))
        else:
            out.append(before_key(order, keys[r], columns))
    return out


def with_split(df: DataFrame, train_frac: float = 0.8, name: str = "split") -> DataFrame:
    """Tag the first ``floor(n * train_frac)`` rows in ledger order ``train``, the rest ``test``.

    The row at the cut is found by selection; tagging is then a comparison of
    each row with that one key, so no row is sorted or shuffled. NULLs sort last.
    Rows that agree in ledger, time and hash are not told apart and go to the
    test side together, so ``train`` may be short by the copies of the cut row.
    """
    n = df.count()
    (early,) = _cuts(df, [int(n * train_frac)], n)
    return df.withColumn(name, F.when(early, "train").otherwise("test"))


def temporal_split(df: DataFrame, train_frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(train, test): the past and the future of the ledger."""
    n = df.count()
    (early,) = _cuts(df, [int(n * train_frac)], n)
    return df.filter(early), df.filter(~early)


def split_profile(tagged: DataFrame, name: str = "split") -> DataFrame:
    """Rows and ledger range of each side."""
    return tagged.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ledger_index").alias("first_ledger"),
        F.max("ledger_index").alias("last_ledger"),
    )


def fold_starts(n: int, n_splits: int = 5) -> list[int]:
    """First test row of each expanding-window fold; each fold tests ``n // (k + 1)`` rows."""
    if n_splits < 2:
        raise ValueError("at least 2 splits are needed")
    if n_splits + 1 > n:
        raise ValueError(f"cannot make {n_splits} folds of {n} rows")
    size = n // (n_splits + 1)
    return [n - (n_splits - i) * size for i in range(n_splits)]


def with_segment(df: DataFrame, n_splits: int = 5, name: str = "segment") -> DataFrame:
    """Tag each row with its segment 0..k of the ledger order.

    Fold ``i`` (0-based) tests segment ``i + 1`` and trains on all earlier ones.
    """
    n = df.count()
    earlier = _cuts(df, fold_starts(n, n_splits), n)
    segment = F.lit(0)
    for cond in earlier:
        segment = segment + F.when(cond, 0).otherwise(1)
    return df.withColumn(name, segment)


def fold_profile(segmented: DataFrame, n_splits: int = 5, name: str = "segment") -> DataFrame:
    """Rows and ledger range of the train and test side of each fold."""
    per_segment = segmented.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ledger_index").alias("low"),
        F.max("ledger_index").alias("high"),
    )
    seg = F.col(name)
    uses = F.transform(
        F.sequence(F.lit(1), F.lit(n_splits)),
        lambda fold: F.struct(
            fold.alias("fold"),
            F.when(seg == fold, "test").when(seg < fold, "train").alias("side"),
        ),
    )
    return (
        per_segment.withColumn("use", F.explode(uses))
        .filter("use.side is not null")
        .groupBy("use.fold", "use.side")
        .agg(
            F.sum("n").alias("n"),
            F.min("low").alias("first_ledger"),
            F.max("high").alias("last_ledger"),
        )
    )


def present_features(df: DataFrame) -> list[str]:
    return [c for c in FEATURE_COLUMNS if c in df.columns]


def feature_vector(df: DataFrame, name: str = "features") -> DataFrame:
    """The present features as one array column, non-finite values as 0."""
    values = [finite_or_zero(F.col(c).cast("double")) for c in present_features(df)]
    return df.withColumn(name, F.array(*values))


def split_xy(df: DataFrame, keys: Sequence[str] = ("hash",)) -> tuple[DataFrame, DataFrame]:
    """(features, labels), both with the row keys so that they can be aligned."""
    if "label" not in df.columns:
        raise ValueError(
            "there is no 'label' column; use feature_vector() for unsupervised work, "
            "or add pseudo-labels from the forest's highest scores first"
        )
    have = [k for k in keys if k in df.columns]
    return (
        df.select(*have, *present_features(df)),
        df.select(*have, F.col("label").cast("int").alias("label")),
    )


def draw_number(seed: int, key: Column) -> Column:
    """A 52-bit number per row, uniform, from the seed and the row key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


#: Rows of a class, about, that are ranked to find where its test rows end.
CUT_ROWS = 4096
#: Cells of a class at most, and classes at most in a broadcast table.
MAX_CELLS = 65_536
BROADCAST_CLASSES = 100_000


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_frac: float = 0.2, seed: int = 42
) -> DataFrame:
    """Tag ``ceil(n * test_frac)`` random rows ``test``, each class in proportion.

    A row's draw depends on the seed and its key only. All classes are cut at once, any
    number and size of them: the draws of a class are counted in cells, the cell that its
    last test row lies in is found by running sums, and only that cell's rows are ranked.
    Largest remainders are rounded up, the smaller class first. With one class this is a
    plain random split.
    """
    classes = written_table(df.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("_n")), "classes")
    sizes = classes.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    if not sizes["rows"]:
        return df.withColumn("split", F.lit("train"))
    quota = written_table(class_quotas(classes, sizes["rows"], sizes["classes"], test_frac), "quotas")
    if sizes["classes"] <= BROADCAST_CLASSES:
        quota = F.broadcast(quota)
    drawn = df.select(
        F.col(label).alias("_label"),
        draw_number(seed, F.col(key)).alias("_draw"),
        F.col(key).cast("string").alias("_key"),
    )
    open_rows = drawn.join(quota, F.col("_label").eqNullSafe(F.col("_class"))).filter("_take > 0 AND _take < _n")
    count = F.least(F.ceil(F.col("_n") / CUT_ROWS), F.lit(MAX_CELLS))
    cell = F.floor(F.col("_draw") / float(1 << 52) * count)
    open_rows = open_rows.select("_class", "_take", "_draw", "_key", cell.alias("_cell"))
    cells = open_rows.groupBy("_class", "_take", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(W.partitionBy("_class").orderBy("_cell"))
    before = F.col("_upto") - F.col("_rows")
    edges = (
        cells.withColumn("_upto", upto)
        .filter((before < F.col("_take")) & (F.col("_take") <= F.col("_upto")))
        .select(
            F.col("_class").alias("_edge_class"), F.col("_cell").alias("_edge_cell"),
            (F.col("_take") - before).alias("_need"),
        )
    )
    if sizes["classes"] <= BROADCAST_CLASSES:
        edges = F.broadcast(edges)
    same = F.col("_class").eqNullSafe(F.col("_edge_class")) & (F.col("_cell") == F.col("_edge_cell"))
    nth = F.row_number().over(W.partitionBy("_class").orderBy("_draw", "_key"))
    cuts = (
        open_rows.join(edges, same)
        .withColumn("_nth", nth)
        .filter("_nth = _need")
        .select(F.col("_class").alias("_cut_class"), F.struct("_draw", "_key").alias("_cut"))
    )
    at = quota.join(cuts, F.col("_class").eqNullSafe(F.col("_cut_class")), "left")
    at = written_table(at.select("_class", "_n", "_take", "_cut"), "cuts")
    if sizes["classes"] <= BROADCAST_CLASSES:
        at = F.broadcast(at)
    draw = F.struct(draw_number(seed, F.col(key)).alias("_draw"), F.col(key).cast("string").alias("_key"))
    test = (F.col("_take") >= F.col("_n")) | ((F.col("_take") > 0) & (draw <= F.col("_cut")))
    joined = df.join(at, F.col(label).eqNullSafe(F.col("_class")))
    tagged = joined.withColumn("split", F.when(test, "test").otherwise("train"))
    return tagged.drop("_class", "_n", "_take", "_cut")


def class_quotas(classes: DataFrame, rows: int, n_classes: int, test_frac: float) -> DataFrame:
    """Test rows per class as ``_take``: proportional, largest remainders rounded up."""
    wanted = math.ceil(rows * test_frac)
    exact = F.lit(float(wanted)) * F.col("_n") / F.lit(float(rows))
    number = isinstance(classes.schema["_class"].dataType, T.NumericType)
    shares = classes.withColumns(
        {
            "_take": F.floor(exact),
            "_short": F.floor(exact) - exact,
            "_known": F.col("_class").isNotNull().cast("int"),
            "_name": F.col("_class") if number else F.col("_class").cast("string"),
        }
    )
    left = wanted - shares.agg(F.sum("_take")).first()[0]
    if left <= 0:
        more = F.lit(False)
    elif left >= n_classes:
        more = F.lit(True)
    else:
        order = ["_short", "_known", "_name"]
        filled = shares.select("_short", "_known", "_name")
        more = F.coalesce(before_key(order, cut_keys(filled, order, [left], n_classes)[left]), F.lit(False))
    return shares.withColumn("_take", F.col("_take") + more.cast("long")).select("_class", "_n", "_take")


def class_quota(counts: dict, test_frac: float) -> dict:
    """Test rows per class: proportional, largest remainders rounded up."""
    total = sum(counts.values())
    wanted = math.ceil(total * test_frac)
    exact = {c: wanted * n / total for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(
        counts, key=lambda c: (quota[c] - exact[c], c is not None, c if c is not None else 0)
    )
    for c in by_remainder[: wanted - sum(quota.values())]:
        quota[c] += 1
    return quota
