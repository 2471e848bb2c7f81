"""Ranked search the other way round: documents stream past an index of the queries.

The items' terms make an inverted index that every task holds; it is built from one block
of items at a time, so its size is bounded whatever the number of items. A first pass
reads each text once and keeps the counts of the terms that some item has; statistics and
scores come from that. While scores stream by, a task keeps the best documents of each
item in a heap, and the heaps of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches, slices, struct_of
from riskweave.llm.word_ids import byte_slices
from riskweave.session import written_table

#: Terms of a block of items, repeats counted, about.
BLOCK_TERMS = 500_000
#: Scores that a task has in memory at a time.
SCORES_AT_ONCE = 1 << 20
# Fixed values of the ranking: scale of weights, length share of 100, saturation.
SCALE, LENGTH_SHARE, SATURATION = 1000, 75, 8

# What separates terms becomes a space; A-Z become lower case.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters and bytes beyond ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split() if text else []


def weight(documents: int, holding: int) -> int:
    return math.floor(SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


class Index:
    """Terms of a block of items and, for each, the items that hold it and how often."""

    def __init__(self, texts: list[bytes | None]):
        counts = [Counter(terms(t)) for t in texts]
        self.items = len(texts)
        self.number: dict[bytes, int] = {}
        for c in counts:
            for t in c:
                self.number.setdefault(t, len(self.number))
        postings: list[list[tuple[int, int]]] = [[] for _ in self.number]
        for item, c in enumerate(counts):
            for t, times in c.items():
                postings[self.number[t]].append((item, times))
        self.sizes = np.array([len(p) for p in postings], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.item = np.array([i for p in postings for i, _ in p], dtype=np.int64)
        self.times = np.array([n for p in postings for _, n in p], dtype=np.int64)

    def matches(self, text: bytes | None) -> tuple[int, list[int], list[int]]:
        """Number of terms of a text; numbers and counts of those that some item has."""
        found = terms(text)
        counts = Counter(found)
        number = self.number
        shared = number.keys() & counts.keys()
        return len(found), [number[t] for t in shared], [counts[t] for t in shared]


class Heaps:
    """The best ``k`` documents of each item: high scores, then small ids, NULL ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # a score below this one can't enter

    def offer(self, scores: np.ndarray, keys: list[int | None]) -> None:
        """Scores of a row of items for each document."""
        rows, items = np.nonzero(scores >= self.least)
        found = scores[rows, items].tolist()
        for row, item, score in zip(rows.tolist(), items.tolist(), found, strict=True):
            key = keys[row]
            entry = (score, key is not None, -key if key is not None else 0)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def matched(docs: DataFrame, index, id_col: str, text: str) -> DataFrame:
    """For each document its length in terms, and the index's terms in it with counts."""

    def make(arrow):
        def run(batches):
            known = index.value
            for b in byte_slices(batches, "text"):
                found = [known.matches(t) for t in b.column("text").to_pylist()]
                n, numbers, counts = map(list, zip(*found, strict=True))
                yield batch(arrow, {"id": b.column("id"), "n": n, "term": numbers, "tf": counts})

        return run

    given = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text")
    )
    return map_batches(given, "id long, n long, term array<int>, tf array<long>", make)


def best_of_tasks(found: DataFrame, model, k: int) -> DataFrame:
    """The best ``k`` documents of each item among those of a task."""

    def make(arrow):
        def run(batches):
            index, weights, documents, length = model.value
            heaps = Heaps(index.items, k)
            rows = max(1, min(2000, SCORES_AT_ONCE // max(1, index.items)))
            for b in slices(batches, rows):
                heaps.offer(score_rows(b, index, weights, documents, length), b.column("id").to_pylist())
            out = [(i, -d if named else None, s) for i, h in enumerate(heaps.heaps) for s, named, d in h]
            if out:
                item, doc, score = map(list, zip(*out, strict=True))
                yield batch(arrow, {"item": item, "id": doc, "score": score})

        return run

    return map_batches(found, "item int, id long, score long", make)


def score_rows(b: pa.RecordBatch, index: Index, weights, documents: int, length: int) -> np.ndarray:
    """Scores of all items for each document of a batch, as 64-bit integers."""
    scores = np.zeros(b.num_rows * index.items, dtype=np.int64)
    # Whole numbers of any size in Python; the quotient is small again.
    share = 100 - LENGTH_SHARE
    norms = [share + LENGTH_SHARE * n * documents // length for n in b.column("n").to_pylist()]
    lists = b.column("term")
    owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
    term = lists.flatten().to_numpy().astype(np.int64)
    tf = b.column("tf").flatten().to_numpy()
    if not len(term):
        return scores.reshape(b.num_rows, index.items)
    per_term = weights[term] * ((10**9 * tf) // (1000 * tf + SATURATION * np.array(norms)[owner]))
    # Postings of the matched terms, so many of them at a time.
    ends = np.cumsum(index.sizes[term])
    first = 0
    while first < len(term):
        before = ends[first - 1] if first else 0
        stop = int(np.searchsorted(ends, before + SCORES_AT_ONCE, side="right"))
        stop = max(stop, first + 1)
        part = term[first:stop]
        sizes = index.sizes[part]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        posting = np.repeat(index.starts[part], sizes) + inner
        place = np.repeat(owner[first:stop] * index.items, sizes) + index.item[posting]
        np.add.at(scores, place, np.repeat(per_term[first:stop], sizes) * index.times[posting])
        first = stop
    return scores.reshape(b.num_rows, index.items)


def search_block(docs, items, k: int, id_col: str, text: str) -> DataFrame:
    """Best documents of each item of one block, by the item's number in the block."""
    spark = docs.sparkSession
    index = Index(items)
    shared = spark.sparkContext.broadcast(index)
    found = written_table(matched(docs, shared, id_col, text), "search-matches")
    totals = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    documents, length = totals["docs"], totals["terms"] or 1
    # At most one row for each term of the block.
    held = found.select(F.explode("term").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(index.number), dtype=np.int64)
    for r in held:
        weights[r["term"]] = weight(documents, r["count"])
    model = spark.sparkContext.broadcast((index, weights, documents, length))
    best = best_of_tasks(found, model, k)
    # Heaps are merged in two steps, so that no task meets those of all tasks.
    near = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = best.withColumn("part", F.spark_partition_id() % 64)
    some = top(some, ["item", "part"], near, k).drop("part", "rank")
    return top(some, ["item"], near, k)


def top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def blocks_of(items: DataFrame, text: str) -> int:
    size = items.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return 1 + size // (4 * BLOCK_TERMS)


def reversed_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """The ``k`` documents of the highest score for each item: item_col, rank, id_col, score.

    Every row of ``items`` is an item of its own, every row of ``docs`` a document, repeated
    ones too. NULL texts have no terms; an item without terms, or without a document of a
    score above 0, has no rows. Equal scores are ranked by ascending id, NULL ids last.
    Bytes that aren't ASCII belong to terms, valid UTF-8 or not. Other columns aren't read.
    An empty table on either side gives no rows. Items go through in blocks of about
    ``BLOCK_TERMS`` terms, each one a pass over ``docs``.
    """
    spark: SparkSession = docs.sparkSession
    blocks = blocks_of(items, text)
    given = items.select(
        F.col(item_col).alias("item_id"), F.col(text).cast("binary").alias("text"),
        F.pmod(F.xxhash64(item_col, text), F.lit(blocks)).alias("block"),
    )
    kind = given.schema["item_id"].dataType.simpleString()
    results = None
    for block in range(blocks):
        rows = given.filter(F.col("block") == block).collect()  # bounded by BLOCK_TERMS
        if not rows:
            continue
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], struct_of(f"item int, name {kind}")
        )
        found = search_block(docs, [bytes(r["text"]) if r["text"] is not None else None for r in rows], k, id_col, text)
        found = found.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"),
            F.col("id").alias(id_col), "score",
        )
        results = found if results is None else results.unionByName(found)
    if results is None:
        schema = struct_of(f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
        return spark.createDataFrame([], schema)
    return results
