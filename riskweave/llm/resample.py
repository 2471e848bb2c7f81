"""Importance resampling: texts like a target are drawn from raw ones by a ratio of models.

Two bag-of-n-grams models over hashed buckets are counted, one from the target texts and
one from all raw texts. A text's log weight is the sum of the log ratios of its n-grams;
adding Gumbel noise and keeping the largest keys is sampling without replacement with
probabilities in proportion to the weights.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches, slices
from riskweave.llm.toxicity import words_of
from riskweave.operators.ordering import select_ranks
from riskweave.session import written_table

BUCKETS = 10_000
CACHE_WORDS = 200_000
#: Labels are broadcast up to so many target rows, else joined by shuffle.
BROADCAST_ROWS = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def text_buckets(text: bytes | None, hashes: dict, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of a text's words and word pairs, in order, repeats included."""
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([h % np.uint64(buckets), pairs % np.uint64(buckets)]).astype(np.int64)


def fit_ratio(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket.

    ``docs`` has text and boolean ``_target``; all rows count for the raw model. A task adds
    up its own counts first, so at most ``buckets`` rows per task are shuffled and ``buckets``
    rows reach the driver. Without target texts all ratios are 0.
    """

    def make(arrow):
        def run(batches):
            hashes = _Hashes()
            target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
            for b in slices(batches, 1000):
                marks = b.column("_target").to_pylist()
                for t, marked in zip(b.column("_text").to_pylist(), marks, strict=True):
                    found = np.bincount(text_buckets(t, hashes, buckets), minlength=buckets)
                    raw += found
                    if marked:
                        target += found
            yield batch(
                arrow, {"bucket": np.arange(buckets), "target": target, "raw": raw}
            )

        return run

    counted = map_batches(
        docs.select(F.col("text").cast("binary").alias("_text"), "_target"),
        "bucket int, target long, raw long",
        make,
    )
    sums = counted.groupBy("bucket").agg(F.sum("target").alias("t"), F.sum("raw").alias("r"))
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for row in sums.collect():
        target[row["bucket"]], raw[row["bucket"]] = row["t"], row["r"]
    if target.sum() == 0:
        return np.zeros(buckets)
    p = (target + smoothing) / (target.sum() + smoothing * buckets)
    q = (raw + smoothing) / (raw.sum() + smoothing * buckets)
    return np.log(p) - np.log(q)


def resample(
    docs: DataFrame, targets: DataFrame, keep: float = 0.5, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and kept of every document.

    ``targets`` has the doc_id of target texts. Kept are the ``keep`` share of rows with the
    largest keys; rows that tie at the cut, which only repeats of a row do, all stay. The
    noise is a hash of seed, doc_id and text, so the draw doesn't depend on partitions. NULL
    and empty texts have no n-grams and weight 0. An empty table gives no rows. Counts and
    weights cover all rows and whole texts; the cut is found by selection, not by sorting.
    """
    ids = targets.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    docs = docs.select("doc_id", "text")
    marked = docs.join(ids.withColumn("_target", F.lit(True)), "doc_id", "left")
    ratio = fit_ratio(marked.withColumn("_target", F.coalesce("_target", F.lit(False))), buckets)

    def make(arrow):
        def run(batches):
            hashes = _Hashes()
            for b in slices(batches, 1000):
                found = [text_buckets(t, hashes, buckets) for t in b.column("_text").to_pylist()]
                yield batch(
                    arrow,
                    {
                        "doc_id": b.column("doc_id"),
                        "noise": b.column("noise"),
                        "n_grams": [len(f) for f in found],
                        "log_weight": [float(ratio[f].sum()) for f in found],
                    },
                )

        return run

    # 52 bits of a hash as a number strictly between 0 and 1.
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12)
    uniform = (bits.cast("double") + 0.5) / float(1 << 52)
    weighed = map_batches(
        docs.select(
            "doc_id",
            (-F.log(-F.log(uniform))).alias("noise"),
            F.col("text").cast("binary").alias("_text"),
        ),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, noise double, "
        "n_grams long, log_weight double",
        make,
    )
    scored = written_table(
        weighed.select(
            "doc_id",
            "n_grams",
            "log_weight",
            (F.col("log_weight") + F.col("noise")).alias("gumbel_key"),
        ),
        "resample",
    )
    rows = scored.count()
    if rows == 0:
        return scored.withColumn("kept", F.lit(False))
    rank = min(max(int(rows * (1 - keep)), 0), rows - 1)
    cut = select_ranks(scored, {"gumbel_key": [rank]}, rows)[("gumbel_key", rank)][0]
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(cut))
