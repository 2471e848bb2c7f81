"""Near-duplicate documents by MinHash bands, sequential Bayesian pruning and exact checks.

1. Each text becomes its set of hashed five-word shingles; equal sets are one class.
2. Signatures of class representatives are cut into bands; equal bands make a bucket.
3. Each bucket pairs its most central member with the others. A pair's signatures are
   compared batch by batch; it is dropped as soon as the posterior probability that the
   similarity reaches the threshold is below the chosen miss probability. Pairs left are
   confirmed on the full sets, and links are joined into components.
4. Buckets whose other members are still in several components are finished in blocks of
   bounded size: a task holds two blocks, compares members of different components in the
   same way, and returns links only. So no list of all pairs is made, and none is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches, slices
from riskweave.llm.components import components
from riskweave.session import written_table

SHINGLE = 5
HASHES = 128
BAND_ROWS = 4
BATCH = 16
#: Accepted probability that a pruned pair is a link after all.
MISS = 1e-6
#: Shingles in a block of a bucket that is finished in blocks.
BLOCK_SHINGLES = 400_000
#: Ids are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 500_000
CACHE_WORDS = 200_000
SHINGLES_AT_ONCE = 4096
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finaliser of a public hash function)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; fewer words are one shingle."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(words))
    s = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        s = s * _M + h[i : len(h) - k + 1 + i]
    return np.unique(mix(s + np.uint64(k)))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_260_101)
    odd = rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima per set; sets are not empty."""
    odd, add = permutations()
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    start = 0
    while start < len(sets):
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= SHINGLES_AT_ONCE):
            size += len(sets[end])
            end += 1
        if end == start + 1:
            for at in range(0, size, SHINGLES_AT_ONCE):
                part = (sets[start][at : at + SHINGLES_AT_ONCE] >> np.uint64(32)).astype(np.uint32)
                low = (part[:, None] * odd + add).min(axis=0)
                np.minimum(out[start], low, out=out[start])
        else:
            lengths = [len(s) for s in sets[start:end]]
            joined = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
            edges = np.cumsum([0, *lengths[:-1]])
            out[start:end] = np.minimum.reduceat(joined[:, None] * odd + add, edges, axis=0)
        start = end
    return out


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (a hash of the set) and signature of every row."""

    def make(arrow):
        def run(batches):
            hashes = _WordHashes()
            for b in slices(batches, 500):
                sets = [shingle_set(t, hashes) for t in b.column("_text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                signature: list[bytes | None] = [None] * len(sets)
                if full:
                    rows = signatures([sets[i] for i in full])
                    for i, row in zip(full, rows, strict=True):
                        signature[i] = row.tobytes()
                yield batch(
                    arrow,
                    {
                        "doc_id": b.column("doc_id"),
                        "text_hash": b.column("text_hash"),
                        "n_shingles": [len(s) for s in sets],
                        "node": [set_hash(s) for s in sets],
                        "signature": signature,
                    },
                )

        return run

    return map_batches(
        docs.select(
            "doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("_text")
        ),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        "text_hash long, n_shingles long, node long, signature binary",
        make,
    )


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def least_matches(similarity: float, miss: float) -> list[int]:
    """For each number of batches compared, the fewest equal hashes that keep a pair.

    With a uniform prior the similarity is Beta(m+1, n-m+1) after m equal hashes of n; its
    chance to be at least s is a sum of binomial terms.
    """
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss and m < n:
            m += 1
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        least.append(m)
    return least


def alive_after(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Indices of the rows whose signatures stay likely after every batch."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), dtype=np.int64)
    for step, need in enumerate(least):
        cols = slice(step * BATCH, (step + 1) * BATCH)
        equal[alive] += (left[alive, cols] == right[alive, cols]).sum(axis=1)
        alive = alive[equal[alive] >= need]
        if not len(alive):
            break
    return alive


def prune(pairs: DataFrame, classes: DataFrame, similarity: float, miss: float) -> DataFrame:
    """Pairs (a, b) of nodes that the sequential comparison of signatures leaves."""
    sized = classes.select("node", "n_shingles", "signature")
    rows = pairs
    for side in ("a", "b"):
        named = sized.select(
            F.col("node").alias(side),
            F.col("n_shingles").alias(f"n_{side}"),
            F.col("signature").alias(f"s_{side}"),
        )
        rows = rows.join(named, side)
    # The smaller set must be large enough for the threshold.
    small, big = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    rows = rows.filter(small >= big * F.lit(similarity)).select("a", "b", "s_a", "s_b")
    least = least_matches(similarity, miss)

    def make(arrow):
        def run(batches):
            for b in slices(batches, 5000):
                left, right = (
                    np.frombuffer(
                        b"".join(b.column(c).to_pylist()), dtype=np.uint32
                    ).reshape(-1, HASHES)
                    for c in ("s_a", "s_b")
                )
                alive = alive_after(left, right, least)
                kept = b.select(["a", "b"]).take(pa.array(alive))
                yield batch(arrow, {"a": kept.column("a"), "b": kept.column("b")})

        return run

    return map_batches(rows, "a long, b long", make)


def shingle_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles) of the given classes, from the text of one document of each."""

    def make(arrow):
        def run(batches):
            hashes = _WordHashes()
            for b in slices(batches, 200):
                sets = [shingle_set(t, hashes) for t in b.column("_text").to_pylist()]
                yield batch(
                    arrow,
                    {
                        "node": [set_hash(s) for s in sets],
                        "shingles": [s.view(np.int64) for s in sets],
                    },
                )

        return run

    ids = classes.select("doc_id").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))
    chosen = chosen.join(ids, chosen["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = map_batches(chosen.select("_text"), "node long, shingles array<long>", make)
    return sets.join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    wanted = classes.select("node", "doc_id").join(nodes, "node", "left_semi")
    return written_table(shingle_sets(docs, written_table(wanted, "wanted")), "sets")


def confirm(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity_percent: int
) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = sets_of(nodes, docs, classes)
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(
            sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side
        )
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return rows.filter(100 * common >= similarity_percent * union).select("a", "b")


def block_links(table: dict, percent: int, least: list[int]) -> list[tuple[int, int]]:
    """Links between members of different components in one pair of blocks.

    Members are compared through an inverted index of the shingles. Members of the largest
    component aren't compared with each other, and what a link has joined needs no second.
    """
    nodes, roots, shingles = table["node"], table["root"], table["shingles"]
    signature = table["signature"]
    sizes = np.array([len(s) for s in shingles], dtype=np.int64)
    names, component = np.unique(roots, return_inverse=True)
    largest = np.bincount(component).argmax()
    owner = np.repeat(np.arange(len(nodes)), sizes)
    flat = np.concatenate(shingles)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    links = []
    for x in np.flatnonzero(component != largest):
        small, big = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        others = np.flatnonzero((component != component[x]) & (100 * small >= percent * big))
        if not len(others):
            continue
        left = np.broadcast_to(signature[x], (len(others), HASHES))
        others = others[alive_after(left, signature[others], least)]
        if not len(others):
            continue
        low = np.searchsorted(flat, shingles[x], "left")
        count = np.searchsorted(flat, shingles[x], "right") - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(owner[at], minlength=len(nodes))[others]
        for y in others[100 * common >= percent * (sizes[x] + sizes[others] - common)]:
            if component[y] != component[x]:
                links.append((int(nodes[x]), int(nodes[y])))
                component[component == component[x]] = component[y]
    return links


def finish_in_blocks(
    live: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, miss: float
) -> DataFrame:
    """Links (a, b) between members (bucket, node, root) of different components."""
    sizes = live.join(classes.select("node", "n_shingles", "signature"), "node")
    blocks = sizes.groupBy("bucket").agg(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks")
    )
    sets = sets_of(live.select("node").distinct(), docs, classes)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (
        sizes.drop("n_shingles").join(blocks, "bucket").join(sets, "node")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("own", "other", "blocks")
    )
    least = least_matches(percent / 100, miss)

    def compare(group: pa.Table) -> pa.Table:
        shingles = group.column("shingles").combine_chunks()
        edges = shingles.offsets.to_numpy()
        flat = shingles.values.to_numpy()
        links = block_links(
            {
                "node": group.column("node").to_numpy(),
                "root": group.column("root").to_numpy(),
                "shingles": [flat[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)],
                "signature": np.frombuffer(
                    b"".join(group.column("signature").to_pylist()), dtype=np.uint32
                ).reshape(-1, HASHES),
            },
            percent,
            least,
        )
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, similarity_percent: int = 75, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and group of every document.

    Documents are linked when their shingle sets have a Jaccard similarity of at least
    ``similarity_percent``; a component is what links connect, named by its smallest doc_id;
    kept is doc_id = component_id. Documents without words (NULL, empty, blank) are their own
    components. Equal texts, and texts of equal sets, are one node. Repeated rows of a doc_id
    get equal results. A NULL doc_id never names a component that has another one. Where
    doc_ids are NULL or repeat with other texts, text_hash (xxhash64 of the text) tells their
    rows apart and ``group`` the components (NULL without words). An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    features = written_table(document_features(docs), "features")
    with_words = features.filter("n_shingles > 0")
    # One row per distinct set, however many copies it has.
    classes = written_table(
        with_words.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.max("signature").alias("signature"),
        ),
        "classes",
    )
    band = 4 * BAND_ROWS
    keys = F.array(
        *[
            F.xxhash64(F.lit(i), F.substring("signature", 1 + band * i, band))
            for i in range(HASHES // BAND_ROWS)
        ]
    )
    banded = classes.select(F.explode(keys).alias("bucket"), "node", "n_shingles")
    shared = (
        banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    )
    met = banded.join(shared, "bucket")
    # Who shares its bands with most others stands in the middle of its group.
    weights = met.groupBy("node").agg(F.sum("mates").alias("weight"))
    # Linked sets differ in size by a bounded ratio: a bucket is split by size, each set
    # being in its own class and the next, so that sets of like size share one.
    size = F.floor(F.log("n_shingles") / math.log(100 / similarity_percent))
    buckets = written_table(
        met.join(weights, "node").select(
            F.explode(F.transform(F.array(size, size + 1), lambda c: F.xxhash64("bucket", c))).alias("bucket"),
            "node",
            "weight",
        ),
        "buckets",
    )
    # First the most central member of each bucket meets the others ...
    centres = buckets.groupBy("bucket").agg(
        F.max(F.struct("weight", "node"))["node"].alias("centre"), F.count(F.lit(1)).alias("mates")
    )
    members = buckets.join(centres.filter("mates > 1"), "bucket").filter("node <> centre")
    pairs = members.select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    ).distinct()
    left = written_table(prune(pairs, classes, similarity_percent / 100, miss), "likely")
    links = written_table(confirm(left, docs, classes, similarity_percent), "confirmed")
    roots = written_table(components(links), "roots")
    # ... then buckets whose other members lie in several components are finished.
    rooted = members.select("bucket", "node").join(roots, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root")
    )
    # Bands often make the same group; one bucket of each is enough.
    opened = (
        rooted.groupBy("bucket")
        .agg(
            F.min("root").alias("lo"),
            F.max("root").alias("hi"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("group"),
        )
        .filter("lo <> hi")
        .groupBy("group", "n")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    live = written_table(rooted.join(opened, "bucket", "left_semi"), "members")
    if not live.isEmpty():
        more = finish_in_blocks(live, docs, classes, similarity_percent, miss)
        links = links.union(written_table(more, "confirmed"))
        roots = written_table(components(links), "roots")
    named = classes.select("node", "doc_id")
    rooted = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(names, "root")
    labelled = features.select("doc_id", "text_hash", "n_shingles", "node").join(
        named.select("node", "component_id", "root"), "node", "left"
    )
    # All sets without words have the same hash, but are linked with nothing.
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return labelled.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_hash",
        F.when(F.col("n_shingles") > 0, F.col("root")).alias("group"),
    )
