"""Benchmark decontamination by winnowing.

Of every ``WINDOW - K + 1`` consecutive k-gram hashes of a text the smallest is kept as a
fingerprint, so any span of WINDOW words that two texts share gives both an equal
fingerprint. Documents and items are joined on fingerprints, and each hit is extended
along its diagonal: the words on both sides are compared window by window.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.session import written_table

WINDOW = 10
K = 5
#: Fingerprints are broadcast up to so many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; NULL has none."""
    # lower() is right for ASCII texts and much faster than translate().
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
    found = F.split(F.coalesce(lowered, F.lit("")), _SPLIT)
    return F.array_remove(found, "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k-grams, by position; none if there are fewer words."""
    return F.when(
        F.size(words) >= k,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - (k - 1)),
            lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, span: int) -> Column:
    """The smallest of every ``span`` consecutive hashes, once each."""
    return F.when(
        F.size(grams) >= span,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(grams) - (span - 1)),
                lambda i: F.array_min(F.slice(grams, i, span)),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, row_hash: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    A window is WINDOW consecutive words of an item; an item of fewer words is one window.
    A document word inside an occurrence of a window is hit. NULL or empty texts have no
    words; items without words have no windows. Repeated documents get equal results, and
    repeated item_ids count once. On request ``row_hash``, xxhash64(doc_id, text), tells
    rows of one doc_id apart. An empty table gives no rows. An item_id of NULL hits words but
    isn't counted. Items
    shorter than WINDOW are matched by hashes of their whole length, one length at a time
    (at most WINDOW - 1 lengths).
    """
    items = written_table(
        benchmark.select("item_id", words_of(F.col("text")).alias("item")).filter("size(item) > 0"),
        "items",
    )
    lengths = [
        r["n"]
        for r in items.select(F.least(F.size("item"), F.lit(WINDOW)).alias("n")).distinct().collect()
    ]
    # The gram size that finds items of each length, and how many grams a fingerprint spans.
    kinds = {n: (K, WINDOW - K + 1) if n == WINDOW else (n, 1) for n in lengths}
    sizes = sorted({k for k, _ in kinds.values()})
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_k"))
    # Grams are a column of their own: inside a lambda they would be made again for each word.
    words = docs.withColumn("words", words_of(F.col("text")))
    for k in sizes:
        words = words.withColumn(f"_grams{k}", _grams(F.col("words"), k))
    prints = F.array().cast("array<bigint>")
    for k, span in kinds.values():
        prints = F.array_union(prints, _winnowed(F.col(f"_grams{k}"), span))
    base = written_table(
        words.select("doc_id", "_k", F.size("words").cast("long").alias("n_words"), prints.alias("prints")),
        "prints",
    )
    known = written_table(_item_grams(items, kinds), "grams")
    chosen = known.filter("chosen").select("h").distinct()
    if known.count() <= BROADCAST_ROWS:
        known, chosen = F.broadcast(known), F.broadcast(chosen)
    candidates = written_table(
        base.select("doc_id", "_k", F.explode("prints").alias("h"))
        .join(chosen, "h", "left_semi")
        .select("doc_id", "_k")
        .distinct(),
        "candidates",
    )
    if candidates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    suspects = written_table(_semi(docs, candidates).distinct(), "suspects")
    suspect_words = suspects.select("doc_id", "_k", words_of(F.col("text")).alias("words"))
    # A diagonal is the document's position less the item's, from equal grams.
    places = None
    for k in sizes:
        grams = suspect_words.select(
            "doc_id", "_k", F.posexplode(_grams(F.col("words"), k)).alias("p", "h")
        )
        places = grams if places is None else places.union(grams)
    if places is None:
        done = _result(base, None)
        return done if row_hash else done.drop("row_hash")
    diagonals = (
        places.join(known.filter("chosen"), "h")
        .select("doc_id", "_k", "item_id", "item", (F.col("p") - F.col("q")).alias("d"))
        .groupBy("doc_id", "_k")
        .agg(F.collect_set(F.struct("item_id", "item", "d")).alias("matches"))
    )
    found = _both(suspect_words, diagonals, "inner")
    done = _result(base, found.select("doc_id", "_k", _spans().alias("spans")))
    return done if row_hash else done.drop("row_hash")


def _item_grams(items: DataFrame, kinds: dict[int, tuple[int, int]]) -> DataFrame:
    """h, item_id, item, q: the grams of items by position; ``chosen`` marks fingerprints."""
    rows = None
    for n, (k, span) in kinds.items():
        own = items.filter(F.size("item") >= WINDOW if n == WINDOW else F.size("item") == n)
        part = own.withColumn("grams", _grams(F.col("item"), k)).withColumn(
            "prints", _winnowed(F.col("grams"), span)
        )
        part = part.select("item_id", "item", "prints", F.posexplode("grams").alias("q", "h"))
        part = part.select("item_id", "item", "q", "h", F.array_contains("prints", F.col("h")).alias("chosen"))
        rows = part if rows is None else rows.union(part)
    if rows is None:
        return items.select(
            "item_id", "item", F.lit(0).alias("q"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("chosen")
        ).limit(0)
    return rows


def _semi(left: DataFrame, keys: DataFrame) -> DataFrame:
    same = left["doc_id"].eqNullSafe(keys["doc_id"]) & (left["_k"] == keys["_k"])
    return left.join(keys, same, "left_semi")


def _both(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the key of a document; a NULL doc_id is a key like others."""
    right = right.withColumnsRenamed({"doc_id": "_doc", "_k": "_key"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key"))
    return left.join(right, same, how).drop("_doc", "_key")


def _spans() -> Column:
    """Windows (item_id, at, n) of items that occur in the words, along the diagonals."""

    def along(m):
        n = F.least(F.size(m["item"]), F.lit(WINDOW))
        starts = F.sequence(F.lit(0), F.size(m["item"]) - n)
        occurs = F.filter(
            starts,
            lambda j: (j + m["d"] >= 0)
            & (F.slice("words", F.greatest(j + m["d"], F.lit(0)) + 1, n) == F.slice(m["item"], j + 1, n)),
        )
        return F.transform(
            occurs,
            lambda j: F.struct(m["item_id"].alias("item_id"), (j + m["d"]).alias("at"), n.alias("n")),
        )

    return F.flatten(F.transform("matches", along))


def _result(base: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        marked = base.select(
            "doc_id", "_k", "n_words", F.lit(0).alias("hit"), F.array().cast("array<string>").alias("names")
        )
    else:
        hit = F.size(
            F.array_distinct(
                F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
            )
        )
        names = F.array_compact(F.transform("spans", lambda s: s["item_id"].cast("string")))
        hits = found.select(
            "doc_id", "_k", hit.alias("hit"), F.array_sort(F.array_distinct(names)).alias("names")
        )
        marked = _both(base.select("doc_id", "_k", "n_words"), hits, "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return marked.select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        F.col("_k").alias("row_hash"),
    )
