"""Near-duplicate lines by a deletion-neighbourhood join; the earliest line stays.

Lines are sequences of words, and the edit bound is one word (inserted, left out or
replaced). Two lines within it share a variant with one word left out: at the same place
of lines of equal length, or a variant of one is the other as a whole. Variants are
hashed with that place, so equal keys are within the bound and each key needs only its
earliest line, however many lines share it. Before variants are made, halves are
compared: one edit leaves the first or the last half of a line alone, so a line that
shares neither with any other has no partner and makes no variants.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches, slices
from riskweave.session import written_table

MIN_WORDS = 5
#: Line numbers are broadcast up to so many, else joined by shuffle.
BROADCAST_ROWS = 200_000
_M = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SUB, DEL, FULL = 0, 1, 2


def _half_keys(words: list[bytes]) -> list[int]:
    """Hashes of the halves that one edit may leave alone, for both lengths of the pair."""
    n = len(words)
    keys = []
    for m in (n, n - 1):
        half = m // 2
        keys.append(_digest(b"first %d " % m + b" ".join(words[:half])))
        keys.append(_digest(b"last %d " % m + b" ".join(words[n - (m - half) :])))
    return keys


_digest = xxhash.xxh3_64_intdigest


def _occurrences(docs: DataFrame) -> DataFrame:
    """_doc, _k, line_no, h1, h2 and halves of every line with MIN_WORDS words or more."""

    def make(arrow):
        def run(batches):
            for b in slices(batches, 500):
                owner, number, names, halves = [], [], [], []
                for at, text in enumerate(b.column("_text").to_pylist()):
                    for no, line in enumerate(text.split(b"\n") if text else ()):
                        words = line.split()  # at ASCII white space
                        if len(words) >= MIN_WORDS:
                            owner.append(at)
                            number.append(no)
                            name = xxhash.xxh3_128_intdigest(b" ".join(words))
                            names.append((name >> 64, name & _MASK))
                            halves += _half_keys(words)
                named = np.array(names, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                flat = pa.array(np.array(halves, dtype=np.uint64).view(np.int64))
                edges = pa.array(np.arange(0, len(halves) + 1, 4, dtype=np.int32))
                owner = pa.array(owner, pa.int64())
                yield batch(
                    arrow,
                    {
                        "_doc": b.column("_doc").take(owner),
                        "_k": b.column("_k").take(owner),
                        "line_no": number,
                        "h1": named[:, 0],
                        "h2": named[:, 1],
                        "halves": pa.ListArray.from_arrays(edges, flat),
                    },
                )

        return run

    kind = docs.schema["_doc"].dataType.simpleString()
    return map_batches(
        docs.select("_doc", "_k", F.col("text").cast("binary").alias("_text")),
        f"_doc {kind}, _k long, line_no int, h1 long, h2 long, halves array<long>",
        make,
    )


def _words_of_lines(docs: DataFrame) -> DataFrame:
    """_doc, _k, line_no and words of the lines that ``wanted`` lists for each document."""

    def make(arrow):
        def run(batches):
            for b in slices(batches, 200):
                owner, number, words = [], [], []
                wanted = b.column("wanted").to_pylist()
                for at, text in enumerate(b.column("_text").to_pylist()):
                    lines = text.split(b"\n")
                    for no in wanted[at]:
                        owner.append(at)
                        number.append(no)
                        words.append([w.decode("utf-8", "replace") for w in lines[no].split()])
                owner = pa.array(owner, pa.int64())
                yield batch(
                    arrow,
                    {
                        "_doc": b.column("_doc").take(owner),
                        "_k": b.column("_k").take(owner),
                        "line_no": number,
                        "words": words,
                    },
                )

        return run

    kind = docs.schema["_doc"].dataType.simpleString()
    return map_batches(
        docs.select("_doc", "_k", F.col("text").cast("binary").alias("_text"), "wanted"),
        f"_doc {kind}, _k long, line_no int, words array<string>",
        make,
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def variant_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes with each word left out: keyed by place, then by what is left; the whole line."""
    n = len(words)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _M)]), dtype=np.uint64)
    before = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:n], dtype=np.uint64)])
    whole = before[n:]
    place = np.arange(n, dtype=np.uint64)
    # A replaced word: the rest keeps its places. A left out word: the rest moves up.
    replaced = whole - h * power[:n] + _mixed(place * np.uint64(2) + np.uint64(1)) + np.uint64(n)
    moved = before[:n] + (whole - before[1:]) * _INVERSE
    size = _mixed(np.array([n - 1, n], dtype=np.uint64) * np.uint64(2))
    full = _mixed(before[n:] + size[1:])
    return _mixed(replaced), _mixed(moved + size[:1]), int(full[0])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word edit distance is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, w in enumerate(short) if w != long[i]), len(short))
    return short[i + (len(a) == len(b)) :] == long[i + 1 :]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _variants(lines: DataFrame) -> DataFrame:
    """key, kind, id of the variants of each (id, words)."""

    def make(arrow):
        def run(batches):
            for b in slices(batches, 2000):
                keys, kinds, owner = [], [], []
                for at, words in enumerate(b.column("words").to_pylist()):
                    sub, left, whole = variant_keys(words)
                    left = np.unique(left)
                    keys += [sub, left, np.array([whole], dtype=np.uint64)]
                    kinds += [np.full(len(sub), SUB), np.full(len(left), DEL), np.array([FULL])]
                    owner.append(np.full(len(sub) + len(left) + 1, at))
                if not owner:
                    continue
                owner = np.concatenate(owner)
                yield batch(
                    arrow,
                    {
                        "key": _signed(np.concatenate(keys)),
                        "kind": np.concatenate(kinds).astype(np.int8),
                        "id": b.column("id").take(owner),
                    },
                )

        return run

    kind = lines.schema["id"].dataType.simpleString()
    return map_batches(lines.select("id", "words"), f"key long, kind byte, id {kind}", make)


def _verified(pairs: DataFrame) -> DataFrame:
    """Ids of lines whose earlier partner is within one edit indeed."""

    def make(arrow):
        def run(batches):
            for b in slices(batches, 2000):
                good = [
                    i
                    for i, (x, y) in enumerate(
                        zip(b.column("words").to_pylist(), b.column("other").to_pylist(), strict=True)
                    )
                    if within_one(x, y)
                ]
                yield batch(arrow, {"id": b.column("id").take(good)})

        return run

    return map_batches(pairs, f"id {pairs.schema['id'].dataType.simpleString()}", make)


def line_verdicts(docs: DataFrame) -> DataFrame:
    """_doc, _k and dropped: [(line_no, is near)] of documents that lose lines.

    ``docs`` has _doc (the order of documents), _k (a hash that tells rows of one _doc
    apart) and text.
    """
    # A line is named by two 64-bit hashes; texts aren't shuffled to find equal lines.
    occurrences = written_table(_occurrences(docs), "lines")
    distinct = written_table(
        occurrences.groupBy("h1", "h2").agg(
            F.min(F.struct("_doc", "_k", "line_no")).alias("id"), F.first("halves").alias("halves")
        ),
        "distinct-lines",
    )
    halves = distinct.select(F.explode("halves").alias("half"), "h1", "h2")
    shared = (
        halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
        .filter("lo <> hi").select("half")
    )
    names = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    likely = written_table(
        distinct.select("id", "h1", "h2").join(names, ["h1", "h2"], "left_semi"), "likely-lines"
    )
    # Their words, read again from the documents in which they stand first.
    wanted = likely.groupBy(F.col("id._doc").alias("_doc2"), F.col("id._k").alias("_k2")).agg(
        F.collect_list("id.line_no").alias("wanted")
    )
    if likely.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    # Rows equal in both keys are copies of one text; one of them is enough.
    same = docs["_doc"].eqNullSafe(wanted["_doc2"]) & (docs["_k"] == wanted["_k2"])
    again = _words_of_lines(docs.join(wanted, same))
    words = written_table(
        again.select(F.struct("_doc", "_k", "line_no").alias("id"), "words").distinct(), "words"
    )
    variants = written_table(_variants(words), "variants")
    # Most variants are alone: they are counted by key before any are compared.
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = written_table(variants.join(shared, "key", "left_semi"), "met-variants")
    firsts = met.groupBy("key").agg(
        *[
            F.min(F.when(F.col("kind") == kind, F.col("id"))).alias(name)
            for kind, name in ((SUB, "sub"), (DEL, "del"), (FULL, "full"))
        ]
    )
    met = met.join(firsts, "key")
    partner = (
        F.when(F.col("kind") == SUB, F.col("sub"))
        .when(F.col("kind") == DEL, F.col("full"))
        .otherwise(F.col("del"))
    )
    pairs = (
        met.select("id", partner.alias("partner"))
        .filter("partner < id")
        .groupBy("id").agg(F.min("partner").alias("partner"))
    )
    both = pairs.join(words, "id").join(
        words.select(F.col("id").alias("partner"), F.col("words").alias("other")), "partner"
    )
    near = _verified(both.select("id", "words", "other")).withColumn("near", F.lit(True))
    verdict = distinct.join(near, "id", "left").select("h1", "h2", "id", "near")
    here = F.struct("_doc", "_k", "line_no")
    later = here != F.col("id")
    dropped = occurrences.drop("halves").join(verdict, ["h1", "h2"]).filter(later | F.col("near"))
    return dropped.groupBy("_doc", "_k").agg(
        F.collect_list(F.struct("line_no", F.coalesce(~later, F.lit(False)).alias("near"))).alias("dropped")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and line counts.

    A line of MIN_WORDS words or more goes if an earlier one (by doc_id, then place) has the
    same words, or if the first line with its words is within one word of a line that stands
    first earlier; whether that one stays itself doesn't matter. Shorter lines and line
    breaks stay. Adds n_lines, n_exact, n_near (long); a column of that name is replaced.
    NULL texts stay NULL with 0 lines, an empty text is one empty line; rows of equal
    doc_id and text get equal results, and NULL doc_ids come first. Lines are told apart by
    their bytes; invalid UTF-8 is compared as U+FFFD. Other columns are kept whatever their
    names. No row is dropped.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "text",
        F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_k"),
    )
    dropped = written_table(
        line_verdicts(keyed.select("_doc", "_k", "text")), "dropped"
    ).withColumnsRenamed({"_doc": "_doc2", "_k": "_k2"})
    same = F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_k") == F.col("_k2"))
    # Lines are a column of their own: inside a lambda the text would be split for each line.
    joined = keyed.join(dropped, same, "left").withColumn("_lines", F.split("text", "\n"))
    lines = F.col("_lines")
    gone = F.coalesce(F.col("dropped.line_no"), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    near = F.size(F.filter("dropped", lambda d: d["near"]))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped") - near).cast("long").alias("n_exact"),
        F.when(F.col("dropped").isNull(), 0).otherwise(near).cast("long").alias("n_near"),
    )
