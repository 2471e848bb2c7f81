"""Token ids of all documents in binary files of Simple-8b words.

Documents are dealt by ranges of their id to shards, sorted in each shard and encoded;
every shard is one file, written by Spark's own file writer, so a lost task is written
again and a folder holds whole files only. Files are read back by Spark as well, so
both work on any store.

A file is a row of records of little-endian 64-bit words. A record holds, in this order:
the mark ``MAGIC``, the shard's number, the number of NULL ids among its documents, and
four streams: the alphabet (different token ids, most frequent first), the token ids as
places in the alphabet, the document ids (differences, zigzag) and the token counts of
the documents that end in the record. A stream is its number of values, of blocks and of
words, the offset of each block and the words. Eight bytes end a record, the last one the
line feed that Spark's writer adds. Frequent ids get few bits by their place in the
alphabet; a document may span records, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import simple8b
from riskweave.llm.arrow import batch, map_batches
from riskweave.llm.word_ids import byte_slices, word_ids
from riskweave.session import scratch_dir, written_table

MAGIC = 0x3153444938425345
#: Token ids of a record.
RECORD_IDS = 1 << 20
#: Bytes of text of a shard, about.
SHARD_BYTES = 128 << 20
U = np.uint64
END = b"\0" * 7  # and the writer's line feed


def stream_words(values: np.ndarray) -> list[np.ndarray]:
    words, offsets = simple8b.encode(values)
    return [np.array([len(values), len(offsets), len(words)], dtype=U), offsets, words]


def zigzag(ids: np.ndarray) -> np.ndarray:
    """Differences of signed numbers as unsigned ones, small for near neighbours."""
    steps = np.diff(ids.astype(np.int64).view(U), prepend=U(0)).view(np.int64)
    return ((steps << 1) ^ (steps >> 63)).view(U)


def unzigzag(steps: np.ndarray) -> np.ndarray:
    signed = (steps >> U(1)) ^ (U(0) - (steps & U(1)))
    return np.cumsum(signed, dtype=U).view(np.int64)


def record(shard: int, ids: np.ndarray, keys: list[int | None], lengths: list[int]) -> bytes:
    """Bytes of a record: token ids, and ids and token counts of documents that end in it."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    used = np.flatnonzero(counts)
    alphabet = used[np.argsort(-counts[used], kind="stable")]
    place = np.zeros(len(counts), dtype=np.int64)
    place[alphabet] = np.arange(len(alphabet))
    named = [k for k in keys if k is not None]
    parts = [np.array([MAGIC, shard, len(keys) - len(named)], dtype=U)]
    parts += stream_words(alphabet.astype(U))
    parts += stream_words(place[ids].astype(U))
    parts += stream_words(zigzag(np.array(named, dtype=np.int64)))
    parts += stream_words(np.array(lengths, dtype=U))
    return np.concatenate(parts).astype("<u8").tobytes() + END


def records(content: bytes) -> Iterator[tuple]:
    """Shard, token ids, document ids and token counts of each record of a file."""
    at = 0
    while at < len(content):
        if len(content) - at < 24:
            raise ValueError("the file ends inside a record")
        magic, shard, nulls = np.frombuffer(content, "<u8", 3, at).tolist()
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += 24
        streams = []
        for _ in range(4):
            n, blocks, words = np.frombuffer(content, "<u8", 3, at).tolist()
            offsets = np.frombuffer(content, "<u8", blocks, at + 24)
            found = np.frombuffer(content, "<u8", words, at + 24 + 8 * blocks)
            streams.append(simple8b.decode(found, offsets, n))
            at += 24 + 8 * (blocks + words)
        at += len(END) + 1
        alphabet, places, steps, lengths = streams
        ids = alphabet.astype("<u4")[places.astype(np.int64)]
        yield shard, ids, [None] * nulls + unzigzag(steps).tolist(), lengths.tolist()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of all documents in ascending order of ``id_col`` to ``path``.

    ``tokenizer`` is the path of a tokenizer file that every executor has. A document is
    its ids and ``end_id``; NULL and empty texts are ``end_id`` alone. NULL ids come
    first; documents of one id are ordered by a hash of their text, and repeated rows are
    documents of their own. Invalid UTF-8 is read as U+FFFD. Other columns aren't read.
    An empty table gives a folder without files that hold a record.
    """
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    # A salt spreads repeated rows of one document, whose order makes no difference.
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"),
        F.xxhash64(text).alias("hash"), F.rand(7).alias("salt"),
    )
    order = [F.col("id").asc_nulls_first(), "hash", "salt"]
    dealt = dealt.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def make(arrow):
        def run(batches):
            words, shard = word_ids(tokenizer), TaskContext.get().partitionId()
            held: list[np.ndarray] = []
            keys: list = []
            lengths: list[int] = []
            waiting, last = 0, np.array([end_id], dtype=np.uint32)

            def cut():
                ids = np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
                held.clear()
                while len(ids) > RECORD_IDS:  # one text longer than a record
                    yield record(shard, ids[:RECORD_IDS], [], [])
                    ids = ids[RECORD_IDS:]
                yield record(shard, ids, keys, lengths)
                keys.clear()
                lengths.clear()

            for b in byte_slices(batches, "text"):
                ids, ends = words.encode(b.column("text"))
                begins = ends - np.diff(ends, prepend=0)
                ids = np.insert(ids, ends, last)
                begins, ends = begins + np.arange(len(ends)), ends + np.arange(len(ends)) + 1
                first = 0
                while first < len(ends):
                    free = begins[first] + RECORD_IDS - waiting
                    stop = max(int(np.searchsorted(ends, free, side="right")), first + 1)
                    part = ids[begins[first] : ends[stop - 1]]
                    held.append(part)
                    waiting += len(part)
                    keys += b.column("id").slice(first, stop - first).to_pylist()
                    lengths += (ends[first:stop] - begins[first:stop]).tolist()
                    first = stop
                    if first < len(ends) or waiting >= RECORD_IDS:
                        for r in cut():
                            yield pa.RecordBatch.from_arrays([pa.array([r])], schema=arrow)
                        waiting = 0
            if keys:
                for r in cut():
                    yield pa.RecordBatch.from_arrays([pa.array([r])], schema=arrow)

        return run

    coded = map_batches(dealt.select("id", "text"), "record binary", make)
    coded.select(F.col("record").cast("string").alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: its id, start, n_tokens, ids_crc32 and shard.

    ``start`` counts the ids of all documents before it, in files of lower shards too. The
    driver holds one number for each file. ``decoded`` gives the token ids themselves.
    """
    places = written_table(decoded(spark, path, False), "token-places")
    sizes = places.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["shard"]):  # one number for each file
        starts.append((row["shard"], total))
        total += row["n"]
    before = spark.createDataFrame(starts, "shard int, before long")
    return places.join(F.broadcast(before), "shard").select(
        F.col("id").alias(id_col),
        (F.col("before") + F.col("local")).alias("start"),
        "n_tokens",
        "ids_crc32",
        "shard",
    )


def decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """Documents of the files with their place in the file, and their ids if asked for."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    schema = "shard int, id long, local long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"

    def make(arrow):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    yield from documents(b.column("content")[i].as_buffer())

        def documents(content):
            start, crc, open_ids = 0, 0, []
            for shard, ids, keys, lengths in records(content):
                out = {n: [] for n in ("shard", "id", "local", "n_tokens", "ids_crc32")}
                texts, at, raw = [], 0, memoryview(ids.tobytes())
                for key, n in zip(keys, lengths, strict=True):
                    stop = at + n - sum(map(len, open_ids))
                    crc = zlib.crc32(raw[4 * at : 4 * stop], crc)
                    if with_ids:
                        texts.append(np.concatenate([*open_ids, ids[at:stop]]).astype(np.int32))
                    out["shard"].append(shard)
                    out["id"].append(key)
                    out["local"].append(start)
                    out["n_tokens"].append(n)
                    out["ids_crc32"].append(crc)
                    open_ids, crc, start, at = [], 0, start + n, stop
                if at < len(ids):  # the document goes on in the next record
                    crc = zlib.crc32(raw[4 * at :], crc)
                    open_ids.append(ids[at:] if with_ids else range(len(ids) - at))
                if with_ids:
                    out["ids"] = texts
                if keys:
                    yield batch(arrow, out)

        return run

    return map_batches(files, schema, make)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files, to a folder of their own unless named, and read them."""
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/riskweave/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path, **options)
    return read_token_files(spark, path, options.get("id_col", "doc_id"))
