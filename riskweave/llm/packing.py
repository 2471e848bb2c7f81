"""Hierarchical packing of documents into sequences of several lengths.

Whole windows of the largest tier are cut off long documents. What is left of a
document goes to the smallest tier (a power of two) that holds it. Tiers are packed
from the longest to the shortest: a window takes its own tier's piece, then ever
shorter ones that fit its gap, and a last gap is filled by cutting a shorter piece.
So windows are full, and a full window of a power of two needs no padding. Windows of
one tier make step groups of an equal number of tokens.

Packing happens in the task that has read the documents, over pools of bounded size:
nothing is shuffled, and a source or a copy that holds a third of all rows changes
nothing. Sequence and step ids carry the task's number.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches
from riskweave.llm.word_ids import WordIds, byte_slices, word_ids

#: Pieces that wait in a task before a pool is packed.
POOL_PIECES = 4096
#: Bytes of text that are encoded together, but for one longer text: the arrays on the way
#: take many times as much memory.
ENCODE_BYTES = 2_000_000
#: Id bits below a task's number.
TASK_BITS = 33

PIECE = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, step_group long"
)


class Packer:
    """Packs pieces (document, start, length) of one task into windows of the tiers."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, base: int):
        self.tiers = tuple(sorted(tiers))
        self.longest = self.tiers[-1]
        self.group_tokens = group_tokens
        self.base = base
        self.next_sequence = 0
        self.next_group = 0
        self.open_groups: dict[int, list[int]] = {}  # tier -> [group, tokens still free]
        self.by_length: dict[int, deque] = {}
        self.filled = 0  # bit n: pieces of length n wait
        self.waiting = 0
        self.rows: list[tuple] = []

    def wait(self, piece: tuple) -> None:
        n = piece[2]
        queue = self.by_length.get(n)
        if queue is None:
            queue = self.by_length[n] = deque()
        queue.append(piece)
        self.filled |= 1 << n
        self.waiting += 1

    def take(self, n: int) -> tuple:
        queue = self.by_length[n]
        piece = queue.popleft()
        if not queue:
            self.filled &= ~(1 << n)
        self.waiting -= 1
        return piece

    def longest_up_to(self, n: int) -> int:
        return (self.filled & ((1 << (n + 1)) - 1)).bit_length() - 1

    def add(self, doc: int, tokens: int) -> None:
        start = 0
        while tokens - start >= self.longest:
            self.emit([(doc, start, self.longest)], self.longest)
            start += self.longest
        if start < tokens:
            self.wait((doc, start, tokens - start))

    def emit(self, pieces: list[tuple], tier: int) -> None:
        group = self.open_groups.get(tier)
        if group is None or group[1] < tier:
            group = self.open_groups[tier] = [self.next_group, self.group_tokens]
            self.next_group += 1
        group[1] -= tier
        offset = 0
        for doc, start, n in pieces:
            self.rows.append(
                (doc, start, n, self.base + self.next_sequence, offset, tier, self.base + group[0])
            )
            offset += n
        self.next_sequence += 1

    def pack(self) -> None:
        """Pack all waiting pieces; the last windows are cut to powers of two."""
        below = 0
        lows = {}
        for t in self.tiers:
            lows[t] = below
            below = t
        for tier in reversed(self.tiers):
            while (n := self.longest_up_to(tier)) > lows[tier]:
                window, gap = [self.take(n)], tier - n
                while gap and (n := self.longest_up_to(gap)) > 0:
                    window.append(self.take(n))
                    gap -= n
                if gap and self.waiting:
                    # Every piece left is longer than the gap: cut the longest of a lower
                    # tier, or of this one.
                    n = self.longest_up_to(lows[tier])
                    n = n if n > gap else self.longest_up_to(tier)
                    doc, start, n = self.take(n)
                    window.append((doc, start, gap))
                    self.wait((doc, start + gap, n - gap))
                    gap = 0
                if gap:
                    self.emit_rest(window)
                else:
                    self.emit(window, tier)

    def emit_rest(self, window: list[tuple]) -> None:
        """Cut a window that nothing is left to fill into full windows of powers of two."""
        pieces = deque(window)
        total = sum(p[2] for p in window)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            part, free = [], size
            while free:
                doc, start, n = pieces.popleft()
                cut = min(n, free)
                part.append((doc, start, cut))
                free -= cut
                if cut < n:
                    pieces.appendleft((doc, start + cut, n - cut))
            self.emit(part, size)


def encoded(words: WordIds, texts: pa.RecordBatch, end_id: int) -> Iterator[memoryview]:
    """The ids of each text and ``end_id``, as unsigned 32-bit numbers."""
    for part in byte_slices([texts], "_text", size=ENCODE_BYTES):
        found, ends = words.encode(part.column("_text"))
        raw = memoryview(np.insert(found, ends, end_id).astype("<u4").tobytes())
        ends = 4 * (ends + np.arange(1, len(ends) + 1))
        begins = np.concatenate([[0], ends[:-1]])
        for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
            yield raw[i:j]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    max_tokens: int = 2048,
    tiers: tuple[int, ...] = (256, 512, 1024, 2048),
    end_id: int = 1,
    windows_per_step: int = 16,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``max_tokens``.

    ``tokenizer`` is the path of a tokenizer file that every executor has and that drops
    white space. A document is its ids and ``end_id``; NULL and empty texts are the end id
    alone; invalid UTF-8 is read as U+FFFD. Each id lies in exactly one piece. Repeated rows and NULL ids are documents of
    their own. ``tier`` is the window length, ``step_group`` numbers groups of windows of
    one tier with ``windows_per_step * max_tokens`` tokens. A task's last windows, at most
    one per power of two for each pool, may be shorter than the shortest tier.
    """
    if max(tiers) != max_tokens or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two up to max_tokens")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {PIECE}"

    def make(arrow):
        def run(batches):
            words = word_ids(tokenizer)
            base = TaskContext.get().partitionId() << TASK_BITS
            packer = Packer(tiers, windows_per_step * max_tokens, base)
            keys: list = []
            ids: list[memoryview] = []

            def flush():
                packer.pack()
                rows, packer.rows = packer.rows, []
                doc, start, length, sequence, offset, tier, group = zip(*rows, strict=True)
                columns = {
                    id_col: pa.array([keys[d] for d in doc], type=arrow.field(id_col).type),
                    "start": start,
                    "length": length,
                    "ids_crc32": [
                        zlib.crc32(ids[d][4 * s : 4 * (s + n)]) for d, s, n, *_ in rows
                    ],
                    "doc_tokens": [len(ids[d]) // 4 for d in doc],
                    "sequence_id": sequence,
                    "offset": offset,
                    "tier": tier,
                    "step_group": group,
                }
                keys.clear()
                ids.clear()
                return batch(arrow, columns)

            held = 0
            for b in byte_slices(batches, "_text"):
                for key, doc in zip(b.column(id_col).to_pylist(), encoded(words, b, end_id), strict=True):
                    ids.append(doc)
                    keys.append(key)
                    packer.add(len(keys) - 1, len(doc) // 4)
                    held += len(doc)
                if packer.waiting >= POOL_PIECES or held >= 32_000_000:
                    held = 0
                    yield flush()
            if keys:
                yield flush()

        return run

    return map_batches(docs.select(id_col, F.col(text).alias("_text")), schema, make)
