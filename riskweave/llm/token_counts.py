"""Token counts by byte-pair merging, without making token ids.

A pre-token starts as one symbol per byte. The adjacent pair of the lowest rank is
popped from a heap, its two symbols are merged in a linked list, and the pairs with
the two neighbours are pushed. The count is the number of symbols minus the merges.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, free_name, map_batches, slices, valid_text

# The pre-token pattern of byte-level merge tables.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of text whose counts a task remembers at a time; older ones are counted anew.
CACHE_PIECES = 400_000
#: Longer pieces of text are not remembered.
CACHE_CHARS = 64
SHIFT = 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1)]
    shown += range(ord("®"), ord("ÿ") + 1)
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class MergeTable:
    """Ranks of a byte-level vocabulary file and the count of a text's tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[left] << SHIFT | vocab[right]] = (rank, vocab[left + right])
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, reverse=True))))
        self.pretokens = regex.compile(PRETOKEN).findall
        self.pieces = _Counts(self.count_piece)
        self.words = _Counts(self.count_pretoken)

    def count_pretoken(self, word: str) -> int:
        """Symbols left after all merges of one pre-token."""
        symbols = [self.first[b] for b in word.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << SHIFT | symbols[i + 1])
            if found is not None:
                heap.append((found[0], i, found[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merged = 0
        while heap:
            rank, i, made = heapq.heappop(heap)
            # A pair is stale when a neighbour's merge has changed one of its symbols.
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            if merges.get(symbols[i] << SHIFT | symbols[j], (-1,))[0] != rank:
                continue
            symbols[i] = made
            symbols[j] = -1
            merged += 1
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                found = merges.get(made << SHIFT | symbols[k])
                if found is not None:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << SHIFT | made)
                if found is not None:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return n - merged

    def count_piece(self, piece: str) -> int:
        words = self.words
        return sum(words[w] for w in self.pretokens(piece))

    def count(self, text: str | None) -> int:
        """Tokens of a text. A special string in it is one token, as the library has it."""
        if not text:
            return 0
        if self.specials and any(s in text for s in self.specials):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count_plain(p) for p in parts)
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        # A space before a non-space always starts a pre-token, so a text may be cut there.
        first, *rest = CUT.split(text)
        pieces = self.pieces
        return pieces[first] + sum(map(pieces.__getitem__, map(" ".__add__, rest)))


CUT = re.compile(r" (?=\S)")


class _Counts(dict):
    """Remembered counts, bounded in number and in length of text."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    """One table per worker process, read from the installed vocabulary file."""
    return MergeTable(path)


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text"
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit of the whole text.

    ``vocabulary`` is the path of a byte-level vocabulary file that every executor has.
    NULL and empty texts have 0 bytes and 0 tokens; invalid UTF-8 is read as U+FFFD. Rows, repeated ones too, stay one to
    one, and other columns are kept; one that has the name of a result is replaced. There
    is no shuffle: a task keeps only a bounded number of counts.
    """
    given = free_name(docs, "_text")
    results = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in results and c != text]
    fields = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema
    )
    schema = (fields + ", " if fields else "") + "n_bytes long, n_tokens long, over_limit boolean"

    def make(arrow):
        def run(batches):
            table = merge_table(vocabulary)
            for b in slices(batches, 2000):
                texts = valid_text(b.column(given)).to_pylist()
                tokens = [table.count(t) for t in texts]
                out = {c: b.column(c) for c in kept}
                out["n_bytes"] = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
                out["n_tokens"] = tokens
                out["over_limit"] = [n > limit for n in tokens]
                yield batch(arrow, out)

        return run

    return map_batches(docs.select(*kept, F.col(text).alias(given)), schema, make)
