"""Simple-8b: unsigned integers in 64-bit words, a selector and 60 bits of payload in each.

The upper four bits of a word select how many values of what width follow, the first
value in the lowest bits. Values of more than 60 bits are escaped: two words with the
selectors 0 and 1 hold their upper and lower halves. A stream is cut into blocks of
``BLOCK`` values that begin on a word of their own, so any block can be decoded alone,
and all blocks of a stream at once by array operations.
"""

from __future__ import annotations

import numpy as np

#: Values of a block.
BLOCK = 1024
# Fixed values of the code: values in a word and bits of each, by selector. 0 and 1 escape.
COUNTS = np.array([0, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([32, 32, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE_HIGH, ESCAPE_LOW, WIDEST = 0, 1, 15
PAYLOAD = 60
U = np.uint64
#: Bits of the values that token ids have.
SHORT = np.frexp(np.arange(1 << 17, dtype=np.float64))[1].astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; above 2**53 it may be one too many, which only costs room."""
    if len(values) and values.max() < len(SHORT):
        return SHORT[values]
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def window_maxima(bits: np.ndarray) -> dict[int, np.ndarray]:
    """By number of values: the most bits of that many values from each place on."""
    found = {1: bits}

    def join(n: int, a: int, b: int) -> None:
        # n values are a values and the b values that end where they end.
        most = found[a].copy()
        part = most[:, : most.shape[1] - (n - b)]
        np.maximum(part, found[b][:, n - b :], out=part)
        found[n] = most

    for n, a, b in (
        (2, 1, 1), (3, 2, 2), (4, 2, 2), (5, 4, 4), (6, 4, 4), (7, 4, 4), (8, 4, 4), (10, 8, 8),
        (12, 8, 8), (15, 8, 8), (20, 12, 12), (30, 15, 15), (60, 30, 30),
    ):
        join(n, a, b)
    return found


def in_blocks(values: np.ndarray) -> np.ndarray:
    """A row for each block, with zeros behind it."""
    n = len(values)
    full = n // BLOCK
    room = np.zeros((-(-n // BLOCK), BLOCK + PAYLOAD), dtype=values.dtype)
    room[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    if n % BLOCK:
        room[full, : n % BLOCK] = values[full * BLOCK :]
    return room


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the stream, and the word where each block begins."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=U)
    # Zeros behind the last value of a block fill up its last word.
    room = in_blocks(values)
    bits = in_blocks(bit_lengths(values))
    most = window_maxima(bits)
    # The selectors that fit follow one another, as what fits few bits fits more.
    selector = np.full(bits.shape, WIDEST, dtype=np.uint8)
    for s in range(WIDEST - 1, 1, -1):
        selector -= most[int(COUNTS[s])] <= WIDTHS[s]
    selector[bits > PAYLOAD] = ESCAPE_HIGH
    # All blocks step from word to word side by side.
    step = np.maximum(COUNTS, 1)
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = n - (blocks - 1) * BLOCK
    begins = np.zeros(room.shape, dtype=bool)
    lane, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    while len(lane):
        begins[lane, at] = True
        at = at + step[selector[lane, at]]
        going = at < sizes[lane]
        lane, at = lane[going], at[going]
    row, column = np.nonzero(begins)
    chosen = selector[row, column]
    escaped = chosen == ESCAPE_HIGH
    ends = np.cumsum(1 + escaped)
    where = ends - 1
    words = np.zeros(int(ends[-1]), dtype=U)
    flat, place = room.reshape(-1), row * room.shape[1] + column
    for s in range(2, WIDEST + 1):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            word = np.full(len(mine), s << PAYLOAD, dtype=U)
            first = place[mine]
            for k in range(int(COUNTS[s])):
                word |= flat[first + k] << U(WIDTHS[s] * k)
            words[where[mine]] = word
    if escaped.any():
        wide = flat[place[escaped]]
        words[where[escaped] - 1] = wide >> U(32)
        words[where[escaped]] = U(ESCAPE_LOW << PAYLOAD) | (wide & U(0xFFFFFFFF))
    per_block = np.bincount(row, weights=1 + escaped, minlength=blocks).astype(np.int64)
    return words, (np.cumsum(per_block) - per_block).astype(U)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a stream; ``offsets`` has the word where each block begins.

    A part of a stream decodes alone: give the words from one block's offset on, offsets
    less that one, and the number of values.
    """
    blocks = len(offsets)
    if not n:
        return np.zeros(0, dtype=U)
    selector = (words >> U(PAYLOAD)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    offsets = offsets.astype(np.int64)
    block = np.repeat(np.arange(blocks), np.diff(offsets, append=len(words)))
    out = np.zeros((blocks, BLOCK + PAYLOAD), dtype=U)
    place = block * out.shape[1] + before - before[offsets][block]
    flat = out.reshape(-1)
    for s in range(2, WIDEST + 1):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            word, first, mask = words[mine], place[mine], U((1 << int(WIDTHS[s])) - 1)
            for k in range(int(COUNTS[s])):
                flat[first + k] = (word >> U(WIDTHS[s] * k)) & mask
    low = np.flatnonzero(selector == ESCAPE_LOW)
    if len(low):
        half = U(0xFFFFFFFF)
        flat[place[low]] = (words[low - 1] & half) << U(32) | (words[low] & half)
    return out[:, :BLOCK].reshape(-1)[:n]
