"""Repetition inside a text, by suffix arrays over its words.

Suffixes are ordered by prefix doubling, several texts at a time; after each doubling
only suffixes that still tie are sorted again. The longest common prefix of neighbours
in that order is found by descending through the ranks of the doublings. The larger of
a suffix's two neighbouring values is the longest substring that starts there and occurs
again in the text; where it isn't just the rest of the one a word earlier, it opens a
maximal repeat. The spans of all occurrences are united.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, map_batches, slices

#: Words of the texts that are sorted together; a longer text is sorted alone.
WORDS_AT_ONCE = 250_000
TEXTS_AT_ONCE = 2000
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, n_repeats long, longest_repeat long, base_failed boolean, kept boolean"
)


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self) + 1
        return n


def repeat_lengths(ids: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """For each word, the longest substring from it that occurs again in its text.

    ``ids`` are the words (from 1) of texts, none empty, that begin at ``starts``; values
    below ``least`` (2 or more) may be given as 0.
    """
    n = len(ids)
    longest = np.zeros(n, dtype=np.int64)
    if n < 2:
        return longest
    ends = np.append(starts[1:], n)
    text = np.repeat(np.arange(len(starts)), ends - starts)
    end = ends[text]
    width = int(ids.max()) + 1
    single = text * width + ids
    ahead = np.zeros(n, dtype=np.int64)
    ahead[:-1] = np.where(text[1:] == text[:-1], ids[1:], 0)
    key = single * width + ahead
    order = np.argsort(key)
    rank = np.empty(n + 1, dtype=np.int64)  # the last place stands for no suffix
    rank[n] = -1
    ranks = [np.append(single, -1)]

    def number(order, keys, first):
        """Group starts in sorted order, and which places tie with another."""
        new = np.empty(len(order), dtype=bool)
        new[0] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(order)))
        rank[order] = np.repeat(first[begin], size)
        return np.repeat(size, size) > 1

    tied = number(order, key[order], np.arange(n))
    suffixes = order
    place = np.arange(n)
    step = 2
    while True:
        ranks.append(rank.copy())
        if not tied.any():
            break
        suffixes, place = suffixes[tied], place[tied]
        nxt = suffixes + step
        follow = np.where(nxt < end[suffixes], rank[np.minimum(nxt, n)], -1)
        # Places are in group order already: sort by (group, rank a step ahead).
        by = np.lexsort((follow, rank[suffixes]))
        suffixes, follow = suffixes[by], follow[by]
        tied = number(suffixes, rank[suffixes] * (n + 2) + follow, place)
        step *= 2
    array = np.empty(n, dtype=np.int64)
    array[rank[:n]] = np.arange(n)
    a, b = array[:-1], array[1:]
    level = min(max(least.bit_length() - 1, 1), len(ranks) - 1)
    near = np.flatnonzero(ranks[level][a] == ranks[level][b]) if 1 << level <= least else ()
    if len(near) == 0:
        return longest
    a, b = a[near], b[near]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][np.minimum(a + common, n)] == ranks[k][np.minimum(b + common, n)]
        common += np.where(same, 1 << k, 0)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """1 for each word inside an occurrence of a repeat of ``least`` words or more."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        if line in seen:
            repeated += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return repeated


def repetition_rules(
    docs: DataFrame,
    text: str = "text",
    least_words: int = 10,
    max_covered: float = 0.2,
    max_longest: int = 100,
) -> DataFrame:
    """``docs`` without the text, with repetition measures and the verdict ``kept``.

    Words are runs without ASCII white space. A text fails the base rule with fewer than 10
    words or over 20 % of them in repeated five-word windows. It fails the method's rule if
    maximal repeats of ``least_words`` words or more cover over ``max_covered`` of its words,
    or the longest repeat is over ``max_longest`` words. NULL and empty texts have no words
    and fail the base. Rows stay one to one; other columns are kept, and those named like a
    result are replaced. There is no shuffle, and memory is that of one text, or of
    WORDS_AT_ONCE words.
    """
    names = [f.split()[0] for f in RESULT.split(", ")]
    kept_columns = [c for c in docs.columns if c not in (*names, text, "_text")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept_columns).schema]
    schema = ", ".join([*fields, RESULT])

    def measure(texts: list[bytes | None]) -> dict[str, np.ndarray]:
        numbers = _Numbers()
        words = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter(
            (i for ws in words for i in map(numbers.__getitem__, ws)),
            dtype=np.int64,
            count=int(sizes.sum()),
        )
        del words
        longest = repeat_lengths(ids, starts[sizes > 0], 4)

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[starts + sizes] - sums[starts]

        opens = longest >= least_words
        opens[1:] &= longest[1:] + 1 != longest[:-1]
        top = np.zeros(len(texts), dtype=np.int64)
        if len(ids):
            full = sizes > 0
            top[full] = np.maximum.reduceat(longest, starts[full])
        out = {
            "n_words": sizes,
            "n_repeat_words": total(covered(longest, 5)),
            "n_covered_words": total(covered(longest, least_words)),
            "n_repeats": total(opens),
            "longest_repeat": top,
        }
        out["word_chars"] = np.array(
            [len(t.translate(None, BLANKS).decode("utf-8", "replace")) if t else 0 for t in texts],
            dtype=np.int64,
        )
        out["n_symbols"] = np.array(
            [len(t) - len(t.translate(None, SYMBOLS)) if t else 0 for t in texts], dtype=np.int64
        )
        out["n_dup_lines"] = np.array(
            [duplicate_lines(t) if t else 0 for t in texts], dtype=np.int64
        )
        failed = (sizes < 10) | (100 * out["n_repeat_words"] > 20 * sizes)
        over = (out["n_covered_words"] > max_covered * sizes) | (top > max_longest)
        return out | {"base_failed": failed, "kept": ~failed & ~over}

    def make(arrow):
        def run(batches):
            for b in slices(batches, TEXTS_AT_ONCE):
                texts = b.column("_text").to_pylist()
                start = size = 0
                for at, t in enumerate([*texts, None]):
                    last = at == len(texts)
                    more = len(t) // 5 if t else 0
                    if at > start and (last or size + more > WORDS_AT_ONCE):
                        out = measure(texts[start:at])
                        part = b.slice(start, at - start)
                        yield batch(arrow, {c: part.column(c) for c in kept_columns} | out)
                        start, size = at, 0
                    size += more

        return run

    chosen = docs.select(*kept_columns, F.col(text).cast("binary").alias("_text"))
    return map_batches(chosen, schema, make)
