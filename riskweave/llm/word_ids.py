"""Token ids of many texts by a tokenizer file, each different word encoded once.

Texts are cut where no token can reach across, words are counted off by Arrow's
dictionary encoding, and only different words meet Python: the ids of known ones lie in
one flat table, new ones go through the library's own model. The ids of a batch are then
one numpy gather over that table.

A row of the table is forgotten when the table is full and the row was met in few
batches, so memory is bounded and frequent words stay.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from riskweave.llm.arrow import valid_text
from riskweave.llm.token_counts import PRETOKEN, byte_letters

#: Different words whose ids a process remembers at most.
CACHE_WORDS = 500_000
#: New words that go through the tokenizer together.
NEW_AT_ONCE = 20_000
#: Longer words are not remembered for long.
CACHE_BYTES = 128
#: White space but the space itself.
INNER = re.compile(r"[^\S ]")
BLANKS = b"\t\n\x0b\x0c\r"


def byte_slices(batches, column: str, rows: int = 2000, size: int = 4_000_000) -> Iterator:
    """Cut batches to slices of few rows and, but for one longer text, few bytes of ``column``."""
    for b in batches:
        lengths = pc.binary_length(b.column(column)).fill_null(0).to_numpy()
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < b.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = min(max(stop, start + 1), start + rows, b.num_rows)
            yield b.slice(start, stop - start)
            start = stop


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts[i] : starts[i] + lengths[i]]`` of all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total)
    index += np.repeat(starts - (ends - lengths), lengths)
    return flat[index]


class IdTable:
    """Known words; the ids of word r are ``flat[starts[r] : starts[r] + lengths[r]]``."""

    def __init__(self):
        self.words = pa.array([], type=pa.string())
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int32)

    def rows(self, words: pa.Array, ids_of: Callable) -> np.ndarray:
        """Rows of different words; ``ids_of`` gives the ids of new ones, which are added."""
        found = pc.index_in(words, value_set=self.words)
        rows = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = words.take(pa.array(missing))
            flat, lengths = ids_of(new.to_pylist())
            rows[missing] = len(self.starts) + np.arange(len(missing))
            begins = len(self.flat) + np.cumsum(lengths) - lengths
            self.words = pa.concat_arrays([self.words, new])
            self.starts = np.concatenate([self.starts, begins])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
            self.met = np.concatenate([self.met, np.zeros(len(missing), dtype=np.int32)])
        self.met[rows] += 1
        return rows

    def trim(self, most: int) -> None:
        """Forget all but the rows met most often, if there are more than ``most``."""
        if len(self.met) <= most:
            return
        limit = max(2, int(np.partition(self.met, -(most // 2))[-(most // 2)]))
        short = pc.binary_length(self.words).to_numpy() <= CACHE_BYTES
        rows = np.flatnonzero((self.met >= limit) & short)[: most // 2]
        self.words = self.words.take(pa.array(rows))
        self.flat = gather(self.flat, self.starts[rows], self.lengths[rows])
        self.lengths, self.met = self.lengths[rows], self.met[rows] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths


class WordIds:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids``.

    Two kinds of file are known: byte-level ones without a normalizer, whose tokens may
    begin with one space, and ones that drop white space. Texts that hold a special
    string go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.path = path
        self.cutter = Tokenizer.from_file(path)
        self.normalizer = self.cutter.normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        before = spec["pre_tokenizer"]
        kinds = [before] if before["type"] != "Sequence" else before["pretokenizers"]
        if kinds[-1]["type"] != "ByteLevel" or kinds[-1]["add_prefix_space"]:
            raise ValueError("a byte-level tokenizer without a prefix space is needed")
        self.spaced = len(kinds) == 1 and bool(kinds[0]["use_regex"]) and spec["normalizer"] is None
        if self.spaced:
            pattern = PRETOKEN
        elif len(kinds) == 2 and kinds[0]["type"] == "Split" and kinds[0]["invert"]:
            pattern = kinds[0]["pattern"]["Regex"]
            if not isinstance(pattern, str) or kinds[0]["behavior"] != "Removed":
                raise ValueError("unknown pre-tokenizer")
        else:
            raise ValueError("unknown pre-tokenizer")
        #: Without ``spaced``, a space is a piece too and ends a word.
        self.pretokens = regex.compile(pattern if self.spaced else pattern + "| ").findall
        letters = byte_letters()
        self.letters = np.array([ord(letters[b]) for b in range(256)], dtype="<u2")
        self.cutter.normalizer = Sequence([])
        self.cutter.pre_tokenizer = CharDelimiterSplit("\0")
        unused = letters[255]
        self.between = f"\0{unused}\0"
        (self.mark,) = self.cutter.encode(unused, add_special_tokens=False).ids
        self.table = IdTable()
        self.firsts = IdTable()
        lower = np.arange(256, dtype=np.uint8)
        lower[list(BLANKS)] = 32
        lower[65:91] += 32
        self.lower = lower

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has.

        Each different piece goes once, as its letters, through a copy of the tokenizer
        that only cuts at NUL; a piece of a byte that no text holds marks the ends.
        """
        different = list(dict.fromkeys(pieces))
        joined = "\0".join(different)
        if joined.count("\0") != len(different) - 1:  # NUL characters in the texts
            model = self.cutter.model.tokenize
            spelt = (self.letters[np.frombuffer(p.encode(), np.uint8)] for p in pieces)
            found = [[t.id for t in model(s.tobytes().decode("utf-16-le"))] for s in spelt]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.array([i for f in found for i in f], dtype=np.uint32), counts
        letters = self.letters[np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)]
        letters[letters == self.letters[0]] = 0
        shown = letters.tobytes().decode("utf-16-le")
        shown = shown.replace("\0", self.between) + self.between
        ids = self.cutter.encode_batch_fast([shown], add_special_tokens=False)[0].ids
        flat = np.array(ids, dtype=np.uint32)
        marks = np.flatnonzero(flat == self.mark)
        counts = np.diff(marks, prepend=-1) - 1
        starts = marks - counts
        index = dict(zip(different, range(len(different)), strict=True))
        order = np.fromiter(map(index.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        return gather(flat, starts[order], counts[order]), counts[order]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, each with a space before it if the tokenizer keeps spaces."""
        if self.spaced:
            pieces = self.pretokens(" " + " ".join(words))
            ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
            widths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
            owner = np.searchsorted(np.cumsum(widths), ends)
        else:
            words = self.normalized(words)
            pieces = self.pretokens(" ".join(words))
            blank = np.array([p == " " for p in pieces], dtype=bool)
            owner = np.cumsum(blank)[~blank]
            pieces = [p for p in pieces if p != " "]
        if not pieces:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(words), dtype=np.int64)
        flat, counts = self.piece_ids(pieces)
        return flat, np.bincount(owner, weights=counts, minlength=len(words)).astype(np.int64)

    def normalized(self, words: list[str]) -> list[str]:
        """Words as the tokenizer's normalizer has them; blanks inside one become tabs."""
        wide = [i for i, w in enumerate(words) if not w.isascii()]
        if not wide:
            return words
        normal, out = self.normalizer.normalize_str, list(words)
        joined = " ".join([words[i] for i in wide])
        if INNER.search(joined):
            made = [normal(words[i]).replace(" ", "\t") for i in wide]
        else:
            made = normal(joined).split(" ")
        for i, w in zip(wide, made, strict=True):
            out[i] = w
        return out

    def new_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words; a word that a space must not be cut from has none."""
        if len(words) > NEW_AT_ONCE:
            cuts = range(0, len(words), NEW_AT_ONCE)
            parts = [self.new_words(words[i : i + NEW_AT_ONCE]) for i in cuts]
            return np.concatenate([f for f, _ in parts]), np.concatenate([n for _, n in parts])
        if not self.spaced:
            return self.ids_of(words)
        bound = np.array([not w or w[0].isspace() for w in words], dtype=bool)
        if not bound.any():
            return self.ids_of(words)
        flat, counts = self.ids_of([w for w, b in zip(words, bound.tolist(), strict=True) if not b])
        lengths = np.zeros(len(words), dtype=np.int64)
        lengths[~bound] = counts
        return flat, lengths

    def new_heads(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that texts begin with, without a space before them."""
        pieces = [self.pretokens(w) for w in words]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat, counts = self.piece_ids([p for x in pieces for p in x] or [""])
        owner = np.repeat(np.arange(len(words)), sizes)
        return flat, np.bincount(owner, counts[: len(owner)], len(words)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts as unsigned 32-bit numbers, and the end of each text's ids."""
        self.table.trim(CACHE_WORDS)
        self.firsts.trim(CACHE_WORDS // 4)
        texts = valid_text(texts)
        odd = np.zeros(len(texts), dtype=bool)
        for s in self.specials:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        ids, ends, late = (self.spaced_ids if self.spaced else self.plain_ids)(texts)
        odd |= late
        if not odd.any():
            return ids, ends
        begins = ends - np.diff(ends, prepend=0)
        parts, at = [], 0
        for i in np.flatnonzero(odd).tolist():
            parts += [ids[at : begins[i]], self.whole(texts[i].as_py())]
            at = ends[i]
        parts.append(ids[at:])
        lengths = ends - begins
        lengths[odd] = [len(p) for p in parts[1::2]]
        return np.concatenate(parts), np.cumsum(lengths)

    def whole(self, text: str) -> np.ndarray:
        """One text that words don't make up: special strings, runs of white space."""
        found = library(self.path).encode(text, add_special_tokens=False).ids
        return np.array(found, dtype=np.uint32)

    def spaced_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by words that take the space before them; texts with runs of blanks are marked."""
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        words = split.flatten().dictionary_encode()
        if not len(texts):
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint32), none, none.astype(bool)
        rows = self.table.rows(words.dictionary, self.new_words)
        index = words.indices.to_numpy()
        bad = (self.table.lengths[rows] == 0)[index]
        # A space before a non-space always starts a pre-token, so a text may be cut there.
        first = edges[:-1]
        bad[first] = False
        odd = np.add.reduceat(bad, first) > 0
        starts, lengths = self.table.starts[rows][index], self.table.lengths[rows][index]
        heads = pc.take(words.dictionary, words.indices.take(pa.array(first)))
        heads = heads.dictionary_encode()
        at = self.firsts.rows(heads.dictionary, self.new_heads)[heads.indices.to_numpy()]
        starts[first] = self.firsts.starts[at] + len(self.table.flat)
        lengths[first] = self.firsts.lengths[at]
        flat = np.concatenate([self.table.flat, self.firsts.flat])
        return gather(flat, starts, lengths), np.cumsum(np.add.reduceat(lengths, first)), odd

    def plain_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids by words between ASCII white space, A-Z lower-cased."""
        odd = np.zeros(len(texts), dtype=bool)
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), odd
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        lowered = pa.py_buffer(self.lower[raw])
        again = pa.py_buffer(np.ascontiguousarray(at - at[0]))
        texts = pa.StringArray.from_buffers(len(texts), again, lowered)
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        rows = self.table.rows(words.dictionary, self.new_words)
        index = words.indices.to_numpy()
        lengths = self.table.lengths[rows][index]
        ids = gather(self.table.flat, self.table.starts[rows][index], lengths)
        return ids, np.cumsum(np.add.reduceat(lengths, edges[:-1] - edges[0])), odd


@functools.lru_cache(maxsize=1)
def library(path: str):
    """The tokenizer as its file has it, for texts with special strings or runs of blanks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table per worker process, read from the installed tokenizer file."""
    return WordIds(path)
