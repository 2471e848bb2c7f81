"""Fill-in-the-middle: a document's prefix, middle and suffix in another order.

Two cuts are drawn per document from a hash of its id, as counts of tokens; the set of
token boundaries (``boundary_set``) gives both as offsets in the text. Work is per row:
nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.arrow import batch, free_name, map_batches, valid_text
from riskweave.llm.boundary_set import BoundarySet
from riskweave.llm.word_ids import byte_slices

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundaries(text: str) -> BoundarySet:
    """Offsets where tokens end, and 0: runs of A-Z and a-z are tokens, other characters too."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = np.zeros(len(points) + 1, dtype=bool)
    lowered = points | 0x20
    letter[:-1] = (lowered >= ord("a")) & (lowered <= ord("z"))
    inside = letter[:-1] & letter[1:]
    return BoundarySet(np.concatenate([[0], np.flatnonzero(~inside) + 1]))


def draws(seed: str, key: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits from the document's id."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4))


def transform(
    text: str, key: int | None, seed: str = "1", plain: int = 10, spm: int = 20
) -> tuple[int, str, int | None, int | None, str]:
    """Token count, form, characters of prefix and middle, and the text in its new order."""
    places = boundaries(text)
    n = len(places) - 1
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= 100 - plain or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(low), places.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def restore(output: str, form: str) -> str:
    """The text that ``transform`` was given; its parts hold none of the marks."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    head, _, rest = output[len(PREFIX) :].partition(second)
    tail, _, middle = rest.partition(MIDDLE)
    return head + middle + tail if form == "psm" else tail + middle + head


def fill_in_middle(
    docs: DataFrame,
    seed: str = "1",
    plain: int = 10,
    spm: int = 20,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with n (tokens), form, prefix_chars, middle_chars and output.

    ``plain`` of 100 documents stay as they are, as do empty ones and those that hold a
    mark; ``spm`` of 100 others put the suffix first. NULL texts count as empty, invalid
    UTF-8 is read as U+FFFD, a NULL id is drawn for as the empty text. Rows of one id are
    cut at the same draws. Other columns are kept, but for one named like a result, which
    is replaced; an empty table gives no rows.
    """
    inner, number = free_name(docs, "_text"), free_name(docs, "_key")
    kept = [c for c in docs.columns if c not in RESULTS]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    schema += "n long, form string, prefix_chars long, middle_chars long, output string"

    def make(arrow):
        def run(batches):
            for b in byte_slices(batches, inner):
                texts = valid_text(b.column(inner)).to_pylist()
                keys = b.column(number).to_pylist()
                made = [transform(t, k, seed, plain, spm) for t, k in zip(texts, keys, strict=True)]
                out = {c: b.column(c) for c in kept}
                out |= dict(zip(RESULTS, map(list, zip(*made, strict=True)), strict=True))
                yield batch(arrow, out)

        return run

    given = docs.select(
        *kept, F.col(text).alias(inner), F.col(id_col).cast("long").alias(number)
    )
    return map_batches(given, schema, make)


def restored(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``df`` with the texts rebuilt from outputs and forms, as ``restored``."""
    kept = [c for c in df.columns if c != "restored"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*kept).schema)

    def make(arrow):
        def run(batches):
            for b in byte_slices(batches, output):
                pairs = zip(b.column(output).to_pylist(), b.column(form).to_pylist(), strict=True)
                out = {c: b.column(c) for c in kept}
                yield batch(arrow, out | {"restored": [restore(o, f) for o, f in pairs]})

        return run

    return map_batches(df.select(*kept), schema + "restored string", make)
