"""Arrow plumbing of the operators that work on whole texts inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Rows = Iterator[pa.RecordBatch]


def struct_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def map_batches(
    df: DataFrame, schema: str, make: Callable[[pa.Schema], Callable[[Rows], Rows]]
) -> DataFrame:
    """``mapInArrow`` for functions that build their batches from an Arrow schema."""
    run = make(to_arrow_schema(struct_of(schema)))

    def go(batches: Rows) -> Rows:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(go, schema)


def release_memory() -> None:
    """Give free memory back: worker processes live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def valid_text(texts: pa.Array) -> pa.Array:
    """Strings without NULL; invalid bytes are read as U+FFFD, as Python's decoder has it."""
    texts = texts.cast(pa.string()).fill_null("")
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        raw = texts.cast(pa.binary()).to_pylist()
        return pa.array([t.decode("utf-8", "replace") for t in raw], type=pa.string())


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of ``schema`` from lists, numpy arrays or Arrow arrays by name."""
    arrays = []
    for field in schema:
        values = columns[field.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if isinstance(values, pa.Array):
            arrays.append(values.cast(field.type))
        else:
            arrays.append(pa.array(values, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def slices(batches: Rows, rows: int) -> Rows:
    """Cut batches to at most ``rows`` rows each, so that a task holds few long texts at once."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
