"""Helpers of the Arrow stages: bounded slices of batches, and what a task leaves behind."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text and rows that a stage works on at a time; they bound a Python worker's memory.
SLICE_BYTES = 2 << 20
SLICE_ROWS = 8192
_at_end: list[Callable[[], object]] = []


def at_end(f: Callable[[], object]) -> None:
    """Call ``f`` when a task has read its last slice: workers outlive tasks, and so would their caches."""
    _at_end.append(f)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``most`` bytes in ``column`` (or ``row.column``); a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(values(batch, column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most or i - start >= SLICE_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    for f in _at_end:
        f()
    pa.default_memory_pool().release_unused()


def values(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column, or a field of the struct ``row``."""
    if column.startswith("row."):
        return pc.struct_field(batch.column("row"), column[4:])
    return batch.column(column)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values; null counts as empty."""
    return ["" if x is None else x for x in values(batch, column).to_pylist()]


def with_row(docs: DataFrame, text: str, *more: Column) -> tuple[DataFrame, str]:
    """(struct ``row`` of all columns and ``more``, where a stage finds the text): the text goes to Python once, unless it has to be cast."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    if isinstance(docs.schema[text].dataType, T.StringType) and "." not in text:
        return docs.select(row, *more), f"row.{text}"
    return docs.select(row, *more, F.col(text).cast("string").alias("__text")), "__text"
