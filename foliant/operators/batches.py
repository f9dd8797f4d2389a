"""Rows of Arrow batches one after the other, and back: for functions that read a sorted stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
