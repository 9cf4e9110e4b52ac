"""Rows of a key as one value, so that keyed state is called once per key and not once per row.

A stateful processor in Python is handed its rows one by one as tuples, and each call of its state
goes to the JVM and back.  Packed, the rows a task holds of a key travel as one Arrow stream, which
keeps their types, and are read as columns where they meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T

PACKED = T.StructType([T.StructField("_rows", T.BinaryType())])

# So much of a task's rows is put in order of the key at a time.
PACK_ROWS = 200_000
PACK_BYTES = 64 << 20


def to_bytes(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(values: Iterable[bytes]) -> pa.Table:
    """The rows of one or more packed values."""
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(bytes(v))).read_all() for v in values]).combine_chunks()


def runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal codes, none for no codes."""
    if not len(codes):
        return []
    starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]
    return list(zip(starts, [*starts[1:], len(codes)], strict=True))


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where values are, null being one of them."""
    encoded = pa.chunked_array([column.combine_chunks()]).combine_chunks().dictionary_encode()
    return encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def pack(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _rows)``, some values per key and task; each holds whole rows."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        codes = codes_of(table[key])
        order = np.argsort(codes, kind="stable")
        sorted_rows = table.take(order).combine_chunks()
        stretches = runs(codes[order])
        (batch,) = sorted_rows.to_batches()
        values = pa.array([to_bytes(batch.slice(a, b - a)) for a, b in stretches], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([a for a, _ in stretches])), values], [key, "_rows"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held, count, size = [*held, batch], count + batch.num_rows, size + batch.nbytes
            if count >= PACK_ROWS or size >= PACK_BYTES:
                yield flush(held)
                held, count, size = [], 0, 0
        if held:
            yield flush(held)

    return rows.mapInArrow(packed, T.StructType([rows.schema[key], *PACKED.fields]))


def unpack(values: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in ``_rows``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column("_rows"):
                yield from pa.ipc.open_stream(value.as_buffer())

    return values.select("_rows").mapInArrow(rows, schema)


def packed_row(rows: pa.Table) -> Row:
    return Row(_rows=to_bytes(rows))
