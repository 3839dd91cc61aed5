"""Helpers that the numbered operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.sources.shared import materialize, read_table, shared_dir  # noqa: F401  for the operators

#: Bytes of text that a task holds in Python objects at once, unless one text alone is longer.
CHUNK_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    """True for the documents that no model may learn from: crc32(doc_id as text) mod 3 is 1. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of at most `limit` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        size = batch.column(text).cast(pa.large_binary())
        length = np.asarray(pa.compute.binary_length(size).fill_null(0))
        start, held = 0, 0
        for i, n in enumerate(length.tolist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def to_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
