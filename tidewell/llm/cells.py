"""Arrow access to documents made of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a step works on at once; a single longer text is a step of its own.
STEP_BYTES = 4_000_000


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of bounded text, so that memory doesn't grow with texts or batches."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def cell_lists(batch: pa.RecordBatch, text: str = "text", cells: str = "cells") -> list[list[tuple[str, str]]]:
    """Per row the (cell_type, text) of its cells.  Null texts and null or
    reversed places give no cell; a null list of cells gives none."""
    texts = batch.column(text).to_pylist()
    column = batch.column(cells)
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid())
    sizes = np.where(valid, sizes, 0)
    kinds = flat.field("cell_type").to_pylist()
    starts = flat.field("start_char").to_pylist()
    ends = flat.field("end_char").to_pylist()
    live = np.asarray(flat.is_valid()).tolist()
    out = []
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        row = []
        for i in range(at, at + n):
            s, e = starts[i], ends[i]
            if t is not None and live[i] and s is not None and e is not None and 0 <= s < e:
                row.append((kinds[i], t[s:e]))
        at += n
        out.append(row)
    return out
