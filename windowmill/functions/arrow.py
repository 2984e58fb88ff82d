"""Columns of Arrow batches as plain lists."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc


def listed(column: pa.Array) -> list:
    """The same as ``to_pylist`` for whole numbers and texts, without an Arrow scalar for each value."""
    if not pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return column.to_numpy().tolist()
    out = pc.fill_null(column, 0).to_numpy().astype(object)
    out[pc.is_null(column).to_numpy(zero_copy_only=False)] = None
    return out.tolist()
