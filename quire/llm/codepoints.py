"""Arrow text columns as numpy code-point arrays and back, a whole column at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def text_array(column) -> pa.StringArray:
    """One contiguous string array of a column, whatever chunks or width it came in."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if column.type == pa.string() else column.cast(pa.string())


def to_codepoints(column) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row bounds): row i is cp[bounds[i]:bounds[i+1]]; null counts as empty."""
    arr = text_array(column)
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    if n == 0 or arr.buffers()[2] is None:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    at = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(arr.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, at
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return cp, starts[at]


def from_codepoints(cp: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    """The string array of code points cut at bounds."""
    data = cp.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    width = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000), out=width[1:])
    at = width[bounds].astype(np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
