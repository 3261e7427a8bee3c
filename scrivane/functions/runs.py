"""Runs of bytes of one class in a column of texts, found for whole Arrow batches at once, with byte offsets within their text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 4 << 20
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(b" \t\n\x0c\r")] = False
DIGIT = np.zeros(256, bool)
DIGIT[list(b"0123456789")] = True


class Runs:
    """bounds: n + 1 places at which the texts' runs begin and end; start, end: byte offsets within the text; said: the runs as strings."""

    def __init__(self, texts: pa.Array, member: np.ndarray):
        texts = texts.fill_null("").cast(pa.large_string())
        _, off, data = texts.buffers()
        offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        d = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        o = offsets - lo
        inside = member[d]
        first, last = inside.copy(), inside.copy()
        if len(d):
            edge = np.zeros(len(d) + 1, bool)
            edge[o] = True
            first[1:] &= ~inside[:-1] | edge[1:-1]
            last[:-1] &= ~inside[1:] | edge[1:-1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(begin, o)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.start, self.end = begin - o[self.row], end - o[self.row]
        size = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        self.said = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(size), pa.py_buffer(np.ascontiguousarray(d[inside])))

    def place(self) -> np.ndarray:
        """The number of each run within its text."""
        return np.arange(len(self.row)) - self.bounds[self.row]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of text; a longer text is a run of its own."""
    size = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), np.int64)
    o, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
