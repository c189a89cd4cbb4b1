"""Arrow batches for Python that makes many objects of a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece: its objects are many times its size.
PIECE_BYTES = 1 << 18


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, about ``most`` bytes at a time and one row at least."""
    for b in batches:
        if b.num_rows:
            step = max(1, b.num_rows * most // max(b.nbytes, 1))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
