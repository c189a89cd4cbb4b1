"""Rows of groups in order, in pieces of bounded size, however large a group is.

Rows are range-sorted by group and order, so that a large group lies over several tasks. A task reads its rows as a stream
and cuts them into segments: runs of one group, of at most ``max_rows`` rows and about ``max_bytes`` bytes. A group is whole
if it is a single segment that neither begins nor ends its task's rows; all others may go on in other segments and have to
be put together by their operator. Segments of a group are numbered in its order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import filesystem, give_back

MAX_ROWS, MAX_BYTES = 4096, 4 << 20


def in_order(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` range-sorted by group and order (nulls first); rows that are equal in these are dealt to several tasks too."""
    name = "_".join(["tie", *rows.columns])  # no other column has this name
    keys = [group, *order, name]
    return rows.withColumn(name, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(name)


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    total = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def segments(batches, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES):
    """(number, whole, table) of the segments of a task's rows; the first column is the group, of type long."""
    number, held, rows, size = TaskContext.get().partitionId() << 40 if TaskContext.get() else 0, [], 0, 0
    key, first, cut = None, True, False  # first: the task's first group. cut: the group has given a segment already

    def give(ended: bool):
        nonlocal number, held, rows, size
        if held:
            yield number, ended and not first and not cut, pa.Table.from_batches(held)
            number, held, rows, size = number + 1, [], 0, 0

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value, null = pc.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        changed = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
        ends = np.cumsum(_sizes(batch))
        for a, z in zip([0, *changed.tolist()], [*changed.tolist(), n]):
            own = (bool(null[a]), int(value[a]))
            if key is not None and own != key:
                yield from give(True)
                first = cut = False
            key = own
            while a < z:
                before = int(ends[a - 1]) if a else 0
                to = min(z, a + max_rows - rows, max(a + 1, int(np.searchsorted(ends, before + max_bytes - size, "right"))))
                held.append(batch.slice(a, to - a))
                rows, size, a = rows + to - a, size + int(ends[to - 1]) - before, to
                if rows >= max_rows or size >= max_bytes:
                    yield from give(False)
                    cut = True
    yield from give(False)
    give_back()


def put(folder: str, data: bytes) -> str:
    """Writes ``data`` below ``folder`` (shared by all executors) and returns the file's name; a retried task writes another."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{base}/{name}") as f:
        f.write(data)
    return name


def get(folder: str, name: str) -> bytes:
    """What put() wrote."""
    fs, base = filesystem(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read()
