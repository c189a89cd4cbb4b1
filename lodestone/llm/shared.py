"""Helpers that several operators use: the shared folder, written tables, Arrow batches, word scanning."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import shared_base


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name in the folder that the driver and all executors share."""
    return f"{shared_base(spark)}/lodestone/{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(file system, path) of a shared URI, for byte-range access from Python tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def small_batches(batches, max_rows: int = 2048, max_bytes: int = 8 << 20):
    """Arrow record batches cut so that each has at most ``max_rows`` rows and about ``max_bytes`` bytes (one row at least)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(max_rows, int(rows * max_bytes / max(batch.nbytes, 1))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks, and each operator would add what it once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null text: empty), so that other columns and their names never matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


# ---------------------------------------------------------------- words of a batch, in numpy

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_weights: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _weight(n: int, seed: int) -> np.ndarray:
    """n odd random 64-bit weights by position; the table only ever grows."""
    w = _weights.get(seed)
    if w is None or len(w) < n:
        with np.errstate(over="ignore"):
            size = max(256, 1 << (n - 1).bit_length())
            w = mix((np.arange(1, size + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_GOLDEN)) | np.uint64(1)
        _weights[seed] = w
    return w


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per document) of every run of bytes that are not white space; words never cross documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    return start, end, np.diff(bounds)


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words, each with a line feed behind it; where each starts, and the end of all)."""
    bounds = np.append(0, np.cumsum(end - start + 1)).astype(np.int64)
    text = np.full(int(bounds[-1]), 0x0A, np.uint8)
    inside = np.ones(len(text), bool)
    inside[bounds[1:] - 1] = False
    text[inside] = data[~_SPACE[data]]
    return text, bounds


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool, seed: int = 1, chunk: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased first if ``lower``)."""
    n = len(start)
    out = np.empty(n, np.uint64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, start[at] + chunk, "right")))
        lo, hi = start[at], end[to - 1]
        part = data[lo:hi]
        if lower:
            part = _LOWER[part]
        s = start[at:to] - lo
        length = end[at:to] - start[at:to]
        w = _weight(int(length.max()), seed)
        inside = np.ones(hi - lo, dtype=np.int64)
        # the place of each byte in its word: a running count that starts anew at each word
        inside[0] = 0
        inside[s[1:]] -= s[1:] - s[:-1]
        place = np.cumsum(inside)
        np.minimum(place, len(w) - 1, out=place)
        value = (part.astype(np.uint64) + np.uint64(1)) * w[place]
        value[_SPACE[part]] = 0
        out[at:to] = mix(np.add.reduceat(value, s) + length.astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` consecutive values; len(words) - k + 1 of them (none if fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = _weight(k, seed)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * w[j]
    return mix(total)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 values as differences of a fixed byte width, a plane for each byte."""
    if not len(keys):
        return b""
    gaps = np.empty(len(keys), np.uint64)
    gaps[0] = keys[0]
    np.subtract(keys[1:], keys[:-1], out=gaps[1:])
    width = max(1, (int(gaps[1:].max() if len(gaps) > 1 else 0).bit_length() + 7) // 8)
    planes = gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(keys[0]).to_bytes(8, "little") + np.ascontiguousarray(planes.T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    """The values that pack_sorted was given."""
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], int.from_bytes(blob[1:9], "little")
    planes = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    gaps[1:, :width] = planes.T
    gaps = gaps.reshape(-1).view(np.uint64)
    gaps[0] = first
    return np.cumsum(gaps, dtype=np.uint64)
