"""Media columns: content-addressed payloads in tar shards, filled in by range reads.

Each text is an 8-bit grey image of 576 samples a row, stored losslessly as PNG. Of equal texts, those with the least
non-null id are owners (all, if none has an id); a task appends its owners' payloads to a tar shard in the shared folder,
each different one once, under the name of its SHA-256. So a payload is stored once, whatever tasks its copies are in,
unless rows repeat with their ids in several tasks. Copies take their owner's place by the digest: only digests that repeat
take part in joins, which broadcast them up to BROADCAST_ROWS rows and salt their keys beyond that. A row carries the
digest, the shard, the offset and the length of its member; width and height are filled by reading only the 33 header
bytes of a member, and features by reading the member.

A shard is written under the task attempt's own name, so a retried task leaves at most an orphan; the rows that are kept
name complete shards. A shard is closed at ``shard_bytes``.

Edge cases: a null or empty text is one row of 255s; equal texts have equal values wherever they are stored; repeated
rows each return a row; an empty table gives no shard and no row; a very long text is a tall image, cut nowhere; only id
and text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import documents, filesystem, shared_dir, small_batches, written

ROW = 576
HEADER_BYTES = 33
#: Rows of repeated digests that may be broadcast: each is under 300 bytes.
BROADCAST_ROWS = 50_000
#: Parts into which a digest's rows are dealt in the join beyond that.
SALTS = 32
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ROW."""
    return data + b"\xff" * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image whose samples, row by row, are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES bytes of a member."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(png: bytes) -> bytes:
    """The payload of an image that to_png() made."""
    width, height, _ = read_header(png[:HEADER_BYTES])
    at, data = HEADER_BYTES, b""
    while at < len(png):
        size = struct.unpack(">I", png[at : at + 4])[0]
        if png[at + 4 : at + 8] == b"IDAT":
            data += png[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


class Shard:
    """A tar file that is being written; member() returns the offset of the data."""

    def __init__(self, folder: str, path: str):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = path
        self.out = self.fs.open_output_stream(f"{base}/{path}")
        self.at = 0
        self.members: dict[str, tuple[int, int]] = {}

    def member(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.members:
            png = to_png(payload)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(png)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            fill = -len(png) % tarfile.BLOCKSIZE
            self.out.write(head + png + b"\0" * fill)
            self.members[digest] = (self.at + len(head), len(png))
            self.at += len(head) + len(png) + fill
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
        self.out.close()


def _beside(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
    """rows joined with ``few`` (written, a row per key) on key, a part of which may hold a large share of the rows."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), "key", how)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], how).drop("salt")


def store(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text", extend=None) -> DataFrame:
    """Writes the shards below ``folder`` (a URI that all executors share) and returns their index: a row per document.
    extend: adds columns to an index, by reading its members; it is applied to stored members only, and copies of a payload
    take theirs."""
    rows = documents(docs, id_col, text_col).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    keys = written(rows.select("doc_id", "key"), "keys")
    repeated = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).where("n > 1").select("key", "owner", F.lit(True).alias("repeats"))
    repeated = written(repeated, "repeated")
    is_owner = F.col("repeats").isNull() | F.col("doc_id").eqNullSafe(F.col("owner"))
    owners = _beside(rows, repeated, "left").where(is_owner).select("doc_id", "text", F.when(F.col("repeats"), F.col("key")).alias("key"))
    own = written(put(owners, folder, shard_bytes), "owners")
    if extend:
        own = written(extend(own), "members")
    names = [c for c in own.columns if c not in ("doc_id", "key")]
    places = own.where("key is not null").groupBy("key").agg(F.min(F.struct(*names)).alias("place"))
    copied = _beside(keys, repeated, "inner").where(~is_owner).select("doc_id", "key")
    copies = _beside(copied, written(places, "places"), "inner")
    return own.drop("key").unionByName(copies.select("doc_id", *(F.col(f"place.{c}").alias(c) for c in names)))


def put(rows: DataFrame, folder: str, shard_bytes: int) -> DataFrame:
    """Appends the payloads of rows (doc_id, text, key) to shards: INDEX and the key."""

    def run(batches):
        shard = None
        try:
            for b in small_batches(batches):
                rows = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if shard is None or shard.at >= shard_bytes:
                        if shard is not None:
                            shard.close()
                        shard = Shard(folder, f"{uuid.uuid4().hex}.tar")
                    data = text.encode()
                    payload = pad(data)
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((doc_id, len(data), digest, shard.path, *shard.member(digest, payload)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)), b.column(2)], names=[x.split(" ")[0] for x in INDEX.split(", ")] + ["key"])
        finally:
            if shard is not None:
                shard.close()

    return rows.mapInArrow(run, f"{INDEX}, key string")


class Ranges:
    """Byte ranges of the shards, one open shard at a time."""

    def __init__(self, folder: str):
        self.fs, self.base = filesystem(folder)
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file:
                self.file.close()
            self.path, self.file = path, self.fs.open_input_file(f"{self.base}/{path}")
        return self.file.read_at(length, offset)


def _extended(index: DataFrame, columns: str, row) -> DataFrame:
    """``index`` with more columns: row(ranges, shard, offset, length) gives their values, once for a member that repeats."""
    fields = index.schema.fields
    names = [f.name for f in fields]
    more = [c.split(" ") for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches, folder):
        ranges, last, value = Ranges(folder), None, None
        known: dict[tuple, tuple] = {}
        for b in small_batches(batches):
            out = []
            for key in zip(*(b.column(names.index(n)).to_pylist() for n in ("shard", "offset", "length")), strict=True):
                if key[0] != last:
                    known.clear()
                    last = key[0]
                value = known.get(key)
                if value is None:
                    value = known[key] = row(ranges, *key)
                out.append(value)
            extra = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*out, strict=True), more, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=names + [n for n, _ in more])

    return run


def with_headers(index: DataFrame, folder: str) -> DataFrame:
    """width, height and bits of each member, from range reads of its header alone."""
    run = _extended(index, "width int, height int, bits int", lambda ranges, shard, offset, length: read_header(ranges.read(shard, offset, min(length, HEADER_BYTES))))
    return index.mapInArrow(lambda batches: run(batches, folder), f"{_ddl(index)}, width int, height int, bits int")


def _features(ranges: Ranges, shard: str, offset: int, length: int) -> tuple:
    png = ranges.read(shard, offset, length)
    payload = from_png(png)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    entropy = float(-(p * np.log2(p)).sum())
    mean = float(counts @ np.arange(256)) / len(payload)
    feature = f"levels={int((counts > 0).sum())};mean={mean:.4f};entropy={entropy:.4f};histogram={zlib.crc32(counts.astype('<i8').tobytes()):08x}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), feature


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes say, read back: sizes, digests and a feature line (levels, mean, entropy, histogram digest)."""
    run = _extended(index, FEATURES, _features)
    return index.mapInArrow(lambda batches: run(batches, folder), f"{_ddl(index)}, {FEATURES}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def with_media(index: DataFrame, folder: str) -> DataFrame:
    """The columns of with_headers() and with_features(), one range read of the header and one of the member."""

    def row(ranges: Ranges, shard: str, offset: int, length: int) -> tuple:
        return (*read_header(ranges.read(shard, offset, min(length, HEADER_BYTES))), *_features(ranges, shard, offset, length))

    more = f"width int, height int, bits int, {FEATURES}"
    run = _extended(index, more, row)
    return index.mapInArrow(lambda batches: run(batches, folder), f"{_ddl(index)}, {more}")


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores all texts and returns their media columns."""
    folder = f"{shared_dir(docs.sparkSession)}/shards"
    return store(docs, folder, extend=lambda index: with_media(index, folder))
