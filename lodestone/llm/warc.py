"""WARC archives: writing pages with revisit records, and reading them back by verified record boundaries.

Reading. An archive is split into byte blocks; a task searches its block for the magic line and emits, for each place that
parses as a record, the offset and the offset of the record that must follow (header, Content-Length bytes and two line
ends further). Within an archive, pointer jumping from offset 0 doubles the reach of every link in each round and keeps
the offsets that the file start reaches. A payload that contains a record, or the magic alone, emits candidates too, but
no chain from the start leads to them.

Writing. Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the largest page_id is stored
as a response and the others as revisits that refer to it. Only the payload digests of repeated payloads take part in a
join; they are broadcast up to BROADCAST_ROWS rows and joined with salted keys beyond that.

Edge cases: null html is an empty payload; a null url gives a record without a target; a null page_id never is the
largest; repeated rows of the largest page_id are all responses; an empty table writes no archive and reads no record; line
ends in a url are percent-encoded; a record head or a payload may be of any length; magic with a malformed or impossible length is no candidate; only page_id, url and html are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import filesystem, shared_dir, small_batches, written

MAGIC = b"WARC/1.0\r\n"
HEAD_END = b"\r\n\r\n"
#: Rows of repeated digests that may be broadcast: each is under 100 bytes.
BROADCAST_ROWS = 100_000
#: Parts into which a digest's rows are dealt in the join beyond that.
SALTS = 32
BLOCK_BYTES = 8 << 20
#: Tasks that search blocks for heads, or read records, at most.
MAX_TASKS = 10_000
RECORD = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def with_referrals(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the response that a page's record revisits, null if it is a response itself."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    repeated = (
        rows.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy(key.alias("digest"))
        .agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
        .where("n > 1 and response is not null")
        .drop("n")
    )
    repeated = written(repeated, "repeated")
    own = rows.withColumn("digest", F.when(F.octet_length("html") >= min_revisit_bytes, key))
    if repeated.count() <= BROADCAST_ROWS:
        joined = own.join(F.broadcast(repeated), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
        salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("salt", salt).join(salted, ["digest", "salt"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record. A revisit keeps the HTTP head, whose Content-Length tells the payload's size, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = http + payload if refers_to is None else http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the rows of with_referrals() below ``folder`` (a URI that all executors share). Returns archive, size, records.

    A retried task writes under another name; only archives that are returned count.
    """

    def run(batches):
        out, done = None, []
        fs, base = filesystem(folder)
        for b in small_batches(batches):
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, size, n = f"{uuid.uuid4().hex}.warc", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}")
                data = record(page_id, url, html.encode(), refers_to, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    out = done.append((name, size, n))
        if out is not None:
            out.close()
            done.append((name, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "size", "records"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, size long, records long")


# ---------------------------------------------------------------- reading


def _length(value: bytes) -> int | None:
    """A Content-Length: ASCII digits, at most 18."""
    return int(value) if re.fullmatch(rb"[0-9]{1,18}", value.strip()) else None


def parse_head(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """(fields by lower-case name, offset after the head) of the record head at ``at``; None if it is none or not complete."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(HEAD_END, at)
    if end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if _length(fields.get("content-length", "").encode()) is not None else None


def heads(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, offset after the head, Content-Length) of all places where parse_head() finds a head. Places with the same
    head end share its lines, which are read once, from the end back to the first line without a colon."""
    out, first = [], data.find(MAGIC)
    while first >= 0 and (end := data.find(HEAD_END, first)) >= 0:
        to, told, length = end, False, None
        while to > first:
            line = data.rfind(b"\r\n", first, to) + 2
            if line < first + len(MAGIC):  # the magic line itself
                break
            name, colon, value = data[line:to].partition(b":")
            if not colon:
                break
            if not told and name.strip().lower() == b"content-length":
                told, length = True, _length(value)
            if length is not None and line - len(MAGIC) >= first and data.startswith(MAGIC, line - len(MAGIC)):
                out.append((line - len(MAGIC), end + len(HEAD_END), length))
            to = line - 2
        first = data.find(MAGIC, max(first + 1, end - len(MAGIC) + 3))
    return sorted(out)


def tasks_for(archives: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Tasks that read archives: rows of blocks and spans are tiny and what they stand for is not, so the bytes of the archives
    set their number, not those of the rows."""
    return max(1, min(MAX_TASKS, archives.agg(F.sum(F.ceil(F.col("size") / block_bytes))).first()[0] or 1))


def candidates(archives: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES, head_bytes: int = 64 << 10) -> DataFrame:
    """archive, size, offset, successor for each place that parses as a record head and ends within its archive. A head that starts in a block and ends
    beyond what was read with it is read on by ``head_bytes`` at a time, doubled each time, until its end."""
    blocks = archives.select("archive", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(block_bytes))).alias("start"))
    tasks = tasks_for(archives, block_bytes)

    def run(batches):
        fs, base = filesystem(folder)
        for b in batches:
            for archive, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = []
                with fs.open_input_file(f"{base}/{archive}") as f:
                    data = f.read_at(min(block_bytes + head_bytes, size - start), start)
                    more = head_bytes
                    last = data.rfind(MAGIC, 0, block_bytes + len(MAGIC) - 1)
                    while last >= 0 and start + len(data) < size and data.find(HEAD_END, last) < 0:
                        data += f.read_at(min(more, size - start - len(data)), start + len(data))
                        more *= 2
                    for at, end, length in heads(data):
                        if at < block_bytes and (successor := start + end + length + 4) <= size:
                            found.append((start + at, successor))
                if found:
                    here, there = zip(*found, strict=True)
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([size] * n), pa.array(here), pa.array(there)], names=["archive", "size", "offset", "successor"])

    return blocks.repartition(tasks, F.col("archive"), F.col("start")).mapInArrow(run, "archive string, size long, offset long, successor long")


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which of the offsets (ascending) a chain of successors from offset 0 reaches, by pointer jumping."""
    n = len(offsets)
    to = np.searchsorted(offsets, successors)
    ok = to < n
    ok[ok] = offsets[to[ok]] == successors[ok]
    jump = np.append(np.where(ok, to, n), n)  # n: the end
    reach = np.zeros(n + 1, bool)
    reach[0] = n > 0 and offsets[0] == 0
    for _ in range(max(1, int(n).bit_length())):
        reach[jump[:n][reach[:n]]] = True
        jump = jump[jump]
    return reach[:n]


def chain(found: DataFrame) -> DataFrame:
    """The candidates that are records: those that the start of their archive reaches. Raises if a chain breaks before the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset", ignore_index=True)
        kept = pdf[reachable(pdf["offset"].to_numpy(), pdf["successor"].to_numpy())]
        size = int(pdf["size"].iloc[0])
        if not len(kept) or int(kept["successor"].iloc[-1]) != size:
            raise ValueError(f"archive {pdf['archive'].iloc[0]}: the chain of records ends before {size}")
        return kept

    return found.groupBy("archive").applyInPandas(run, found.schema)


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def read_records(spans: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record, by range reads. The digest and size of a response are those of the bytes read; a digest that
    differs from the record's own raises. Those of a revisit are what its record says."""

    def run(batches):
        fs, base = filesystem(folder)
        path, f = None, None
        for b in small_batches(batches, 512):
            rows = []
            for archive, offset, successor in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if archive != path:
                    if f:
                        f.close()
                    path, f = archive, fs.open_input_file(f"{base}/{archive}")
                data = f.read_at(successor - offset, offset)
                fields, at = parse_head(data, 0)
                body = data.index(b"\r\n\r\n", at) + 4
                http = data[at:body]
                payload = data[body : at + int(fields["content-length"])]
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response":
                    size = len(payload)
                    if payload_digest(payload) != digest:
                        raise ValueError(f"archive {archive}, offset {offset}: the payload's digest differs")
                else:
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                rows.append((archive, offset, _id(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, _id(fields.get("warc-refers-to")), size, digest, payload)[: 8 + with_payload])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = [x.split(" ")[0] for x in RECORD.split(", ")] + ["payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names[: len(rows[0])])
        if f:
            f.close()

    return spans.select("archive", "size", "offset", "successor").mapInArrow(run, RECORD + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, finds the records again and reads them."""
    folder = f"{shared_dir(pages.sparkSession)}/archives"
    archives = written(write_archives(with_referrals(pages), folder), "list")
    spans = chain(candidates(archives, folder)).repartition(tasks_for(archives), F.col("archive"), F.floor(F.col("offset") / BLOCK_BYTES)).sortWithinPartitions("archive", "offset")
    records = read_records(spans, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: Base32 in SQL: every five hexadecimal digits of a SHA-1 are four letters.
ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), s AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda c: list_reduce(list_transform(range(1, 6), lambda i: instr('0123456789abcdef', x[5 * c + i]) - 1), lambda a, b: a * 16 + b)) AS fives FROM s)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(flatten(list_transform(fives, lambda f: list_transform([15, 10, 5, 0], lambda q: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(f >> q) % 32 + 1]))), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, url FROM v
"""
