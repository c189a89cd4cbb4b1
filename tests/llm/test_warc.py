import base64
import hashlib

import numpy as np

from lodestone.llm import warc
from lodestone.llm.shared import shared_dir, written

SCHEMA = "page_id long, url string, html string, size int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_reachable():
    offsets = np.array([0, 10, 15, 30, 40, 44])
    assert warc.reachable(offsets, np.array([10, 30, 40, 44, 44, 60])).tolist() == [True, True, False, True, False, True]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]
    n = 1000
    assert warc.reachable(np.arange(n) * 7, np.arange(1, n + 1) * 7).all()


def test_round_trip(spark):
    inner = warc.record(77, "http://inner", b"payload", None, "1970-01-01T00:00:00Z").decode()
    rows = [(1, "http://a/\r\nX: y", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "u", "x" + inner + inner), (5, "u", "<p>one</p>"), (6, "u", "WARC/1.0\r\n" * 50)]
    rows += [(7, "u", "ß" * 70000), (8, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (9, "u", "<p>one</p>"), (9, "u", "<p>one</p>"), (None, "u", "<p>one</p>")]
    rows += [(100 + i, "u", f"page {i % 40}") for i in range(300)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    folder = f"{shared_dir(spark)}/archives"
    archives = written(warc.write_archives(warc.with_referrals(pages), folder, archive_bytes=20_000), "list")
    found = warc.candidates(archives, folder, block_bytes=4096)
    out = warc.read_records(warc.chain(found), folder, with_payload=True).collect()
    assert found.count() > len(rows) == len(out)
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out)
    expected = []
    for i, _, html in rows:
        to = last[html or ""]
        revisit = i is None or i < to
        expected.append((i or -1, len((html or "").encode()), digest(html), "revisit" if revisit else "response", to if revisit else -1))
    assert got == sorted(expected)
    assert all(bytes(r.payload).decode() == next(h or "" for i, _, h in rows if i == r.page_id) for r in out if r.record_type == "response")
    assert {r.url for r in out if r.page_id == 1} == {"http://a/%0D%0AX:%20y"}


def test_salted_join_and_empty(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i % 3}", 1) for i in range(40)], SCHEMA)
    key = lambda df: sorted((r.page_id, r.refers_to or -1) for r in df.collect())
    plain = key(warc.with_referrals(pages))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert key(warc.with_referrals(pages)) == plain
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_heads_across_the_ends_of_blocks(spark):
    """Records with urls far above head_bytes start all over a block and end beyond it; texts without an end follow."""
    rows = [(i, "http://e.com/" + "x" * (37 * i % 9000), "y" * (211 * i % 3000), 1) for i in range(120)]
    rows += [(200, "u" * 300_000, "WARC/1.0\r\n" + "z" * 5000, 1), (201, "last", "WARC/1.0\r\n", 1)]
    pages = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    folder = f"{shared_dir(spark)}/archives"
    archives = written(warc.write_archives(warc.with_referrals(pages, 10**9), folder), "list")
    found = warc.chain(warc.candidates(archives, folder, block_bytes=4096, head_bytes=64))
    assert sorted((r.page_id, r.url) for r in warc.read_records(found, folder).collect()) == [(i, u) for i, u, *_ in rows]


def naive_heads(data):
    out = []
    for at in range(len(data)):
        if head := warc.parse_head(data, at):
            out.append((at, head[1], int(head[0]["content-length"])))
    return out


def test_heads_against_each_place_alone():
    rng = np.random.default_rng(3)
    parts = [b"WARC/1.0\r\n", b"Content-Length: 5\r\n", b"content-length:%d\r\n" % 10**17, b"Content-Length: \xc2\xb2\r\n", b"a: b\r\n", b"\r\n", b"\r\n\r\n", b"x", b"a:", b"Content-Length: " + b"9" * 25 + b"\r\n"]
    for _ in range(3000):
        data = b"".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 14)))
        assert warc.heads(data) == naive_heads(data), data


def test_malformed_lengths_and_much_magic(spark):
    """Superscript digits, lengths beyond any archive, and magic on every line, with and without colons."""
    texts = ["WARC/1.0\r\nContent-Length: ²\r\n\r\n", "WARC/1.0\r\nContent-Length: " + "9" * 25 + "\r\n\r\n", "WARC/1.0\r\nContent-Length: " + "9" * 18 + "\r\n\r\n", "WARC/1.0\r\n" * 40_000, "a:WARC/1.0\r\n" * 40_000]
    rows = [(i, "u", t, 1) for i, t in enumerate(texts)]
    out = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.payload_digest) for r in out) == [(i, digest(t)) for i, t in enumerate(texts)]
