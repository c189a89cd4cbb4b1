import hashlib
import tarfile
import zlib

from lodestone.llm import media
from lodestone.llm.shared import filesystem, shared_dir, written


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 9, b"x" * 576, "é日本".encode() * 500):
        payload = media.pad(data)
        png = media.to_png(payload)
        assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
        assert media.from_png(png) == payload
        assert media.read_header(png[:33]) == (576, len(payload) // 576, 8)


def test_columns(spark):
    rows = [(1, "abc", 0), (2, None, 0), (3, "", 0), (4, "z" * 200_000, 0), (5, "abc", 0), (5, "abc", 0), (None, "ß", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(2)
    out = media.media_columns(docs).collect()
    assert len(out) == 7
    for r in out:
        data = next((t or "") for i, t, _ in rows if i == r.doc_id).encode()
        payload = media.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.width, r.height) == (len(data), len(payload), 576, len(payload) // 576)
        assert r.payload_sha256 == r.digest == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (r.length, hashlib.sha256(media.to_png(payload)).hexdigest())
    assert len({r.feature for r in out if r.doc_id in (1, 5)}) == 1 == len({r.feature for r in out if r.doc_id in (2, 3)})
    assert media.media_columns(docs.limit(0)).collect() == []


def test_shards_are_tar_files(spark):
    folder = f"{shared_dir(spark)}/shards"
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(50)], "doc_id long, text string").coalesce(1)
    index = written(media.store(docs, folder, shard_bytes=3000), "index").collect()
    fs, base = filesystem(folder)
    paths = {r.shard for r in index}
    assert len(paths) > 1
    for p in paths:
        with tarfile.open(f"{base}/{p}") as t:
            members = {m.name: (m.offset_data, m.size) for m in t.getmembers()}
        assert members == {f"{r.digest}.png": (r.offset, r.length) for r in index if r.shard == p}


def test_a_payload_is_stored_once(spark, monkeypatch):
    """Copies in many tasks, with and without ids, by broadcast and by salted keys."""
    rows = [(i, ("same", "other " * 500, f"own {i}")[i % 3]) for i in range(90)] + [(None, "same"), (None, "nobody"), (None, "nobody"), (7, "own 7"), (200, None), (201, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(6)
    for most in (media.BROADCAST_ROWS, 0):
        monkeypatch.setattr(media, "BROADCAST_ROWS", most)
        folder = f"{shared_dir(spark)}/shards"
        index = media.store(docs, folder).collect()
        assert len(index) == len(rows)
        digest = lambda t: hashlib.sha256(media.pad((t or "").encode())).hexdigest()
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.digest, r.n_bytes)) for r in index) == sorted((i is None, i or 0, digest(t), len((t or "").encode())) for i, t in rows)
        places = {(r.digest, r.shard, r.offset, r.length) for r in index if r.digest != digest("nobody")}
        assert len(places) == len({digest(t) for _, t in rows} - {digest("nobody")})
    assert media.media_columns(docs.limit(0)).collect() == []
