import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lodestone.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    random.seed(1)
    parts = [" ", "\n", "a", "b", "'s", "1", ".", " the", "\t", "é", "\x1d", "_", "²", "　", "\x85", "日本", "👍🏽", "▁"]
    texts = ["", "a  b   c \n \n d ", " ", "it's 's ''s 12ab½²  ", "a" * 3000, "x " * 300, "\x00\x01 z"]
    texts += ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(5000)]
    got = bpe.ByteBpe(RANKS, P.PATTERN).encode_texts(texts)
    assert got == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_round_trip_and_edges(spark, library):
    rows = [(1, "Hello  world", "x"), (2, None, None), (3, "", "x"), (None, "ß ü\n", "x"), (4, "word " * 30000, "x"), (4, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.digests(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)).collect()
    assert len(out) == 6
    for r in out:
        text = next((t or "") for i, t, _ in rows if i == r.doc_id)
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).collect() == []
