import math
import random

import public_tokenizers as P
import regex

from lodestone.llm import token_counts
from lodestone.llm.bpe import load_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def brute(score, s):
    best = [(0.0, 0)]
    for j in range(1, len(s) + 1):
        options = [(best[i][0] + score[s[i:j]], best[i][1] + 1) for i in range(j) if s[i:j] in score]
        top = max(v for v, _ in options)
        best.append((top, min(n for v, n in options if v == top)))
    return best[-1][1], best[-1][0]


def test_shared_prefixes_change_nothing():
    vocabulary = [bytes([b]) for b in range(97, 103)] + [b"ab", b"abc", b"bcd", b"ef", b"cdef", b"fa"]
    model = token_counts.Unigram(vocabulary)
    rng = random.Random(1)
    strings = list({bytes(rng.choices(range(97, 103), k=rng.randint(1, 12))) for _ in range(2000)})
    assert model.count(strings) == {s: brute(model.score, s) for s in strings}


def test_documents(spark):
    rows = [(1, "Hello  world, hello world."), (2, None), (3, ""), (4, "word " * 20000), (5, "été 日本 \n x"), (5, "été 日本 \n x"), (None, "a" * 700), (6, "a \n \n b  ")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    out = token_counts.token_counts(docs, RANKS, P.PATTERN).collect()
    model = token_counts.Unigram(load_ranks(RANKS))
    assert len(out) == len(rows)
    for r in out:
        text = next((t or "") for i, t in rows if i == r.doc_id)
        pre = [t.encode() for t in regex.findall(P.PATTERN, text)]
        known = {t: brute(model.score, t) for t in set(pre)}
        assert (r.n_pretokens, r.n_tokens) == (len(pre), sum(known[t][0] for t in pre))
        assert math.isclose(r.log_score, sum(known[t][1] for t in pre), rel_tol=1e-9, abs_tol=1e-12)
    assert token_counts.token_counts(docs.limit(0), RANKS, P.PATTERN).collect() == []


def test_prefixes_are_scored_once():
    model = token_counts.Unigram([bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cd", b"bcd"])
    counts = model.count([b"abcdcd", b"abcdab", b"x", b"abcd"])
    assert model.scored == 9  # abcd, then ab and cd below it, and x
    assert counts == {s: brute(model.score, s) for s in counts}
