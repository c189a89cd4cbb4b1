"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a string's first j bytes depends on these bytes alone, so pre-tokens with a common prefix share it.
The different new pre-tokens of a batch are inserted in byte order, which builds their trie depth first: the path to the
last one is kept, a node's forward state is (best score, tokens of it), and of each pre-token only the nodes below the path
that it shares are scored. The state at a pre-token's end is its terminal count; terminal counts outlast the batch in a
bounded cache and are added up per document. Nodes do not outlast it: a trie kept over batches was measured 40 % slower, for
a node then costs a key of its own.

A piece of rank r has the score -log(r + 2) - log(Z), Zipf's law with the vocabulary's normaliser; every byte is a piece, so
every text can be segmented. Of equally good segmentations the one of fewest tokens counts.

Edge cases: null and empty texts have no tokens; repeated rows are counted each on its own; an empty table gives an empty
table; a very long pre-token costs its length times the longest piece; only id and text are read.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.bpe import load_ranks
from lodestone.llm.shared import documents, small_batches
from lodestone.llm.units import BoundedCache, SpaceSplit

RESULT = "doc_id long, n_pretokens long, n_tokens long, log_score double"


class Unigram:
    """Scores of pieces; count() gives (tokens, score) of each of some byte strings."""

    def __init__(self, vocabulary: list[bytes]):
        z = math.log(sum(1 / (r + 2) for r in range(len(vocabulary))))
        self.score = {piece: -math.log(r + 2) - z for r, piece in enumerate(vocabulary)}
        # the ends of pieces too, without a score: a walk back from a place stops where no piece ends so
        self.ends: dict[bytes, float | None] = {piece[i:]: None for piece in vocabulary for i in range(len(piece))}
        self.ends.update(self.score)
        self.scored = 0

    def count(self, strings: list[bytes]) -> dict[bytes, tuple[int, float]]:
        out: dict[bytes, tuple[int, float]] = {}
        find = self.ends.get
        best, tokens, last = [0.0], [0], b""
        for s in sorted(strings):
            shared = 0
            for x, y in zip(s, last):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for j in range(shared + 1, len(s) + 1):
                top, n = -math.inf, 0
                for i in range(j - 1, -1, -1):
                    value = find(s[i:j], 0.0)
                    if value is None:
                        continue
                    if not value:  # not the end of a piece; scores are below 0
                        break
                    value += best[i]
                    if value > top or value == top and tokens[i] + 1 < n:
                        top, n = value, tokens[i] + 1
                best.append(top)
                tokens.append(n)
            self.scored += len(s) - shared
            out[s] = (tokens[len(s)], best[len(s)])
            last = s
        return out


@functools.cache
def _model(ranks_path: str) -> Unigram:
    return Unigram(load_ranks(ranks_path))


class Counter:
    """Pre-tokens, tokens and score of whole texts."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.model, self.pattern = _model(ranks_path), regex.compile(pattern)
        self.known = BoundedCache()
        self.units = BoundedCache()

    def _all(self, texts: list[str]) -> list[tuple[int, int, float]]:
        found = [self.pattern.findall(t) for t in texts]
        known = self.known
        known.make_room()
        new = {t.encode(): t for t in set().union(*found).difference(known)}
        known.update({new[s]: x for s, x in self.model.count(list(new)).items()})
        out = []
        for f in found:
            terminal = [known[t] for t in f]
            out.append((len(f), sum(n for n, _ in terminal), sum(s for _, s in terminal)))
        return out

    def __call__(self, texts: list[str]) -> list[tuple[int, int, float]]:
        return SpaceSplit.summed(texts, self._all, self.units)


@functools.cache
def _counter(ranks_path: str, pattern: str) -> Counter:
    return Counter(ranks_path, pattern)


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and log_score of each whole text."""

    def run(batches):
        counter = _counter(ranks_path, pattern)
        for b in small_batches(batches):
            columns = zip(*counter(b.column(1).to_pylist()), strict=True)
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split(" ")[0] for x in RESULT.split(", ")])

    return documents(docs, id_col, text_col).mapInArrow(run, RESULT)
