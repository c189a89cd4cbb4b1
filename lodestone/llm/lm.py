"""N-gram scoring with Elias-Fano tries (order 2, Dirichlet smoothing over an add-half unigram base).

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v) = (n(v, w) + mu p1(w)) / (c(v) + mu)

c, N and V are counts over the training texts, of words and one end per text; before a text's first word stands a start,
which counts once per training text. The tries hold log10 of the smoothed p(w | v) of every pair seen in training, quantised
to 8 bits in steps of its log odds; an unseen pair has mu p1(w) / (c(v) + mu) and needs no entry.

Texts are kept as blocks of word numbers. Three exchanges follow, each with one row per block and shard: words out, counts
and global ids back; word pairs out, codes back. A shard of pairs builds its trie and answers every block's pairs from it, by
successor search within the context. Pairs are dealt by context and, for a context seen often, by the word in as many parts as
its count asks for; a block sends each of its pairs once. Nothing that grows with the corpus is broadcast or collected, but two
numbers per shard of words, of 16 MB of text each.

Edge cases: a null or empty text is its end token alone; a null id is in the training part; without training texts every
token is unknown and p1 is 1/(V+1) with V = 0; repeated rows count as often as they occur; an empty table gives an empty
table; other columns never clash. Words are known by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.elias_fano import Trie
from lodestone.llm.shared import mix, pack_sorted, small_batches, text_bytes, unpack_sorted, word_hashes, word_spans, written

#: The hash that stands for a text's end; words are hashed with their length, which is at least 1.
END = np.uint64(0x452821E638D01377)
MIN_SHARD_BITS = 6
SHARD_BYTES = 16 << 20
#: A context that is seen more often is dealt by its words too, one part more for each so many times.
SPLIT_COUNT = 1 << 18
_UNKNOWN = np.iinfo(np.int64).max
_TEXTS = "block long, size long, doc_id array<long>, held array<boolean>, lengths array<int>, tokens binary, words binary, counts binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes without those that are all zero, so that few bytes are sent."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    """What planes() was given, as int64."""
    width = blob[0]
    part = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.reshape(-1).view(np.int64)


def tokenised(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts: ids, tokens per text, the tokens as numbers of the block's words, those words, their training counts."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in small_batches(batches, 1 << 18, 8 << 20):
            data, offsets = text_bytes(b.column(2))
            start, end, words = word_spans(data, offsets)
            lengths = words + 1
            ends = np.cumsum(lengths) - 1
            token = np.full(int(lengths.sum()), END, np.uint64)
            inner = np.ones(len(token), bool)
            inner[ends] = False
            token[inner] = word_hashes(data, start, end, lower=True)
            kinds, place = np.unique(token, return_inverse=True)
            trains = np.repeat(~b.column(1).to_numpy(zero_copy_only=False), lengths)
            counts = np.bincount(place[trains], minlength=len(kinds))
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), pa.concat_arrays([c])) for c in (b.column(0), b.column(1), pa.array(lengths, pa.int32()))]
            tokens = zlib.compress(planes(place), 1)
            row = [pa.array([task << 32 | n], pa.int64()), pa.array([len(data)], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in (tokens, pack_sorted(kinds), planes(counts)))]
            yield pa.RecordBatch.from_arrays(row, names=[x.split(" ")[0] for x in _TEXTS.split(", ")])
            n += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(run, _TEXTS), "texts")


def _names(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


def _cut(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, first, after) of each run of equal numbers."""
    if not len(shard):
        return []
    at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
    return [(int(shard[a]), a, z) for a, z in zip(at, [*at[1:], len(shard)], strict=True)]


def unigrams(texts: DataFrame, bits: int) -> DataFrame:
    """shard, block, counts, ids: for the block's words in the shard the training counts of the corpus and the number of the
    word among the shard's known words. Rows with a null block: total tokens and known words of the shard in n and v."""
    out = "shard int, block long, counts binary, ids binary, n long, v long"

    def send(batches):
        for b in batches:
            for block, words, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = unpack_sorted(words), unplanes(counts)
                rows = [(s, block, pack_sorted(words[a:z]), planes(counts[a:z])) for s, a, z in _cut((words >> np.uint64(64 - bits)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "block", "words", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        words = [unpack_sorted(x) for x in table.column("words").to_pylist()]
        counts = np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()])
        kinds, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, place, counts)
        number = np.cumsum(total > 0) - 1
        ends = np.cumsum([len(w) for w in words])
        rows = []
        for block, w, z in zip(blocks, words, ends.tolist(), strict=True):
            own = place[z - len(w) : z]
            rows.append((shard, block, planes(total[own]), planes(np.maximum(number[own], 0)), None, None))
        rows.append((shard, None, None, None, int(total.sum()), int((total > 0).sum())))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(out))

    sent = texts.select("block", "words", "counts").mapInArrow(send, "shard int, block long, words binary, counts binary")
    return written(sent.groupBy("shard").applyInArrow(merge, out), "unigrams")


class Block:
    """A block with the corpus' counts and ids of its words."""

    def __init__(self, tokens: bytes, lengths, answers: list[dict], base: dict[int, int], n_ids: int):
        answers = sorted(answers, key=lambda x: x["shard"])  # the words are ascending, and so are the shards
        self.count = np.concatenate([unplanes(x["counts"]) for x in answers])
        self.id = np.concatenate([unplanes(x["ids"]) + base[x["shard"]] for x in answers])
        self.token = unplanes(zlib.decompress(tokens))
        self.lengths = np.asarray(lengths, np.int64)
        first = np.cumsum(self.lengths) - self.lengths
        n_words = len(self.count)
        # the start has the number after the last word, in the block and in the corpus
        self.context = np.append(np.int64(n_words), self.token[:-1])
        self.context[first] = n_words
        self.id = np.append(self.id, n_ids)
        end = self.token[first + self.lengths - 1][0]
        self.context_count = np.append(self.count, self.count[end])
        self.pairs, self.place = np.unique(self.context * (n_words + 1) + self.token, return_inverse=True)
        left, right = self.pairs // (n_words + 1), self.pairs % (n_words + 1)
        known = np.flatnonzero((self.context_count[left] > 0) & (self.count[right] > 0))
        a, b = self.id[left[known]], self.id[right[known]]
        self.left = left
        parts = (1 + self.context_count[left[known]] // SPLIT_COUNT).astype(np.uint64)
        part = mix(b.astype(np.uint64)) % parts
        self.known, self.a, self.b, self.hash = known, a, b, mix(mix(a.astype(np.uint64)) + part)
        self.right = right

    def dealt(self, bits: int):
        """(order of the known pairs by shard, context and word; their shards in that order)."""
        shard = (self.hash >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((self.b, self.a, shard))
        return order, shard[order]


def code_values(total: int, known: int, mu: float, bins: int = 255) -> np.ndarray:
    """log10 of the probabilities that codes stand for: equal steps of log10 p / (1 - p), from the least smoothed probability
    that a seen pair can have up to 0.9999, so that values near 1, which long repetitions add up, are told apart as well."""
    least = (1 + mu * 1.5 / (total + 0.5 * (known + 1))) / (total + mu) if total else 0.5
    odds = 10.0 ** np.linspace(np.log10(least), 4.0, bins)
    return np.log10(odds / (1 + odds))


def pair_codes(joined: DataFrame, base: dict[int, int], n_ids: int, bits: int, mu: float, total: int, known: int) -> DataFrame:
    """shard, block, codes: the code of each pair of the block in the shard (0: not seen in training)."""

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                x = Block(row["tokens"], row["lengths"], row["answers"], base, n_ids)
                trains = np.repeat(~np.array(row["held"], bool), x.lengths)
                n = np.bincount(x.place[trains], minlength=len(x.pairs))[x.known]
                order, shard = x.dealt(bits)
                count, follows = x.context_count[x.left[x.known]], x.count[x.right[x.known]]
                rows = []
                for s, i, j in _cut(shard):
                    o = order[i:j]
                    context = x.a[o]
                    at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                    rows.append((s, row["block"], pack_sorted(context[at].astype(np.uint64)), planes(np.diff(np.append(at, j - i))), planes(count[o][at]), planes(x.b[o]), planes(n[o]), planes(np.where(n[o] > 0, follows[o], 0))))
                if rows:
                    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(sent_ddl))

    sent_ddl = "shard int, block long, contexts binary, sizes binary, context_counts binary, words binary, n binary, counts binary"

    def answer(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        queries, seen, weight = [], [], []
        for c, s, k, w, n, f in zip(*(table.column(x).to_pylist() for x in ("contexts", "sizes", "context_counts", "words", "n", "counts")), strict=True):
            sizes, n = unplanes(s), unplanes(n)
            grams = np.column_stack([np.repeat(unpack_sorted(c).astype(np.int64), sizes), unplanes(w)])
            queries.append(grams)
            here = n > 0
            seen.append(grams[here])
            weight.append(np.column_stack([n, np.repeat(unplanes(k), sizes), unplanes(f)])[here])
        grams, weight = np.concatenate(seen), np.concatenate(weight)
        order = np.lexsort((grams[:, 1], grams[:, 0]))
        grams, weight = grams[order], weight[order]
        new = np.append(True, (grams[1:] != grams[:-1]).any(axis=1))[: len(grams)]
        at = np.flatnonzero(new)
        n = np.add.reduceat(weight[:, 0], at) if len(at) else np.zeros(0, np.int64)
        p1 = (weight[at, 2] + 0.5) / (total + 0.5 * (known + 1))
        smoothed = (n + mu * p1) / (weight[at, 1] + mu)
        trie = Trie.from_buffer(Trie.build(grams[at], np.log10(smoothed), table=code_values(total, known, mu)).to_bytes())
        codes = []
        for q in queries:
            found = trie.find(q)
            code = np.zeros(len(q), np.uint8)
            code[found >= 0] = trie.codes[found[found >= 0]] + 1
            codes.append(code.tobytes())
        shard = table.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "codes": pa.array(codes, pa.binary())})

    return written(joined.mapInArrow(send, sent_ddl).groupBy("shard").applyInArrow(answer, "shard int, block long, codes binary"), "codes")


def score(docs: DataFrame, held: Column, mu: float = 500.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from the rows where ``held`` is not true and scores all rows. Columns: RESULT."""
    texts = tokenised(docs, held, id_col, text_col)
    size = texts.agg(F.sum("size")).first()[0] or 0
    bits = max(MIN_SHARD_BITS, (size // SHARD_BYTES).bit_length())
    answers = unigrams(texts, bits)
    shards = answers.where("block is null").select("shard", "n", "v").collect()  # 2 ** bits rows at most
    total, known = sum(r.n for r in shards), sum(r.v for r in shards)
    base, n_ids = {}, 0
    for r in sorted(shards, key=lambda r: r.shard):
        base[r.shard] = n_ids
        n_ids += r.v
    by_block = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "counts", "ids")).alias("answers"))
    joined = texts.drop("words", "counts").join(by_block, "block")
    codes = pair_codes(joined.select("block", "held", "lengths", "tokens", "answers"), base, n_ids, bits, mu, total, known)
    coded = codes.groupBy("block").agg(F.collect_list(F.struct("shard", "codes")).alias("codes"))
    table = np.append(0.0, code_values(total, known, mu))

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            helds = b.column(b.schema.get_field_index("held"))
            rest = b.select(["lengths", "tokens", "answers", "codes"])
            for i, row in enumerate(rest.to_pylist()):
                x = Block(row["tokens"], row["lengths"], row["answers"], base, n_ids)
                p1 = (x.count + 0.5) / (total + 0.5 * (known + 1))
                code = np.zeros(len(x.pairs), np.uint8)
                order, shard = x.dealt(bits)
                cuts = {s: (a, z) for s, a, z in _cut(shard)}
                for c in row["codes"] or ():
                    a, z = cuts[c["shard"]]
                    code[x.known[order[a:z]]] = np.frombuffer(c["codes"], np.uint8)
                n_words = len(x.count)
                back = mu / (x.context_count[x.left] + mu)
                pair = np.where(code > 0, table[code], np.log10(back * p1[x.pairs % (n_words + 1)]))
                at = np.cumsum(x.lengths) - x.lengths
                columns = [
                    ids[i].values, helds[i].values, pa.array(x.lengths), pa.array(np.add.reduceat((x.count > 0)[x.token].astype(np.int64), at)), pa.array(np.full(len(at), total)),
                    pa.array(np.add.reduceat(np.log10(p1)[x.token], at)), pa.array(np.add.reduceat(pair[x.place], at)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_names(RESULT))

    return joined.join(coded, "block", "left").mapInArrow(run, RESULT)


def score_held_out(docs: DataFrame) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 5 is not 1, scores all."""
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
