"""Removal of repeated word runs: suffixes split by variable-length prefixes, a suffix tree per group, its deep internal nodes.

A suffix is a word with the words behind it in its document, up to ``window`` of them. An internal node at that depth is a
run of words that starts in two places or more, and every such run is removed. Equality is that of the words; hashes only
deal suffixes to groups.

Shipping each suffix's words would take ``window`` times the text. So suffixes are split by a prefix that neighbours share:
the one that starts at the anchor, the place within reach at which the next PREFIX words have the least hash. Equal
suffixes have equal anchors, and neighbours with one anchor travel as one run of text. Where more suffixes share a prefix
than a group should hold, the prefix is lengthened to the whole suffix. The number of groups follows from the corpus' size.

A block builds the tree of its own suffixes when it is written, keeps with its texts what later passes need of it, and sends one suffix per node, so a passage that a third of all documents
share costs one suffix a block. A group builds its subtree over what the blocks sent and answers with one bit per suffix, in files of the
shared folder that the tasks over the blocks read.
Runs of overlapping repeats are removed as one.

Edge cases: null and empty texts have no words; documents of fewer than ``window`` words have no suffix of that depth; a
repeated row is a second occurrence, and both lose the run; an empty table gives an empty table; a very long document is in
a block of its own; columns to carry keep their names, whatever they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.blocks import column, to_blocks
from lodestone.llm.shared import filesystem, give_back, joined_words, mix, shared_dir, text_bytes, window_hashes, word_hashes, word_spans, written

WINDOW = 35
#: Bytes of text behind a group: its blocks send about three times as many before compression.
GROUP_BYTES = 4 << 20
#: Bytes of text of a block, whose tree takes some 16 times as many.
BLOCK_BYTES = 8 << 20
MIN_GROUP_BITS = 6
#: Bytes that a task gathers before it hands them on.
SENT_BYTES = 1 << 20
#: Suffixes are counted by this many leading bits of their prefixes' hashes: a table of one size for every corpus.
TABLE_BITS = 16
#: Suffixes beyond the mean of the table's places at which a prefix is lengthened.
HOT_SUFFIXES = 1 << 18


def prefix_words(window: int) -> int:
    """Words of a prefix that is not lengthened."""
    return max(1, window // 4)


def word_numbers(text: np.ndarray, bounds: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(a number for each word, equal for equal words only; a hash of each word, if asked for); each word ends with a separator."""
    array = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(text)]).dictionary_encode()
    number = array.indices.to_numpy(zero_copy_only=False)  # 32 bits
    if not hashed:
        return number, None
    data, offsets = text_bytes(array.dictionary)
    return number, word_hashes(data, offsets[:-1], offsets[1:] - 1, lower=False)[number] if len(number) else np.zeros(0, np.uint64)


def deep_nodes(number: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The node at ``depth`` words of the suffix that starts at each of the places ``at``; -1 where it is a leaf by then.

    The tree grows from its root down, all nodes of a level at once: suffixes of a node part by their next words, as many
    as fit in a key, and one that is alone is a leaf and goes no deeper.
    """
    out = np.full(len(at), -1, np.int64)
    alive, node, nodes, deep = np.arange(len(at)), np.zeros(len(at), np.int64), 1, 0
    bits = max(1, int(number.max(initial=0)).bit_length())
    while deep < depth and len(alive):
        step = min(depth - deep, max(1, (63 - (nodes - 1).bit_length()) // bits))
        key = node
        for k in range(deep, deep + step):
            key = key << bits | number[at[alive] + k].astype(np.int64)
        order = np.argsort(key)
        ranked = key[order]
        head = np.append(True, ranked[1:] != ranked[:-1])
        inner = np.diff(np.append(np.flatnonzero(head), len(ranked))) > 1
        kind = np.cumsum(head) - 1
        stays = inner[kind]
        del key, ranked, head
        alive, node, nodes = alive[order[stays]], (np.cumsum(inner) - 1)[kind[stays]], int(inner.sum())
        deep += step
    out[alive] = node
    return out


def least_ahead(values: np.ndarray, span: int) -> np.ndarray:
    """For each place the first one of the least value among the ``span`` values from it on."""
    at, have = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while have < span and len(at):
        step = min(have, span - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        have += step
    return at


#: What a block keeps of its tree, beside its texts: bits by suffix and, for each run of neighbours with one anchor, a hash.
KEPT = ("repeated", "first", "opens", "prefixes", "shared")


def read_words(texts: pa.Array, window: int):
    """(bytes of the words with a line feed behind each, where each starts, words per document, the places where suffixes start)."""
    data, offsets = text_bytes(texts)
    start, end, words = word_spans(data, offsets)
    left = np.repeat(np.cumsum(words), words) - np.arange(len(start))  # words from here to the document's end
    return *joined_words(data, start, end), words, np.flatnonzero(left >= window)


def own_tree(texts: pa.Array, window: int) -> dict[str, bytes]:
    """The columns KEPT: which suffixes the block has twice or more, which are the first of their node, which open a run of
    neighbours with one anchor, 32 bits of each run's prefix hash and how many suffixes it has."""
    text, bounds, _, place = read_words(texts, window)
    number, hashes = word_numbers(text, bounds)
    del text, bounds
    n = prefix_words(window)
    prefix = window_hashes(hashes, n)
    del hashes
    anchor = least_ahead(prefix, window - n + 1)[place] if len(place) else place
    opens = np.append(True, (np.diff(place) != 1) | (np.diff(anchor) != 0))[: len(place)]
    at = np.flatnonzero(opens)
    # the least of many hashes is small: mixed again, so that groups are even
    runs = (mix(prefix[anchor[at]] + np.uint64(1)) >> np.uint64(32)).astype(np.uint32), np.diff(np.append(at, len(place))).astype(np.uint32)
    del prefix, anchor
    node = deep_nodes(number, place, window)
    repeated = node >= 0
    first = ~repeated
    again = np.flatnonzero(repeated)
    first[again[np.unique(node[again], return_index=True)[1]]] = True
    values = (np.packbits(repeated), np.packbits(first), np.packbits(opens), *runs)
    del number, node, place
    give_back()
    return {name: x.tobytes() for name, x in zip(KEPT, values, strict=True)}


def _flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


class Suffixes:
    """The suffixes of a block in the order in which it sends them: by group, runs of neighbours with one anchor together."""

    def __init__(self, block: pa.RecordBatch, row: int, window: int, group_bits: int, hot: np.ndarray, text_col: str):
        repeated, first, opens, prefixes = (block.column(block.schema.get_field_index(c))[row].as_py() for c in KEPT[:4])
        self.text, self.bounds, self.words, self.place = read_words(column(block, row, text_col), window)
        n, self.window = len(self.place), window
        self.repeated = _flags(repeated, n)
        run = np.cumsum(_flags(opens, n)) - 1
        sent = np.flatnonzero(_flags(first, n))
        run = run[sent]
        key = np.frombuffer(prefixes, np.uint32)[run]
        longer = hot[key >> np.uint32(32 - TABLE_BITS)]
        text, key = memoryview(self.text), key.copy()
        for i in np.flatnonzero(longer).tolist():  # the prefix is the whole suffix
            p = self.place[sent[i]]
            key[i] = int.from_bytes(hashlib.blake2b(text[self.bounds[p] : self.bounds[p + window]], digest_size=4).digest(), "big")
        group = (key >> np.uint32(32 - group_bits)).astype(np.int64)
        heads = np.append(True, (np.diff(sent) != 1) | (np.diff(run) != 0) | longer[1:] | longer[:-1])[: len(sent)]
        order = np.argsort(group, kind="stable")
        self.sent, self.group, self.heads = sent[order], group[order], heads[order]

    def cuts(self) -> list[tuple[int, int, int]]:
        """(group, from, to) among the sent suffixes."""
        at = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])[: len(self.group)]).tolist()
        return [(int(self.group[a]), a, z) for a, z in zip(at, [*at[1:], len(self.group)])]

    def runs(self, a: int, z: int) -> tuple[np.ndarray, bytes]:
        """(suffixes in each run, the words of all runs) of the sent suffixes from a to z."""
        heads = np.flatnonzero(self.heads[a:z])
        sizes = np.diff(np.append(heads, z - a))
        place = self.place[self.sent[a:z][heads]]
        text = memoryview(self.text)
        return sizes, b"".join([text[i:j] for i, j in zip(self.bounds[place].tolist(), self.bounds[place + sizes + self.window - 1].tolist())])


def hot_prefixes(blocks: DataFrame, hot_suffixes: int) -> np.ndarray:
    """Which places of the table hold a prefix that many suffixes share: a table of 2 ** TABLE_BITS flags."""

    def run(batches):
        total = np.zeros(1 << TABLE_BITS)
        for b in batches:
            for row in b.to_pylist():
                place = np.frombuffer(row["prefixes"], np.uint32) >> np.uint32(32 - TABLE_BITS)
                total += np.bincount(place, weights=np.frombuffer(row["shared"], np.uint32), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["place", "n"])

    counts = written(blocks.select("prefixes", "shared").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")), "prefixes")
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << TABLE_BITS)
    hot = np.zeros(1 << TABLE_BITS, bool)
    hot[[r.place for r in counts.where(F.col("n") > 2 * mean + hot_suffixes).collect()]] = True
    return hot


def repeated_suffixes(blocks: DataFrame, window: int, group_bits: int, hot: np.ndarray, text_col: str = "text") -> DataFrame:
    """group, block, bits: which of the suffixes that the block sent to the group, in that order, start in another block too."""

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["group", "block", "sizes", "words"])

    def send(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for row in range(b.num_rows):
                x = Suffixes(b, row, window, group_bits, hot, text_col)
                rows, held = [], 0
                for group, a, z in x.cuts():
                    sizes, text = x.runs(a, z)
                    rows.append((group, b.column(0)[row].as_py(), pack.compress(sizes.astype(np.uint32).tobytes()), pack.compress(text)))
                    held += len(rows[-1][3])
                    if held > SENT_BYTES:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)
        give_back()

    def meet(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        sizes = [np.frombuffer(unpack.decompress(x.as_py()), np.uint32).astype(np.int64) for x in table.column("sizes")]
        text = np.frombuffer(b"".join([unpack.decompress(x.as_py()) for x in table.column("words")]), np.uint8)
        number, _ = word_numbers(text, np.append(0, np.flatnonzero(text == 0x0A) + 1), hashed=False)
        run = np.concatenate(sizes)
        # a run of n suffixes has window - 1 words more
        at = np.arange(int(run.sum())) + np.repeat(np.arange(len(run)) * (window - 1), run)
        hit = deep_nodes(number, at, window) >= 0
        ends, out = np.cumsum([int(x.sum()) for x in sizes]), []
        for block, x, z in zip(table.column("block").to_pylist(), sizes, ends.tolist(), strict=True):
            own = hit[z - int(x.sum()) : z]
            if own.any():
                out.append((table.column("group")[0].as_py(), block, zstandard.compress(np.packbits(own).tobytes())))
        group, block, bits = zip(*out) if out else ((), (), ())
        del text, number, at, run
        give_back()
        return pa.table({"group": pa.array(group, pa.int32()), "block": pa.array(block, pa.int64()), "bits": pa.array(bits, pa.binary())})

    rows = blocks.select("block", *KEPT, f"c_{text_col}").mapInArrow(send, "group int, block long, sizes binary, words binary")
    return rows.groupBy("group").applyInArrow(meet, "group int, block long, bits binary")


def covered(words: np.ndarray, place: np.ndarray, hit: np.ndarray, window: int) -> np.ndarray:
    """Which words a repeated window covers."""
    edge = np.zeros(int(words.sum()) + 1, np.int32)
    np.add.at(edge, place[hit], 1)
    np.add.at(edge, place[hit] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def dedup(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", hot_suffixes: int = HOT_SUFFIXES) -> DataFrame:
    """The carried columns, n_words, n_removed, kept (the words left, joined by one space) and repeats: (start, end) in words
    of each maximal run of repeated windows."""
    docs = docs.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    blocks = to_blocks(docs.select(*dict.fromkeys([*carry, text_col])), BLOCK_BYTES, text_col, more=lambda texts: own_tree(texts, window), more_names=KEPT)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(MIN_GROUP_BITS, (size // GROUP_BYTES).bit_length())
    hot = hot_prefixes(blocks, hot_suffixes)
    # one folder for each task's blocks: whoever reads the blocks fetches their answers, and no text is sent again
    path = f"{shared_dir(docs.sparkSession)}/bits"
    answers = repeated_suffixes(blocks, window, bits, hot, text_col).withColumn("part", F.shiftright("block", 32))
    answers.repartition("part").write.option("compression", "zstd").partitionBy("part").parquet(path)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("repeats", span)])

    def apply(batches):
        files, folder = filesystem(path)
        cache: dict[int, dict[int, dict[int, bytes]]] = {}

        def answers_of(block: int) -> dict[int, bytes]:
            part = block >> 32
            if part not in cache:
                cache.clear()
                cache[part] = {}
                if files.get_file_info(f"{folder}/part={part}").type != fs.FileType.NotFound:  # none: nothing is repeated
                    for x in pq.read_table(f"{folder}/part={part}", filesystem=files, columns=["block", "group", "bits"], partitioning=None).to_pylist():
                        cache[part].setdefault(x["block"], {})[x["group"]] = x["bits"]
            return cache[part].get(block, {})

        for b in batches:
            for row in range(b.num_rows):
                texts = column(b, row, text_col)
                x = Suffixes(b, row, window, bits, hot, text_col)
                words, hit = x.words, x.repeated
                answered = answers_of(b.column(b.schema.get_field_index("block"))[row].as_py())
                for group, a, z in x.cuts():
                    if group in answered:
                        hit[x.sent[a:z]] |= _flags(zstandard.decompress(answered[group]), z - a)
                gone = covered(words, x.place, hit, window)
                ends = np.cumsum(words)
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(ends - words, len(gone))) * (words > 0)
                for at in range(0, len(texts), 1000):
                    part = texts.slice(at, 1000)
                    kept, spans = [], []
                    for text, n, end, lost in zip(part.to_pylist(), words[at : at + 1000].tolist(), ends[at : at + 1000].tolist(), removed[at : at + 1000].tolist(), strict=True):
                        split = text.encode().split()
                        if not lost:
                            kept.append(b" ".join(split))
                            spans.append([])
                            continue
                        mask = gone[end - n : end]
                        kept.append(b" ".join([split[i] for i in np.flatnonzero(~mask).tolist()]))
                        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).reshape(-1, 2)
                        spans.append([{"start": s, "end": e} for s, e in edge.tolist()])
                    own = [column(b, row, c).slice(at, 1000) for c in carry]
                    more = [pa.array(words[at : at + 1000], pa.int64()), pa.array(removed[at : at + 1000], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    yield pa.RecordBatch.from_arrays([*own, *more], names=schema.names)

    return blocks.mapInArrow(apply, schema)


ORACLE = r"""
WITH u AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
h AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, n - 33)) AS i FROM u WHERE n >= 35)),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h SEMI JOIN r USING (k)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS p FROM u) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT u.doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM u LEFT JOIN t USING (doc_id)
"""
