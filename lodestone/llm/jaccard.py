"""Exact Jaccard join of shingle sets by universe partition and pigeonhole.

Sizes fall into bands; a set's partners are in its own band or the next. A band's scheme deals the universe of shingles into
segments. Sets x and y of Jaccard at least t differ in at most H = (1-t)/(1+t) (x+y) shingles, so of n segments at least
n - H are equal in both. The scheme of a pair is that of the larger set's band: a set writes the keys of its segments in its
own scheme and in the next. Where sets are small, a segment may be worth two: with its one-deletion neighbourhood (its
content, and its content less one shingle) it also matches when one shingle differs, and n - H/2 segments match.
``allocate`` chooses per band between the two, and the number of segments beyond the least possible, by their cost.

Allocation by frequency. Keys meet in key ranges, whose number grows with the corpus. A key with at most SMALL sets is worth
all its pairs; a pair stays a candidate if the keys that it shares, and all common keys of either set, are as many as it must
share. A key with more is common, such as a segment that lies in a passage that many documents share; it is worth
nothing as long as a set can do without it. A pair of which one set has fewer common segments than the pair must share also
shares a key that is not common, and is found there. What is left are saturated sets, made of common segments throughout:
in practice the members of large groups of near copies. A saturated set keeps its rarest common keys, as many as a linked
pair can avoid and one more (prefixes in one order over all sets). Each kept key pairs its members with its hub, the
member with the largest share of common segments; links make components. Components with a kept key in common are a field:
no two saturated sets of different fields link. So every link of which one set is not saturated is found as a pair. Links
between two saturated sets are counted in tiles: the saturated sets of a component are cut into blocks, and a task compares two.

Equal sets are one from the start: a block of documents sends a set once, and equal sets of different blocks are one class.
Every candidate pair is bounded by sizes and by a 256-bit parity sketch and then verified on the whole sets.

Edge cases: null or empty text has the empty set and links with nothing; with fewer than k words the whole sequence is the
one shingle; repeated rows and ties are equal sets and form one component; an empty table gives an empty table; a component takes
its smallest non-null id; a very long text is a large set in a block of its own; only id and text are read, so other columns
never clash. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import documents, mix, pack_sorted, small_batches, text_bytes, unpack_sorted, window_hashes, word_hashes, word_spans, written

#: A key with more sets is common.
SMALL = 8
#: Bytes of text behind a key range, and the least number of ranges.
RANGE_BYTES, MIN_RANGES = 12 << 20, 64
#: Bytes of text of a block of documents.
BLOCK_BYTES = 4 << 20
#: Candidate ids that may be broadcast, of 8 bytes each, when their texts are fetched.
BROADCAST_IDS = 400_000
#: A block of a component has about so many sets and shingles at most; a tile compares two blocks.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
#: Columns of a tile that are multiplied at once; counts below 2^24 are exact in 32-bit floats.
COLUMNS = 4096
_C1, _C2, _C3 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)


# ---------------------------------------------------------------- sets


def shingle_sets(texts: pa.Array, k: int = 5):
    """(set size per document, all sets one after another, each ascending)."""
    data, offsets = text_bytes(texts)
    start, end, words = word_spans(data, offsets)
    hashed = word_hashes(data, start, end, lower=True)
    doc = np.repeat(np.arange(len(words)), words)
    grams = window_hashes(hashed, k)
    inside = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    value, owner = grams[inside], doc[: len(grams)][inside]
    first = np.cumsum(words) - words
    for d in np.flatnonzero((words > 0) & (words < k)).tolist():  # few words: their sequence is the one shingle
        own = window_hashes(hashed[first[d] : first[d] + words[d]], int(words[d])) + np.uint64(words[d])
        value, owner = np.append(value, own), np.append(owner, d)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return np.bincount(owner, minlength=len(words)), value


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of values; 0 for an empty run."""
    total = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    at = np.append(0, np.cumsum(sizes))
    return total[at[1:]] - total[at[:-1]]


def fingerprints(sizes: np.ndarray, value: np.ndarray):
    """Two 64-bit sums by which equal sets are known, and the parity sketch: 4 words of 64 bits.

    The sketch has the parity of the number of shingles at each of 256 places, so two sketches differ in at most as many
    bits as their sets differ in shingles.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    parity = np.bincount(owner * 256 + (value >> np.uint64(11) & np.uint64(255)).astype(np.int64), minlength=len(sizes) * 256) & 1
    sketch = np.packbits(parity.astype(np.uint8).reshape(-1, 256), axis=1).view(np.int64)
    return sums(mix(value ^ _C1), sizes), sums(mix(value ^ _C2), sizes), sketch


# ---------------------------------------------------------------- bands and schemes


@functools.cache
def scheme(band: int, t: Fraction) -> tuple[int, int, int, int]:
    """(least size, greatest size, segments, worth of a segment: 1 whole, 2 with its one-deletion neighbourhood) of a band."""
    low = scheme(band - 1, t)[1] + 1 if band else 1
    high = math.floor(low / t)
    return low, high, *allocate(low, high, differ(high, high, t))


def differ(x: int, y: int, t: Fraction) -> int:
    """At most so many shingles are in one of two linked sets of these sizes and not in the other."""
    return math.floor((1 - t) / (1 + t) * (x + y))


def allocate(low: int, high: int, most: int, hot: float = 5_000.0) -> tuple[int, int]:
    """(segments, worth) of least cost. A set costs the keys that it writes, and ``hot`` times the chance that it has more
    segments that are not selective (empty; with a neighbourhood also of one shingle) than it may skip."""
    best = None
    for worth in (1, 2):
        need = -(-(most + 1) // worth)
        for spare in range(0, max(2, most // 2) + 1):
            n = need + spare
            mean = n * (math.exp(-low / n) if worth == 1 else (1 + low / n) * math.exp(-low / n)) if n > 1 else 0.0
            tail, term = 1.0, math.exp(-mean)
            for i in range(spare + 1):
                tail -= term
                term *= mean / (i + 1)
            cost = (n if worth == 1 else n + (low + high) / 2) + hot * max(tail, 0.0)
            if best is None or cost < best[0]:
                best = (cost, n, worth)
    return best[1], best[2]


def bands_of(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """The band of each size (sizes of at least 1)."""
    most, ends = int(sizes.max(initial=0)), []
    while not ends or ends[-1] < most:
        ends.append(scheme(len(ends), t)[1])
    return np.searchsorted(np.array(ends), sizes)


def keys(sizes: np.ndarray, value: np.ndarray, t: Fraction):
    """All keys of sets: (key, place of the set among the given ones, 0 in its own scheme or 1 in the next); and by
    scheme and set the least number of segments that have a key in common with any set that it links with."""
    out = []
    here = np.flatnonzero(sizes > 0)
    band = np.zeros(len(sizes), np.int64)
    band[here] = bands_of(sizes[here], t)
    content = mix(value ^ _C3)
    sure = np.zeros((2, len(sizes)), np.int64)
    for up in (0, 1):
        n_seg, worth, salt = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for b in np.unique(band[here]).tolist():
            low, high, segments, w = scheme(b + up, t)
            for s in np.unique(sizes[here][band[here] == b]).tolist():
                partner = min(high, math.floor(s / t))
                if partner >= low:
                    rows = sizes == s
                    n_seg[rows], worth[rows], salt[rows] = segments, w, b + up
                    sure[up, rows] = segments - differ(s, partner, t) // w
        member = np.repeat(n_seg > 0, sizes)
        v, c = value[member], content[member]
        owner = np.repeat(np.arange(len(sizes)), sizes)[member]
        base = np.cumsum(n_seg) - n_seg
        total = int(n_seg.sum())
        slot = base[owner] + ((v >> np.uint64(32)) * n_seg[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        count = np.bincount(slot, minlength=total)
        whole = sums(c[order], count)
        slot_owner = np.repeat(np.arange(len(sizes)), n_seg)
        place = np.arange(total) - base[slot_owner]
        tag = mix((salt[slot_owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64))
        # keys of no content are common beyond doubt: a set that can do without its segments that have one leaves them out
        bare = count < worth[slot_owner]
        left = sure[up] - np.bincount(slot_owner[bare], minlength=len(sizes))
        leaves = left >= 1
        sure[up] = np.where(n_seg > 0, np.maximum(left, 1), 0)
        kept = (count > 0) | ~leaves[slot_owner]
        out.append((mix(whole + tag)[kept], slot_owner[kept], np.full(int(kept.sum()), up, np.int8)))
        s = slot[order]
        two = (worth[slot_owner[s]] == 2) & ((count[s] > 1) | ~leaves[slot_owner[s]])
        s, less = s[two], order[two]
        out.append((mix(whole[s] - c[less] + tag[s]), slot_owner[s], np.full(len(s), up, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)), sure


# ---------------------------------------------------------------- candidates

_SKETCH = ("s0", "s1", "s2", "s3")
_SENT = "range int, block long, sets binary, docs binary, keys binary, members binary, ups binary"
_MET = "kind int, a long, b long, doc_id long, n long, f0 long, f1 long, s0 long, s1 long, s2 long, s3 long, sure0 long, sure1 long, up byte"
_SETS = ("n", "f0", "f1", *_SKETCH, "sure0", "sure1")


def _names(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers by the least width that holds them, which comes first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if x.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _widened(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32}[blob[0]], offset=1).astype(np.int64)


def _send(docs: DataFrame, t: Fraction, k: int, key_bits: int, range_bits: int) -> DataFrame:
    """A row per key range and block with the keys of the block's different sets; and one (range below 0) with its sets
    (number, sketch, least id) and its documents (id, set)."""
    shift, ranges = np.uint64(64 - key_bits), 1 << range_bits

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in small_batches(batches, 1 << 20, BLOCK_BYTES):
            sizes, value = shingle_sets(b.column(1), k)
            f0, f1, sketch = fingerprints(sizes, value)
            block = task << 40 | n << 20
            ids = b.column(0)
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy().view(np.int64)
            # the different sets, each with its least id
            order = np.lexsort((ids, ~known, f1, f0, sizes))
            new = np.append(True, (sizes[order][1:] != sizes[order][:-1]) | (f0[order][1:] != f0[order][:-1]) | (f1[order][1:] != f1[order][:-1]))
            first = order[new]
            number = np.empty(len(sizes), np.int64)
            number[order] = np.cumsum(new) - 1
            own = np.zeros(len(sizes), bool)
            own[first] = True
            mine = np.repeat(own, sizes)
            chosen = np.flatnonzero(own)  # in order of arrival
            (key, member, up), sure = keys(sizes[chosen], value[mine], t)
            member = number[chosen][member]
            table = np.column_stack([ids[chosen], known[chosen].astype(np.int64), number[chosen], sizes[chosen], f0[chosen].view(np.int64), f1[chosen].view(np.int64), sketch[chosen], sure.T])
            documents_ = np.column_stack([ids, known.astype(np.int64), number, sizes])
            rows = [(-1 - (task * 31 + n) % ranges, block, table.tobytes(), documents_.tobytes(), b"", b"", b"")]
            n += 1
            key >>= shift
            order = np.argsort(key, kind="stable")
            key, member, up = key[order], member[order], up[order]
            cuts = [0, *np.searchsorted(key, np.arange(1, ranges).astype(np.uint64) << np.uint64(key_bits - range_bits)).tolist(), len(key)]
            for r in range(ranges):
                a, z = cuts[r], cuts[r + 1]
                if a < z:
                    rows.append((r, block, b"", b"", pack_sorted(key[a:z]), _narrow(member[a:z]), np.packbits(up[a:z]).tobytes()))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=_names(_SENT))

    return docs.mapInArrow(run, _SENT)


def _row_table(rows: int, /, **columns) -> pa.Table:
    """A table of _MET with the given columns and nulls elsewhere."""
    out = {}
    for name, kind in (x.split(" ") for x in _MET.split(", ")):
        t = {"int": pa.int32(), "long": pa.int64(), "byte": pa.int8()}[kind]
        out[name] = pa.array(columns[name], t) if name in columns else pa.nulls(rows, t)
    return pa.table(out)


def _meet(table: pa.Table) -> pa.Table:
    """kind 0: sets (a: number). kind 1: candidate pairs (a < b), with the number of keys that they share (n) and whose next
    scheme it is (up; 0: neither's, 1: a's, 2: b's). kind 2: sets (b) of a common key (a), with scheme. kind 3: documents and their sets (a)."""
    if table.column("range")[0].as_py() < 0:
        parts = []
        for block, sets, docs in zip(*(table.column(c).to_pylist() for c in ("block", "sets", "docs")), strict=True):
            x, d = np.frombuffer(sets, np.int64).reshape(-1, 12), np.frombuffer(docs, np.int64).reshape(-1, 4)
            own = {name: x[:, 3 + i] for i, name in enumerate(_SETS)}
            parts.append(_row_table(len(x), kind=np.zeros(len(x), np.int32), a=block + x[:, 2], doc_id=pa.array(x[:, 0], mask=x[:, 1] == 0), **own))
            parts.append(_row_table(len(d), kind=np.full(len(d), 3, np.int32), a=block + d[:, 2], doc_id=pa.array(d[:, 0], mask=d[:, 1] == 0), n=d[:, 3]))
        return pa.concat_tables(parts)
    key, member, up = [], [], []
    for block, k, m, u in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "members", "ups")), strict=True):
        own = unpack_sorted(k)
        key.append(own)
        member.append(block + _widened(m))
        up.append(np.unpackbits(np.frombuffer(u, np.uint8), count=len(own)).view(np.int8))
    key, member, up = (np.concatenate(x) for x in (key, member, up))
    order = np.argsort(key, kind="stable")
    key, member, up = key[order], member[order], up[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    useful = (size > 1) & (np.minimum.reduceat(up, start) == 0)  # sets that all only look ahead meet in their own scheme
    start, size = start[useful], size[useful]
    pairs = []
    for n in range(2, SMALL + 1):
        rows = start[size == n][:, None] + np.arange(n)
        if len(rows):
            i, j = np.triu_indices(n, 1)
            m, u = member[rows], up[rows]
            ok = (u[:, i] & u[:, j]) == 0
            pairs.append(np.column_stack([m[:, i][ok], m[:, j][ok], u[:, i][ok], u[:, j][ok]]))
    out = []
    if pairs:
        x, y, x_up, y_up = np.concatenate(pairs).T
        swap = x > y
        x, y, both_up = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, y_up + 2 * x_up, x_up + 2 * y_up)
        order = np.lexsort((both_up, y, x))[: len(x)]
        x, y, both_up = x[order], y[order], both_up[order]
        head = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (both_up[1:] != both_up[:-1]))[: len(x)])
        shared = np.diff(np.append(head, len(x)))
        out.append(_row_table(len(head), kind=np.ones(len(head), np.int32), a=x[head], b=y[head], n=shared, up=both_up[head]))
    many = np.flatnonzero(np.repeat(size > SMALL, size))
    at = (np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))[many]
    out.append(_row_table(len(at), kind=np.full(len(at), 2, np.int32), a=key[at].view(np.int64), b=member[at], up=up[at]))
    return pa.concat_tables(out)


# ---------------------------------------------------------------- verification


def _possible(t: Fraction, x: str, y: str):
    """Whether sizes and sketches of two sets allow a link; x, y: what their columns' names begin with."""
    num, den = t.numerator, t.denominator
    col = lambda side, c: F.col(f"{side}_{c}")
    sketch = functools.reduce(lambda p, q: p + q, (F.bit_count(col(x, s).bitwiseXOR(col(y, s))) for s in _SKETCH))
    sizes = (col(x, "n") * den >= col(y, "n") * num) & (col(y, "n") * den >= col(x, "n") * num)
    return sizes & (sketch * (den + num) <= (col(x, "n") + col(y, "n")) * (den - num))


def _side(table: DataFrame, key: str, side: str, *more: str) -> DataFrame:
    """The columns of a pair's one side: its key as ``side``, others with its name before theirs."""
    return table.select(F.col(key).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", *_SKETCH, *more)))


def _pair(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _blobs(wanted: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """class, set of the wanted classes: their sets are made again from the texts of their least ids, or of those without an id.
    A class has more than one row if texts repeat with their ids."""
    wanted = written(classes.join(wanted.distinct(), "class", "left_semi").select("class", "doc_id", "f0", "f1"), "wanted")
    ids = wanted.where("doc_id is not null").select("doc_id").distinct()
    some = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda x: x
    texts = docs.where("doc_id is not null").join(some(ids), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))

    def blobs(batches):
        for b in small_batches(batches):
            sizes, value = shingle_sets(b.column(1), k)
            f0, f1, _ = fingerprints(sizes, value)
            ends = np.cumsum(sizes)
            packed = [pack_sorted(value[z - n : z]) for n, z in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(f0.view(np.int64)), pa.array(f1.view(np.int64)), pa.array(packed, pa.binary())], names=["f0", "f1", "set"])

    found = texts.mapInArrow(blobs, "f0 long, f1 long, set binary").join(some(wanted.select("class", "f0", "f1")), ["f0", "f1"])
    return written(found.select("class", "set"), "sets")


def _links(pairs: DataFrame, blobs: DataFrame, t: Fraction) -> DataFrame:
    """a, b of the pairs whose sets are similar enough."""
    side = lambda p: blobs.select(F.col("class").alias(p), F.col("set").alias(f"{p}_set"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    num, den = t.numerator, t.denominator

    def verify(batches):
        for b in small_batches(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = unpack_sorted(x), unpack_sorted(y)
                at = np.searchsorted(x, y)
                inside = at < len(x)
                common = int((x[at[inside]] == y[inside]).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            kept = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))
            if kept.num_rows:
                yield kept

    return written(both.mapInArrow(verify, "a long, b long").distinct(), "links")


def common(x_sizes: np.ndarray, x: np.ndarray, y_sizes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of shingles that each of the first sets shares with each of the others."""
    out = np.zeros((len(x_sizes), len(y_sizes)), np.int64)
    both = np.intersect1d(x, y)
    sides = []
    for sizes, value in ((x_sizes, x), (y_sizes, y)):
        at = np.minimum(np.searchsorted(both, value), max(len(both) - 1, 0))
        shared = both[at] == value if len(both) else np.zeros(len(value), bool)
        at, owner = at[shared], np.repeat(np.arange(len(sizes)), sizes)[shared]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order], len(sizes)))
    for low in range(0, len(both), COLUMNS):
        dense = []
        for at, owner, n in sides:
            a, z = np.searchsorted(at, [low, low + COLUMNS])
            part = np.zeros((n, min(COLUMNS, len(both) - low)), np.float32)
            part[owner[a:z], at[a:z] - low] = 1
            dense.append(part)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _rooted(nodes: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of those that links between places x and y join across labels."""
    ends, place = np.unique(label, return_inverse=True)
    root = np.arange(len(ends))
    apart = place[x] != place[y]
    u, v = place[x][apart], place[y][apart]
    while (root[u] != root[v]).any():
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ends)))
    return ends[moved], ends[root[moved]]


_TILED = "class long, n long, a long, b long"


def _tile(table: pa.Table, t: Fraction) -> pa.Table:
    """class, n: links of each set with sets of the other block of its tile (field, i, j), or with others of its own if i = j.
    a, b: labels that such links join, as a forest."""
    num, den = t.numerator, t.denominator
    field, i, j, block, node, label = (table.column(c).to_numpy() for c in ("field", "i", "j", "block", "class", "label"))
    order = np.lexsort((node, block, j, i, field))
    if len(order):  # a class may come more than once
        same = functools.reduce(lambda p, q: p & q, (c[order][1:] == c[order][:-1] for c in (field, i, j, node)))
        order = order[np.append(True, ~same)]
    field, i, j, block, node, label = field[order], i[order], j[order], block[order], node[order], label[order]
    blobs = table.column("set").combine_chunks().take(pa.array(order)) if len(order) else table.column("set")
    new = np.append(True, (field[1:] != field[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
    starts = np.flatnonzero(new)
    nodes, counts, joined = [], [], []
    for a, z in zip(starts.tolist(), np.append(starts[1:], len(field)).tolist()):
        sets = [unpack_sorted(s) for s in blobs[a:z].to_pylist()]
        middle = int(np.searchsorted(block[a:z], i[a], "right")) if i[a] != j[a] else z - a
        sides = [(np.array([len(s) for s in part], np.int64), np.concatenate([np.zeros(0, np.uint64), *part])) for part in (sets[:middle], sets[middle:])]
        (xs, xv), (ys, yv) = sides if i[a] != j[a] else (sides[0], sides[0])
        if not len(xs) or not len(ys):
            continue
        both = common(xs, xv, ys, yv)
        linked = den * both >= num * (xs[:, None] + ys[None, :] - both)
        nodes.append(node[a:z])
        if i[a] == j[a]:
            np.fill_diagonal(linked, False)
            counts.append(linked.sum(axis=1))
        else:
            counts.append(np.append(linked.sum(axis=1), linked.sum(axis=0)))
        x, y = np.nonzero(linked)
        joined.append(_rooted(node[a:z], label[a:z], x, y if i[a] == j[a] else y + middle))
    none = np.zeros(0, np.int64)
    links = [np.concatenate([none, *(p[side] for p in joined)]) for side in (0, 1)]
    rows, more = np.concatenate([none, *nodes]), len(links[0])
    names = [x.split(" ")[0] for x in _TILED.split(", ")]
    columns = (rows, np.concatenate([none, *counts]), *links)
    return pa.table([pa.concat_arrays([pa.nulls(0 if c < 2 else len(rows), pa.int64()), pa.array(x, pa.int64()), pa.nulls(more if c < 2 else 0, pa.int64())]) for c, x in enumerate(columns)], names=names)


def _fields(apart: DataFrame) -> DataFrame:
    """label, field: labels that common keys hold together. ``apart``: kept common keys (key, class, label)."""
    kept = apart.select("key", "label").distinct()
    ends = kept.groupBy("key").agg(F.min("label").alias("least"), F.count("*").alias("labels")).where("labels > 1")
    return components(kept.join(ends, "key").select(F.col("label").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("field"))


def _tiled(apart: DataFrame, classes: DataFrame, blobs: DataFrame, t: Fraction) -> DataFrame:
    """class, n: links of saturated sets with other saturated ones; a, b: labels that these links join. Two saturated sets
    that link have a label or a kept key in common, so both are in one field."""
    found = apart.select("class", "label").distinct().join(_fields(apart), "label", "left").withColumn("field", F.coalesce("field", "label"))
    members = found.join(classes.select("class", F.col("n").alias("weight")), "class")
    sized = members.groupBy("field").agg(F.count("*").alias("size"), F.sum("weight").alias("weight")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("long")
    members = written(members.join(sized.select("field", blocks.alias("blocks")), "field"), "members")
    bundles = max(MIN_RANGES, (members.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0) // BLOCK_SHINGLES)
    rows = members.select("field", "label", "class", "blocks", F.pmod(F.xxhash64("class"), "blocks").alias("block")).join(blobs, "class")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("field", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "label", "set", "blocks")
    # small fields share a group
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("field"), F.lit(bundles))).otherwise(F.xxhash64("field", "i", "j"))
    return written(rows.withColumn("tile", tile).drop("blocks").groupBy("tile").applyInArrow(lambda table: _tile(table, t), _TILED), "tiled")


def _common_keys(met: DataFrame, same: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, class, up) of keys that few classes have after all; and of the common keys that saturated classes keep, with
    the class's share of common segments."""
    many = met.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("a"), "up")
    many = many.join(same.select("a", "class"), "a").groupBy("key", "class").agg(F.min("up").alias("up"))
    counts = many.groupBy("key").agg(F.count("*").alias("sets"), F.min("up").alias("least")).where("sets > 1 and least = 0").drop("least")
    many = written(many.join(counts, "key"), "many")
    hot = many.where(F.col("sets") > SMALL)
    sure = F.when(F.col("up") == 0, F.col("sure0")).otherwise(F.col("sure1"))
    full = hot.groupBy("class", "up").agg(F.count("*").alias("keys")).join(classes.select("class", "sure0", "sure1"), "class").where(F.col("keys") >= sure)
    full = full.select("class", "up", (F.col("keys") - sure + 1).alias("quota"), (F.col("keys") / sure).alias("share"))
    rank = F.row_number().over(Window.partitionBy("class", "up").orderBy("sets", "key"))
    kept = hot.join(full, ["class", "up"]).withColumn("rank", rank).where("rank <= quota").select("key", "class", "up", "share")
    return many.where(F.col("sets") <= SMALL).select("key", "class", "up"), written(kept, "common")


def _meetings(rows: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of classes that share a key and may link."""
    rows = rows.join(classes.select("class", "n", *_SKETCH), "class")
    x, y = (rows.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("class", "up", "n", *_SKETCH))) for p in "xy")
    apart = F.col("x_class") < F.col("y_class")
    both = x.join(y, (x.key == y.key) & apart & (F.col("x_up") + F.col("y_up") < 2) & _possible(t, "x", "y"))
    return both.select(F.col("x_class").alias("a"), F.col("y_class").alias("b"))


def similar(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (other sets that its set links with)."""
    t = Fraction(percent, 100)
    docs = documents(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key_bits = min(62, max(40, 2 * max(1, size // 12).bit_length() - 12))
    range_bits = (max(MIN_RANGES, size // RANGE_BYTES) - 1).bit_length()
    met = written(_send(docs, t, k, key_bits, range_bits).groupBy("range").applyInArrow(_meet, _MET), "met")
    sets = met.where("kind = 0 and n > 0").select("a", "doc_id", *_SETS)
    own = sets.groupBy("n", "f0", "f1").agg(F.min("a").alias("class"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in _SETS[3:]))
    classes = written(own, "classes")
    busy = met.where("kind = 2").groupBy(F.col("b").alias("a")).agg(F.sum(1 - F.col("up")).alias("hot0"), F.sum("up").alias("hot1"))
    same = sets.drop("doc_id").join(classes.select("n", "f0", "f1", "class"), ["n", "f0", "f1"]).join(busy, "a", "left").na.fill(0, ["hot0", "hot1"])
    # what a set may share at most beyond the keys that are not common, less what it must share
    same = written(same.select("a", "class", "n", *_SKETCH, (F.col("hot0") - F.col("sure0")).alias("spare0"), (F.col("hot1") - F.col("sure1")).alias("spare1")), "same")
    small = met.where("kind = 1").groupBy("a", "b", "up").agg(F.sum("n").alias("shared"))
    small = small.join(_side(same, "a", "a", "class", "spare0", "spare1"), "a").where(F.col("shared") + F.when(F.col("up") == 1, F.col("a_spare1")).otherwise(F.col("a_spare0")) >= 0)
    small = small.join(_side(same, "a", "b", "class", "spare0", "spare1"), "b").where(F.col("shared") + F.when(F.col("up") == 2, F.col("b_spare1")).otherwise(F.col("b_spare0")) >= 0)
    small = small.where((F.col("a_class") != F.col("b_class")) & _possible(t, "a", "b")).select(*_pair("a_class", "b_class"))
    few, common_ = _common_keys(met, same, classes)
    hubs = common_.groupBy("key").agg(F.max_by("class", F.struct("share", "class")).alias("hub"))
    to_hub = common_.join(hubs, "key").where("class <> hub").select(*_pair("class", "hub")).distinct()
    to_hub = to_hub.join(_side(classes, "class", "a"), "a").join(_side(classes, "class", "b"), "b").where(_possible(t, "a", "b")).select("a", "b")
    first = written(small.unionByName(_meetings(few, classes, t)).unionByName(to_hub).distinct(), "first")
    saturated = common_.select("class").distinct()
    blobs = _blobs(first.select(F.explode(F.array("a", "b")).alias("class")).unionByName(saturated), classes, docs, k)
    links = _links(first, blobs, t)
    labels = components(links)
    # saturated sets once more, whether or not they are connected yet
    apart = common_.select("key", "class").distinct().join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    tiled = _tiled(written(apart, "apart"), classes, blobs, t)
    more = tiled.where("a is not null").select("a", "b")
    if more.take(1):
        labels = components(links.unionByName(more))
    marked = saturated.withColumn("yes", F.lit(True))
    found = links.join(marked.select(F.col("class").alias("a"), F.col("yes").alias("a_yes")), "a", "left").join(marked.select(F.col("class").alias("b"), F.col("yes").alias("b_yes")), "b", "left")
    found = found.where("a_yes is null or b_yes is null").select(F.explode(F.array("a", "b")).alias("class"), F.lit(1).cast("long").alias("n"))
    degree = found.unionByName(tiled.where("class is not null").select("class", "n")).groupBy("class").agg(F.sum("n").alias("n_links"))
    of_class = classes.select("class", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.drop("doc_id").join(least, "label").join(degree, "class", "left")
    answers = written(same.select("a", "class").join(of_class, "class").select("a", "label", "component_id", "n_links"), "answers")
    rows = met.where("kind = 3").select("a", "doc_id", F.col("n").alias("n_shingles")).join(answers, "a", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of the rows with its least non-null id, the first. Rows are told apart by a number of
    their own, so ids may repeat or be null; rows without a shingle stay."""
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    near = similar(numbered, percent, k, row, text_col).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    near = written(near.join(near.where(F.col(row) != F.col("group")).select("group").distinct(), "group", "left_semi"), "near")
    ids = near.join(numbered.select(F.col(row), F.col(id_col).alias("id")), row)
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", row)).alias("first"))
    gone = written(ids.join(first, "group").where(F.col(row) != F.col(f"first.{row}")).select(row), "gone")
    return numbered.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, row, "left_anti").drop(row)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS sh FROM d),
k AS (SELECT doc_id, len(sh) AS n, sh, CASE WHEN len(sh) > 0 THEN min(doc_id) OVER (PARTITION BY sh) ELSE doc_id END AS class FROM s),
e AS (SELECT class, n, unnest(sh) AS x FROM k WHERE class = doc_id),
p AS MATERIALIZED (SELECT a.class AS a, b.class AS b FROM e a JOIN e b ON a.x = b.x AND a.class < b.class GROUP BY a.class, b.class HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT class AS v, class AS m FROM k UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.v AND l.b > r.m),
c AS (SELECT v, min(m) AS component_id FROM r GROUP BY v),
g AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM k JOIN c ON c.v = k.class LEFT JOIN g ON g.a = k.class
"""
