"""Packing token sequences into bins of a fixed capacity: best fit first, then bin completion with branch and bound.

A document longer than the capacity is cut into full pieces, of which the first may be shorter. What is packed is the
histogram of piece lengths, at most ``capacity`` numbers however large the corpus: the plan is a list of bin patterns with
multiplicities. Each piece finds its place by its rank among the pieces of its length, so placing needs no global sort.

The bound: ceil(tokens / capacity), or the number of pieces above half the capacity if larger. Best fit decreasing over
the histogram is the first incumbent. While it is above the bound, the search takes the largest piece left, enumerates
the undominated fillings around it (a filling is dominated if another holds its pieces, grouped, one group to a piece),
of any number of pieces, fullest first, uses each as often as the counts allow or once, and cuts branches whose waste rules
out a better packing. ``max_nodes`` bounds the search, not the input: the incumbent is always a whole packing, and it is
optimal if it meets the bound or the search ended before that many nodes.

Edge cases: a null or empty text is one end token, hence a piece of length 1; equal lengths are interchangeable and are
ranked by task and order of arrival; repeated rows are packed each on its own; an empty table gives no pieces; only id and
text are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import byte_characters
from lodestone.llm.shared import documents, small_batches, written
from lodestone.llm.units import SpaceSplit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, idx long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---------------------------------------------------------------- ids


@functools.cache
def _encoder(tokenizer_path: str, pattern: str) -> SpaceSplit:
    """Encodes as the tokenizer file says. Where its merges are in the order of the ids, the rank engine gives the same ids faster."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    byte = {c: b for b, c in enumerate(byte_characters())}
    if all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        import tiktoken

        n = 256 + len(merges)
        ranks = {bytes(byte[c] for c in piece): i for piece, i in vocabulary.items() if i < n}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        return SpaceSplit(lambda texts: [array("I", encode(t)).tobytes() for t in texts])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = True
    return SpaceSplit(lambda texts: [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece. part and idx: the task that made it and its number among that task's pieces of its length."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = _encoder(tokenizer_path, pattern)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in small_batches(batches):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                head = n % capacity or min(n, capacity)
                cuts = [0, *range(head, n + 1, capacity)]
                for k, (a, z) in enumerate(itertools.pairwise(cuts)):
                    rows.append((doc_id, k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), part, int(seen[z - a])))
                    seen[z - a] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split(" ")[0] for x in PIECES.split(", ")])

    return documents(docs, id_col, text_col).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan

#: items of a bin, by length: ((length, number), ...); and how many such bins
Pattern = tuple[tuple[tuple[int, int], ...], int]


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    total = sum(k * n for k, n in histogram.items())
    return max(-(-total // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, a whole class of equal pieces and a whole class of equal bins at a time."""
    room: dict[int, list[list]] = {}  # what is free -> [[items, bins], ...]
    free: list[int] = []  # the keys of room, ascending

    def put(left: int, items: dict, bins: int) -> None:
        if left not in room:
            room[left] = []
            free.insert(bisect_right(free, left), left)
        room[left].append([items, bins])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect_right(free, length - 1)
            if at == len(free):
                each = min(n, capacity // length)
                put(capacity - each * length, {length: each}, n // each)
                n %= each
                continue
            left = free[at]
            items, bins = room[left].pop()
            each = min(left // length, n)
            used = min(bins, n // each)
            if used < bins:
                room[left].append([items, bins - used])
            if not room[left]:
                del room[left], free[at]
            put(left - each * length, items | {length: items.get(length, 0) + each}, used)
            n -= used * each
    return [(tuple(items.items()), bins) for groups in room.values() for items, bins in groups]


#: The test for dominance only saves work, so it is left out for sets of many pieces and made against the latest sets.
DOMINANCE_PIECES, DOMINANCE_SETS = 6, 32


def dominated(small: tuple[int, ...], by: tuple[int, ...]) -> bool:
    """Whether the pieces of ``small`` can be dealt to the pieces of ``by`` with no sum above its piece."""

    def deal(i: int, left: tuple[int, ...]) -> bool:
        return i == len(small) or any(x >= small[i] and deal(i + 1, (*left[:j], x - small[i], *left[j + 1 :])) for j, x in enumerate(left))

    return deal(0, by)


def fillings(counts: dict[int, int], room: int, least: int = 0, go_on: Callable[[], bool] = lambda: True):
    """Undominated sets of pieces that fit in ``room`` with a sum of ``least`` or more, of any number, the fullest first and
    of equal ones those with larger pieces; () if none fits. Sums that the pieces can make are known as bits, so no walk ends
    without a set. ``go_on`` is asked once a set, dominated ones included, and ends the walk."""
    lengths = sorted(k for k, n in counts.items() if n and k <= room)
    number = [counts[k] for k in lengths]
    reach = [1]  # bit t of reach[i]: t is a sum of the first i lengths' pieces
    mask = (1 << room + 1) - 1
    for k, n in zip(lengths, number):
        bits, left, step = reach[-1], min(n, room // k), 1
        while left:
            step = min(step, left)
            bits |= bits << step * k & mask
            left, step = left - step, step * 2
        reach.append(bits)

    def walk(i: int, total: int):
        if not total:
            yield ()
        for j in range(min(i, bisect_right(lengths, total)) - 1, -1, -1):
            if not reach[j + 1] >> total & 1:
                return
            k = lengths[j]
            for n in range(min(number[j], total // k), 0, -1):
                if reach[j] >> total - n * k & 1:
                    for rest in walk(j, total - n * k):
                        yield (k,) * n + rest

    given: list[tuple[int, ...]] = []
    for total in range(room, max(least, 0) - 1, -1):
        if reach[-1] >> total & 1 and (total or not given):
            for chosen in walk(len(lengths), total):
                if not go_on():
                    return
                if len(chosen) > DOMINANCE_PIECES or not any(dominated(chosen, x) for x in given[-DOMINANCE_SETS:]):
                    given.append(chosen)
                    yield chosen


def complete(histogram: dict[int, int], capacity: int, incumbent: list[Pattern], max_nodes: int, max_fillings: int = 20_000) -> list[Pattern]:
    """Bin completion: the best packing found, the incumbent if none is better. The search ends at the lower bound, when all
    is tried, after ``max_nodes`` opened nodes, or after ``max_fillings`` sets of pieces that were looked at in all of them."""
    looked = itertools.count(1)
    go_on = lambda: next(looked) <= max_fillings
    total = sum(k * n for k, n in histogram.items())
    bound, best, nodes = lower_bound(histogram, capacity), sum(b for _, b in incumbent), 0
    counts = {k: n for k, n in histogram.items() if n}
    stack: list[list] = [[None, 0, None]]  # [choices left, waste so far, what was taken to get here]
    while stack and best > bound and nodes < max_nodes:
        frame = stack[-1]
        if frame[0] is None:
            nodes += 1
            if not counts:
                found = [(items, bins) for *_, (items, bins) in stack[1:]]
                best, incumbent = sum(b for _, b in found), found
                frame[0] = iter(())
                continue
            largest = max(counts)
            # each filling as often as the counts allow, and once: then others, or itself again, may follow for this length
            rest = {**counts, largest: counts[largest] - 1}
            # a bin that wastes more than what is left to waste is in no better packing, and sums only fall from there
            slack = (best - 1) * capacity - total - frame[1]
            frame[0] = (((largest, *x), times) for x in fillings(rest, capacity - largest, capacity - largest - slack, go_on) for times in (0, 1))
        if (choice := next(frame[0], None)) is None:
            stack.pop()
            if frame[2]:
                for k, n in frame[2][0]:
                    counts[k] = counts.get(k, 0) + n * frame[2][1]
            continue
        chosen, times = choice
        items = tuple((k, chosen.count(k)) for k in dict.fromkeys(chosen))
        bins = min(counts[k] // n for k, n in items)
        if times and bins == 1:
            continue  # that was the choice before
        bins = times or bins
        waste = frame[1] + bins * (capacity - sum(chosen))
        # the last bin may be left part empty for free: a better packing has best - 1 bins
        if waste > (best - 1) * capacity - total:
            slack = (best - 1) * capacity - total - frame[1]
            one = capacity - sum(chosen)
            bins = slack // one if one else bins
            if bins <= 0:
                continue
            waste = frame[1] + bins * one
        for k, n in items:
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
        stack.append([None, waste, (items, bins)])
    return incumbent


def plan(histogram: dict[int, int], capacity: int, max_nodes: int = 2000) -> list[Pattern]:
    """Bins for all pieces: best fit decreasing, then bin completion where that is above the lower bound."""
    first = best_fit(histogram, capacity)
    return complete(histogram, capacity, first, max_nodes)


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first bin, pieces of this length in a bin, offset of the first), by first rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for items, bins in patterns:
        offset = 0
        for length, n in items:
            out.setdefault(length, []).append((ranks.get(length, 0), first, n, offset))
            ranks[length] = ranks.get(length, 0) + n * bins
            offset += n * length
        first += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(table: DataFrame, capacity: int = 2048, max_nodes: int = 2000) -> DataFrame:
    """Places the rows of pieces(); ``table`` is read twice, so it should be a written one."""
    histogram = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = slots(plan(histogram, capacity, max_nodes))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = table.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("idx")).alias("rank"))

    def run(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(rows):
                    continue
                k = int(length[rows[0]])
                slot = places[k][np.searchsorted(places[k][:, 0], rank[rows], "right") - 1]
                within = rank[rows] - slot[:, 0]
                sequence[rows] = slot[:, 1] + within // slot[:, 2]
                offset[rows] = slot[:, 3] + within % slot[:, 2] * k
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[x.split(" ")[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(run, PLACED)


def packed(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents, cut and placed."""
    return pack(written(pieces(docs, tokenizer_path, pattern, capacity, end_id), "pieces"), capacity)
