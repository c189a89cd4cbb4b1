"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation's rows are steps of a small automaton over role initials, `(s?(ua)+)?`. A node is (rows used, state); keeping,
reroling, deleting a row and inserting an empty one are arcs of cost 0 to 3. Dial's algorithm finds the distance of all nodes
to the end with a bucket per distance, since costs are small integers; from the start, a walk along tight arcs (cost plus
distance of the head equals distance of the tail), least letter first, is the audit. Arcs of a node have different letters,
so the walk gives the least of all cheapest audits.

A conversation of any length: rows are range-sorted and cut into segments (ordered.py). What is whole in a task is repaired
there. Of the others a segment is summed up by the distances between the four states at its start and its end; a chain over
these sums gives the distances to the end at every cut, then each segment walks from each of the four states, and a second
chain picks the walks that meet. First occurrences of texts are found over all segments by their digests. Texts of such
segments lie in files in the shared folder and are read one after another only for the digest of the repaired conversation.

Edge cases: a null role or text is one space; null turns come first; rows with equal turns are in order of a digest of role
and text, and equal rows stay together; null conversation ids are one conversation; an empty role has no initial and is
never kept; conversations that damage() emptied are returned with zeros; an empty table gives an empty table; only conv_id,
turn, role and text are read, so other columns never clash; texts of any length are rows of their own segment.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ordered import MAX_BYTES, MAX_ROWS, get, in_order, put, segments
from lodestone.llm.shared import shared_dir, written

SPACE = " \t\n\x0b\x0c\r"
#: The automaton: state -> {role initial: next state}. It accepts in 0 (nothing) and 3 (after an assistant).
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: state -> the state after the only role of user and assistant that may follow, and that role.
FILL = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: Cost from each state to an accepting one when no rows are left: one or two insertions.
FINAL = (0, 4, 2, 0)
REROLE, DELETE, INSERT, OPEN = 2, 3, 2, 1
FAR = 1 << 60
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, TRUNCATED = "b", "d", "t"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = "conv_id long, seg long, file string, n int, first_turn long, last_turn long, turns long, illegal long, initials array<string>, faults string, keys array<binary>, places array<int>"

#: A row as the search sees it: (initial, must be deleted, costs one more unless deleted).
Step = tuple[str, bool, bool]


# ---------------------------------------------------------------- the search


def distances(steps: list[Step], goal: tuple[int, ...] | list[int]) -> list[list[int]]:
    """Distance of every node to the end by Dial's buckets; ``goal``: what the states cost after the last row."""
    n = len(steps)
    done = [[FAR] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = []

    def reach(d: int, i: int, s: int) -> None:
        if d < done[i][s]:
            done[i][s] = d
            while len(buckets) <= d - base:
                buckets.append([])
            buckets[d - base].append((i, s))

    base = min(goal)
    for s, d in enumerate(goal):
        if d < FAR:
            reach(d, n, s)
    at = 0
    while at < len(buckets):
        for i, s in buckets[at]:  # grows while it is read: some arcs cost nothing
            d = base + at
            if done[i][s] < d:
                continue
            before = [p for p in range(4) if FILL[p][0] == s]
            if i < n:
                for p in before:
                    reach(d + INSERT, i, p)
            if i:
                initial, must, is_open = steps[i - 1]
                reach(d + DELETE, i - 1, s)
                if not must:
                    for p in range(4):
                        if NEXT[p].get(initial) == s:
                            reach(d + is_open * OPEN, i - 1, p)
                    for p in before:
                        reach(d + REROLE + is_open * OPEN, i - 1, p)
        buckets[at] = []
        at += 1
    return done


def walk(steps: list[Step], dist: list[list[int]], state: int) -> tuple[str, int]:
    """(letters, state after the last row) of the least walk along tight arcs from the start in ``state``."""
    out, i, n = [], 0, len(steps)
    while i < n:
        d, (initial, must, is_open) = dist[i][state], steps[i]
        to, after = FILL[state][0], NEXT[state].get(initial)
        if DELETE + dist[i + 1][state] == d:
            letter, i = "D", i + 1
        elif INSERT + dist[i][to] == d:
            letter, state = "I", to
        elif not must and after is not None and is_open * OPEN + dist[i + 1][after] == d:
            letter, i, state = "K", i + 1, after
        else:  # tight by exclusion
            letter, i, state = "R", i + 1, to
        out.append(letter)
    return "".join(out), state


def ending(state: int) -> str:
    """The insertions after the last row."""
    return "I" * (FINAL[state] // INSERT)


def repaired(rows, letters: str, state: int):
    """(role, text) of the rows that edits leave, from ``state`` on."""
    rows = iter(rows)
    for letter in letters:
        if letter == "D":
            next(rows)
        elif letter == "K":
            role, text = next(rows)
            state = NEXT[state][role[:1]]
            yield role, text
        else:
            state, role = FILL[state]
            yield role, next(rows)[1] if letter == "R" else ""


class Digest:
    """SHA-256 of items with a line end between them."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False

    def add(self, pairs) -> None:
        for role, text in pairs:
            self.hash.update(b"\n" * self.any + f"{role}:{text}".encode())
            self.any = True

    def hex(self) -> str:
        return self.hash.hexdigest()


# ---------------------------------------------------------------- a segment


def steps_of(initials: list[str], faults: str) -> list[Step]:
    return [(x, f in (BLANK, DUPLICATE), f == TRUNCATED) for x, f in zip(initials, faults, strict=True)]


def faults_of(rows: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """(first fault of each row, - if none, duplicates being those of these rows; places of first occurrences)."""
    seen, out, places = set(), [], []
    for i, row in enumerate(rows):
        bare = row[1].rstrip(SPACE)
        if row not in seen:
            seen.add(row)
            places.append(i)
            again = False
        else:
            again = True
        out.append(BLANK if not bare else DUPLICATE if again else TRUNCATED if bare[-1] not in ".!?" else "-")
    return "".join(out), places


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """(least, greatest, number of different turns), nulls left out."""
    known = sorted({t for t in turns if t is not None})
    return (known[0], known[-1], len(known)) if known else (None, None, 0)


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))


def _segment(folder: str, conv_id, number: int, rows: list[tuple[str, str]], turns: list) -> tuple:
    file = put(folder, _stream(rows))
    initials = [r[:1] for r, _ in rows]
    faults, places = faults_of(rows)
    keys = [hashlib.blake2b(f"{len(rows[i][0])}:{rows[i][0]}{rows[i][1]}".encode(), digest_size=20).digest() for i in places]
    return (conv_id, number, file, len(rows), *_turns(turns), _illegal(initials), initials, faults, keys, places)


def _stream(rows: list[tuple[str, str]]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"role": pa.array([r for r, _ in rows], pa.large_string()), "text": pa.array([t for _, t in rows], pa.large_string())})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _whole(conv_id, rows: list[tuple[str, str]], turns: list) -> tuple:
    least, most, different = _turns(turns)
    initials, (faults, _) = [r[:1] for r, _ in rows], faults_of(rows)
    steps = steps_of(initials, faults)
    dist = distances(steps, FINAL)
    letters, state = walk(steps, dist, 0)
    digest = Digest()
    digest.add(repaired(rows, letters + ending(state), 0))
    return (conv_id, most - least + 1 - different if different else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), _illegal(initials), dist[0][0], letters + ending(state), digest.hex())


# ---------------------------------------------------------------- over the table


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that are left after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1
    empties its text, 2 removes its sentence ends, 3 repeats it, 4 gives it to the user. Nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _arrow(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])


_LONG, _TEXT, _INT = pa.int64(), pa.string(), pa.int32()
_RESULT = [_LONG] * 7 + [_TEXT, _TEXT]
_SEGMENT = [_LONG, _LONG, _TEXT, _INT, _LONG, _LONG, _LONG, _LONG, pa.list_(_TEXT), _TEXT, pa.list_(pa.binary()), pa.list_(_INT)]


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A row (RESULT) per conversation of ``rows`` (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/segments"
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"))
    rows = rows.withColumn("tie", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    both = f"{SEGMENT}, {', '.join('r_' + x for x in RESULT.split(', '))}"

    def run(batches):
        done, left = [], []

        def batch():
            made = [(*[None] * len(_SEGMENT), *x) for x in done] + [(*x, *[None] * len(_RESULT)) for x in left]
            done.clear(), left.clear()
            return _arrow(made, both, _SEGMENT + _RESULT)

        for number, whole, table in segments(batches, max_rows, max_bytes):
            conv_id, turns = table.column(0)[0].as_py(), table.column(1).to_pylist()
            pairs = list(zip(table.column(2).to_pylist(), table.column(3).to_pylist(), strict=True))
            if whole:
                done.append(_whole(conv_id, pairs, turns))
            else:
                left.append(_segment(folder, conv_id, number, pairs, turns))
            if len(done) >= 1024 or len(left) >= 16:
                yield batch()
        if done or left:
            yield batch()

    made = written(in_order(rows, "conv_id", ["turn", "tie"]).mapInArrow(run, both), "made")
    at_once = made.where("seg is null").select(*(F.col("r_" + x.split(" ")[0]).alias(x.split(" ")[0]) for x in RESULT.split(", ")))
    return at_once.unionByName(_joined(made.where("seg is not null").select(*(x.split(" ")[0] for x in SEGMENT.split(", "))), folder))


def _joined(parts: DataFrame, folder: str) -> DataFrame:
    """The results of conversations that lie in several segments."""
    # texts that an earlier segment of the conversation has
    each = parts.select("conv_id", "seg", F.explode(F.arrays_zip("keys", "places")).alias("x")).groupBy("conv_id", F.col("x.keys").alias("key")).agg(F.min("seg").alias("first"), F.collect_list(F.struct("seg", F.col("x.places").alias("place"))).alias("all"))
    again = each.where(F.size("all") > 1).select("first", F.inline("all")).where("seg > first").groupBy("seg").agg(F.collect_list("place").alias("again"))
    thin = parts.select("conv_id", "seg", "initials", "faults").join(again, "seg", "left").select("conv_id", "seg", "initials", "faults", "again")

    def repeated(faults: str, places) -> str:
        out = list(faults)
        for i in places or ():
            out[i] = DUPLICATE if out[i] != BLANK else BLANK
        return "".join(out)

    def sums(batches):
        for b in batches:
            rows = []
            for conv_id, seg, initials, faults, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                faults = repeated(faults, places)
                steps = steps_of(initials, faults)
                to = [distances(steps, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
                rows.append((conv_id, seg, initials, faults, [to[t][s] for s in range(4) for t in range(4)]))
            if rows:
                yield _arrow(rows, summed, [_LONG, _LONG, pa.list_(_TEXT), _TEXT, pa.list_(_LONG)])

    summed = "conv_id long, seg long, initials array<string>, faults string, sums array<bigint>"
    sum_table = written(thin.mapInArrow(sums, summed), "sums")

    def goals(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seg", "descending")])
        goal, out = list(FINAL), []
        for sums in table["sums"].to_pylist():
            out.append(goal)
            goal = [min(FAR, *(sums[4 * s + t] + goal[t] for t in range(4))) for s in range(4)]
        return pa.table({"seg": table["seg"], "goal": pa.array(out, pa.list_(_LONG))})

    goal_table = sum_table.select("conv_id", "seg", "sums").groupBy("conv_id").applyInArrow(goals, "seg long, goal array<bigint>")

    def walks(batches):
        for b in batches:
            rows = []
            for seg, initials, faults, goal in zip(*(c.to_pylist() for c in b.columns), strict=True):
                steps = steps_of(initials, faults)
                dist = distances(steps, goal)
                found = [walk(steps, dist, s) if dist[0][s] < FAR else ("", s) for s in range(4)]
                rows.append((seg, [x for x, _ in found], [s for _, s in found], dist[0][0], *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED))))
            if rows:
                yield _arrow(rows, walked, [_LONG, pa.list_(_TEXT), pa.list_(_INT), _LONG, _LONG, _LONG, _LONG])

    walked = "seg long, letters array<string>, states array<int>, cost long, blank long, duplicate long, truncated long"
    walk_table = sum_table.join(goal_table, "seg").select("seg", "initials", "faults", "goal").mapInArrow(walks, walked)
    ends = F.struct(F.get("initials", F.lit(0)).alias("a"), F.get("initials", F.size("initials") - 1).alias("z")).alias("ends")
    last = parts.select("conv_id", "seg", "file", "first_turn", "last_turn", "turns", "illegal", ends).join(walk_table, "seg")
    names = ["conv_id", "seg", "file", "first_turn", "last_turn", "turns", "illegal", "ends", "letters", "states", "cost", "blank", "duplicate", "truncated"]

    def finish(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("seg", "ascending")]).to_pylist()
        known = [r for r in rows if r["turns"]]
        different = sum(r["turns"] for r in known) - sum(a["last_turn"] == b["first_turn"] for a, b in itertools.pairwise(known))
        gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - different if known else 0
        illegal = sum(r["illegal"] for r in rows) + sum(a["ends"]["z"] + b["ends"]["a"] not in LEGAL for a, b in itertools.pairwise(rows))
        state, audit, digest = 0, [], Digest()
        for k, r in enumerate(rows):
            letters, after = r["letters"][state], r["states"][state]
            letters += ending(after) if k == len(rows) - 1 else ""
            audit.append(letters)
            texts = pa.ipc.open_stream(get(folder, r["file"])).read_all()
            digest.add(repaired(zip(texts["role"].to_pylist(), texts["text"].to_pylist(), strict=True), letters, state))
            state = after
        row = (rows[0]["conv_id"], gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, rows[0]["cost"], "".join(audit), digest.hex())
        return pa.Table.from_batches([_arrow([row], RESULT, _RESULT)])

    return last.select(*names).groupBy("conv_id").applyInArrow(finish, RESULT)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table, damaged and repaired; those without a row left have zeros and nothing in them."""
    found = repair(damage(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    joined = every.join(found.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left")
    return joined.select("conv_id", *(F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in names[1:]))


#: CRC-32 bit by bit, then the automaton row by row: of each state the cheapest audit so far, the least of equals. m: what may
#: be inserted before a row, act: what may become of the row, fin: what is inserted at the end.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS damage FROM t),
x AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE damage WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(len(role), ':', role, text)), copy) AS i FROM x),
f AS MATERIALIZED (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault FROM o),
m(s, mid, letters, said) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', concat('user:', chr(10))), (1, 2, 'I', concat('user:', chr(10))), (3, 2, 'I', concat('user:', chr(10))),
  (2, 3, 'I', concat('assistant:', chr(10))), (0, 3, 'II', concat('user:', chr(10), 'assistant:', chr(10))), (1, 3, 'II', concat('user:', chr(10), 'assistant:', chr(10)))),
act(mid, kind, c, next, made) AS (VALUES (0, 'D', '', 0, ''), (1, 'D', '', 1, ''), (2, 'D', '', 2, ''), (3, 'D', '', 3, ''), (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (2, 'K', 'a', 3, ''), (3, 'K', 'u', 2, ''),
  (0, 'R', '', 2, 'user'), (1, 'R', '', 2, 'user'), (2, 'R', '', 3, 'assistant'), (3, 'R', '', 2, 'user')),
fin(s, letters, said) AS (VALUES (0, '', ''), (3, '', ''), (2, 'I', concat('assistant:', chr(10))), (1, 'II', concat('user:', chr(10), 'assistant:', chr(10)))),
r AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0, 'audit': '', 'said': ''} AS b FROM x
UNION ALL SELECT conv_id, i, s, min(b) FROM (
  SELECT f.conv_id, f.i, act.next AS s, {'cost': r.b.cost + 2 * len(m.letters) + CASE act.kind WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN act.kind <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END, 'audit': concat(r.b.audit, m.letters, act.kind),
    'said': concat(r.b.said, m.said, CASE act.kind WHEN 'D' THEN '' WHEN 'K' THEN concat(f.role, ':', f.text, chr(10)) ELSE concat(act.made, ':', f.text, chr(10)) END)} AS b
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1 JOIN m ON m.s = r.s JOIN act ON act.mid = m.mid AND (act.kind = 'D' OR f.fault NOT IN ('b', 'd')) AND (act.kind <> 'K' OR act.c = f.c)) GROUP BY conv_id, i, s),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND concat(before, c) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
z AS (SELECT n.*, min({'cost': r.b.cost + 2 * len(fin.letters), 'audit': concat(r.b.audit, fin.letters), 'said': concat(r.b.said, fin.said)}) AS b FROM n JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.i = n.n JOIN fin ON fin.s = r.s GROUP BY ALL),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(CASE WHEN coalesce(b.said, '') = '' THEN '' ELSE substr(b.said, 1, len(b.said) - 1) END) AS repaired_sha256
FROM every LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM every.conv_id
"""
