import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import lru_cache

from lodestone.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost int, seg string"
sys.setrecursionlimit(20_000)
MACHINE = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Of (turn, role, text) in order: the columns of a result, by plain recursion over all edits."""
    seen, steps, counts = set(), [], dict.fromkeys("bdt", 0)
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
        if fault != "-":
            counts[fault] += 1
        steps.append((role, text, fault))

    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(steps) and last in ("", "a"):
            options.append((0, "", ()))

        def add(cost, letter, role, text, j, more):
            after = last if role is None else ("X" if not role else role[0])
            if role is not None:
                if not {"": after in "su", "s": after == "u", "u": after == "a", "a": after == "u"}[last]:
                    return
            rest = best(j, after, more)
            if rest:
                options.append((cost + rest[0], letter + rest[1], (() if role is None else ((role, text),)) + rest[2]))

        if inserted < 3:
            for role in ("user", "assistant"):
                add(2, "I", role, "", i, inserted + 1)
        if i < len(steps):
            role, text, fault = steps[i]
            add(3, "D", None, None, i + 1, 0)
            if fault not in "bd":
                more = fault == "t"
                add(more, "K", role, text, i + 1, 0)
                for new in ("user", "assistant"):
                    add(2 + more, "R", new, text, i + 1, 0)
        return min(options, key=lambda x: x[:2]) if options else None

    cost, audit, kept = best(0, "", 0)
    assert MACHINE.fullmatch("".join(r[:1] for r, _ in kept))
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)


def tie(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows):
    groups, every = defaultdict(list), set()
    for conv_id, turn, role, text in rows:
        every.add(conv_id)
        known = lambda x: " " if x is None else x
        role, text = known(role), known(text)
        kind = zlib.crc32(f"{known(conv_id)}:{known(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        groups[conv_id] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id in every:
        ordered = sorted(groups[conv_id], key=lambda x: (x[0] is not None, x[0] or 0, tie(*x[1:])))
        out[conv_id] = brute(ordered)
    return out


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["", " ", None, "Yes.", "No!", "Maybe", "What? ", "ß.\n", "a\x00b.", "Line one.\nline two"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    for conv_id in range(n):
        turns = list(range(rng.choice([1, 2, 4, 8, 20])))
        for t in turns:
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = f"Turn {t}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv_id if conv_id else None, None if rng.random() < 0.05 else t + (t > 5) * rng.choice([0, 3]), role, text))
    rows += [(7, 3, "user", "Same turn."), (7, 3, "user", "Same turn."), (7, 3, "assistant", "Other.")]
    return rows


def result(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r[c] for c in names) for r in rows}


def test_repair_against_brute_force(spark):
    rows = conversations(1, 60)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert result(repair.repair_damaged(table)) == expected(rows)


def test_segments_make_no_difference(spark):
    """Cut after three rows, or after few bytes, nearly every conversation goes through the chain of segments."""
    rows = conversations(2, 40) + [(500, t, "user" if t % 3 else "assistant", f"Row {t % 17}.") for t in range(300)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    plain = result(repair.repair(repair.damage(table)))
    assert result(repair.repair(repair.damage(table), max_rows=3)) == plain
    assert result(repair.repair(repair.damage(table), max_bytes=200)) == plain
    want = expected(rows)
    assert {k: want[k] for k in plain} == plain


def test_empty_table_and_conversations_without_rows(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(dropped, 0, "user", "Hello.", 1, "x")], SCHEMA)
    assert result(repair.repair_damaged(table)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair_damaged(table.limit(0)).collect() == []


def test_walk_is_least():
    """u u: deleting either user row and inserting an assistant cost the same as other ways; the least letters win."""
    steps = [("u", False, False), ("u", False, False)]
    dist = repair.distances(steps, repair.FINAL)
    letters, state = repair.walk(steps, dist, 0)
    assert (dist[0][0], letters + repair.ending(state)) == (2, "KR")
    assert repair.distances([], repair.FINAL)[0] == list(repair.FINAL)
