"""Chat formatting: records of any declared layout to canonical turns, then to one text with a loss mask, and back.

A record is a JSON object. Its schema fingerprint is a hash of the set of its nested field paths (an item of an array is
`[]`, whatever its place), so it does not depend on the order of fields, the number of turns, or what values hold. A table
from fingerprints to declared layouts, each spelled out with and without its optional fields, selects how a record becomes
turns; records that no layout declares are given back without turns, and unknown() counts them by fingerprint.

The template writes a turn as START role, line end, text, END, line end. Every control string begins with `<|`, so a `<`, any
backslashes and a `|` in a text get one more backslash, and reading takes one away. Texts of assistant turns are under the
loss mask: pairs of code point offsets into the formatted text.

A conversation of any length: rows are range-sorted and cut into segments (ordered.py), each a record of its own. Digests of
a conversation that lies in several segments are made by a task that reads the formatted segments one after another.

Edge cases: a null text or role is an empty one; null turns come first, equal ones in order of role and text; null
conversation ids are one conversation; rows with the id of the probe conversation join it; line ends and backslashes in a
role are escaped too; repeated rows are turns of their own; an empty table gives an empty table; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.ordered import MAX_BYTES, MAX_ROWS, get, in_order, put, segments
from lodestone.llm.shared import shared_dir, small_batches, written

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
PROBE_ID, PROBE_TEXT = -1, f"{END}{START}assistant ok"

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Layout:
    """How records become turns. Either ``turns`` names the fields of fixed roles, several of which are joined with an empty
    line between them and a turn without any is left out, or every item of the array ``each`` is a turn with ``role`` and ``text``."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def schemas(self):
        """All sets of field paths that the layout covers."""
        for n in range(len(self.optional) + 1):
            for more in itertools.combinations(self.optional, n):
                yield {*self.required, *more}
                if self.each and not any(x.startswith(self.each + "[]") for x in more):
                    yield {self.each + "[]", *more}  # no turns


LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), ("id",), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), ("id", "messages[].name"), each="messages", role="role", text="content"),
    Layout("parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), ("id",), each="messages", role="role", text="content[].text"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), ("id", "source"), each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
    Layout("nested", ("dialog.turns[].speaker.role", "dialog.turns[].body.text"), ("id", "dialog.id"), each="dialog.turns", role="speaker.role", text="body.text"),
)


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; dots, brackets and backslashes in a name are escaped."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(x, f"{at}.{name}" if at else name) for name, x in ((re.sub(r"([\\.\[\]])", r"\\\1", k), x) for k, x in value.items())))
    if isinstance(value, list):
        return set().union(*(paths(x, at + "[]") for x in value)) if value else {at + "[]"}
    return {at}


def fingerprint(names: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


@functools.cache
def _table(layouts: tuple[Layout, ...]) -> dict[str, Layout]:
    return {fingerprint(names): layout for layout in reversed(layouts) for names in layout.schemas()}


def _text(value, path: str) -> str | None:
    """The value at ``path`` as text: null is empty, items of an array are joined, and None means that there is none."""
    head, _, rest = path.partition(".")
    name, many = head.removesuffix("[]"), head.endswith("[]")
    if not isinstance(value, dict) or name not in value:
        return None
    value = value[name]
    if many:
        return "".join(_text(x, rest) or "" for x in value)
    if rest:
        return _text(value, rest)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    if layout.each:
        for name in layout.each.split("."):
            record = record[name]
        roles = ((_text(x, layout.role) or "", _text(x, layout.text) or "") for x in record)
        return [(layout.roles.get(r, r), t) for r, t in roles]
    out = []
    for role, names in layout.turns:
        given = [_text(record, x) for x in names]
        if any(x is not None for x in given):
            out.append((role, "\n\n".join(x for k, x in enumerate(given) if x or not k and x is not None)))
    return out


def canonical_record(text: str | None, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[str | None, str | None, list[tuple[str, str]] | None]:
    """(fingerprint, layout, turns) of a record; no fingerprint if it is no JSON object, no layout if none is declared."""
    try:
        record = json.loads(text or "")
    except (ValueError, RecursionError):
        return None, None, None
    if not isinstance(record, dict):
        return None, None, None
    key = fingerprint(paths(record))
    layout = _table(layouts).get(key)
    return (key, None, None) if layout is None else (key, layout.name, turns_of(record, layout))


# ---------------------------------------------------------------- the template


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """(formatted text, loss mask: start and end of each trained text, one after another)."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
        body = escape(text)
        if role == TRAINED:
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def read_back(formatted: str, mask: list[int]) -> tuple[list[tuple[str, str]], list[str]]:
    """(turns, texts under the loss mask) of a formatted text."""
    turns = []
    for turn in formatted.split(END + "\n")[:-1]:
        if not turn.startswith(START):
            raise ValueError("a turn does not begin with its mark")
        role, _, text = turn[len(START) :].partition("\n")
        turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)))
    return turns, [unescape(formatted[a:z]) for a, z in zip(mask[::2], mask[1::2], strict=True)]


# ---------------------------------------------------------------- over tables

_LONG, _TEXT, _BOOL, _TEXTS, _INTS = pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int32())
RECORDS = "conv_id long, seg long, whole boolean, record string"
TURNS = "conv_id long, seg long, whole boolean, fingerprint string, layout string, roles array<string>, texts array<string>"
FORMATTED = "conv_id long, seg long, whole boolean, formatted string, mask array<int>"
PIECES = "conv_id long, seg long, file string, mask array<int>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])


def _mapped(df: DataFrame, make, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``df`` with every row made anew by ``make`` from its values, in small batches."""

    def run(batches):
        for b in small_batches(batches, 512, 2 << 20):
            yield _batch([make(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], schema, kinds)

    return df.mapInArrow(run, schema)


def _record(conv_id: int | None, turns: list[tuple[str, str | None]]) -> str:
    """One of the layouts that can hold the turns as they are, by the conversation's number."""
    roles = [r for r, _ in turns]
    fits = [
        lambda: {"id": conv_id, "messages": [{"role": r, "content": t} for r, t in turns]},
        lambda: {"dialog": {"turns": [{"body": {"text": t}, "speaker": {"role": r}} for r, t in turns]}},
        lambda: {"messages": [{"content": [{"type": "text", "text": t}], "role": r} for r, t in turns]},
    ]
    if not {"human", "gpt"} & set(roles):
        back = {"user": "human", "assistant": "gpt"}
        fits.append(lambda: {"conversations": [{"from": back.get(r, r), "value": t} for r, t in turns]})
    if roles == ["user", "assistant"]:
        fits.append(lambda: {"prompt": turns[0][1], "completion": turns[1][1]})
    if roles[-2:] == ["user", "assistant"] and roles[:-2] in ([], ["system"]):
        head, _, rest = (turns[-2][1] or "").partition("\n\n")
        asked = {"instruction": head, "input": rest} if rest else {"instruction": turns[-2][1]}
        fits.append(lambda: ({"system": turns[0][1]} if len(turns) == 3 else {}) | asked | {"output": turns[-1][1]})
    return json.dumps(fits[zlib.crc32(str(conv_id).encode()) % len(fits)](), ensure_ascii=False)


def to_records(conversations: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """RECORDS of a table (conv_id, turn, role, text) in a mix of layouts, a record per segment of a conversation."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))

    def run(batches):
        made, size = [], 0
        for number, whole, table in segments(batches, max_rows, max_bytes):
            conv_id = table.column(0)[0].as_py()
            made.append((conv_id, number, whole, _record(conv_id, list(zip(table.column(2).to_pylist(), table.column(3).to_pylist(), strict=True)))))
            size += len(made[-1][3])
            if size >= 1 << 20:
                yield _batch(made, RECORDS, [_LONG, _LONG, _BOOL, _TEXT])
                made, size = [], 0
        if made:
            yield _batch(made, RECORDS, [_LONG, _LONG, _BOOL, _TEXT])

    return in_order(rows, "conv_id", ["turn", "role", "hash"]).mapInArrow(run, RECORDS)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """TURNS of RECORDS: the layout by fingerprint, roles and texts; nulls where no layout is declared."""

    def make(conv_id, seg, whole, record):
        key, name, turns = canonical_record(record, layouts)
        return (conv_id, seg, whole, key, name, None if turns is None else [r for r, _ in turns], None if turns is None else [t for _, t in turns])

    return _mapped(records.select("conv_id", "seg", "whole", "record"), make, TURNS, [_LONG, _LONG, _BOOL, _TEXT, _TEXT, _TEXTS, _TEXTS])


def unknown(turns: DataFrame) -> DataFrame:
    """fingerprint, n: records without a declared layout (a null fingerprint: those that are no JSON object)."""
    return turns.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("n"))


def formatted(turns: DataFrame) -> DataFrame:
    """FORMATTED of TURNS; records without turns have no text."""

    def make(conv_id, seg, whole, roles, texts):
        return (conv_id, seg, whole, *((None, None) if roles is None else format_turns(list(zip(roles, texts, strict=True)))))

    return _mapped(turns.select("conv_id", "seg", "whole", "roles", "texts"), make, FORMATTED, [_LONG, _LONG, _BOOL, _TEXT, _INTS])


class _Digest:
    """What is read back of a conversation, part after part."""

    def __init__(self):
        self.n, self.chars, self.size, self.turns, self.loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: list[int]) -> _Digest:
        turns, trained = read_back(text, mask)
        for role, said in turns:
            self.turns.update(f"{role}\n{said}\n".encode())
        for said in trained:
            self.loss.update(said.encode())
            self.chars += len(said)
        self.n, self.size = self.n + len(turns), self.size + len(text)
        return self

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def digests(texts: DataFrame) -> DataFrame:
    """DIGESTS of the conversations of FORMATTED texts, read back from them."""
    folder = f"{shared_dir(texts.sparkSession)}/formatted"

    def make(conv_id, seg, whole, text, mask):
        if whole:
            return (conv_id, None, None, None, *_Digest().add(text, mask).row())
        return (conv_id, seg, put(folder, text.encode()), mask, *[None] * 5)

    kinds = [_LONG, _LONG, _TEXT, _INTS, _LONG, _TEXT, _LONG, _TEXT, _LONG]
    pieces = written(_mapped(texts.where("formatted is not null").select("conv_id", "seg", "whole", "formatted", "mask"), make, PIECES, kinds), "pieces")

    def joined(table: pa.Table) -> pa.Table:
        digest = _Digest()
        for row in table.sort_by([("seg", "ascending")]).to_pylist():
            digest.add(get(folder, row["file"]).decode(), row["mask"])
        return pa.Table.from_batches([_batch([(table["conv_id"][0].as_py(), *digest.row())], DIGESTS, [_LONG, _LONG, _TEXT, _LONG, _TEXT, _LONG])])

    names = [x.split(" ")[0] for x in DIGESTS.split(", ")]
    parts = pieces.where("seg is not null").select("conv_id", "seg", "file", "mask").groupBy("conv_id").applyInArrow(joined, DIGESTS)
    return pieces.where("seg is null").select(*names).unionByName(parts)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table with a conversation whose texts hold the template's own marks."""
    probe = conversations.sparkSession.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, TRAINED, PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def round_trip(conversations: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Lays out, recognises, formats and reads back all conversations."""
    return digests(formatted(canonical(to_records(conversations, max_rows, max_bytes))))


#: The conversations as they are, with the probe; escapes are those of the template.
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, t, r, '{PROBE_TEXT}' FROM (VALUES (0, 'user'), (1, '{TRAINED}')) x(t, r)),
e AS (SELECT *, sha256(text) AS h, regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') AS shown_role, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, h)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{TRAINED}' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = '{TRAINED}' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, h)) AS loss_sha256,
  CAST(sum(len(shown_role) + len(shown) + {len(START) + len(END) + 2}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
