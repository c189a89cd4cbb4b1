import hashlib
import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, record string, seg int"


def brute(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        groups[conv_id].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    out = {}
    for conv_id, own in groups.items():
        turns = [(x[2], x[4]) for x in sorted(own)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv_id] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["", None, "plain", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|", "<<||>", "a\n\nb", "\n\nc", "a\n\n", "ß 🎉  ", "\\", '{"role": "user"}', "x\x00y"]
    roles = ["user", "assistant", "system", "tool", "human", "gpt", "", None, "odd\nrole", "\\n", "<|im_end|>"]
    rows = []
    for conv_id in range(n):
        k = rng.choice([1, 2, 2, 3, 3, 9])
        shape = rng.random()
        named = ["system"] * (k == 3) + ["user", "assistant"] * 9
        for t in range(k):
            role = named[t] if shape < 0.6 else rng.choice(roles)
            rows.append((conv_id, t, role, rng.choice(texts) if rng.random() < 0.7 else f"text {t} of {conv_id}"))
    return rows + [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (3, 0, "user", "again"), (3, 0, "user", "again")]


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    assert all(r.formatted_chars >= r.loss_chars for r in rows)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_round_trip_against_brute_force(spark):
    rows = conversations(1, 150) + [(900, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(400)]
    table = chat.with_probe(spark.createDataFrame([(*r, "r", 1) for r in rows], SCHEMA).repartition(4))
    want = brute([*rows, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")])
    assert result(chat.round_trip(table)) == want
    assert result(chat.round_trip(table, max_rows=2)) == want
    layouts = {r.layout for r in chat.canonical(chat.to_records(table)).collect()}
    assert layouts == {x.name for x in chat.LAYOUTS}


def test_empty_table(spark):
    assert chat.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "record, layout, turns",
    [
        ({"prompt": "q", "completion": None}, "prompt", [("user", "q"), ("assistant", "")]),
        ({"output": "o", "instruction": "i"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": "o", "system": "s", "id": 4}, "instruction", [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"messages": []}, "messages", []),
        ({"messages": [{"role": "user", "content": 3}, {"content": "x", "role": "assistant", "name": "n"}]}, "messages", [("user", "3"), ("assistant", "x")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, "parts", [("user", "ab")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "system", "value": "s"}]}, "from_value", [("user", "h"), ("assistant", "g"), ("system", "s")]),
        ({"dialog": {"id": 1, "turns": [{"speaker": {"role": "user"}, "body": {"text": "t"}}]}}, "nested", [("user", "t")]),
        ({"prompt": "q"}, None, None),
        ({"prompt.completion": 1, "prompt": "x"}, None, None),
    ],
)
def test_layouts(record, layout, turns):
    key, name, found = chat.canonical_record(json.dumps(record))
    assert (name, found) == (layout, turns) and key


def test_unknown_layouts(spark):
    texts = ['{"a": 1}', '{"a": {}}', '{"b": [1, 2, 3]}', '{"b": [4]}', "[1]", "no json", None]
    records = spark.createDataFrame([(i, i, True, t) for i, t in enumerate(texts)], chat.RECORDS)
    turns = chat.canonical(records)
    assert sorted(r.n for r in chat.unknown(turns).collect()) == [2, 2, 3]
    assert {r.n for r in chat.unknown(turns).where("fingerprint is null").collect()} == {3}
    assert chat.digests(chat.formatted(turns)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("us<|>\\n\n", max_size=6), st.text("<|\\>im_endstar\n", max_size=30))))
def test_template_is_reversible(turns):
    text, mask = chat.format_turns(turns)
    back, trained = chat.read_back(text, mask)
    assert back == turns and trained == [t for r, t in turns if r == "assistant"]
