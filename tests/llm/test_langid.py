import zlib
import re
import math
import collections
import itertools
import random

import numpy as np
import pyarrow as pa

import pytest

from lodestone.llm import langid

VOICES = {"en": "the of and tion ing her shed wh th ou ea".split(), "de": "der sch ich ung zu ä ö ei ver be".split(), "ru": "при ова ение сто ный по на".split()}


def speak(lang, n, rng):
    return " ".join("".join(rng.choices(VOICES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 7, 4)
        doc = np.repeat(np.arange(4), sizes)
        score = rng.normal(size=(len(doc), 3)).astype(np.float32)
        got = langid.viterbi(doc, score, 0.8)

        def value(rows, path):
            return sum(float(score[r, p]) for r, p in zip(rows, path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:]))

        for d in range(4):
            rows = np.flatnonzero(doc == d)
            best = max(value(rows, p) for p in itertools.product(range(3), repeat=len(rows)))
            assert abs(value(rows, got[rows]) - best) < 1e-5


def test_identify(spark):
    rng = random.Random(4)
    rows = [(i, speak(lang, rng.randint(3, 80), rng), lang) for i, lang in enumerate(rng.choices(list(VOICES), k=300))]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int").repartition(3)
    out = {r.doc_id: r for r in langid.identify_held_out(docs).collect()}
    assert len(out) == 300
    held = [r for r in rows if out[r[0]].held_out]
    assert 60 < len(held) < 140
    assert sum(out[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    model = langid.train(docs)
    mixed = speak("en", 40, rng) + " " + speak("de", 25, rng) + " " + speak("ru", 30, rng)
    spans = langid.label_spans(model, pa.array([mixed]))[0]
    assert [s[0] for s in spans] == ["en", "de", "ru"]
    edge = [(1, None), (2, ""), (3, "12 34 !?"), (4, "日本語"), (None, speak("de", 9, rng)), (5, speak("en", 60000, rng)), (5, "²½ ×÷")]
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(edge, "doc_id long, text string"), model).collect()]
    assert sorted(x for x in got if x[0])[:3] == [(1, "und"), (2, "und"), (3, "und")]
    assert dict(got)[4] != "und" and dict(got)[None] == "de" and (5, "en") in got and (5, "und") in got
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).collect() == []


def brute_words(text):
    """Words of letters as bytes, lower-cased, and their scripts' bits."""
    out = []
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()):
        scripts = 0
        for c in w.decode("utf-8", "replace"):
            name = next((n for a, z, n in langid.SCRIPTS if a <= ord(c) <= z), None)
            scripts |= 1 << langid.NAMES.index(name) if name else 0
        out.append((w.lower(), scripts))
    return out


def brute_trigrams(word):
    two, one = 1, 0
    for b in word:
        yield ((b * 0x9E3779B1 ^ one * 0x85EBCA77 ^ two * 0xC2B2AE3D) & 0xFFFFFFFF) >> 17
        two, one = one, b


def brute_predict(rows):
    """Training counts, word scores and best label path by plain loops; the whole query's rows."""
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    grams, scripts = {}, {}
    for i, text, lang in rows:
        if not held[i] and lang and text:
            for w, bits in brute_words(text):
                for g in brute_trigrams(w):
                    grams.setdefault(lang, collections.Counter())[g] += 1
                for k in range(len(langid.NAMES)):
                    if bits >> k & 1:
                        scripts.setdefault(lang, collections.Counter())[k] += len(w)
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) for x in langs}
    allowed = {x: sum(1 << k for k, n in scripts.get(x, {}).items() if n >= 0.01 * sum(scripts[x].values())) for x in langs}
    log = lambda x, g: math.log((grams[x][g] + 0.5) / (total[x] + 0.5 * langid.BUCKETS))
    out = {}
    for i, text, _ in rows:
        words = brute_words(text or "")
        if not words or not langid.has_letter(text):
            out[i] = ("und", 0.0)
            continue
        paths = {x: (0.0, []) for x in langs}
        for n, (w, bits) in enumerate(words):
            fit = [x for x in langs if bits & allowed[x] == bits]
            own = {}
            for x in langs:
                mean = [sum(log(y, g) for y in langs) / len(langs) for g in brute_trigrams(w)]
                own[x] = 0.0 if not fit else -1e4 if x not in fit else sum(log(x, g) for g in brute_trigrams(w)) - sum(mean)
            best = max(langs, key=lambda x: paths[x][0])
            new = {}
            for x in langs:
                value, labels = paths[x]
                if n and paths[best][0] - 6.0 > value:
                    value, labels = paths[best][0] - 6.0, paths[best][1]
                new[x] = (value + own[x], [*labels, x])
            paths = new
        labels = paths[max(langs, key=lambda x: paths[x][0])][1]
        size = collections.Counter()
        for (w, _), x in zip(words, labels):
            size[x] += len(w)
        x = min(size, key=lambda x: (-size[x], x))
        out[i] = (x, size[x] / sum(size.values()))
    return out


def test_whole_query_against_plain_loops(spark):
    rng = random.Random(21)
    voices = {"en": "the of and with that from have this".split(), "de": "der die und nicht mit eine über für".split(), "ru": "это что как для она быть".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(list(voices))
        words = rng.choices(voices[lang], k=rng.randint(1, 25))
        if i % 6 == 0:
            words += rng.choices(voices[rng.choice(list(voices))], k=12)
        rows.append((i, " ".join(words), lang if i % 9 else None))
    rows += [(100, "Это the über 日本", "en"), (101, "123 -", "en"), (102, None, "de"), (103, "ωμέγα", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_held_out(docs).collect()}
    expected = brute_predict(rows)
    assert got.keys() == expected.keys()
    for i, (lang, score) in expected.items():
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6, (i, got[i], lang, score)


def test_too_many_labels_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, f"word{chr(97 + i)} and", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than the 3 languages"):
        langid.identify_held_out(docs).collect()
