"""Language identification of words, spans and documents.

Training counts hashed byte trigrams of lower-cased words per language, over all labelled training rows, and which
scripts a language's letters are in. Prediction: the scripts of a word's letters narrow the languages that it may be in;
each word gets a log-likelihood for every language left; Viterbi with a penalty for each switch labels the words, so that a text in
several languages falls into spans. The document's language is the one whose spans hold the most letters-bearing bytes,
its score the share of these bytes.

The model's size is bounded by MAX_LANGUAGES x BUCKETS; more labels raise, for they are no languages. Only text and, in training, the label are read.

Edge cases: null text and text without a letter get the language ``und`` and score 0; equal shares go to the language
first in alphabetical order; without training rows every text is ``und``; repeated rows count as often as they occur;
an empty table gives an empty table; whole texts are read however long; other columns never clash.
"""

from __future__ import annotations

import dataclasses
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import small_batches, text_bytes, written

BUCKETS = 1 << 15
#: The model is broadcast, 128 KB a language; a label column with more values than this is refused.
MAX_LANGUAGES = 512
UNDETERMINED = "und"

#: Script ranges (fixed values): first code point, last code point, script.
SCRIPTS = (
    (0x0041, 0x005A, "Latin"),
    (0x0061, 0x007A, "Latin"),
    (0x00AA, 0x024F, "Latin"),
    (0x1E00, 0x1EFF, "Latin"),
    (0x0370, 0x03FF, "Greek"),
    (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"),
    (0x08A0, 0x08FF, "Arabic"),
    (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0DFF, "Indic"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0FFF, "Tibetan"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"),
    (0xAC00, 0xD7AF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"),
    (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"),
    (0x20000, 0x3FFFF, "Han"),
)
NAMES = ("Other", *dict.fromkeys(s for *_, s in SCRIPTS))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def _lead_scripts() -> np.ndarray:
    """Script number by the first two bytes of a UTF-8 sequence; 255: not the head of a letter. Code points that share
    two head bytes share a row of this table's ranges, to within blocks of 64 or 4096."""
    table = np.full((256, 256), 255, np.uint8)
    for b in (*range(0x41, 0x5B), *range(0x61, 0x7B)):
        table[b, :] = NAMES.index("Latin")
    for lead in range(0xC2, 0xF5):
        for second in range(0x80, 0xC0):
            size = 64 if lead < 0xE0 else 4096 if lead < 0xF0 else 1 << 18
            low = (lead & 0x1F) << 6 | second & 0x3F if lead < 0xE0 else (lead & 0x0F) << 12 | (second & 0x3F) << 6 if lead < 0xF0 else (lead & 7) << 18 | (second & 0x3F) << 12
            high = low if size == 64 else low + 63 if size == 4096 else low + 4095
            if lead == 0xC2 and low not in (0xAA, 0xB5, 0xBA) or low in (0xD7, 0xF7) or 0x2000 <= low <= 0x2BFF or 0xE000 <= low <= 0xF8FF:
                continue
            table[lead, second] = next((NAMES.index(s) for a, z, s in SCRIPTS if a <= high and low <= z), 0)
    return table


_SCRIPT = _lead_scripts()
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def features(column: pa.Array):
    """Per byte that belongs to a word of letters: the trigram bucket. Per word: start among these bytes, document, script bits.

    A word is a run of ASCII letters and bytes above 127; a trigram is the byte and the two before it, the word's edge
    counting as a byte.
    """
    data, offsets = text_bytes(column)
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint32)
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = letter[heads]
    at = np.flatnonzero(letter)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint32)
    low = _LOWER[data[at]].astype(np.uint32)
    is_first = first[at]
    one = np.empty_like(low)
    one[0], one[1:] = 0, low[:-1]
    one[is_first] = 0
    two = np.empty_like(low)
    two[0], two[1:] = 0, one[:-1]
    two[is_first] = 1
    bucket = ((low * np.uint32(0x9E3779B1)) ^ (one * np.uint32(0x85EBCA77)) ^ (two * np.uint32(0xC2B2AE3D))) >> np.uint32(32 - 15)
    start = np.flatnonzero(is_first)
    doc = np.searchsorted(offsets, at[start], "right") - 1
    following = np.zeros(len(data), np.uint8)
    following[:-1] = data[1:]
    script = _SCRIPT[data[at], following[at]]
    bits = np.where(script == 255, np.uint32(0), np.uint32(1) << np.minimum(script, 31).astype(np.uint32))
    word_bits = np.bitwise_or.reduceat(bits, start) if len(start) else np.zeros(0, np.uint32)
    return bucket.astype(np.int64), start, doc, word_bits


@dataclasses.dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log-likelihood relative to the languages' mean
    scripts: np.ndarray  # script bits by language
    switch: float


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", switch: float = 6.0, min_script_share: float = 0.01) -> Model:
    """Counts over all rows with text and label: partial sums per task, at most languages x (BUCKETS + scripts) rows in the end."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for b in small_batches(batches):
            names, code = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            bucket, start, doc, bits = features(b.column(1))
            if not len(start):
                continue
            lang = code[doc]
            length = np.diff(np.append(start, len(bucket)))
            each = np.bincount(np.repeat(lang, length) * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for k, name in enumerate(names):
                total = totals.setdefault(name, np.zeros(BUCKETS + len(NAMES), np.int64))
                total[:BUCKETS] += each[k]
                for s in range(len(NAMES)):
                    total[BUCKETS + s] += int(length[(lang == k) & (bits >> np.uint32(s) & np.uint32(1)).astype(bool)].sum())
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    counts = written(rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    several = counts.select("lang").distinct().count()
    if several > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has {several} values with words, more than the {MAX_LANGUAGES} languages that a model may have")
    counts = counts.toArrow()
    names, code = np.unique(np.array(counts.column("lang").to_pylist(), object), return_inverse=True)
    dense = np.zeros((len(names), BUCKETS + len(NAMES)))
    dense[code, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    grams, scripts = dense[:, :BUCKETS], dense[:, BUCKETS:]
    log = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    bits = ((share >= min_script_share) * (1 << np.arange(len(NAMES)))).sum(1).astype(np.uint32) if len(names) else np.zeros(0, np.uint32)
    return Model([str(x) for x in names], (log - log.mean(0)).T.astype(np.float32).copy() if len(names) else np.zeros((BUCKETS, 0), np.float32), bits, switch)


def word_scores(model: Model, column: pa.Array):
    """Per word: document, bytes, log-likelihood by language (languages that its scripts rule out get -inf-like scores)."""
    bucket, start, doc, bits = features(column)
    n, k = len(start), len(model.languages)
    length = np.diff(np.append(start, len(bucket)))
    allowed = (bits[:, None] & model.scripts[None, :]) == bits[:, None]
    none = ~allowed.any(1)
    allowed[none] = True
    score = np.full((n, k), -1e4, np.float32)
    for lang in np.flatnonzero(allowed[~none].any(0)):  # languages of other scripts than the batch's are not looked up
        score[:, lang] = np.where(allowed[:, lang], np.add.reduceat(model.table[bucket, lang], start), np.float32(-1e4))
    score[none] = 0
    return doc, length, score


def viterbi(doc: np.ndarray, score: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: the sum of scores less ``switch`` for each change of label within a document.

    All documents advance together, a word at a time, so a step costs one array operation.
    """
    n, k = score.shape
    labels = np.zeros(n, np.int64)
    if not n:
        return labels
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(start, n))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    longest = int(length[0])
    live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")  # documents with a word t
    back = np.empty(n, np.int8 if k < 128 else np.int16)  # at a word: the best label before it if it switches, by place
    stay = np.empty((n, k), bool)
    value = score[start].astype(np.float64)
    ends = np.empty(len(start), np.int64)
    for t in range(1, longest):
        m, before = live[t], live[t - 1]
        if m < before:
            ends[m:before] = value[m:before].argmax(1)
            value = value[:m]
        at = start[:m] + t
        top = value.argmax(1)
        best = value[np.arange(m), top] - switch
        keep = value >= best[:, None]
        back[at], stay[at] = top, keep
        value = np.where(keep, value, best[:, None]) + score[at]
    ends[: len(value)] = value.argmax(1)
    state = np.empty(len(start), np.int64)
    for t in range(longest - 1, -1, -1):
        m, after = live[t], live[t + 1] if t + 1 < longest else 0
        state[after:m] = ends[after:m]
        at = start[:m] + t
        labels[at] = state[:m]
        if t:
            state[:m] = np.where(stay[at, state[:m]], state[:m], back[at])
    return labels


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def label_spans(model: Model, column: pa.Array) -> list[list[tuple[str, int]]]:
    """Per text: the (language, bytes of words) of its spans, in order."""
    doc, length, score = word_scores(model, column)
    out: list[list[tuple[str, int]]] = [[] for _ in range(len(column))]
    if not model.languages or not len(doc):
        return out
    label = viterbi(doc, score, model.switch)
    edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])))
    for d, k, size in zip(doc[edge].tolist(), label[edge].tolist(), np.add.reduceat(length, edge).tolist(), strict=True):
        out[d].append((model.languages[k], size))
    return out


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The carried columns, lang_pred, score, n_spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, F.coalesce(text_col, F.lit("")).alias("text to read"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())])

    def run(batches):
        for b in small_batches(batches, 4096, 2 << 20):
            column = b.column(b.num_columns - 1)
            out = []
            for text, spans in zip(column.to_pylist(), label_spans(shared.value, column), strict=True):
                if not spans or not has_letter(text):
                    out.append((UNDETERMINED, 0.0, 0))
                    continue
                sizes: dict[str, int] = {}
                for lang, size in spans:
                    sizes[lang] = sizes.get(lang, 0) + size
                lang = min(sizes, key=lambda x: (-sizes[x], x))
                out.append((lang, sizes[lang] / sum(sizes.values()), len(spans)))
            pred, score, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred), pa.array(score), pa.array(n, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def held_out_remainder(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 3 (null id: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def identify_held_out(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learns from rows whose remainder is not 1 and predicts for all rows; a null doc_id is learned from and not held out.
    The carried columns (doc_id among them), held_out, lang_pred, score, n_spans."""
    held = F.coalesce(held_out_remainder() == 1, F.lit(False))
    model = train(docs.where(~held))
    return identify(docs, model, carry).select(*carry, held.alias("held_out"), "lang_pred", "score", "n_spans")
