"""Line-first quality rules in DataFrame functions only.

Each line is judged by itself: it fails if it ends without closing punctuation, is a navigation bar (separators between
few words), carries more than one symbol in ten words, or has at most PHRASE_LINE_WORDS words and a boilerplate phrase. Failing lines are removed; a document
that loses more than ``max_lost_percent`` of its characters is rejected, as is one that fails the base rules (fewer than
MIN_WORDS words, or more than half of its words in repeated 3-word windows).

Everything is computed inside the row: no explode, no shuffle. Repeated windows are found by sorting the pairs of each
window's 64-bit hash and its place, so that equal windows become neighbours, however long the text is.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; lines without a word neither pass nor
fail; a very long text is one row of long arrays; repeated rows and ties are judged each on its own; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_LOST_PERCENT = 50

#: White space between words; symbols; closing punctuation; separators of navigation bars; boilerplate.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
CLOSING = """.!?:;…"'”’»)]。！？」』）】》〉।॥؟۔؛։።"""
SEPARATORS = r"[|»›·•]"
PHRASES = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "general public license",
    "enable javascript",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "lorem ipsum",
    "click here",
)
#: A line of more words does not fail by a phrase: it would be less than a tenth of the line.
PHRASE_LINE_WORDS = 30
_CLOSED = "[" + CLOSING.replace("]", "\\]") + r"][\x20\x09-\x0D]*\z"
_PHRASE = "(" + "|".join(PHRASES) + ")"


def let(value: Column, body) -> Column:
    """body(value), with ``value`` computed once a row though body may use it in lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more. What the lambdas use is bound once a row."""

    def count(w: Column) -> Column:
        n = F.size(w)
        window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))

        def repeated(s: Column) -> Column:
            size = F.size(s)
            near = F.zip_with(F.slice(s, F.lit(2), size - 1), F.slice(s, F.lit(1), size - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.when(size < 2, F.array().cast("array<int>")).otherwise(F.flatten(F.array_compact(near)))

        places = F.sort_array(let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)), repeated))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.aggregate(places, start, step, lambda a: a["n"]))

    return let(words, count)


def line_passes(line: Column, doc: Column | None = None) -> Column:
    """The verdict on one line; a line without a word passes. doc: what the whole text says of the costlier tests, so that
    texts without symbols, separators or phrases skip them (fields symbols, separators, phrases)."""
    has = (lambda f: F.lit(True)) if doc is None else (lambda f: doc[f])
    n = F.regexp_count(line, F.lit(WORD))
    bars = F.regexp_count(line, F.lit(SEPARATORS))

    def closed(cut: Column) -> Column:
        return (cut == "") | (F.instr(F.lit(CLOSING), F.right(cut, F.lit(1))) > 0) & ~(has("separators") & (bars >= 2) & (bars * 4 >= n)) & ~(has("symbols") & let(F.regexp_count(line, F.lit(SYMBOLS)), lambda k: (k > 0) & (k * 10 > n))) & ~(has("phrases") & (n <= PHRASE_LINE_WORDS) & let(F.lower(line), boilerplate))

    return let(F.rtrim(line, F.lit(SPACE)), closed)


def boilerplate(lower: Column) -> Column:
    out = F.lit(False)
    for phrase in PHRASES:
        out = out | lower.contains(phrase)
    return out


def cleaned(text: Column, lines: Column) -> Column:
    """The lines that pass, in order."""
    separators = F.lit(False)
    for mark in SEPARATORS.strip("[]"):
        separators = separators | text.contains(mark)
    doc = F.struct(text.rlike(SYMBOLS).alias("symbols"), separators.alias("separators"), let(F.lower(text), boilerplate).alias("phrases"))
    return let(doc, lambda d: F.array_join(F.filter(lines, lambda x: line_passes(x, d)), "\n"))


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The carried columns, the measures of the base rules, cleaned text, lost characters, and the verdict."""
    carried = F.struct(*(F.col(c) for c in carry)).alias("carried")
    rows = docs.select(carried, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("carried", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    with_word = F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE)) != "")
    measures = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        cleaned(F.col("text"), F.col("lines")).alias("cleaned"),
        F.length("text").cast("long").alias("n_chars"),
    )
    # through a generator, so that a later filter on a measure is not moved below it and its expression computed twice
    rows = rows.select("carried", F.inline(F.array(measures)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.col("n_chars") - F.length("cleaned")
    kept = ~failed & (100 * lost <= max_lost_percent * F.col("n_chars"))
    return rows.select("carried.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", lost.cast("long").alias("lost_chars"), failed.alias("base_failed"), kept.alias("kept"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
u AS (SELECT doc_id, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
v AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM v WHERE c IS NOT NULL),
x AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM r WHERE n > 1) GROUP BY doc_id),
y AS (SELECT doc_id, len(t) AS n_chars, len(ws) AS n_words,
  len(array_to_string(ws, '')) AS word_chars,
  len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
  len(list_filter(ls, lambda l: regexp_matches(l, '{WORD}'))) - len(list_distinct(list_filter(ls, lambda l: regexp_matches(l, '{WORD}')))) AS n_dup_lines,
  len(array_to_string(list_filter(ls, lambda l: NOT regexp_matches(l, '{WORD}') OR (
    regexp_matches(l, '{_CLOSED.replace("'", "''")}')
    AND NOT (len(regexp_extract_all(l, '{SEPARATORS}')) >= 2 AND len(regexp_extract_all(l, '{SEPARATORS}')) * 4 >= len(regexp_extract_all(l, '{WORD}')))
    AND NOT len(regexp_extract_all(l, '{SYMBOLS}')) * 10 > len(regexp_extract_all(l, '{WORD}'))
    AND NOT (len(regexp_extract_all(l, '{WORD}')) <= {PHRASE_LINE_WORDS} AND regexp_matches(lower(l), '{_PHRASE}')))), chr(10))) AS cleaned_chars
  FROM w),
z AS (SELECT y.*, coalesce(x.n_repeat_words, 0) AS n_repeat_words FROM y LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars - cleaned_chars AS lost_chars,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_chars - cleaned_chars) <= {MAX_LOST_PERCENT} * n_chars AS kept
FROM z
"""
