"""Filter interaction audit: what each filter removes under every order of the filters.

A document's failures are a bit mask. Duplicates are found by sorting: documents are range-sorted by (text fingerprint,
doc_id), sorted by (fingerprint, full text, doc_id) within a task, and compared with their predecessor, so that a large
group of copies lies over several tasks. At the border of tasks a text's least document is open: each task tells the texts
of its last fingerprint with their least id, and an open document is a duplicate if an earlier task told its text with a
smaller id. The masks of all documents are then counted per part and label; all orders and steps follow from these counters,
which are additive, so nothing is ever counted twice or held per document.

Edge cases: a null text is an empty one (which has no words, no code points, and equals other empty ones); a null doc_id is
smaller than none and has no labels; documents that share an id do not make each other duplicates; of several label rows of
an id each flag holds if any has it; parts that differ in null and empty are one; other columns, whatever their names, are
not read; an empty table has no parts.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality import let, words_of
from lodestone.llm.shared import give_back, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, MARKS = 200, 50, 3, r"[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")
FOUND = "doc_id long, part string, mask int, kind int, task int, print long, text string, n long"
COUNTERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_mask(text: Column) -> Column:
    """The bits of the filters that look at one text only."""

    def of_words(words: Column) -> Column:
        few = F.when(F.size(words) < MIN_WORDS, 1).otherwise(0)
        poor = F.when(100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words), 2).otherwise(0)
        return few + poor

    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    loud = F.when(100 * capitals > MAX_CAPITAL_PERCENT * F.length(text), 4).otherwise(0)
    marked = F.when(text.rlike(MARKS), 8).otherwise(0)
    return (let(words_of(text), of_words) + loud + marked).cast("int")


class Run:
    """The copies of one text within a task."""

    def __init__(self, fingerprint: int, text: str):
        self.fingerprint, self.text, self.least, self.open = fingerprint, text, None, {}

    def fails(self, doc_id: int | None, part: str, mask: int, border: bool) -> bool | None:
        """Whether a document, the next of this run, is a duplicate; None if an earlier task may hold a smaller id."""
        if doc_id is None:
            return False
        if self.least is None:
            self.least = doc_id
        if doc_id > self.least:
            return True
        if border:
            self.open[part, mask] = self.open.get((part, mask), 0) + 1
            return None
        return False


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """FOUND rows of range-sorted documents. kind 0: n documents with their whole mask; kind 1: n documents of a text whose
    duplicate bit is open; kind 2: a text of a task's last fingerprint with its least id."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    # the mask comes after the exchange, so that sampling for the ranges does not compute it
    ranged = rows.withColumn("print", F.xxhash64("text")).repartitionByRange("print", "doc_id", "tie").sortWithinPartitions("print", "text", "doc_id")
    ranged = ranged.select("doc_id", "part", own_mask(F.col("text")).alias("mask"), "print", "text")

    def run(batches):
        task = TaskContext.get().partitionId()
        now, first, tail = None, None, []  # tail: finished runs of the current fingerprint
        opened: list[Run] = []

        def table(made):
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in FOUND.split(", ")])

        for b in batches:
            made = []
            ids, parts, masks, prints = (b.column(i).to_pylist() for i in range(4))
            texts = b.column(4)
            for i, (doc_id, part, mask, fingerprint) in enumerate(zip(ids, parts, masks, prints, strict=True)):
                if now is None or fingerprint != now.fingerprint:
                    tail, text = [], texts[i].as_py()
                    first = fingerprint if now is None else first
                    now = Run(fingerprint, text)
                    tail.append(now)
                    opened += [now] * (fingerprint == first)
                elif (text := texts[i].as_py()) != now.text:  # another text with this fingerprint
                    now = Run(fingerprint, text)
                    tail.append(now)
                    opened += [now] * (fingerprint == first)
                again = now.fails(doc_id, part, mask, fingerprint == first)
                if again is not None:
                    made.append((doc_id, part, mask | DUPLICATE * again, 0, task, None, None, 1))
            if made:
                yield table(made)
        made = [(r.least, part, mask, 1, task, r.fingerprint, r.text, n) for r in opened for (part, mask), n in r.open.items()]
        made += [(r.least, None, None, 2, task, r.fingerprint, r.text, 1) for r in tail if r.least is not None]
        if made:
            yield table(made)
        give_back()

    return ranged.mapInArrow(run, FOUND)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: how many documents of an id and a part have the mask."""
    found = written(compared(docs, id_col, text_col, part_col), "found")
    told = found.where("kind = 2").select("print", "text", F.col("doc_id").alias("least"), F.col("task").alias("from"))
    open_ = found.where("kind = 1").select("doc_id", "part", "mask", "n", "task", "print", "text")
    # of a text only its first task's least id matters
    told = told.groupBy("print", "text").agg(F.min(F.struct("from", "least")).alias("told"))
    closed = open_.join(told, ["print", "text"], "left")
    again = F.coalesce((F.col("told.from") < F.col("task")) & (F.col("told.least") < F.col("doc_id")), F.lit(False))
    closed = closed.select("doc_id", "part", F.when(again, F.col("mask").bitwiseOR(DUPLICATE)).otherwise(F.col("mask")).alias("mask"), "n")
    return found.where("kind = 0").select("doc_id", "part", "mask", "n").unionByName(closed).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def counters(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents with a mask, and how many of them have each label."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    own = own.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return masked.join(own, "doc_id", "left").groupBy("part", "mask").agg(flag("good"), flag("toxic"), F.sum("n").alias("n"))


ORDERS = ["".join(x) for x in itertools.permutations(FILTERS)]


def _places() -> list[tuple[int, int, str, int]]:
    """(bit of a filter, bits of those before it, order, step) of every step of every order."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [(bit[f], sum(bit[x] for x in order[:k]), order, k + 1) for order in ORDERS for k, f in enumerate(order)]


def interaction(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the COUNTERS, from the rows of counters(). A step's counters depend only on its filter
    and on the set of those before it, so they are summed per such pair and then given to the orders that have it."""
    places = _places()
    pairs = F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(e).alias("before")) for b, e in sorted({x[:2] for x in places})))
    totals = counted.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    each = totals.select("*", F.inline(pairs))
    failing, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    among = lambda test, c: F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    here = failing & ~earlier
    # of all orders, a document that fails k filters is removed by each of them in one of k
    own_orders = F.when(failing, F.col("n") * F.expr(f"{len(ORDERS)} div bit_count(mask)")).otherwise(0)
    summed = each.groupBy("part", "bit", "before").agg(
        among(~failing & ~earlier, "n").alias("kept"), among(here, "n").alias("removed"), among(failing & earlier, "n").alias("redundant"),
        among(F.col("mask") == F.col("bit"), "n").alias("unique_fails"), among(here, "good").alias("good_lost"), among(here, "toxic").alias("toxic_lost"),
        F.sum(own_orders).cast("long").alias("shapley"),
    )
    table = counted.sparkSession.createDataFrame(places, "bit int, before int, filter_order string, step int")
    return summed.join(F.broadcast(table), ["bit", "before"]).select("part", "filter_order", "step", *COUNTERS)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of a table of documents (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    return interaction(counters(masks(docs), labels))


ORACLE = rf"""
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT x AS o FROM letters UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit, list_sum(list_transform(range(1, s), lambda k: 1 << (ascii(o[k]) - 65))) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS s) WHERE len(o) = 5),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT doc_id, part, (len(w) < {MIN_WORDS})::INT + 2 * (100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w))::INT
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > {MAX_CAPITAL_PERCENT} * len(t))::INT + 8 * regexp_matches(t, '{MARKS}')::INT
    + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM d),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL)
SELECT part, o AS filter_order, s::INT AS step,
  sum(CASE WHEN mask & bit = 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::INT = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & bit <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM c, steps GROUP BY part, o, s
"""
