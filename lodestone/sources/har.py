"""HAR archives: entries to candidates, bodies decoded within limits."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.functions.core import text
from lodestone.sources.network import header
from lodestone.storage import written

_HEADERS = "array<struct<name:string,value:string>>"
_ENTRY = (
    "struct<startedDateTime:string,pageref:string,request:struct<url:string,headers:" + _HEADERS + ">,"
    "response:struct<status:int,bodySize:bigint,headers:" + _HEADERS + ",content:struct<mimeType:string,size:bigint,text:string,encoding:string>>>"
)
SCHEMA = f"log struct<entries:array<{_ENTRY}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """archive (file name), text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("archive"), F.col("value").alias("text"))


def errors(archives: DataFrame) -> DataFrame:
    """archive, error: empty if the archive can be read."""
    parsed = F.try_parse_json("text")
    entries = F.from_json("text", SCHEMA)["log"]["entries"]
    return archives.select("archive", F.when(parsed.isNull(), "not valid JSON").when(entries.isNull(), "no log.entries").otherwise("").alias("error"))


def entries(archives: DataFrame) -> DataFrame:
    """A row per entry: pos, url, mime_type, bytes, status, timestamp (epoch ms, 0 if unknown), content."""
    return _facts(archives.select("archive", F.posexplode(F.from_json("text", SCHEMA)["log"]["entries"]).alias("pos", "e")))


def _facts(rows: DataFrame) -> DataFrame:
    """The columns of entries() from (archive, pos, e)."""
    response, content = F.col("e.response"), F.col("e.response.content")
    length = header(response["headers"], "content-length").try_cast("double")
    size = F.coalesce(F.when(content["size"] > 0, content["size"].cast("double")), F.when(response["bodySize"] > 0, response["bodySize"].cast("double")), F.when(length > 0, length))
    mime = F.when(text(content["mimeType"]) != "", content["mimeType"]).otherwise(header(response["headers"], "content-type"))
    return rows.select(
        "archive", "pos", text(F.col("e.request.url")).alias("url"), mime.alias("mime_type"), size.alias("bytes"), F.coalesce(response["status"], F.lit(0)).alias("http_status"),
        F.coalesce(F.unix_millis(F.col("e.startedDateTime").try_cast("timestamp")), F.lit(0)).alias("timestamp"), content.alias("content"),
    )


def candidates(archives: DataFrame, max_items: int = K.MAX_ITEMS_PER_TAB) -> DataFrame:
    """Accepted entries: answered, media, not junk, first of their key, at most ``max_items`` an archive."""
    rows = _judged(entries(archives))
    kept = rows.where("verdict = ''").withColumn("n", F.row_number().over(Window.partitionBy("archive", "normalized_url").orderBy("pos"))).where("n = 1")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("archive").orderBy("pos"))).where(F.col("n") <= max_items).drop("n", "verdict").withColumns({"source": F.lit("har"), "status": F.lit("background")})


def _judged(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"kind": M.classify(F.col("url"), F.col("mime_type")), "normalized_url": U.normalize_url(F.col("url"))})
    reason = M.rejection_reason(F.col("url"), F.lit(0), F.lit(0), F.col("bytes"))
    return rows.withColumn("verdict", F.when(F.col("http_status") >= 400, "skipped").when(F.col("kind") == "", "other").when(reason != "", "skipped").when(F.col("normalized_url") == "", "skipped").otherwise(""))


def skipped(archives: DataFrame, max_items: int = K.MAX_ITEMS_PER_TAB) -> DataFrame:
    """archive, items, skipped: entries that are not media are not counted."""
    rows = _judged(entries(archives))
    n = rows.groupBy("archive").agg(F.count_if(F.col("verdict") != "other").alias("media"))
    kept = candidates(archives, max_items).groupBy("archive").agg(F.count("*").alias("items"))
    return n.join(kept, "archive", "left").select("archive", F.coalesce("items", F.lit(0)).alias("items"), (F.col("media") - F.coalesce("items", F.lit(0))).alias("skipped"))


def decode_body(content: Column, max_bytes: int = K.HAR_BODY_MAX) -> Column:
    """The body's bytes; null if empty, malformed or above the limit, which is checked before anything is decoded."""
    body = text(content["text"])
    is64 = F.lower(text(content["encoding"])) == "base64"
    fits = F.when(is64, F.length(body) <= (max_bytes * 4 + 2) // 3 + 4).otherwise(F.octet_length(body) <= max_bytes)
    raw = F.when(is64, F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64"))).otherwise(F.encode(body, "UTF-8"))
    return F.when((body != "") & fits, F.when((F.octet_length(raw) > 0) & (F.octet_length(raw) <= max_bytes), raw))


def with_bodies(rows: DataFrame, max_bytes: int = K.HAR_BODY_MAX, total: int = K.HAR_TOTAL_MAX) -> DataFrame:
    """candidates() with body, within the archive's total: bodies are taken in order, one that does not fit is left out and
    a later, smaller one may fit. Only positions and sizes are gathered per archive, never bodies."""
    rows = rows.withColumn("body", decode_body(F.col("content"), max_bytes))
    sizes = rows.where("body is not null").groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("pos", F.octet_length("body").cast("long").alias("size")))).alias("all"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["size"] <= total, F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["kept"], F.array(x["pos"])).alias("kept"))).otherwise(a)
    kept = sizes.select("archive", F.explode(F.aggregate("all", zero, step)["kept"]).alias("pos"), F.lit(True).alias("har_body"))
    out = rows.join(kept, ["archive", "pos"], "left")
    return out.withColumns({"har_body": F.coalesce("har_body", F.lit(False)), "body": F.when(F.col("har_body"), F.col("body"))}).drop("content")


# ---------------------------------------------------------------- archives of any size

_MARK = '"startedDateTime"'
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)
_PARTS = "archive string, block long, at long, rest string, whole array<string>, head string, key boolean"


def cut(piece: str, first: bool) -> tuple[str, list[str], str]:
    """Of the text between two marks: (what ends the object of the mark before it, whole objects of arrays after that, what
    begins the object of the mark after it). Marks are strings themselves, so both ends of a piece lie outside of strings."""
    at, rest, whole = 0, "", []
    stack: list[tuple[str, int]] = [] if first else [("{", 0)]
    ended = first
    for m in _TOKEN.finditer(piece):
        c = m[0]
        if c in "{[":
            stack.append((c, m.start()))
        elif c in "}]" and stack:
            _, begun = stack.pop()
            if not stack and not ended:
                rest, ended, at = piece[: m.end()], True, m.end()
            elif ended and c == "}" and begun >= at and (stack[-1][0] == "[" if stack else not first):
                whole = [x for x in whole if x[0] < begun] + [(begun, piece[begun : m.end()])]
    open_object = next((begun for c, begun in reversed(stack) if c == "{"), len(piece))
    return (rest if ended else piece), [x for _, x in whole], piece[open_object:] if ended else ""


def entries_in_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of entries() for archives of any size. The reader splits them at the key that every entry begins its time with,
    by byte ranges as it does with lines, so no task and no row holds an archive; a task finds where entries end in its
    pieces, and only what stands before that key in an entry travels to the piece after it. An entry is an object with a
    request or a response. Archives in which the key occurs as a value are read as a whole.
    """
    lines = spark.read.option("lineSep", _MARK).text(path).select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")

    def run(batches):
        for b in batches:
            made = []
            for archive, block, at, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = re.match(r"\s*:", value) is not None
                # a first piece does not continue an object: it stands at the file's start, before any mark
                made.append((archive, block, at, *cut(value, first=not key), key))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in _PARTS.split(", ")])

    parts = written(lines.mapInArrow(run, _PARTS))
    order = Window.partitionBy("archive").orderBy("block", "at")
    thin = parts.select("archive", "block", "at", F.lag("head").over(order).alias("head"), F.row_number().over(order).alias("n"), "key")
    odd = thin.where("n > 1 and not key").select("archive").distinct()
    texts = parts.drop("head", "key").join(thin.select("archive", "block", "at", "head", "n"), ["archive", "block", "at"]).join(odd, "archive", "left_anti")
    own = F.when(F.col("n") > 1, F.concat(F.coalesce("head", F.lit("{")), F.lit(_MARK), "rest"))
    each = texts.select("archive", "n", F.posexplode(F.filter(F.concat(F.array(own), F.coalesce("whole", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("k", "text"))
    found = each.select("archive", "n", "k", F.from_json("text", _ENTRY).alias("e")).where("e.request is not null or e.response is not null")
    place = F.row_number().over(Window.partitionBy("archive").orderBy("n", "k")) - 1
    # only numbers are ordered per archive; the entries stay where they are
    found = written(found)
    placed = found.select("archive", "n", "k", place.alias("pos"))
    rows = _facts(found.join(placed, ["archive", "n", "k"]).select("archive", "pos", "e"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("archive"), F.col("value").alias("text"))
    return rows.unionByName(entries(whole.join(odd, "archive", "left_semi")))
