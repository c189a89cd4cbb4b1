"""Network evidence: requests before and after their headers, and payloads seen by pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.functions.core import number, text

RESOURCE_TYPES = ["image", "media", "xmlhttprequest", "object", "other", "sub_frame"]


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever its case; empty if there is none."""
    return text(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), 0)["value"])


def relevant(requests: DataFrame) -> DataFrame:
    return requests.where(F.col("type").isin(RESOURCE_TYPES) & (F.col("tab_id") >= 0))


def _candidates(rows: DataFrame) -> DataFrame:
    kind = M.classify(F.col("url"), F.col("mime_type"))
    rows = rows.withColumns({"kind": F.when(kind != "", kind).otherwise(M.kind_from_ext(M.ext_of(F.col("url")))), "source": F.lit("net"), "status": F.lit("background"), "width": F.lit(0.0), "height": F.lit(0.0)})
    return rows.where((F.col("kind") != "") & (M.rejection_reason(F.col("url"), F.col("width"), F.col("height"), F.col("bytes")) == ""))


def before_request(requests: DataFrame) -> DataFrame:
    """First pass: only URLs whose extension is a media type's."""
    rows = relevant(requests).where(M.kind_from_ext(M.ext_of(F.col("url"))) != "")
    return _candidates(rows.withColumns({"mime_type": F.lit(""), "bytes": F.lit(None).cast("double"), "content_disposition": F.lit("")}))


def headers_received(responses: DataFrame) -> DataFrame:
    """Second pass: type and size from the headers; a size of 0 or none is unknown."""
    size = number(header(F.col("headers"), "content-length"))
    rows = relevant(responses).withColumns({"mime_type": header(F.col("headers"), "content-type"), "bytes": F.when(size > 0, size), "content_disposition": F.substring(header(F.col("headers"), "content-disposition"), 1, 256)})
    return _candidates(rows)


def payload_action(content_type: Column, is_fetch: Column, body_length: Column) -> Column:
    """What to do with a response that a page reads: walk its JSON, report its URL, or skip it."""
    kind = F.lower(F.trim(F.substring_index(text(content_type), ";", 1)))
    json = kind.rlike(r"\A(?:application|text)/(?:[\w.+-]+\+)?json\z") | ((kind == "") & is_fetch)
    return F.when(kind.rlike(r"\A(?:image|video|audio)/"), "report").when(json & (F.coalesce(body_length, F.lit(0)) <= K.JSON_MAX_BODY), "walk").otherwise("skip")


def bridged(messages: DataFrame) -> DataFrame:
    """Messages of a page's own script: absolute http(s) or inline URLs only, at most 500 a batch; source and status are forced."""
    from lodestone.operators.index import absolute

    place = Window.partitionBy("tab_id", "batch").orderBy("pos")
    rows = messages.withColumn("place", F.row_number().over(place)).where("place <= 500").drop("place")
    rows = rows.withColumn("url", absolute(F.col("url"), F.col("page_url"))).where("url <> ''")
    return rows.withColumns({"source": F.lit("main"), "status": F.lit("background")})


def first_per_route(rows: DataFrame) -> DataFrame:
    """Each URL once per tab and route, the first."""
    first = Window.partitionBy("tab_id", "route", "url").orderBy("seq")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def batches(rows: DataFrame, size: int = K.JSON_BATCH) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("tab_id").orderBy("seq")) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def media_source(rows: DataFrame) -> DataFrame:
    """Object URLs: of a media source a stream, of a media blob its type and size."""
    kind = F.when(F.col("is_media_source"), "stream").otherwise(M.kind_from_mime(F.col("mime_type")))
    return rows.withColumn("kind", kind).where("kind <> ''").withColumn("source", F.lit("main"))


def resolved(rows: DataFrame) -> DataFrame:
    return rows.withColumn("url", U.href(U.parse(F.col("url"), F.col("page_url"))))
