"""Views over the driver's tables that stand for web evidence; the same SQL serves Spark and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATES = """
SELECT p_partkey AS item_seq, CAST((p_partkey - p_partkey % 200) / 200 AS BIGINT) AS tab_id,
  concat('https://',
    CASE p_partkey % 4 WHEN 0 THEN 'cdn.shop-a.example.com' WHEN 1 THEN 'www.shop-a.example.com'
                       WHEN 2 THEN 'img.shop-b.example.co.uk' ELSE 'm.shop-c.example.net' END,
    '/media/', lower(p_type), '/', CAST(2020 + p_partkey % 5 AS VARCHAR(10)), '/',
    replace(p_name, ' ', '-'), '-', CAST(p_partkey AS VARCHAR(20)),
    CASE WHEN p_partkey % 3 = 0 THEN '-150x150' ELSE '' END,
    CASE p_size % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp'
                    WHEN 3 THEN '.mp4' WHEN 4 THEN '.m3u8' ELSE '.html' END,
    CASE p_partkey % 7 WHEN 0 THEN '?w=800&h=600' WHEN 1 THEN '?utm_source=feed&id=7'
                       WHEN 2 THEN '?token=abc' ELSE '' END) AS url,
  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 16 END AS width,
  CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size * 12 END AS height,
  CAST(p_retailprice * 100 AS BIGINT) AS bytes,
  CASE p_partkey % 5 WHEN 0 THEN 'dom' WHEN 1 THEN 'net' WHEN 2 THEN 'main' WHEN 3 THEN 'har' ELSE 'dom' END AS source
FROM {part}
"""

SIGHTINGS = """
SELECT c.tab_id, c.url, c.width, c.height,
  CASE WHEN l.l_linenumber % 5 = 4 THEN NULL ELSE c.bytes END AS bytes,
  CASE l.l_linenumber % 4 WHEN 0 THEN 'dom' WHEN 1 THEN 'net' WHEN 2 THEN 'main' ELSE 'har' END AS source,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 3 THEN 'unavailable' WHEN l.l_linenumber % 4 = 0 THEN 'referenced' ELSE 'background' END AS status,
  CASE WHEN l.l_quantity > 25 THEN 'image/jpeg' ELSE '' END AS mime_type, '' AS kind,
  l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, l.l_extendedprice
FROM ({candidates}) c JOIN {lineitem} l ON l.l_partkey = c.item_seq
"""

#: The order of sightings. On the cluster it is one sortable value per row, so that no global sort is needed.
SIGHTING_ORDER = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"

EVENT_LOG = """
SELECT user_id % 20 AS tab_id, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'nav_begin' WHEN 'error' THEN 'eme' WHEN 'purchase' THEN 'page_info' ELSE 'candidate' END AS type,
  concat('https://page.example.com/', CAST(event_id % 97 AS VARCHAR(10)), '.mp4') AS url,
  CASE WHEN event_id % 3 = 0 THEN 'video' ELSE 'image' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 'dom' ELSE 'net' END AS source,
  CASE WHEN event_id % 2 = 0 THEN 'referenced' ELSE 'background' END AS status,
  event_type = 'purchase' AS navigation
FROM {events}
"""


#: The tab of a candidate. In jobs whose whole work is asked for, ten tabs hold all items and grow with the table.
TAB, TEN_TABS = "CAST((p_partkey - p_partkey % 200) / 200 AS BIGINT)", "p_partkey % 10"


def in_ten_tabs(sql: str) -> str:
    return sql.replace(TAB, TEN_TABS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table, dealt to all cores: its files are a few megabytes where its rows are a million, and Spark splits by bytes,
    so that two or three tasks would read all the addresses made of it. Its columns come out of a generator, so that filters on
    those addresses stay behind the exchange."""
    used = ("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    dealt = table(spark, sf_dir, "part").select(*used).repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return dealt.select(F.inline(F.array(F.struct(*used))))


def candidates(spark: SparkSession, sf_dir: str, ten_tabs: bool = False) -> DataFrame:
    """item_seq, tab_id, url, width, height, bytes, source, and empty mime_type, kind, seq = item = item_seq."""
    rows = spark.sql(in_ten_tabs(CANDIDATES) if ten_tabs else CANDIDATES, part=parts(spark, sf_dir))
    return rows.selectExpr("*", "'' AS mime_type", "'' AS kind", "item_seq AS seq", "item_seq AS item")


def sightings(spark: SparkSession, sf_dir: str, ten_tabs: bool = False) -> DataFrame:
    rows = spark.sql(SIGHTINGS.replace("({candidates})", "{candidates}"), candidates=spark.sql(in_ten_tabs(CANDIDATES) if ten_tabs else CANDIDATES, part=parts(spark, sf_dir)), lineitem=table(spark, sf_dir, "lineitem"))
    return rows.selectExpr("tab_id", "url", "width", "height", "bytes", "source", "status", "mime_type", "kind", f"{SIGHTING_ORDER} AS seq")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EVENT_LOG, events=table(spark, sf_dir, "events"))


def duck(sql: str) -> str:
    """A view's SQL over the plain table names."""
    for name in ("part", "lineitem", "events"):
        sql = sql.replace("{" + name + "}", name)
    return sql


DUCK_CANDIDATES = duck(CANDIDATES)
DUCK_SIGHTINGS = duck(SIGHTINGS.replace("{candidates}", DUCK_CANDIDATES))
DUCK_EVENTS = duck(EVENT_LOG)
