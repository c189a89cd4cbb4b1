"""Write-through of a stream to a table with one row per key.

The table is a folder. Keys are dealt to a fixed number of buckets; a micro-batch writes new files for the buckets it
touches, under its own number, and then a manifest that says for every bucket which number holds it. A manifest is one file
and appears whole, so readers see all of a batch or nothing. A batch that is repeated finds its own manifest and does
nothing, or overwrites the files that a killed attempt left.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "bucket int, version long"
BUCKETS = 32


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """(number of the last batch, -1 before the first; version of each bucket). At most a row per bucket comes to the driver."""
    table = _manifests(spark, path)
    last = table.agg(F.max("batch")).first()[0] if table is not None else None
    if last is None:
        return -1, {}
    return last, {r.bucket: r.version for r in table.where(F.col("batch") == last).collect() if r.bucket is not None}


def _parts(path: str, at: dict[int, int], only: set[int]) -> list[str]:
    return [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(at.items()) if b in only]


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows with the same order one of the greatest."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *(F.desc(c) for c in rest)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def write(rows: DataFrame, number: int, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> bool:
    """Puts the rows of batch ``number`` into the table; False if it is in there already."""
    spark = rows.sparkSession
    last, at = versions(spark, path)
    if number <= last:
        return False
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    new = latest(rows, keys, order).select("*", bucket).persist()
    try:
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}
        old = _parts(path, at, touched)
        merged = new
        if old:
            kept = spark.read.schema(T.StructType([f for f in new.schema.fields if f.name != "bucket"])).parquet(*old).select("*", bucket)
            merged = latest(new.unionByName(kept), [*keys, "bucket"], order)
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
        now = at | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()) or [(None, None)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={number}")
    finally:
        new.unpersist()
    return True


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the table as of its last batch."""
    _, at = versions(spark, path)
    found = _parts(path, at, set(at))
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def started(out: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, interval: str = "250 milliseconds", buckets: int = BUCKETS):
    """Writes a stream of rows through to the table, batch by batch."""
    put = lambda rows, number: write(rows, number, path, keys, order, buckets)
    return out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(put).start()
