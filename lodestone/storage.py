"""The folder that the driver and all executors share, in which lineage is cut."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local() -> str:
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_base(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where all of Spark runs in one process (tests) and it is unset, a folder that goes with the process;
    on a cluster executors would not share such a folder, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder. For loops: unlike a checkpoint, a table's statistics are
    those of its files and not what the plan behind it was thought to give, which joins of joins multiply without end."""
    path = f"{shared_base(df.sparkSession)}/lodestone/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
