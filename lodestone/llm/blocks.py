"""Blocks: a written table with one row per few megabytes of documents, so that later passes meet the same documents in the same order."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import shared_dir, small_batches


def to_blocks(docs: DataFrame, block_bytes: int = 12 << 20, text_col: str = "text", more: Callable[[pa.Array], dict[str, bytes]] | None = None, more_names: tuple[str, ...] = ()) -> DataFrame:
    """block, size (bytes of text), binary columns ``more_names`` that ``more`` makes of a block's texts, and every column of
    ``docs`` as a list; a null text becomes the empty one."""
    docs = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    names = docs.columns
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("size", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in more_names), *(T.StructField(f"c_{f.name}", T.ArrayType(f.dataType)) for f in docs.schema.fields)])
    at = names.index(text_col)

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for b in small_batches(batches, 1 << 20, block_bytes):
            b = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in b.columns], names=b.schema.names)
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in b.columns]
            size = sum(x.as_py() for x in [pa.compute.sum(pa.compute.binary_length(b.column(at)))] if x.as_py())
            made = more(b.column(at)) if more else {}
            extra = [pa.array([made[c]], pa.binary()) for c in more_names]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), pa.array([size], pa.int64()), *extra, *lists], names=schema.names)
            n += 1

    import pyarrow.compute  # noqa: F401  (pa.compute)

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/blocks"
    docs.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)
    return spark.read.schema(schema).parquet(path)


def column(block: pa.RecordBatch, row: int, name: str) -> pa.Array:
    """A column of the block's documents."""
    return block.column(block.schema.get_field_index(f"c_{name}"))[row].values
