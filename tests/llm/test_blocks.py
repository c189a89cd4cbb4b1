import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm.blocks import to_blocks


def test_a_block_is_a_row_group(spark):
    """Spark decodes a row group at once: with all blocks of a task in one, a task held as much as it had read."""
    docs = spark.range(0, 64, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    blocks = to_blocks(docs, 80_000)
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in blocks.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == sum(f.num_row_groups for f in files) > 4
    assert blocks.select(F.explode("c_doc_id")).count() == 64
