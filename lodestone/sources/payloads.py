"""Media URLs mined from JSON payloads."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import constants as K
from lodestone.functions import media as M
from lodestone.functions import url as U
from lodestone.sources.pieces import pieces


def strings(document: str | None) -> list[str]:
    """The strings of a JSON document, depth first, last child first. The walk ends for good at the node that is one too many
    or one too deep."""
    try:
        root = json.loads(document or "")
    except (ValueError, RecursionError):
        return []
    out, stack, seen = [], [(root, 0)], 0
    while stack:
        node, depth = stack.pop()
        if seen > K.JSON_MAX_NODES or depth > K.JSON_MAX_DEPTH:
            break
        seen += 1
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, list):
            stack += [(x, depth + 1) for x in node]
        elif isinstance(node, dict):
            stack += [(x, depth + 1) for x in node.values()]
    return out


def mine(payloads: DataFrame, body: str = "body", base: str = "url") -> DataFrame:
    """The payload's columns but its body, pos, found: resolved media URLs in the order of the walk. Bodies above the limit
    are skipped. The walk is Python; the test and the resolution are Column expressions after it."""
    others = [c for c in payloads.columns if c != body]
    schema = T.StructType([*(payloads.schema[c] for c in others), T.StructField("strings", T.ArrayType(T.StringType()))])

    def run(batches):
        for b in pieces(batches):
            found = [strings(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.list_(pa.string()))], names=schema.names)

    small = payloads.where(F.octet_length(body) <= K.JSON_MAX_BODY).select(*others, body)
    rows = small.mapInArrow(run, schema).select(*others, F.posexplode("strings").alias("pos", "raw")).where(M.scan_prefilter(F.col("raw"), inline=False))
    resolved = U.parse(F.col("raw"), F.col(base))
    return rows.withColumn("found", F.coalesce(U.href(resolved), F.col("raw"))).drop("raw")
