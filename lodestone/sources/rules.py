"""Site rules: a JSON file of {match, path?, find, replace, verify?, note?}, small and read on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

RULE = "struct<match:string,path:string,find:string,replace:string,verify:boolean,note:string>"


def load(spark: SparkSession, path: str) -> list[dict]:
    """The rules in order; none if the file cannot be read as such."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema(f"rules array<{RULE}>").json(path, multiLine=True).first()
    except AnalysisException:
        return []
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in (row.rules or [])] if row else []
