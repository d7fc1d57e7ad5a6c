"""Structured Streaming over a growing folder of documents: pattern references as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refquarry.functions import rx
from refquarry.operators.textprep import passages

SCHEMA = "doc_id long, text string"


def documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def numeric_references(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, match: numeric information in each passage; stateless, so no watermark is needed."""
    found = F.regexp_extract_all("text", F.lit(f"({rx.COMPLEX_NUMERIC})"), F.lit(1))
    return passages(docs).select("doc_id", "line_no", F.explode(found).alias("match"))


def write(df: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet and ends when all that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
