"""Tables of a folder, and cut points of iterative jobs in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, for work that takes far longer than the reading: a small file is the work of few tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to spark.checkpoint.dir (a folder of our own where that is unset and there is one machine only) and reads it again: short lineage that survives lost executors."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("refquarry.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="refquarry-")
            spark.conf.set("refquarry.scratch.dir", root)
    path = f"{root.rstrip('/')}/refquarry-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
