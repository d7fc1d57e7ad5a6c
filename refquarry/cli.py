"""Command line: python -m refquarry.cli --input FOLDER --output FOLDER --job JOB.json [--catalogue TABLE --services TABLE] [--patterns FILE]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from refquarry.plans.pipelines import Job, links, references
from refquarry.plans.runner import coerced
from refquarry.sources import readers, sinks


def job_of(text: str) -> Job:
    """Values may be text; unknown fields are an error."""
    return coerced(Job, json.loads(text))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("input", "output", "job"):
        p.add_argument(f"--{name}", required=True)
    for name in ("catalogue", "services", "patterns", "tag"):
        p.add_argument(f"--{name}")
    a = p.parse_args(argv)
    with open(a.job, encoding="utf-8") as f:
        job = job_of(f.read())
    spark = SparkSession.builder.appName("refquarry").getOrCreate()
    docs = readers.text_files(spark, a.input, a.tag)
    patterns = None
    if a.patterns:
        patterns = readers.term_list(spark, a.patterns, "regex").withColumn("pattern", F.col("regex"))
    if a.catalogue:
        entities, found = links(docs, job, spark.read.parquet(a.catalogue), spark.read.parquet(a.services), patterns)
        sinks.json_dump({"entities": (entities, "ref_id"), "entity_links": (found, "entity_id")}, a.output)
    else:
        sinks.json_dump({"textual_references": (references(docs, job, patterns), "ref_id")}, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
