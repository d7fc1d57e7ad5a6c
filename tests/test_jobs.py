"""Sources, sinks, jobs, the command line and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from refquarry.cli import job_of, main
from refquarry.plans import pipelines
from refquarry.sources import readers, sinks
from refquarry.streaming import watch


def test_job_validation():
    with pytest.raises(ValueError):
        pipelines.Job("names")
    with pytest.raises(ValueError):
        pipelines.Job("no such")
    with pytest.raises(TypeError):
        job_of('{"algorithm": "dois", "colour": 1}')


def test_links_from_names(spark):
    docs = spark.createDataFrame([(1, "we use the ALLBUS 2000 data\nnothing"), (2, "no data")], "doc_id long, text string")
    cat = spark.createDataFrame([("10.1/1", "ALLBUS 2000 survey", "a"), ("10.1/2", "Other", "a")], "identifier string, title string, service string")
    services = spark.createDataFrame([("a", 0.8)], "service string, service_reliability double")
    entities, found = pipelines.links(docs, pipelines.Job("names", seeds=("ALLBUS",), linker="multi"), cat, services)
    assert [r["name"] for r in entities.collect()] == ["ALLBUS"]
    assert {(tuple(r["relations"]), r["identifier"] == "10.1/1") for r in found.collect()} == {(("same_as_temporal",), True), (("references",), False)}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("siehe 10.4232/1.5126 dort")
    (tmp_path / "job.json").write_text('{"algorithm": "dois"}')
    assert main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--job", str(tmp_path / "job.json")]) == 0
    told = [json.loads(json.loads(x)["json"]) for f in (tmp_path / "out/textual_references").glob("*.json") for x in f.read_text().splitlines()]
    assert [t["reference"] for t in told] == ["10.4232/1.5126"]


def test_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"good")
    (tmp_path / "y.pdf").write_bytes(b"bad")

    def extract(content: bytes, start: int) -> str:
        if content == b"bad":
            raise ValueError("broken")
        return content.decode()

    got = {r["file_name"]: (r["text"], r["error"]) for r in readers.pdf_texts(spark, str(tmp_path), extract).collect()}
    assert got == {"x.pdf": ("good", None), "y.pdf": (None, "ValueError: broken")}
    (tmp_path / "links.json").write_text(json.dumps({"entity": {"a": {"name": "A", "identifiers": ["i"]}}, "entityLink": {"l": {"fromEntity": "a", "toEntity": "b"}, "m": {"fromEntity": "a"}}}))
    from refquarry.operators.link import import_links

    entities, links = import_links(readers.link_files(spark, str(tmp_path / "links.json")))
    assert entities.count() == 1 and [r["link_id"] for r in links.collect()] == ["l"]
    sinks.write_lines(spark.createDataFrame([("a",), ("a",)], "v string"), "v", str(tmp_path / "lines"), distinct=True)
    assert readers.term_list(spark, str(tmp_path / "lines")).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "in 1990\nand 1991-1992")], watch.SCHEMA).write.parquet(str(tmp_path / "in"))
    watch.write(watch.numeric_references(watch.documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["match"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("match")).collect()} == {"1990", "1991-1992"}
