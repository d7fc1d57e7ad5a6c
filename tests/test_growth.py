"""Steps whose cost grew faster than their input: what their plans may not hold, and results of the ways around it."""

import time

import pytest

from refquarry.operators import link, search, spread
from refquarry.plans import catalogue
from refquarry.sources import readers

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def one_line(spark, text):
    return spark.createDataFrame([(1, 0, text)], "doc_id long, line_no int, text string")


def test_contexts_shuffle_no_passages(spark, monkeypatch):
    lines = one_line(spark, "x see  the MIT License and the Apache License").union(one_line(spark, "the\tMIT"))
    seeds = spark.createDataFrame([("the",), ("the MIT",), ("Apache License",), ("MIT Apache",), (" ",)], "seed string")
    found = search.seed_contexts(lines, seeds)
    assert "Exchange hashpartitioning" not in plan_of(found) and "SortMergeJoin" not in plan_of(found)
    want = sorted(map(tuple, found.collect()))
    assert [(r[2], r[3]) for r in want if r[2] != "the"] == [("Apache License", "x see  the MIT License and the "), ("the MIT", "x see  ")]
    monkeypatch.setattr(search, "MOST_PATTERNS", 1)
    assert sorted(map(tuple, search.seed_contexts(lines, seeds).collect())) == want


def test_phrases_of_long_passages(spark):
    """A passage's tokens are not made again for each place."""
    lines = one_line(spark, " ".join(f"w{i}" for i in range(40_000)) + " under the MIT License, ender b Apache")
    lines.count()
    began = time.time()
    n = lambda phrase, slop=0: search.phrase_search(lines, phrase.split(), slop).count()
    assert [n("under * * License,"), n("*nder * A*e"), n("* Apache"), n("Apache *"), n("nder b"), n("License, the under", 5), n("License, the under", 4)] == [1, 1, 1, 0, 0, 1, 0]
    assert time.time() - began < 30


def test_patterns_copy_only_passages_that_have_their_words(spark):
    lines = one_line(spark, "Data of the ALLBUS survey, in the field")
    patterns = spark.createDataFrame([("a", r"of the (\S+)"), ("b", r"in the (\S+)"), ("c", r"\bthe (\S+) survey")], "pattern string, regex string")
    found = search.pattern_search(lines, patterns)
    assert "explode(filter(words" in plan_of(found)
    assert [(r["pattern"], r["reference"]) for r in found.orderBy("pattern").collect()] == [("a", "ALLBUS"), ("c", "ALLBUS")]


def test_reliability_queries_search_once(spark):
    for name in ("pmi_scores", "pattern_reliability_round1", "instance_reliability_round1", "topk_patterns"):
        assert "posexplode" not in plan_of(catalogue.QUERIES[name](spark, SF)), name


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(spread, "LOT", 3)
    many = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1), ("b", 1), ("c", 1), (None, 1)], "k string, e long")
    few = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("d", "x"), (None, "x")], "k string, v string")
    got = spread.spread_join(many, few, ["k"], "e")
    assert got.rdd.getNumPartitions() >= 8
    assert sorted(map(tuple, got.collect())) == sorted([("a", i, v) for i in range(20) for v in "xy"] + [("b", 1, "x")] * 2)


@pytest.mark.parametrize("n", [1050])
def test_every_hit_of_a_name(spark, tmp_path, n):
    """The SQL knows no page of 1,000 hits; one title is judged once for an entity, whatever the number of its hits."""
    parts = spark.range(n).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "2 AS p_size", "900.0D AS p_retailprice")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    for name in ("search_result_scores", "multi_match_links"):
        found = catalogue.QUERIES[name](spark, str(tmp_path))
        assert found.count() == n * n
    assert catalogue.QUERIES["ontology_links"](spark, str(tmp_path)).count() == n * n + n


def test_gold_links_of_several_tags(spark):
    row = "entity_id string, name string, tags array<string>, numeric_info array<string>"
    e = spark.createDataFrame([("e1", "a", ["s", "t", None], ["1", "2", "2"]), ("e2", "a", ["t"], []), ("e3", "a", ["t"], ["3"]), ("e4", "b", ["t"], ["1"]), ("e5", "a", [None], [None]), ("e6", "a", ["t"], None)], row)
    g = spark.createDataFrame([("g1", "a", ["t", "s"], ["2", "1"]), ("g2", "a", ["t", None], []), ("g3", "a", ["u"], ["3"]), ("g4", "a", ["t"], ["", None])], row)
    asked = []

    def fallback(rest):
        asked.extend(sorted(r["entity_id"] for r in rest.collect()))
        return spark.createDataFrame([("e3", "x", ["unknown"], 0.6)], "entity_id string, identifier string, relations array<string>, confidence double")

    found = sorted((r["entity_id"], r["identifier"]) for r in link.gold_links(e, g, fallback).collect())
    assert found == [("e1", "g1"), ("e2", "g2"), ("e3", "x")] and asked == ["e3", "e4", "e5", "e6"]


def test_outgoing_links_without_pairs(spark):
    gold = spark.createDataFrame([("g1", ["t"]), ("g2", ["t"]), ("g3", ["u"])], "entity_id string, tags array<string>")
    onwards = spark.createDataFrame([("g1", "d1", ["t"]), ("g1", "d2", ["u"]), ("g2", "d3", ["t"]), ("g3", "d4", ["u"])], "from_entity string, to_entity string, tags array<string>").selectExpr("*", "array('references') AS relations", "0.5D AS confidence")
    left = spark.createDataFrame([("e1", "k"), ("e2", "k"), ("e2", "k"), ("e3", "l")], "entity_id string, k string")
    right = spark.createDataFrame([("g1", "k"), ("g2", "k"), ("g2", "k"), ("g3", "m")], "identifier string, k string")
    pairs = left.join(right, "k").select("entity_id", "identifier")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(link.outgoing_gold_links(pairs, gold, onwards))
    assert len(want) == 4 and rows(link.outgoing_gold_links((left, right), gold, onwards)) == want


def test_records_are_parsed_by_all_cores(spark):
    plan = plan_of(catalogue.QUERIES["xml_metadata"](spark, SF))
    assert "RoundRobinPartitioning" in plan and plan.count("XPathStringEvaluator(") == 1
    rows = spark.createDataFrame([("a/b.xml", "<r><dc:title xmlns:dc='x'> T &amp; t</dc:title><dc:title xmlns:dc='x'>U</dc:title><dc:language xmlns:dc='x'>eng</dc:language></r>"), ("c.xml", "<r/>"), ("d.xml", None)], "file_name string, xml string")
    got = [tuple(r)[:4] for r in readers.metadata_records(rows).orderBy("file_stem").collect()]
    assert got == [("b", " T & t", "", "en"), ("c", "", "", ""), ("d", None, None, None)]


def test_entities_are_not_broadcast(spark):
    assert "Broadcast" not in plan_of(catalogue.QUERIES["link_csv"](spark, SF))
    plan = plan_of(catalogue.QUERIES["keyword_top5"](spark, SF))
    assert plan.count("BroadcastExchange") == 1 and "RoundRobinPartitioning" in plan and "RoundRobin" not in plan[plan.index("BroadcastExchange"):]
    assert "Join" not in plan_of(catalogue.QUERIES["tagged_chunks"](spark, SF))
