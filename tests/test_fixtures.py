"""Literal fixtures of the domain: scalars, the match matrix, contexts, induction, linking and the learners' goldens."""

import inspect

import pytest
from pyspark.sql import functions as F

from refquarry.functions import numeric, strings
from refquarry.operators import bootstrap, induce, link, search, textprep
from refquarry.plans import catalogue

TERMS = ["FOOBAR", "R2", "D2", "term", "_", None, "FOOBAR"]


def corpus(spark, n, odd="the term ."):
    text = "Hallo , please try to find {} in this short text snippet . Thank you ."
    rows = [(i, text.format(odd if TERMS[i % 7] is None else f"the {TERMS[i % 7]}")) for i in range(n)]
    return textprep.passages(spark.createDataFrame(rows, "doc_id long, text string"))


def values(spark, xs, f):
    df = spark.createDataFrame([(x,) for x in xs], "x string")
    return [r[0] for r in df.select(f(F.col("x"))).collect()]


def test_term_and_phrase_counts(spark):
    lines = corpus(spark, 100, ". the term .")
    found = search.seed_contexts(lines, spark.createDataFrame([("FOOBAR",), ("term",), ("terma",), ("the FOOBAR",), ("the term",)], "seed string"))
    counts = {r["seed"]: r["n"] for r in found.groupBy("seed").agg(F.count("*").alias("n")).collect()}
    assert counts == {"FOOBAR": 29, "term": 28, "the FOOBAR": 29, "the term": 28}
    n = lambda phrase, slop=0: search.phrase_search(lines, phrase.split(), slop).count()
    assert n("to find the * in") == 86
    assert n("to find . the * in", 2) == 14
    assert n("to find the term in", 2) == 28


@pytest.mark.parametrize("strategy", bootstrap.STRATEGIES)
def test_learner_goldens(spark, strategy):
    refs = bootstrap.frequency_bootstrap(corpus(spark, 20), ["FOOBAR"], strategy, threshold=0.25, upper_case=False).collect()
    assert {r["doc_id"] % 7 for r in refs} == {0, 3, 5, 6}
    longer = strategy in ("merge_current", "merge_all")
    assert {r["phrase"] for r in refs} == {"find the * in", "to find the" if longer else "find the"}


def test_stopwords(spark):
    yes = ["the", "thethe", "tothe", "e", ".", "--", ".the", "142", "142."]
    no = ["theterm", "term", "B142", "Daten"]
    assert all(values(spark, yes, strings.is_stopword)) and not any(values(spark, no, strings.is_stopword))


def test_scalars(spark):
    assert values(spark, ["30850", "1836", "1990 until 1992", "1990 & 1992", "1990 - 1992", "1990-1992"], strings.wildcard_word) == ["*"] * 6
    assert values(spark, ["eigene Berechnung", "ALLBUS", "eigene Berechnung; ALLBUS"], lambda c: strings.ignored(c, regex=True)) == [True, False, False]
    assert values(spark, ["1. 1.0 5, 7"], lambda c: F.array_join(numeric.numbers(c), "|")) == ["1|1.0|5|7"]
    assert values(spark, ["56.1 2000 '85", "1996/08"], lambda c: numeric.best_info(numeric.numeric_info(c))) == ["2000", "1996/08"]
    assert values(spark, ["die DOI 10.4232/pairfam.5678.5.0.0.", "10,4232/1.5126", "siehe 10.4232/1.5126"], numeric.first_doi) == ["10.4232/pairfam.5678.5.0.0", None, "10.4232/1.5126"]
    assert values(spark, ["at http://www.da-ra.de/", "at www.da-ra.de", ".da-ra.de"], numeric.first_url) == ["http://www.da-ra.de/", "www.da-ra.de", None]
    assert values(spark, ["a & <b> 'c'"], lambda c: strings.xml_unescape(strings.xml_escape(c))) == ["a & <b> 'c'"]
    assert values(spark, ["a;b", "x"], lambda c: F.array_join(strings.split_enumeration(c), "|")) == ["a|b", "x"]


def test_overlap_and_range(spark):
    year = lambda y: F.lit(str(y))
    cases = [((2000, 2010), ["S"]), ((1900, 2010), ["P"]), ((1900, 2009), ["P", "U"]), ((2000, 2020), ["P"]), ((2001, 2020), ["P", "U"]), ((1900, 2020), ["P"]), ((2005, 2006), ["U"]), ((1900, 1990), None), ((2011, 2020), None)]
    names = {"S": numeric.SAME, "P": numeric.PART, "U": numeric.SUPERSET}
    columns = [numeric.overlap(year(2000), year(2010), year(a), year(b), False) for (a, b), _ in cases] + [numeric.overlap(year(2005), year(2006), year(2000), year(2010), True)]
    got = list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())
    assert [None if g is None else sorted(g) for g in got] == [None if w is None else [names[x] for x in w] for _, w in cases] + [[numeric.SUPERSET]]
    inside = spark.range(1).select(*[numeric.in_range(year(2000), year(2010), year(y)).alias(str(y)) for y in (2000, 2010, 2005, 1999, 2011)]).first()
    assert list(inside) == [True, True, True, False, False]


# Catalogue titles, mentions, and the titles (by number) that a mention is the same as, part of, a superset of, or both of these.
TITLES = (
    "Studierendensurvey 2000/01", "Studierendensurvey 2001", "German Social Survey (ALLBUS) Cumulative File, 1980, 1982, 1984, 1986", "German Social Survey (ALLBUS) Cumulative File, 1980-1992",
    "German Social Survey (ALLBUS) Cumulative File, 1980, 1992", "German Social Survey (ALLBUS) Cumulative File, 1980, 1996", "German Social Survey (ALLBUS) Cumulative File, 1980 - 1996",
    "German Social Survey (ALLBUS) Cumulative File, 1980 1996", "German Social Survey (ALLBUS) Cumulative File, 1980-1990", "Ausländerumfrage 1982 (1. Welle: Haushaltsvorstände)", "SFB580-B2 Betriebspanel",
    "USICA-Jugend-Studie (Panel: 2. Welle 1979)", "Ausländer in Deutschland 2000 - 2. Welle", "CBS News Monthly Poll #2, May 1999", "Eurobarometer 54.1 (2000)",
)
MATCHES = {
    "1996/08": {"part_of": (5, 6, 7)},
    "1982": {"part_of": (2, 3, 6, 8), "same_as": (9,)},
    "1982   -   1983": {"part_of": (2, 3, 6, 8), "superset_of": (9,)},
    "85/82": {"part_of": (2, 3, 6, 8, 9)},
    "54.1": {"same_as": (14,)},
    "2000, 2002": {"part_of": (0, 12, 14)},
    "2-4": {"same_as": (10, 12), "superset_of": (11, 13)},
    "2, 3": {"part_of": (10, 11, 12, 13)},
}


def test_match_matrix(spark):
    pairs = spark.createDataFrame([(r, k, t) for r in MATCHES for k, t in enumerate(TITLES)], "reference string, k int, title string")
    got = {(r["reference"], r["k"]): r["relations"] for r in pairs.select("reference", "k", numeric.numeric_match(F.col("reference"), F.col("title")).alias("relations")).collect()}
    names = {"same_as": [numeric.SAME], "part_of": [numeric.PART], "superset_of": [numeric.SUPERSET]}
    assert got == {(r, k): next((names[x] for x, ks in of.items() if k in ks), None) for r, of in MATCHES.items() for k in range(len(TITLES))}


def test_metadata_entities(spark):
    # Contexts of the domain's examples, and the name, numbers and identifier that each holds.
    rows = [
        ("In this snippet, the reference", "ALLBUS 2000", "is to be extracted as", "ALLBUS", ["2000"], None),
        ("In this snippet, the reference 2000", "Eurobarometer", "56.1 is to be", "Eurobarometer", ["2000", "56.1"], None),
        ("the reference to the 1982   -   1983", "ALLBUS", "is to be extracted as", "ALLBUS", ["1982   -   1983"], None),
        ("the reference to the 2nd wave of the", "2000 Eurobarometer", "56.1 is to be extracted as", "Eurobarometer", ["2000", "56.1", "2"], None),
        ("the reference to the 2nd wave of the", "10.4232/1.2525", "2000 is to be extracted as", "", ["2000", "2"], "10.4232/1.2525"),
        ("In this snippet, the reference", "Sozio - ökonomisches Panel -LRB- SOEP -RRB-", "of any year is to", "Sozio oekonomisches Panel SOEP", [], None),
    ]
    df = spark.createDataFrame([(*r[:3], 1.0) for r in rows], "left_text string, reference string, right_text string, reliability double")
    got = {(r["left_text"], r["reference"]): (r["name"], r["numeric_info"], r["identifier"]) for r in link.metadata_entities(df).collect()}
    assert got == {(r[0], r[1]): tuple(r[3:]) for r in rows}


def test_induction(spark):
    df = spark.createDataFrame([(1, "this is a ref 1998 1999 2000 ", " dataset ."), (2, "this is a ref to the 2000 ", " dataset ."), (3, " ", " dataset .")], "id int, left_text string, right_text string")
    got = {(r["id"], r["rank"]): r["phrase"] for r in induce.induce(df, 5).collect()}
    assert (got[1, 0], got[1, 3], got[1, 5]) == ("dataset", "dataset", "ref * * * * dataset")
    assert (got[2, 0], got[2, 2], got[2, 3]) == ("dataset", "dataset", "to the * * dataset")
    assert not any(k[0] == 3 for k in got)


# The catalogue's identifiers by survey years.
SURVEYS = {
    "1982/83": ("12499", "1884"), "1984/85": ("12500", "1885"), "1986/87": ("12501", "2416"), "1989/90": ("12502", "2417"), "1992/93": ("12503", "3130"), "1994/95": ("12504", "3131"),
    "1997/98": ("12505", "3511"), "2000/01": ("12506", "4208"), "2003/04": ("12508", "4344"), "2006/07": ("12507", "4263"), "2009/10": ("11059", "12509"), "2012/13": ("12510", "5126"),
}


def test_linking_counts(spark):
    title = "Studiensituation und studentische Orientierungen {}(Studierenden-Survey){}"
    rows = [(f"10.4232/1.{i}", title.format(y + " ", "")) for y, ids in SURVEYS.items() for i in ids] + [("10.4232/1.12494", title.format("", " Kumulation 1983 - 2013"))]
    cat = spark.createDataFrame([(*r, "dara") for r in rows], "identifier string, title string, service string")
    services = spark.createDataFrame([("dara", 0.8)], "service string, service_reliability double")
    entity = lambda info: spark.createDataFrame([("e", "Studierendensurvey", info, None)], "entity_id string, name string, numeric_info array<string>, identifier string")
    several = link.multi_match_links(entity(["2012/13"]), cat, services)
    assert {r["identifier"] for r in several.collect()} == {"10.4232/1.5126", "10.4232/1.12510", "10.4232/1.12494"}
    assert link.multi_match_links(entity([]), cat, services).count() == 25
    assert link.best_match_links(entity(["2012/13"]), cat, services).count() == 1


def test_pmi_and_top_patterns(spark):
    joint = spark.createDataFrame([("i", "p", 169)], "instance string, pattern string, joint long")
    i, p = spark.createDataFrame([("i", 24200)], "instance string, instance_count long"), spark.createDataFrame([("p", 38900)], "pattern string, pattern_count long")
    import math

    assert abs(bootstrap.pmi(joint, i, p, 10_000_000).first()["pmi"] - math.log2(1.8)) < 0.01
    scores = spark.createDataFrame([(str(k), float(min(k, 5))) for k in range(7)], "pattern string, reliability double")
    assert [r["reliability"] for r in bootstrap.top_patterns(scores, 5).collect()] == [5.0, 5.0, 4.0, 3.0, 2.0]
    assert bootstrap.top_patterns(scores, 9, 4.0).count() == 3


def test_text_preparation(spark):
    assert values(spark, ["a--b x-y"], textprep.split_compounds) == ["a -  - b x - y"]
    assert values(spark, ["Wort-\nteil 12-\n34 a¬\nb  c"], textprep.dehyphenate) == ["Wortteil \n12-\n34 ab \nc "]
    assert values(spark, ["a\x07b\n"], textprep.strip_controls) == ["ab\n"]
    docs = spark.createDataFrame([(1, "\n".join(f"l{i}" for i in range(21)) + "\n\n"), (2, "")], "doc_id long, text string")
    assert [r["doc_id"] for r in textprep.sections(docs).orderBy("doc_id", "section").collect()] == [1, 1, 1, 2]


def test_patterns_in_parts(spark, monkeypatch):
    lines = corpus(spark, 20)
    patterns = spark.createDataFrame([(p, rf"{p}\s(\S+)") for p in ("find the", "try to", "this short", "Thank", "please try", "in this", "no such")], "pattern string, regex string")
    find = lambda: sorted(map(tuple, search.pattern_search(lines, patterns, False).collect()))
    want = find()
    monkeypatch.setattr(search, "MOST_PATTERNS", 2)
    assert want and find() == want


def test_registered_learners_rounds(spark, monkeypatch):
    rounds = []
    for name in ("frequency_bootstrap", "reliability_bootstrap"):
        learner = getattr(bootstrap, name)

        def told(*args, learner=learner, **more):
            bound = inspect.signature(learner).bind(*args, **more)
            bound.apply_defaults()
            rounds.append(bound.arguments["max_iterations"])

        monkeypatch.setattr(bootstrap, name, told)
    for name in [f"frequency_bootstrap_{s}" for s in bootstrap.STRATEGIES] + ["reliability_bootstrap"]:
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rounds == [10] * 5
