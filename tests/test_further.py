"""Parts that no registered query shows: the reliability learner against a plain one, jobs with states, plug-ins, time limits."""

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from refquarry.operators import bootstrap, federate, induce, link, search, textprep
from refquarry.plans import runner


def lines_of(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, line_no int, text string")


WORDS = ["Data of the {} survey were used", "analysis of the {} panel shows growth", "according to the {} survey from Berlin", "we use the {} panel data here"]
NAMES = ["ALLBUS", "SOEP", "NEPS", "PISA", "ESS"]


def learner_corpus():
    return [WORDS[(i * 7 + i // 3) % 4].format(NAMES[i % 5 if i % 4 else (i // 4) % 2]) for i in range(40)] + ["nothing to see in this line", "the quick survey of nobody"] * 3


@pytest.mark.parametrize(("ranker", "threshold", "instance_threshold"), [("relative", 0.8, None), ("absolute", 0.5, None), ("relative", 0.8, 0.3)])
def test_reliability_learner(spark, ranker, threshold, instance_threshold):
    """The loop's arithmetic by dictionaries; contexts, candidates and matches come from the operators tested elsewhere."""
    texts, seeds, rounds = learner_corpus(), ["ALLBUS"], 4
    lines = lines_of(spark, texts).cache()
    got = {tuple(r) for r in bootstrap.reliability_bootstrap(lines, seeds, threshold, max_iterations=rounds, ranker=ranker, instance_threshold=instance_threshold).collect()}

    def contexts_of(terms):
        return search.seed_contexts(lines, spark.createDataFrame([(t,) for t in sorted(terms)], "seed string")).withColumn("ctx", F.struct("doc_id", "line_no", "seed"))

    refs, phrases, counts = {}, {}, Counter()
    reliable, new, top, most, scores = {s: 1.0 for s in seeds}, set(seeds), {}, -100.0, {}
    for _ in range(1, rounds):
        contexts = contexts_of(new)
        counts.update(r["seed"] for r in contexts.collect())
        for r in induce.induce(contexts, 3, threshold, relative=False).where("regex is not null").where(induce.has_content_word(F.col("words"))).select("phrase", "regex").distinct().collect():
            phrases.setdefault(r["regex"], r["phrase"])
        unseen = [p for p in phrases if p not in refs]
        if unseen:
            found = search.pattern_search(lines, spark.createDataFrame([(p, phrases[p], p) for p in unseen], "pattern string, phrase string, regex string")).collect()
            refs |= {p: [] for p in unseen}
            for r in found:
                refs[r["pattern"]].append((r["doc_id"], r["line_no"], r["reference"]))
        pmi = defaultdict(dict)
        for p, rs in refs.items():
            for i, n in Counter(x[2] for x in rs).items():
                if i in reliable:
                    pmi[p][i] = math.log2(n * len(texts) / (counts[i] * len(rs)))
        most = max([most, *(v for d in pmi.values() for v in d.values())])
        for _ in range(2):
            scores = {p: sum(v / most * reliable[i] for i, v in d.items()) / len(d) for p, d in pmi.items()}
            mine = defaultdict(list)
            for p, d in pmi.items():
                for i, v in d.items():
                    mine[i].append(v / most * scores[p])
            reliable = {i: 1.0 if i in seeds else sum(mine[i]) / len(mine[i]) if mine[i] else 0.0 for i in reliable}
        order = sorted(scores, key=lambda p: (-scores[p], p))
        before = top
        if ranker == "absolute":
            top = {p: scores[p] for p in order if scores[p] >= threshold}
        else:
            chosen = {p: scores[p] for p in order[: len(top) + 1 if top else 20]}
            mean = lambda d: sum(d.values()) / len(d)
            top = chosen if not top or abs(mean(top) - mean(chosen)) <= threshold else top
        new = {x[2] for p in top for x in refs[p]} - set(reliable)
        if instance_threshold is not None:
            n_contexts = Counter(r["seed"] for r in contexts_of(new).collect()) if new else Counter()
            able = set()
            for i in new:
                values = [math.log2(n * len(texts) / (n_contexts[i] * len(refs[p]))) / most * scores.get(p, 0.0) for p in top if (n := sum(x[2] == i for x in refs[p])) and n_contexts[i]]
                if values and sum(values) / len(values) >= instance_threshold:
                    able.add(i)
            new = able
        if set(top) == set(before) or not new:
            break
        reliable |= dict.fromkeys(new, 0.0)
    want = {(d, n, phrases[p], r) for p in top for d, n, r in refs[p] if r in reliable}
    assert got == want
    if threshold != 0.5:
        assert {w[3] for w in want} >= {"ALLBUS"} and want


def test_threshold_of_the_rankers(spark):
    scores = spark.createDataFrame([(f"p{k:02}", 1 - k / 50) for k in range(40)], "pattern string, reliability double")
    first = bootstrap.rank_relative(scores, {}, 0.1)
    assert len(first) == 20 and len(bootstrap.rank_relative(scores, first, 0.1)) == 21
    lower = scores.withColumn("reliability", F.col("reliability") - 0.5)
    assert bootstrap.rank_relative(lower, first, 0.1) == first and set(bootstrap.rank_relative(lower, first, 0.6)) == {f"p{k:02}" for k in range(21)}
    assert set(bootstrap.rank_absolute(scores, {}, 0.9)) == {f"p{k:02}" for k in range(6)}


def test_required_words(spark):
    rows = [(None, r"^(\S+) of\b"), (None, r"[.] (\S+) the\b"), (None, r"(foo bar|baz) qux "), (None, "a|b the "), (None, r"x? foo* (\S+)"), ("Data of the * survey*", "whatever"), ("* 12", "x")]
    df = spark.createDataFrame(rows, "phrase string, regex string")
    got = [r[0] for r in df.select(search.required_words(F.col("phrase"), F.col("regex"))).collect()]
    assert got == [["of"], ["the"], ["qux"], [], [], ["Data", "of", "the"], []]


def test_runner(spark):
    def inner(run, execution, n):
        return n + 1

    def outer(run, execution, n):
        child, result = run.run("inner", ("own",), execution, n=n)
        assert child.parent == execution.id and child.tags == ("t", "own")
        return result * 2

    jobs = runner.Runner(spark, {"inner": inner, "outer": outer, "broken": lambda run, e: 1 / 0})
    assert jobs.run("outer", ("t",), n=4)[1] == 10
    failed, nothing = jobs.run("broken")
    unknown, _ = jobs.run("no such")
    assert nothing is None and failed.message.startswith("ZeroDivisionError") and "algorithm must be one of" in unknown.message
    assert {r["status"]: r["n"] for r in runner.status_counts(jobs.log()).collect()} == {"FINISHED": 2, "FAILED": 2}
    assert all(r["started"] <= r["ended"] for r in jobs.log().collect())


def test_coerced():
    @dataclass
    class Fields:
        name: str = ""
        window: int = 3
        limit: float = 0.5
        strict: bool = False
        tags: tuple[str, ...] = ()

    assert runner.coerced(Fields, {"name": "7", "window": "4", "limit": "0.25", "strict": "true", "tags": "a, b"}) == Fields("7", 4, 0.25, True, ("a", "b"))
    with pytest.raises(TypeError, match="unknown fields"):
        runner.coerced(Fields, {"other": "1"})


def test_federated_search_asks_once(spark):
    asked = []

    def fetch(missing):
        asked.append(sorted((r["service"], r["query"]) for r in missing.collect()))
        return missing.where("query = 'x'").select("service", "query", F.lit(0).cast("long").alias("list_index"), F.lit("X").alias("title"), F.lit("10.1/x").alias("identifier"))

    queries = spark.createDataFrame([("e1", "s", "x"), ("e2", "s", "x"), ("e3", "s", "none"), ("e4", "s", "known")], "entity_id string, service string, query string")
    cache = spark.createDataFrame([("s", "known", 0, "K", "10.1/k")], federate.RESULT)
    results, cache = federate.federated_search(queries, cache, fetch)
    assert sorted((r["entity_id"], r["identifier"]) for r in results.collect()) == [("e1", "10.1/x"), ("e2", "10.1/x"), ("e4", "10.1/k")]
    assert asked == [[("s", "none"), ("s", "x")]]
    again, _ = federate.federated_search(queries, spark.createDataFrame(cache.collect(), federate.RESULT), fetch)
    assert asked[1] == [] and again.count() == 3
    with pytest.raises(ValueError, match="kind"):
        federate.Connector("s", 0.5, "no such")


def test_time_limit(spark):
    docs = spark.createDataFrame([(1, "a" * 40 + "b"), (2, "aab aab"), (3, None)], "doc_id long, text string")
    got = [tuple(r) for r in search.bounded_regex_scan(docs, r"(?:a|a|aa)+c|aab", 0.2).orderBy("doc_id", "place").collect()]
    assert got[-2:] == [(2, 0, "aab", None), (2, 1, "aab", None)] and got[0][0] == 1


def test_regex_contexts(spark):
    docs = spark.createDataFrame([(1, "see 10.4232/1.2525 here\n10.1/ab"), (2, "none")], "doc_id long, text string")
    got = [tuple(r) for r in search.doi_contexts(docs).orderBy("place").collect()]
    assert got == [(1, 0, "see ", "10.4232/1.2525", "here"), (1, 1, " ", "10.1/ab", " ")]


def test_model_tokens_and_imported_links(spark):
    docs = spark.createDataFrame([(1, "One two. Three"), (2, None)], "doc_id long, text string")
    got = dict(map(tuple, textprep.model_tokens(docs, lambda t: [s.split() for s in t.split(". ")] if t else []).collect()))
    assert got == {1: " One two\n Three", 2: ""}
    entities = spark.createDataFrame([("a", ["https://doi.org/10.4232/1.1"]), ("b", []), ("c", None)], "entity_id string, identifiers array<string>")
    assert [tuple(r)[:2] for r in link.imported_ontology_links(entities).collect()] == [("a", "dataset_10423211")]
