"""Pattern ranking and the two iterative learners (by frequency and by reliability)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refquarry.functions.strings import STOPWORDS
from refquarry.operators.induce import has_content_word, induce
from refquarry.operators.search import pattern_search, seed_contexts, with_words
from refquarry.sources.tables import cut

STRATEGIES = ("separate", "merge_current", "merge_new", "merge_all")


def relative_frequency(candidates: DataFrame) -> DataFrame:
    """Adds score: how often a regex was induced against the number of contexts."""
    contexts = candidates.where("rank = 0").agg(F.count(F.lit(1)).alias("n_contexts"))
    counts = candidates.where("regex is not null").groupBy("regex").agg(F.count(F.lit(1)).alias("n"))
    return candidates.join(counts, "regex").crossJoin(F.broadcast(contexts)).withColumn("score", F.col("n") / F.col("n_contexts"))


def select_patterns(candidates: DataFrame, known: DataFrame | None = None, stopwords=STOPWORDS) -> DataFrame:
    """regex, phrase of the first acceptable rank in each context (ctx); a known regex before it ends the context."""
    scored = relative_frequency(candidates).withColumn("ok", has_content_word(F.col("words"), stopwords) & (F.col("score") >= F.col("threshold")))
    if known is None:
        scored = scored.withColumn("known", F.lit(False))
    else:
        scored = scored.join(known.select("regex").distinct().withColumn("known", F.lit(True)), "regex", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    first = scored.where("ok or known").groupBy("ctx").agg(F.min(F.struct("rank", "known", "regex", "phrase")).alias("p"))
    return first.where("not p.known").select("p.regex", "p.phrase").distinct()


def _context_id(df: DataFrame) -> DataFrame:
    return df.withColumn("ctx", F.struct("doc_id", "line_no", "seed"))


def frequency_bootstrap(lines: DataFrame, seeds: list[str], strategy: str = "merge_all", threshold: float = 0.25, window: int = 3, max_iterations: int = 10, upper_case: bool = True, one_per_doc: bool = True, stopwords=STOPWORDS) -> DataFrame:
    """doc_id, line_no, phrase, reference found by learnt patterns, from seed terms.

    A round looks up contexts of new terms, induces and selects patterns, and searches with them; the
    terms it finds are the next round's.  At most max_iterations - 1 rounds.  Round results are
    written, so lineage does not grow.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    spark = lines.sparkSession
    lines = cut(with_words(lines.select("doc_id", "line_no", "text")), "passages")
    new = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "seed string")
    done = spark.createDataFrame([], "seed string")
    every = known = refs = None
    for round_ in range(1, max_iterations):
        unseen = new.join(done, "seed", "left_anti")
        fresh = cut(_context_id(seed_contexts(lines, unseen, one_per_doc)), f"contexts{round_}")
        every_next = fresh if every is None else every.unionByName(fresh)
        if strategy == "merge_current" and every is not None:
            current = fresh.unionByName(every.join(new, "seed", "left_semi"))
        else:
            current = every_next if strategy == "merge_all" else fresh
        every, done = every_next, done.union(unseen)
        if strategy == "separate":
            candidates = induce(current, window, threshold)
            per = Window.partitionBy("seed", "regex")
            sizes = candidates.where("rank = 0").groupBy("seed").agg(F.count(F.lit(1)).alias("n_contexts"))
            scored = candidates.where("regex is not null").withColumn("n", F.count(F.lit(1)).over(per)).join(sizes, "seed")
            scored = scored.withColumn("ok", has_content_word(F.col("words"), stopwords) & (F.col("n") / F.col("n_contexts") >= F.col("threshold")))
            first = scored.where("ok").groupBy("ctx").agg(F.min(F.struct("rank", "regex", "phrase")).alias("p")).select("p.regex", "p.phrase").distinct()
            selected = first if known is None else first.join(known.select("regex"), "regex", "left_anti")
        else:
            selected = select_patterns(induce(current, window, threshold), known, stopwords)
        selected = cut(selected, f"selected{round_}")
        if selected.isEmpty():
            break
        known = selected if known is None else known.unionByName(selected)
        found = cut(pattern_search(lines, selected.select(F.col("phrase").alias("pattern"), "phrase", "regex"), upper_case, stopwords), f"found{round_}")
        refs = found if refs is None else refs.unionByName(found)
        new = found.select(F.col("reference").alias("seed")).distinct()
        if new.join(done, "seed", "left_anti").isEmpty():
            break
    if refs is None:
        return spark.createDataFrame([], "doc_id long, line_no int, phrase string, reference string")
    return refs.select("doc_id", "line_no", F.col("pattern").alias("phrase"), "reference").distinct()


def joint_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy(F.col("reference").alias("instance"), "pattern").agg(F.count(F.lit(1)).alias("joint"))


def pmi(joint: DataFrame, instances: DataFrame, patterns: DataFrame, n: int) -> DataFrame:
    """instance, pattern, pmi = log2 of p(i, p) / (p(i) p(p)), from counts instance_count and pattern_count of n documents."""
    return joint.join(instances, "instance").join(patterns, "pattern").where("joint > 0").withColumn("pmi", F.log2(F.col("joint") * F.lit(float(n)) / (F.col("instance_count") * F.col("pattern_count"))))


def pattern_reliability(assoc: DataFrame, instance_scores: DataFrame, top: float | None = None) -> DataFrame:
    """pattern, reliability: mean over its instances of pmi / max pmi times the instance's reliability; top: the largest pmi so far, else that of assoc."""
    scored = _against_top(assoc.join(instance_scores, "instance", "left"), assoc, top)
    return scored.groupBy("pattern").agg((F.sum(F.col("pmi") / F.col("top") * F.coalesce("reliability", F.lit(0.0))) / F.count(F.lit(1))).alias("reliability"))


def instance_reliability(assoc: DataFrame, pattern_scores: DataFrame, seeds: DataFrame, top: float | None = None) -> DataFrame:
    """instance, reliability: 1 for seeds, else the mean over its patterns."""
    scored = _against_top(assoc.join(pattern_scores, "pattern", "left"), assoc, top)
    mean = scored.groupBy("instance").agg((F.sum(F.col("pmi") / F.col("top") * F.coalesce("reliability", F.lit(0.0))) / F.count(F.lit(1))).alias("m"))
    return mean.join(seeds.select(F.col("seed").alias("instance")).withColumn("s", F.lit(1.0)), "instance", "left").select("instance", F.coalesce("s", "m").alias("reliability"))


def _against_top(scored: DataFrame, assoc: DataFrame, top: float | None) -> DataFrame:
    return scored.crossJoin(F.broadcast(assoc.agg(F.max("pmi").alias("top")))) if top is None else scored.withColumn("top", F.lit(top))


def top_patterns(scores: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k patterns of highest reliability (ties by the pattern's text), of those at or above the threshold if there is one."""
    kept = scores if threshold is None else scores.where(F.col("reliability") >= threshold)
    return kept.where("reliability is not null and not isnan(reliability)").orderBy(F.desc("reliability"), "pattern").limit(k)


def rank_relative(scores: DataFrame, previous: dict[str, float], threshold: float) -> dict[str, float]:
    """The next top patterns: 20 at first, then one more each round, unless their mean score lies further than the threshold from the previous ones'."""
    found = {r["pattern"]: r["reliability"] for r in top_patterns(scores, len(previous) + 1 if previous else 20).collect()}  # at most k rows
    if not previous or not found:
        return found or previous
    mean = lambda d: sum(d.values()) / len(d)
    return found if abs(mean(previous) - mean(found)) <= threshold else previous


def rank_absolute(scores: DataFrame, previous: dict[str, float], threshold: float) -> dict[str, float]:
    """The 100 best patterns at or above the threshold."""
    return {r["pattern"]: r["reliability"] for r in top_patterns(scores, 100, threshold).collect()}


#: how the reliability learner picks its top patterns; a further one may be registered under a name of its own
RANKERS = {"relative": rank_relative, "absolute": rank_absolute}


def reliability_bootstrap(
    lines: DataFrame, seeds: list[str], threshold: float = 0.8, window: int = 3, max_iterations: int = 10, n_docs: int | None = None, upper_case: bool = True, stopwords=STOPWORDS,
    ranker: str = "relative", instance_threshold: float | None = None, sweeps: int = 2, inducer=induce,
) -> DataFrame:
    """doc_id, line_no, phrase, reference of the most reliable patterns' references whose term is a reliable instance.

    A round induces patterns from the contexts of the newest instances, searches with those not
    searched before, and scores every pattern against the reliable instances: pmi against the largest
    pmi of all rounds so far, times the instance's reliability, which is 1 for seeds and else the mean
    over its patterns (`sweeps` turns between the two).  Terms of the ranker's top patterns become
    instances; with instance_threshold only those that reach it.  It ends when the top patterns stay
    the same or nothing new is found, at max_iterations - 1 rounds at most.  Every table of a round is written.
    """
    if ranker not in RANKERS:
        raise ValueError(f"ranker must be one of {sorted(RANKERS)}")
    spark = lines.sparkSession
    lines = cut(with_words(lines.select("doc_id", "line_no", "text")), "passages")
    n_docs = n_docs or lines.select("doc_id").distinct().count()
    seeded = spark.createDataFrame([(s,) for s in sorted(set(seeds))], "seed string")
    new, known, refs, counts, scores = seeded, None, None, None, None
    reliable = seeded.select(F.col("seed").alias("instance"), F.lit(1.0).alias("reliability"))
    top: dict[str, float] = {}
    most = -100.0  # the running maximum of pmi
    for round_ in range(1, max_iterations):
        contexts = cut(_context_id(seed_contexts(lines, new)), f"reliable-contexts{round_}")
        counted = contexts.groupBy(F.col("seed").alias("instance")).agg(F.count(F.lit(1)).alias("instance_count"))
        counts = cut(counted if counts is None else counts.unionByName(counted), f"reliable-counts{round_}")
        candidates = inducer(contexts, window, threshold, relative=False).where("regex is not null").where(has_content_word(F.col("words"), stopwords))
        fresh = candidates.select("phrase", "regex").dropDuplicates(["regex"])
        fresh = cut(fresh if known is None else fresh.join(known, "regex", "left_anti"), f"reliable-fresh{round_}")
        if not fresh.isEmpty():
            found = cut(pattern_search(lines, fresh.select(F.col("regex").alias("pattern"), "phrase", "regex"), upper_case, stopwords), f"reliable-found{round_}")
            known = fresh if known is None else known.unionByName(fresh)
            refs = found if refs is None else refs.unionByName(found)
        if refs is None:
            break
        patterns = refs.groupBy("pattern").agg(F.count(F.lit(1)).alias("pattern_count"))
        assoc = cut(pmi(joint_counts(refs), counts, patterns, n_docs).join(reliable.select("instance"), "instance", "left_semi"), f"reliable-assoc{round_}")
        largest = assoc.agg(F.max("pmi").alias("m")).first()["m"]
        if largest is None:
            break
        most = max(most, largest)
        for _ in range(sweeps):
            scores = pattern_reliability(assoc, reliable, most)
            reliable = reliable.select("instance").join(instance_reliability(assoc, scores, seeded, most), "instance", "left").select("instance", F.coalesce("reliability", F.lit(0.0)).alias("reliability"))
        scores, reliable = cut(scores, f"reliable-scores{round_}"), cut(reliable, f"reliable-instances{round_}")
        before, top = top, RANKERS[ranker](scores, top, threshold)
        chosen = spark.createDataFrame(sorted(top.items()), "pattern string, score double")
        terms = refs.join(F.broadcast(chosen), "pattern").select(F.col("reference").alias("seed")).distinct().join(reliable.select(F.col("instance").alias("seed")), "seed", "left_anti")
        if instance_threshold is not None:
            joint = joint_counts(refs.join(F.broadcast(chosen), "pattern", "left_semi"))
            of_terms = seed_contexts(lines, terms).groupBy(F.col("seed").alias("instance")).agg(F.count(F.lit(1)).alias("instance_count"))
            able = instance_reliability(pmi(joint, of_terms, patterns, n_docs), scores, seeded, most).where(F.col("reliability") >= instance_threshold)
            terms = terms.join(able.select(F.col("instance").alias("seed")), "seed", "left_semi")
        new = cut(terms, f"reliable-new{round_}")
        if set(top) == set(before) or new.isEmpty():
            break
        reliable = reliable.unionByName(new.select(F.col("seed").alias("instance"), F.lit(0.0).alias("reliability")))
    if refs is None or not top:
        return spark.createDataFrame([], "doc_id long, line_no int, phrase string, reference string")
    chosen = spark.createDataFrame(sorted(top.items()), "pattern string, score double")
    kept = refs.join(F.broadcast(chosen), "pattern").join(reliable.select(F.col("instance").alias("reference")), "reference", "left_semi").join(known.select(F.col("regex").alias("pattern"), "phrase"), "pattern")
    return kept.select("doc_id", "line_no", "phrase", "reference").distinct()
