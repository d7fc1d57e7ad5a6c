"""Searches over passages: seeds, phrases, patterns and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refquarry.functions import rx
from refquarry.functions.numeric import let
from refquarry.functions.strings import STOPWORDS, accepted_term
from refquarry.operators.textprep import tokens

#: patterns, or seeds, that one scan takes, about; they are broadcast, so more of them are searched in parts
MOST_PATTERNS = 10_000


def split_context(text: Column, term: Column) -> tuple[Column, Column]:
    """Text before a term's first occurrence, and from there to its second; empty sides are one space."""
    parts = F.split(text, F.concat(F.lit("\\Q"), term, F.lit("\\E")))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(" ")).otherwise(c)
    return blank(F.get(parts, F.lit(0))), blank(F.get(parts, F.lit(1)))


def _among(words: DataFrame) -> list[str]:
    """The distinct values of a column of at most about MOST_PATTERNS words."""
    return sorted(r[0] for r in words.distinct().collect() if r[0] is not None)


def _dealt(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """Rows in parts of about `most`, by the hash of a column."""
    parts = max(1, -(-rows.count() // most))
    return [rows] if parts == 1 else [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def seed_contexts(lines: DataFrame, seeds: DataFrame, one_per_doc: bool = False) -> DataFrame:
    """doc_id, line_no, seed, left_text, right_text for passages that hold the seed's words as tokens in a row.

    The longest word of the seed is an equi-join key on the passage's distinct tokens, so no passage
    meets seeds whose longest word it lacks, and seeds that begin with a common word do not share a key.
    Tokens are held against the keys before the passage is copied for each that is one, and the seeds
    are broadcast, about MOST_PATTERNS at once, so no passage is shuffled.
    """
    asked = seeds.select("seed", tokens(F.col("seed")).alias("asked")).withColumn("key", F.array_max(F.transform("asked", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    out = reduce(DataFrame.unionByName, [_contexts_part(lines, part) for part in _dealt(asked, "seed", MOST_PATTERNS)])
    if one_per_doc:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "seed").orderBy("line_no"))).where("n = 1").drop("n")
    return out


def _contexts_part(lines: DataFrame, asked: DataFrame) -> DataFrame:
    keys = _among(asked.select("key"))
    here = F.array_distinct(F.filter(tokens(F.col("text")), lambda w: w.isin(keys)))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    in_a_row = (F.size("asked") == 1) | F.contains(spaced(tokens(F.col("text"))), spaced(F.col("asked")))
    hits = lines.select("doc_id", "line_no", "text", F.explode(here).alias("key")).join(F.broadcast(asked), "key").where(F.contains("text", "seed") & in_a_row)
    left, right = split_context(F.col("text"), F.col("seed"))
    return hits.select("doc_id", "line_no", "seed", left.alias("left_text"), right.alias("right_text"))


def _word_regex(wanted: str) -> str:
    """A phrase's word as a regex; * within a word stands for any characters."""
    return r"\S*".join(f"\\Q{part}\\E" if part else "" for part in wanted.split("*"))


def _token_is(token: Column, wanted: str) -> Column:
    """Whether a token is a phrase's word; * within a word stands for any characters."""
    return token.rlike(f"^{_word_regex(wanted)}$") if "*" in wanted else token == F.lit(wanted)


def phrase_regex(phrase: list[str]) -> str:
    """A regex that finds a phrase's words as tokens in a row; a word alone that is * stands for any token."""
    return r"(?<!\S)" + r"\s++".join(r"\S++" if w == "*" else rf"{_word_regex(w)}(?!\S)" for w in phrase)


def phrase_matches(words: Column, phrase: list[str], slop: int) -> Column:
    """Whether a token array holds a phrase's words, which may move against each other by slop; * stands for any token, or for any characters of one."""
    fixed = [(i, w) for i, w in enumerate(phrase) if w != "*"]
    def adjusted(ws: Column, i: int, w: str) -> Column:
        return F.transform(F.filter(F.transform(ws, lambda x, p: F.struct(x.alias("w"), p.alias("p"))), lambda x: _token_is(x["w"], w)), lambda x: x["p"] - i)

    shifted = lambda ws: F.array(*[adjusted(ws, i, w) for i, w in fixed])
    near = lambda s, b: F.forall(s, lambda places: F.exists(places, lambda x: (x >= b) & (x <= b + slop)))
    return let(let(words, shifted), lambda s: F.exists(F.flatten(s), lambda b: near(s, b)))


def phrase_search(lines: DataFrame, phrase: list[str], slop: int = 0) -> DataFrame:
    """Passages that hold a phrase; with slop, words are looked for in passages that have the phrase's plain words at all."""
    if slop == 0:
        return lines.where(F.col("text").rlike(phrase_regex(phrase)))
    held = reduce(lambda a, b: a & b, [F.contains("text", F.lit(part)) for w in phrase for part in w.split("*") if part], F.lit(True))
    return lines.where(held & phrase_matches(tokens(F.col("text")), phrase, slop))


def candidate_documents(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """query, n_docs, first_doc: documents matched by each query term."""
    hits = seed_contexts(lines, terms.withColumnRenamed("query", "seed"))
    return hits.groupBy(F.col("seed").alias("query")).agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def regex_scan(docs: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """doc_id, place, match: all matches of a pattern in each text."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(group))).alias("place", "match"))


def regex_contexts(docs: DataFrame, pattern: str, left: int = 1, term: int = 2, right: int = 3) -> DataFrame:
    """doc_id, place, left_text, reference, right_text: all matches of a pattern, whose groups are the contexts and the term; empty contexts are one space, terms are trimmed."""
    every = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (left, term, right)]
    found = docs.select("doc_id", F.posexplode(F.arrays_zip(*[e.alias(n) for e, n in zip(every, ("l", "t", "r"), strict=True)])).alias("place", "m"))
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(" ")).otherwise(c)
    return found.select("doc_id", "place", blank(F.col("m.l")).alias("left_text"), F.trim("m.t").alias("reference"), blank(F.col("m.r")).alias("right_text"))


def doi_contexts(docs: DataFrame) -> DataFrame:
    """DOIs with the line around them, in each place that they stand."""
    return regex_contexts(docs, rx.LEFT_CONTEXT + f"({rx.DOI_JAVA})" + rx.RIGHT_CONTEXT)


def bounded_regex_scan(docs: DataFrame, pattern: str, seconds: float = 750.0) -> DataFrame:
    """doc_id, place, match, error: matches of a pattern that may take long, each text for a limited time; a text beyond it has a row with the error alone."""
    import pandas as pd
    import regex

    compiled = regex.compile(pattern)

    def run(frames):
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                try:
                    found = [m.group() for m in compiled.finditer(text or "", timeout=seconds)]
                    rows += [(doc_id, k, m, None) for k, m in enumerate(found)]
                except TimeoutError:
                    rows.append((doc_id, None, None, f"no answer within {seconds} s"))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "match", "error"]).astype({"place": "Int32"})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, place int, match string, error string")


def escaped_query(c: Column) -> Column:
    """A term as an index query takes it: trimmed, its operators escaped twice, in quotes if it has a space."""
    escape = lambda x: F.regexp_replace(x, r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1")
    term = escape(escape(F.trim(c)))
    return F.when(term.rlike(r"\s"), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def doi_scan(docs: DataFrame) -> DataFrame:
    found = regex_scan(docs, rx.DOI_JAVA)
    return found.select("doc_id", F.trim("match").alias("doi")).distinct()


def with_words(lines: DataFrame) -> DataFrame:
    """Adds words: the distinct runs of letters and digits of each passage.  A learner writes this once."""
    return lines.withColumn("words", F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def required_words(phrase: Column, regex: Column) -> Column:
    """Whole words that a passage must have: those of the phrase, or, where there is none, literals of the regex that stand between spaces or word bounds outside all groups."""
    of_phrase = F.filter(F.split(phrase, r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]*\p{L}[\p{L}\p{N}]*$"))
    flat = regex
    for _ in range(3):  # groups within groups
        flat = F.regexp_replace(flat, r"\((?:[^()\\]|\\.)*\)", "#")
    flat = F.regexp_replace(flat, r"\[[^\]]*\]", "#")
    edge = r"(?: (?![?*{])|\\s(?![?*{])|\\b)"
    literals = F.regexp_extract_all(flat, F.lit(rf"(?:^|(?<= )|(?<=\\s)|(?<=\\b))(\p{{L}}{{2,}})(?={edge})"), F.lit(1))
    of_regex = F.when(flat.contains("|") | flat.contains("(") | flat.contains("\\Q"), F.array().cast("array<string>")).otherwise(literals)
    return F.array_distinct(F.coalesce(of_phrase, of_regex))


def pattern_search(lines: DataFrame, patterns: DataFrame, upper_case: bool = True, stopwords=STOPWORDS) -> DataFrame:
    """doc_id, line_no, pattern, reference, left_text, right_text: passages in which a pattern's first match is an acceptable term.

    patterns has columns pattern and regex (group 1: the term), and may have phrase, whose plain words
    the passage must have as whole words.  Parts of about MOST_PATTERNS are dealt by the regex.  A
    pattern meets only passages that have the rarest of its required words; patterns that require none
    try every passage.
    """
    lines = lines if "words" in lines.columns else with_words(lines)
    return reduce(DataFrame.unionByName, [_search_part(lines, part, upper_case, stopwords) for part in _dealt(patterns, "regex", MOST_PATTERNS)])


def _search_part(lines: DataFrame, patterns: DataFrame, upper_case: bool, stopwords) -> DataFrame:
    phrase = F.col("phrase") if "phrase" in patterns.columns else F.lit(None).cast("string")
    asked = patterns.select("pattern", "regex", required_words(phrase, F.col("regex")).alias("required"))
    single, several = asked.where(F.size("required") == 1), asked.where(F.size("required") > 1)
    wanted = _among(several.select(F.explode("required")))
    common = lines.select(F.explode(F.filter("words", lambda w: w.isin(wanted))).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    counted = several.withColumn("anchor", F.explode("required")).join(F.broadcast(common), "anchor").groupBy("pattern", "regex", "required").agg(F.min(F.struct("n", "anchor"))["anchor"].alias("anchor"))
    chosen = single.withColumn("anchor", F.get("required", F.lit(0))).collect() + (counted.collect() if wanted else [])  # a row for each pattern of the part; else passages were counted anew in each use
    rarest = lines.sparkSession.createDataFrame(chosen, counted.schema)
    anchors = _among(rarest.select("anchor"))
    columns = ["doc_id", "line_no", "text", "pattern", "regex"]
    here = lines.select("doc_id", "line_no", "text", "words", F.explode(F.filter("words", lambda w: w.isin(anchors))).alias("anchor"))
    hits = here.join(F.broadcast(rarest), "anchor").where(F.forall("required", lambda w: F.array_contains("words", w))).select(columns)
    loose = asked.where(F.size("required") == 0)
    if not loose.isEmpty():
        hits = hits.union(lines.crossJoin(F.broadcast(loose)).select(columns))
    hits = hits.withColumn("reference", F.explode(F.array(F.trim(F.expr("regexp_extract(text, regex, 1)")))))  # exploded, so that what follows does not extract again; no match gives no term
    hits = hits.where(accepted_term(F.col("reference"), upper_case, stopwords))
    left, right = split_context(F.col("text"), F.col("reference"))
    return hits.select("doc_id", "line_no", "pattern", "reference", left.alias("left_text"), right.alias("right_text"))


def name_search(lines: DataFrame, names: DataFrame) -> DataFrame:
    return seed_contexts(lines, names.withColumnRenamed("name", "seed")).withColumnRenamed("seed", "name")


def postings(lines: DataFrame) -> DataFrame:
    """Inverted index rows: token, doc_id, line_no, pos (white-space tokens, case kept)."""
    return lines.select("doc_id", "line_no", F.posexplode(tokens(F.col("text"))).alias("pos", "token")).select("token", "doc_id", "line_no", "pos")
