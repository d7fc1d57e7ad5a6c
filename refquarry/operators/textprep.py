"""Document-to-document preparation: passages, sections, bibliographies, hyphens, tokens, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refquarry.functions import rx
from refquarry.functions.strings import BIBLIOGRAPHY_CUES

# Digit and decimal ratios that mark bibliography sections.
SECTION_LINES = 10
START_RATIO, AFTER_RATIO, BEFORE_RATIO, MOST_DECIMALS = (0.005, 0.1), (0.01, 0.1), (0.08, 0.1), 0.004


def passages(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line_no, text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def sections(docs: DataFrame, lines: int = SECTION_LINES, strict_compat: bool = False) -> DataFrame:
    """doc_id, section, text: runs of `lines` lines; empty lines at the end vanish; strict_compat adds an empty section after a last one that is full."""
    if strict_compat:
        n = F.size(F.split(F.regexp_replace("text", r"\n+$", ""), "\n"))
        full = docs.where(n % lines == 0).select("doc_id", F.floor(n / lines).alias("section"), F.lit("").alias("text"))
        return sections(docs, lines).unionByName(full)
    trimmed = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\n+$", ""), "\n")).alias("line_no", "line"))
    parts = trimmed.groupBy("doc_id", F.floor(F.col("line_no") / lines).alias("section")).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return parts.select("doc_id", "section", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def bibliography_flags(parts: DataFrame, cues=BIBLIOGRAPHY_CUES) -> DataFrame:
    """Adds drop: whether a section belongs to a bibliography, given the sections before it."""
    n = F.length("text")
    r, d = (F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))) / n for p in (rx.DIGIT_RATIO, rx.DECIMAL))
    within = lambda lo, hi: (r >= lo) & (r <= hi) & (d <= MOST_DECIMALS)
    cue = F.col("text").rlike("|".join(cues))
    start = F.coalesce(cue & within(*START_RATIO), F.lit(False))
    before = Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    marked = parts.withColumn("start", start).withColumn("started", F.coalesce(F.max("start").over(before), F.lit(False)))
    rest = F.when(F.col("started"), within(*AFTER_RATIO)).otherwise(within(*BEFORE_RATIO))
    return marked.withColumn("drop", F.col("start") | F.coalesce(rest, F.lit(False)) | (n == 0)).drop("start", "started")


def without_bibliography(docs: DataFrame, cues=BIBLIOGRAPHY_CUES) -> DataFrame:
    kept = bibliography_flags(sections(docs), cues).where(~F.col("drop"))
    parts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("ps"))
    return docs.select("doc_id").join(parts, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("ps", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


def strip_controls(c: Column, strict_compat: bool = False) -> Column:
    """Without control characters; strict_compat leaves the text as it is."""
    return c if strict_compat else F.regexp_replace(c, rx.CONTROLS, "")


def dehyphenate(c: Column) -> Column:
    """Joins words that a line break has divided: a token with a soft hyphen, or a hyphen before a line break and no digit first."""
    parts = F.filter(F.split(c, " "), lambda t: t != "")
    broken = lambda t: t.contains("¬") | (t.rlike(r"-\n") & ~t.rlike(r"^\d"))
    hyphen = lambda t: F.when(t.contains("¬"), F.regexp_replace(t, r"¬", "")).otherwise(F.regexp_replace(t, r"-(\n)", "$1"))
    join = lambda t: F.when(broken(t), F.concat(F.regexp_replace(hyphen(t), r"\s", ""), F.lit(" \n"))).otherwise(F.concat(t, F.lit(" ")))
    return F.array_join(F.transform(parts, join), "")


def split_compounds(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\S)([-–/])(?=\S)", " $1 ")


def tokenize(c: Column, compounds: bool = False) -> Column:
    """Words, numbers with their marks, and single punctuation marks, each after a space; sentences by line."""
    text = split_compounds(c) if compounds else c
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:['’.,/-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), F.lit(1))
    line = F.concat(F.lit(" "), F.array_join(found, " "))
    return F.regexp_replace(line, r" ([.!?]) (?=\p{Lu})", " $1\n ")


def with_tags(df: DataFrame, add: list[str], remove: list[str] = ()) -> DataFrame:
    """Provenance tags: a set union, then removals."""
    tags = F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in add]))
    for t in remove:
        tags = F.array_remove(tags, t)
    return df.withColumn("tags", F.array_sort(F.array_distinct(tags)))


def not_yet(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose text has not been extracted before."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


#: media types that a step takes
ACCEPTED = {"extract": ("application/pdf",), "search": ("text/plain",), "remove_bib": ("text/plain",), "tokenize": ("text/plain",), "read_xml": ("text/xml",)}


def media_guard(files: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """(files that the step takes, the others with status FAILED and why)."""
    fits = F.coalesce(F.col("media_type").isin(*ACCEPTED[step]), F.lit(False))
    return files.where(fits), files.where(~fits).select("*", F.lit("FAILED").alias("status"), F.concat(F.lit(f"{step} does not take "), F.coalesce("media_type", F.lit("files of no type"))).alias("error"))


def planned_steps(files: DataFrame, remove_bib: bool = True, tokenizer: str | None = "STANFORD") -> DataFrame:
    """Adds steps: what each file still needs, by its media type and its provenance tags; a file tokenised another way is left alone and warned about."""
    has = lambda tag: F.array_contains("tags", tag)
    other = F.exists("tags", lambda t: t.startswith("TOKENIZED_") & (t != f"TOKENIZED_{tokenizer}"))
    one = lambda test, step: F.when(test, F.lit(step))
    steps = [one(F.col("media_type") == "application/pdf", "extract"), one(~has("BIB_REMOVED") & F.lit(remove_bib), "remove_bib"), one(F.lit(tokenizer is not None) & ~has(f"TOKENIZED_{tokenizer}") & ~other, "tokenize")]
    planned = files.withColumn("steps", F.filter(F.array(*steps), lambda s: s.isNotNull()))
    return planned.withColumn("warning", F.when(other, F.lit("tokenised another way")))


def model_tokens(docs: DataFrame, tokenizer) -> DataFrame:
    """doc_id, text of documents tokenised by a plug-in (text -> list of sentences, each a list of tokens): a space before each token, a line for each sentence."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            text = ["\n".join("".join(f" {t}" for t in sentence) for sentence in tokenizer(x or "")) for x in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": text})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string")


def chunks_of_tags(rows: DataFrame) -> DataFrame:
    """Phrase chunks of tagger output (doc_id, line_no, line = word<TAB>tag<TAB>lemma, or <TAG> and </TAG>)."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    opened = F.col("line").rlike("^<[^/]")
    lines = rows.withColumn("chunk", F.sum(opened.cast("int")).over(w)).withColumn("closed", F.sum(F.col("line").rlike("^</").cast("int")).over(w))
    word = (F.col("chunk") > F.col("closed")) & ~F.col("line").rlike("^<")
    found = lines.where(opened | word).groupBy("doc_id", "chunk").agg(
        F.max(F.when(opened, F.regexp_extract("line", "^<([^>]+)>", 1))).alias("tag"), F.array_sort(F.collect_list(F.when(word, F.struct("line_no", F.split("line", "\t")[0].alias("word"))))).alias("ws"),
    )
    return found.where(F.size("ws") > 0).select("doc_id", "chunk", "tag", F.array_join(F.transform("ws", lambda x: x["word"]), " ").alias("words"))
