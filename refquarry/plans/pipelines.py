"""Jobs from documents to links: by patterns, by names, by DOIs, by learning."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.functions.strings import file_stem
from refquarry.operators import bootstrap, link, search, textprep

LINKERS = {"best": link.best_match_links, "multi": link.multi_match_links, "doi": link.doi_links}


@dataclass(frozen=True)
class Job:
    """A job's parameters; names follow the reference-mining vocabulary."""

    algorithm: str
    seeds: tuple[str, ...] = ()
    bootstrap_strategy: str = "merge_all"
    reliability_threshold: float = 0.8
    windowsize: int = 3
    max_iterations: int = 10
    upper_case_constraint: bool = True
    remove_bib: bool = False
    tokenize: bool | None = None
    linker: str = "best"
    ranker: str = "relative"
    instance_threshold: float | None = None
    tags: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {sorted(ALGORITHMS)}")
        if self.algorithm in ("learn_frequency", "learn_reliability", "names") and not self.seeds:
            raise ValueError(f"{self.algorithm} needs seeds")
        if self.linker not in LINKERS:
            raise ValueError(f"linker must be one of {sorted(LINKERS)}")
        if self.ranker not in bootstrap.RANKERS:
            raise ValueError(f"ranker must be one of {sorted(bootstrap.RANKERS)}")
        if self.bootstrap_strategy not in bootstrap.STRATEGIES:
            raise ValueError(f"bootstrap_strategy must be one of {bootstrap.STRATEGIES}")


def prepare(docs: DataFrame, job: Job) -> DataFrame:
    """Bibliographies and tokens as the job asks, with provenance tags where documents carry tags."""
    text = textprep.without_bibliography(docs) if job.remove_bib else docs.select("doc_id", "text")
    return text.withColumn("text", textprep.tokenize(F.col("text"))) if job.tokenize else text


def by_frequency(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    return bootstrap.frequency_bootstrap(textprep.passages(docs), list(job.seeds), job.bootstrap_strategy, job.reliability_threshold, job.windowsize, job.max_iterations, job.upper_case_constraint)


def by_reliability(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    return bootstrap.reliability_bootstrap(textprep.passages(docs), list(job.seeds), job.reliability_threshold, job.windowsize, job.max_iterations, upper_case=job.upper_case_constraint, ranker=job.ranker, instance_threshold=job.instance_threshold)


def by_patterns(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    return search.pattern_search(textprep.passages(docs), patterns, job.upper_case_constraint).withColumnRenamed("pattern", "phrase").select("doc_id", "line_no", "phrase", "reference")


def by_names(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    names = docs.sparkSession.createDataFrame([(s,) for s in job.seeds], "name string")
    found = search.name_search(textprep.passages(docs), names)
    return found.select("doc_id", "line_no", F.lit(None).cast("string").alias("phrase"), F.col("name").alias("reference"))


def by_dois(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    lines = textprep.passages(docs)
    found = search.doi_scan(lines.select(F.struct("doc_id", "line_no").alias("doc_id"), "text"))
    return found.select("doc_id.doc_id", "doc_id.line_no", F.lit(None).cast("string").alias("phrase"), F.col("doi").alias("reference"))


ALGORITHMS = {"learn_frequency": by_frequency, "learn_reliability": by_reliability, "patterns": by_patterns, "names": by_names, "dois": by_dois}


def references(docs: DataFrame, job: Job, patterns: DataFrame | None = None) -> DataFrame:
    """ref_id, doc_id, line_no, phrase, reference, left_text, right_text, reliability."""
    ready = prepare(docs, job)
    found = ALGORITHMS[job.algorithm](ready, job, patterns).join(textprep.passages(ready), ["doc_id", "line_no"])
    left, right = search.split_context(F.col("text"), F.col("reference"))
    key = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("line_no").cast("string"), "phrase", "reference"), 256)
    return found.select(key.alias("ref_id"), "doc_id", "line_no", "phrase", "reference", left.alias("left_text"), right.alias("right_text"), F.lit(1.0).alias("reliability"))


def text_and_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Texts (doc_id, file_name, text) with the publication's metadata record of the same file stem (file_stem, name, language, authors, ...); texts without one stay."""
    return files.withColumn("file_stem", file_stem(F.col("file_name"))).join(metadata, "file_stem", "left")


def links(docs: DataFrame, job: Job, catalogue: DataFrame, services: DataFrame, patterns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, links): repository links are made once for each (name, numeric information), and every reference links its document to its entity."""
    entities = link.metadata_entities(references(docs, job, patterns))
    named = entities.withColumn("entity_id", F.sha2(F.concat_ws("|", "name", F.array_join("numeric_info", ";"), "identifier"), 256))
    once = named.dropDuplicates(["entity_id"]).select("entity_id", "name", "numeric_info", "identifier")
    found = LINKERS[job.linker](once, catalogue, services)
    return named, found.unionByName(link.publication_links(named))
