"""Sources: folders of texts, XML, JSON and list files, and queries for remote repositories."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refquarry.functions import rx
from refquarry.functions.strings import file_stem

LINK_FILE = "entity map<string, struct<entityType: string, versionInfo: string, identifiers: array<string>, name: string, reliability: double, tags: array<string>>>, entityLink map<string, struct<confidence: double, entityRelations: array<string>, fromEntity: string, toEntity: string, tags: array<string>>>"
SOLR = "response struct<numFound: int, docs: array<struct<title: array<string>, doi: array<string>>>>"


def text_files(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """doc_id (md5 of the bytes), file_name, media_type, md5, tags, text of each file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".pdf"), "application/pdf").when(name.endswith(".xml"), "text/xml").when(name.endswith(".json"), "application/json").otherwise("text/plain")
    return raw.select(F.md5("content").alias("doc_id"), name.alias("file_name"), kind.alias("media_type"), F.md5("content").alias("md5"), (F.array(F.lit(tag)) if tag else F.array().cast("array<string>")).alias("tags"), F.when(kind != "application/pdf", F.decode("content", "UTF-8")).alias("text"))


def pdf_texts(spark: SparkSession, path: str, extract: Callable[[bytes, int], str], start_page: int = 1) -> DataFrame:
    """file_name, text, error of PDF files by a pluggable extractor; bad files have no text and stay with their error."""

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    texts.append(extract(content, start_page))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  any fault of a foreign parser belongs to its file alone
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"file_name": pdf["path"].str.rsplit("/", n=1).str[-1], "text": texts, "error": errors})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, "file_name string, text string, error string")


def term_list(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def link_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINK_FILE).option("multiLine", "true").json(path)


def body_text(xmls: DataFrame) -> DataFrame:
    """file_name, text of the first Body element of publishers' XML (file_name, xml)."""
    return xmls.select("file_name", F.expr("xpath_string(xml, '//Body')").alias("text"))


def metadata_records(xmls: DataFrame) -> DataFrame:
    """file_stem, name, abstract, language, identifiers, authors, subjects of Dublin Core records (file_name, xml)."""
    # one parse for all elements of which the first counts; no XML text holds the character between them
    first = ", '\x01', ".join(f"//*[name()='dc:{tag}']" for tag in ("title", "description", "language"))
    many = lambda tag: F.expr(f"xpath(xml, '//*[name()=\"dc:{tag}\"]/text()')")
    read = xmls.select("*", F.split(F.expr(f'xpath_string(xml, "concat({first})")'), "\x01").alias("first"))
    language = F.get("first", F.lit(2))
    return read.select(
        file_stem(F.col("file_name")).alias("file_stem"), F.get("first", F.lit(0)).alias("name"), F.get("first", F.lit(1)).alias("abstract"),
        F.when(language.isin("eng", "en"), "en").when(language.isin("deu", "de"), "de").otherwise(language).alias("language"), many("identifier").alias("identifiers"), many("creator").alias("authors"), many("subject").alias("subjects"),
    )


def annotations(lines: DataFrame) -> DataFrame:
    """doc_id, pos, word, label of token lines n-m<TAB>word<TAB>label...; the label is the first field after the word, none if _ or missing."""
    found = lines.where(F.col("text").rlike(r"^\d+-\d+\t"))
    fields = F.split("text", "\t")
    label = F.regexp_replace(F.coalesce(F.get(fields, F.lit(2)), F.lit("_")), r"\[.*\]$", "")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return found.select("doc_id", pos.alias("pos"), F.get(fields, F.lit(1)).alias("word"), F.when(label.isin("_", ""), "none").otherwise(label).alias("label"))


def html_links(pages: DataFrame) -> DataFrame:
    items = F.regexp_extract_all("html", F.lit(f"({rx.LINK_ITEM})"), F.lit(1))
    return pages.select("page_id", F.posexplode(items).alias("place", "item")).select("page_id", "place", F.regexp_extract("item", rx.LINK_ITEM, 1).alias("href"), F.regexp_extract("item", rx.LINK_ITEM, 2).alias("label"))


def solr_docs(responses: DataFrame) -> DataFrame:
    """service, list_index, title, identifier of search responses (service, json); docs without an identifier are skipped."""
    docs = responses.select("service", F.posexplode(F.from_json("json", SOLR)["response"]["docs"]).alias("list_index", "d"))
    return docs.where(F.size("d.doi") > 0).select("service", "list_index", F.get("d.title", F.lit(0)).alias("title"), F.get("d.doi", F.lit(0)).alias("identifier"))


DATACITE = "data array<struct<attributes: struct<doi: string, title: string, titles: array<struct<title: string>>>>>"


def datacite_docs(responses: DataFrame) -> DataFrame:
    """service, list_index, title, identifier of DataCite-style responses (service, json); incomplete records are skipped."""
    d = responses.select("service", F.posexplode(F.from_json("json", DATACITE)["data"]).alias("list_index", "d")).select("service", "list_index", "d.attributes.*")
    named = d.withColumn("title", F.coalesce("title", F.get("titles.title", F.lit(0))))
    return named.where("doi is not null and doi <> '' and title is not null and title <> ''").select("service", "list_index", "title", F.col("doi").alias("identifier"))


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a table that have one of the keys (a table with that column), each once."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def gold_names(lines: DataFrame) -> DataFrame:
    """name: dataset names of a list, a name a line (value); blank lines and notes after # are no names; each name once."""
    return lines.select(F.trim(F.regexp_replace("value", r"#.*$", "")).alias("name")).where("name <> ''").distinct()
