"""Sinks: tables, link lists, context XML, text files and JSON dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.functions.strings import pretty, xml_escape


def upsert(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace existing ones of the same key."""
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


def link_lines(links: DataFrame, entities: DataFrame, refs: DataFrame) -> DataFrame:
    """One pipe-separated line per link: from ids, from name, file, to ids, to name, numeric information, context; blank cells are a space."""
    e = entities.select("entity_id", "name", F.array_join("identifiers", ";").alias("ids"), F.array_join("numeric_info", ";").alias("numbers"))
    a, b = e.alias("a"), e.alias("b")
    r = refs.select(F.col("ref_id"), "doc_id", pretty(F.col("left_text"), F.col("reference"), F.col("right_text")).alias("context"))
    a, b, r = (df.hint("merge") for df in (a, b, r))  # small files hold rows many times their size: sorted, they need not fit the memory
    joined = links.join(a, links["from_entity"] == F.col("a.entity_id")).join(b, links["to_entity"] == F.col("b.entity_id")).join(r, links["link_reason"] == r["ref_id"], "left")
    cells = ["a.ids", "a.name", F.col("doc_id").cast("string"), "b.ids", "b.name", "b.numbers", "context"]
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(" ")).otherwise(c)
    return joined.select("link_id", F.concat_ws("|", *[blank(F.col(c) if isinstance(c, str) else c) for c in cells]).alias("line"))


def context_xml(refs: DataFrame) -> DataFrame:
    e = lambda c: xml_escape(F.col(c).cast("string"))
    return refs.select(F.concat(F.lit('<context reference="'), e("reference"), F.lit('" textFile="'), e("doc_id"), F.lit('"><leftContext>'), e("left_text"), F.lit("</leftContext><rightContext>"), e("right_text"), F.lit("</rightContext></context>")).alias("value"))


def json_dump(tables: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """Each table as JSON lines below a folder of its name, keyed by its uri column."""
    for name, (df, key) in tables.items():
        df.select(F.col(key).alias("uri"), F.to_json(F.struct(*df.columns)).alias("json")).write.mode("overwrite").json(f"{path}/{name}")


def write_lines(df: DataFrame, column: str, path: str, distinct: bool = False) -> None:
    lines = df.select(F.col(column).cast("string").alias("value"))
    (lines.distinct() if distinct else lines).write.mode("overwrite").text(path)
