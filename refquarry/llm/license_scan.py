"""License scan by diagonal voting, in DataFrame operations alone.

Every rolling word pair of a text is hashed and joined to the word pairs of the templates.  A match at
word i of the text and word j of a template votes for the diagonal i - j.  Votes are added up by
diagonal, and every diagonal is merged with its NEAR next ones (words put in or left out).  The span of
such a run is verified: votes are taken in the template's order, each only where it lies further on in
the text than the one before, and those so taken must cover enough of the template; the span is at most
NEAR words longer than the template.  The base phrases are templates of their own whose runs must be
whole and on one diagonal, so their places are exact; the join compares the words beside the hash.

The templates are a fixed list; the broadcast side has one row for each of their word pairs.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refquarry.llm.common import table

# Base phrases with their labels, and notices with theirs (lower case, words only).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "creative commons attribution 4 0 international license": "cc-by-4.0",
    "mozilla public license version 2 0": "mpl-2.0",
}
#: a notice's verified span covers this share of its word pairs; a run reaches over so many further diagonals
COVER, NEAR = 0.85, 3
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, str, bool, int, int, str]]:
    """(template, text, label, base, its pairs, place, pair)"""
    rows = []
    for t, (text, label, base) in enumerate([*((k, v, True) for k, v in BASE.items()), *((k, v, False) for k, v in NOTICES.items())]):
        w = text.split()
        rows += [(t, text, label, base, len(w) - 1, j, f"{w[j]} {w[j + 1]}") for j in range(len(w) - 1)]
    return rows


def _pairs(spark: SparkSession) -> DataFrame:
    rows = templates()
    return spark.createDataFrame([(t, label, base, n, j, pair) for t, _, label, base, n, j, pair in rows], "template int, label string, base boolean, pairs int, j int, pair string")


def _words(text):
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), NON_WORD), lambda w: w != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base counts the places of base phrases; first_word and last_word are their smallest and largest
    start (null without one).  score is the largest share of a template that a verified span covers (1 with
    a base phrase).  Long texts count whole.  Further columns take no part, whatever their names.  Null and empty texts have no words; rows that repeat an id with another text are
    told apart by the text's hash, equal rows get equal results; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.xxhash64("text").alias("key")
    words = rows.select("doc_id", key, _words(F.col("text")).alias("w"))
    two = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    rolled = words.select("doc_id", "key", F.posexplode(two).alias("i", "pair")).withColumn("h", F.xxhash64("pair"))
    wanted = _pairs(spark).withColumnRenamed("pair", "wanted").withColumn("h", F.xxhash64("wanted"))
    votes = rolled.join(F.broadcast(wanted), "h").where("pair = wanted").select("doc_id", "key", "template", "label", "base", "pairs", "j", (F.col("i") - F.col("j")).alias("diagonal")).distinct()

    starts = F.when(F.col("base"), F.array("diagonal")).otherwise(F.sequence(F.col("diagonal") - NEAR, F.col("diagonal")))
    runs = votes.select("*", F.explode(starts).alias("start")).groupBy("doc_id", "key", "template", "label", "base", "pairs", "start").agg(F.array_sort(F.collect_set(F.struct("j", (F.col("j") + F.col("diagonal")).alias("i")))).alias("votes"))
    nothing = F.struct(F.lit(-1).alias("j"), F.lit(-1).alias("i"), F.lit(0).alias("n"))
    further = lambda at, v: F.when((v["j"] > at["j"]) & (v["i"] > at["i"]), F.struct(v["j"].alias("j"), v["i"].alias("i"), (at["n"] + 1).alias("n"))).otherwise(at)
    spans = runs.withColumn("share", F.aggregate("votes", nothing, further)["n"] / F.col("pairs"))
    kept = spans.where(F.col("share") >= F.when(F.col("base"), 1.0).otherwise(COVER))
    is_base = F.col("base")
    found = kept.groupBy("doc_id", "key").agg(
        F.sum(F.when(is_base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    base = words.select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    joined = base.join(found.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    return ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {j}, '{pair}')" for t, _, label, base, n, j, pair in templates())


ORACLE = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM w
), g AS (
  SELECT doc_id, i - 1 AS i, a || ' ' || lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM p
), t(template, label, base, pairs, j, wanted) AS (VALUES {_values()}),
v AS (SELECT DISTINCT doc_id, template, label, base, pairs, j, i, unnest(CASE WHEN base THEN [i - j] ELSE range(i - j - {NEAR}, i - j + 1) END) AS start FROM g JOIN t ON pair = wanted),
r AS (SELECT doc_id, template, label, base, pairs, start, list({{'j': j, 'i': i, 'n': 1}} ORDER BY j, i) AS votes FROM v GROUP BY ALL),
k AS (SELECT *, list_reduce(votes, lambda a, x: CASE WHEN x.j > a.j AND x.i > a.i THEN {{'j': x.j, 'i': x.i, 'n': a.n + 1}} ELSE a END).n / pairs AS share FROM r
      WHERE share >= CASE WHEN base THEN 1.0 ELSE {COVER} END),
f AS (SELECT doc_id, sum(base::int)::bigint AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM w LEFT JOIN f USING (doc_id)
"""
