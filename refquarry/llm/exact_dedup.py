"""Exact deduplication by distributed MSD radix partitioning.

The digits of a text are its length and then its bytes, most significant first.  A level splits every
group by the next block of bytes; groups of one row leave, groups whose bytes have ended are equal
texts, and only the rest goes on.  Blocks widen eightfold, so a text of n bytes takes about log8(n)
levels.  Equality is decided by the bytes alone; no digest takes part.

Each level aggregates (group, block) with partial aggregation and joins the counts back, so a group
that holds a third of all rows is pre-aggregated in every task and its join is split by adaptive
execution.  Levels are written to the shared folder; a lost executor costs a reread of one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refquarry.llm.common import Workspace, table

FIRST_BLOCK = 32
WIDEN = 8
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Joins to each row its group's new name (g), size and first row, by the given keys."""
    groups = rows.groupBy(*keys).agg(F.min("uid").alias("g2"), F.count(F.lit(1)).alias("size"), F.min("rank").alias("first"))
    return rows.join(groups, keys)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, and `row` (the input row) if carry.

    Texts are equal when identical after each run of white space becomes one space; null counts as
    empty.  Of equal texts the row with the smallest id stays (null ids last); of rows that repeat
    that id, exactly one stays.  An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    norm = normalised(F.col(f"in.{text_col}"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("in")).select(
        F.col(f"in.{id_col}").alias("id"),
        F.monotonically_increasing_id().alias("uid"),
        (F.col("in") if carry else F.lit(None).cast("int")).alias("row"),
        norm.alias("norm"),
    )
    bits = F.col("norm").cast("binary")
    base = base.select("*", F.octet_length("norm").alias("len"), F.substring(bits, 1, FIRST_BLOCK).alias("block"))
    sizes = base.groupBy("len", "block").agg(F.count(F.lit(1)).alias("size"), F.min("uid").alias("g"))
    # the first level only splits: row numbers count as fixed once they are written
    level = base.join(sizes, ["len", "block"]).select(
        "id", "uid", "row", F.sha2("norm", 256).alias("sha"), "len", "g", "size", F.struct(F.col("id").isNull().alias("n"), "id", "uid").alias("rank"),
        F.when(F.col("size") > 1, F.substring(bits, FIRST_BLOCK + 1, 2147483647)).alias("rest"),
    )
    level = ws.cut(level, "level0")
    out = [level.where("size = 1").select("id", F.col("id").alias("keep"), "size", F.lit(True).alias("kept"), "sha", "row")]
    active = level.where("size > 1").select("id", "uid", "row", "sha", "len", "g", "rank", "rest")
    seen, width, k = FIRST_BLOCK, FIRST_BLOCK * WIDEN, 0
    while not active.isEmpty():
        k += 1
        keyed = active.withColumn("block", F.substring("rest", 1, width))
        seen += width
        done = (F.col("size") == 1) | (F.col("len") <= seen)
        split = _split(keyed, ["g", "block"]).select(
            "id", "uid", "row", "sha", "len", F.col("g2").alias("g"), "rank", "size", "first", done.alias("done"),
            F.when(~done, F.substring("rest", width + 1, 2147483647)).alias("rest"),
        )
        split = ws.cut(split, f"level{k}")
        out.append(split.where("done").select("id", F.col("first.id").alias("keep"), "size", (F.col("uid") == F.col("first.uid")).alias("kept"), "sha", "row"))
        active = split.where("not done").select("id", "uid", "row", "sha", "len", "g", "rank", "rest")
        width *= WIDEN
    result = reduce(DataFrame.unionAll, out)
    columns = [F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256")]
    return result.select(*columns, *(["row"] if carry else []))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return exact_groups(docs, id_col, text_col, carry=True).where("kept").select("row.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
