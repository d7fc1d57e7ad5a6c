"""Pattern induction: one context gives up to 2 w - 1 candidate patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refquarry.functions import rx
from refquarry.functions.strings import STOPWORDS, escaped_regex, is_stopword, left_words, right_words, wildcard_word

# How far each slot's threshold lies below the given one.
STEPS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.02, 0.04, 0.06, 0.08)


def thresholds(t: float, relative: bool = True) -> list[float]:
    return [t - s if relative else t for s in STEPS]


def shapes(window: int) -> list[tuple[int, int, int]]:
    """(words on the left, on the right, threshold slot) by rank: the general pattern, then left-k and right-k."""
    if window > 5:
        raise ValueError("a window of five words at most: there are nine thresholds")
    out = [(1, 1, 0)]
    for k in range(2, window + 1):
        out += [(k, 1, k - 1), (1, k, k + 3)]
    return out


def induce(contexts: DataFrame, window: int = 3, threshold: float = 0.25, relative: bool = True) -> DataFrame:
    """Adds rank, phrase, regex, words and threshold, a row for each rank; ranks whose words are missing have nulls; contexts without a word on a side have no rows."""
    limits = thresholds(threshold, relative)
    df = contexts.withColumn("lw", F.reverse(left_words(F.col("left_text")))).withColumn("rw", right_words(F.col("right_text")))
    df = df.where((F.size("lw") >= 2) & (F.size("rw") >= 2))
    df = df.withColumn("lr", F.transform("lw", escaped_regex)).withColumn("rr", F.transform("rw", escaped_regex))
    df = df.withColumn("lp", F.transform("lw", wildcard_word)).withColumn("rp", F.transform("rw", wildcard_word))
    gap = lambda c: F.when(c.rlike(r"^\s$"), r"\s").when(c == "", r"\s?").otherwise(c)
    dl, dr = F.get("lw", F.lit(0)), F.get("rw", F.lit(0))
    rows = []
    for rank, (nl, nr, slot) in enumerate(shapes(window)):
        left = lambda c, nl=nl: F.reverse(F.slice(c, 2, nl))
        right = lambda c, nr=nr: F.slice(c, 2, nr)
        phrase = F.concat(F.array_join(left("lp"), " "), dl, F.lit("*"), dr, F.array_join(right("rp"), " "))
        phrase = F.regexp_replace(F.regexp_replace(phrase, r"^(\*\s)+", ""), r"(\s\*)+$", "")
        regex = F.concat(F.array_join(left("lr"), r"\s"), gap(dl), F.lit(f"({rx.STUDY_NGRAM})"), gap(dr), F.array_join(right("rr"), r"\s"))
        words = F.array_distinct(F.concat(left("lw"), right("rw")))
        there = (F.size("lw") > nl) & (F.size("rw") > nr)
        rows.append(F.struct(F.lit(rank).alias("rank"), F.when(there, phrase).alias("phrase"), F.when(there, regex).alias("regex"), F.when(there, words).alias("words"), F.lit(limits[slot]).alias("threshold")))
    return df.withColumn("p", F.explode(F.array(*rows))).drop("lw", "rw", "lr", "rr", "lp", "rp").select("*", "p.*").drop("p")


def has_content_word(words, stopwords=STOPWORDS):
    return F.exists(words, lambda w: ~is_stopword(w, stopwords))
