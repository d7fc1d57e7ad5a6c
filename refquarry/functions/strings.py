"""Scalar string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refquarry.functions import rx

#: default stopwords; pass your own list for a corpus (German and English function words)
STOPWORDS = ("a an and are as at be but by for from has have he her his i in is it its my no not of on or our she so that the their them there they this to was we were what when which who will with you your "
             "aber als am an auch auf aus bei bin bis da das dass dem den der des die du ein eine einem einen einer eines er es für haben hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war wie wir wird zu zum zur").split()
IGNORED_STUDIES = ("eigene Berechnung", "eigene Berechnungen", "eigene Darstellung", "eigene Darstellungen")
BIBLIOGRAPHY_CUES = ("References", "Literatur", "Literaturverzeichnis", "Bibliography", "Quellen")
UMLAUTS = (("ü", "ue"), ("ä", "ae"), ("ö", "oe"), ("Ü", "Ue"), ("Ä", "Ae"), ("Ö", "Oe"))
TOKENIZER_MARKS = ("-LRB-", "-RRB-", "*NL*")


def _drop(c: Column, *texts: str) -> Column:
    for t in texts:
        c = F.replace(c, F.lit(t), F.lit(""))
    return c


def normalize_regex(c: Column) -> Column:
    c = F.regexp_replace(c, rx.PERCENT, "<PERCENT>")
    c = F.regexp_replace(c, rx.COMPLEX_NUMERIC, "<YEAR>")
    return F.regexp_replace(c, rx.PUNCTUATION, "<PUNCT>")


def escaped_regex(c: Column) -> Column:
    """A word as a regex: its normalised form quoted, the placeholders as sub-patterns without groups."""
    quoted = F.concat(F.lit("\\Q"), normalize_regex(c), F.lit("\\E"))
    for mark, pattern in (("<PERCENT>", rx.PERCENT), ("<YEAR>", f"(?:{rx.COMPLEX_NUMERIC})"), ("<PUNCT>", rx.PUNCTUATION)):
        quoted = F.replace(quoted, F.lit(mark), F.lit(f"\\E{pattern}\\Q"))
    return F.replace(quoted, F.lit("\\Q\\E"), F.lit(""))


def wildcard_word(c: Column) -> Column:
    """A word as a phrase element: each percent, number and punctuation mark is a wildcard."""
    for pattern in (rx.PERCENT, rx.COMPLEX_NUMERIC, rx.PUNCTUATION):
        c = F.regexp_replace(c, pattern, "*")
    return F.trim(c)


def clean_name(c: Column) -> Column:
    c = F.regexp_replace(_drop(c, *TOKENIZER_MARKS), r"\d", "")
    c = F.regexp_replace(c, rx.PUNCT_RUN_JAVA, " ")
    for umlaut, plain in UMLAUTS:
        c = F.replace(c, F.lit(umlaut), F.lit(plain))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shorten(c: Column) -> Column:
    return F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 495), F.lit(" (...)"))).otherwise(c)


def left_words(c: Column) -> Column:
    """The words of a left context, then the white-space character that ends it (or the empty string)."""
    last = F.substring(c, -1, 1)
    text = F.regexp_replace(c, r"\s+$", "")
    words = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))
    return F.array_append(words, F.when(last.rlike(r"\s"), last).otherwise(F.lit("")))


def right_words(c: Column) -> Column:
    """The white-space character that begins a right context (or the empty string), then its words."""
    first = F.substring(c, 1, 1)
    return F.array_prepend(F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+"), F.when(first.rlike(r"\s"), first).otherwise(F.lit("")))


def plain_context(left: Column, ref: Column, right: Column) -> Column:
    """A reference within its context, without marks."""
    return F.concat(left, ref, right)


def lower_tagged(c: Column) -> Column:
    """A tagged word (word, tag) with its word in lower case."""
    return F.struct(F.lower(c["word"]).alias("word"), c["tag"].alias("tag"))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; where both have a key, the second's value stands."""
    return F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,double>")), F.coalesce(b, F.create_map().cast("map<string,double>")), lambda _, x, y: F.coalesce(y, x))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(100)).cast("int")


def content_path(root: str, file_id: Column) -> Column:
    """Where a file with this digest lies below root; null unless it is 32 or 40 letters and digits."""
    return F.when(file_id.rlike("^(?:[0-9A-Za-z]{32}|[0-9A-Za-z]{40})$"), F.concat(F.lit(root.rstrip("/") + "/"), file_id))


def pretty(left: Column, ref: Column, right: Column) -> Column:
    return F.concat(left, F.lit("**[  "), ref, F.lit("  ]**"), right)


def xml_escape(c: Column) -> Column:
    c = F.regexp_replace(c, rx.CONTROLS, "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def xml_unescape(c: Column) -> Column:
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def url_param(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def utf8_hex(c: Column) -> Column:
    return F.lower(F.hex(F.encode(c, "UTF-8")))


def split_enumeration(c: Column) -> Column:
    """Split at the first of , ; / \\ that gives more than one part."""
    parts = [F.split(c, p) for p in (",", ";", "/", r"\\")]
    return F.coalesce(*[F.when(F.size(p) > 1, p) for p in parts], F.array(c))


def ontology_key(c: Column) -> Column:
    return F.concat(F.lit("dataset_"), F.translate(c, "/.", ""))


def strip_doi_prefix(c: Column) -> Column:
    return _drop(c, "https://doi.org/", "http://dx.doi.org/")


def file_stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")


def title_version_regex(c: Column) -> Column:
    """A regex that finds a title followed, within about five words, by a range of years, a year or a number."""
    return F.concat(F.lit("\\Q"), c, F.lit(rf"\E(?:\S*\s?){{0,5}}?({rx.YEAR}\s*{rx.RANGE}\s*{rx.YEAR}|{rx.YEAR}|{rx.NUMBER})"))


def is_stopword(c: Column, stopwords=STOPWORDS) -> Column:
    """Only punctuation, space and digits; or numeric; or, without punctuation, one character or less, a stopword, or stopwords in a row."""
    word = F.lower(F.trim(F.regexp_replace(c, rx.PUNCT_RUN_JAVA, "")))
    stops = F.array(*[F.lit(s) for s in stopwords])
    some = word.rlike(r"^(?:\s|" + "|".join(sorted(stopwords, key=len, reverse=True)) + ")+$")  # few words get past this
    joined = some & F.exists(stops, lambda s: F.contains(word, s) & (F.array_contains(stops, F.trim(F.replace(word, s, F.lit(" ")))) | (F.replace(word, s, F.lit("")) == "")))
    return c.rlike(r"^[\p{Punct}\s\d]*$") | F.trim(c).rlike(rf"^(?:{rx.COMPLEX_NUMERIC})$") | (F.length(word) < 2) | F.array_contains(stops, word) | joined


def ignored(c: Column, studies=IGNORED_STUDIES, regex: bool = False) -> Column:
    return c.rlike("^(?:" + "|".join(studies) + ")$") if regex else F.trim(c).isin(*studies)


def without_letters(c: Column) -> Column:
    return ~c.rlike(r"\p{L}")


def has_upper_case(c: Column) -> Column:
    plain = _drop(c, *TOKENIZER_MARKS)
    return F.lower(plain) != plain


def accepted_term(c: Column, upper_case: bool = True, stopwords=STOPWORDS) -> Column:
    ok = (c != "") & ~without_letters(c) & ~is_stopword(c, stopwords) & ~ignored(c)
    return ok & has_upper_case(c) if upper_case else ok
