"""The registered queries over the reference-mining operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refquarry.functions import numeric, rx, strings
from refquarry.operators import bootstrap, induce, link, search, textprep
from refquarry.sources import readers, sinks
from refquarry.sources.tables import cut, dealt, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEEDS = ("Apache", "the", "worthless", "MIT")
#: seeds of the learners: terms of the documents' license lines
LEARNER_SEEDS = ["Apache"]

PASSAGES = "p AS (SELECT doc_id, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
TOKENS = r"regexp_extract_all(text, '\S+')"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _lines(spark, sf):
    return textprep.passages(table(spark, sf, "documents"))


def _names(spark, values, column):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def _sql_list(values) -> str:
    return ", ".join("('" + v.replace("'", "''") + "')" for v in values)


def _sql_array(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ------------------------------------------------------------------ passages and searches


@query("passage_scan", f"WITH {PASSAGES} SELECT doc_id, line_no, text, len({TOKENS})::INT AS n_tokens FROM p")
def passage_scan(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", "text", F.size(textprep.tokens(F.col("text"))).alias("n_tokens"))


_CONTEXTS = f"""WITH {PASSAGES}, s(seed) AS (VALUES {_sql_list(SEEDS)}),
c AS (SELECT doc_id, line_no, seed, string_split(text, seed) AS parts FROM p JOIN s ON list_contains({TOKENS}, seed)),
x AS (SELECT doc_id, line_no, seed, CASE WHEN coalesce(parts[1], '') = '' THEN ' ' ELSE parts[1] END AS left_text,
      CASE WHEN coalesce(parts[2], '') = '' THEN ' ' ELSE parts[2] END AS right_text FROM c)"""


@query("seed_contexts", _CONTEXTS + " SELECT * FROM x")
def seed_contexts(spark, sf):
    return search.seed_contexts(_lines(spark, sf), _names(spark, SEEDS, "seed"))


_LEFT_WORDS = r"""list_append(CASE WHEN regexp_replace(left_text, '\s+$', '') = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(regexp_replace(left_text, '\s+$', ''), '\s+') END,
 CASE WHEN regexp_matches(right(left_text, 1), '\s') THEN right(left_text, 1) ELSE '' END)"""
_RIGHT_WORDS = r"""list_prepend(CASE WHEN regexp_matches(left(right_text, 1), '\s') THEN left(right_text, 1) ELSE '' END,
 regexp_split_to_array(regexp_replace(right_text, '^\s+|\s+$', '', 'g'), '\s+'))"""


@query("context_words", _CONTEXTS + f" SELECT doc_id, line_no, seed, array_to_string({_LEFT_WORDS}, '|') AS left_words, array_to_string({_RIGHT_WORDS}, '|') AS right_words FROM x")
def context_words(spark, sf):
    found = seed_contexts(spark, sf)
    return found.select("doc_id", "line_no", "seed", F.array_join(strings.left_words(F.col("left_text")), "|").alias("left_words"), F.array_join(strings.right_words(F.col("right_text")), "|").alias("right_words"))


@query("candidate_search", _CONTEXTS + " SELECT seed AS query, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM x GROUP BY seed")
def candidate_search(spark, sf):
    return search.candidate_documents(_lines(spark, sf), _names(spark, SEEDS, "query"))


@query("phrase_search", rf"""WITH {PASSAGES} SELECT doc_id, line_no FROM p WHERE regexp_matches(' ' || array_to_string({TOKENS}, ' ') || ' ', ' under \S+ \S+ License, ')""")
def phrase_search(spark, sf):
    return search.phrase_search(_lines(spark, sf), ["under", "*", "*", "License,"]).select("doc_id", "line_no")


@query("sloppy_phrase_search", f"""WITH {PASSAGES}, t AS (SELECT doc_id, line_no, unnest(range(len(w))) AS i, unnest(w) AS w FROM (SELECT doc_id, line_no, {TOKENS} AS w FROM p)),
a AS (SELECT * FROM t WHERE w = 'under'), b AS (SELECT * FROM t WHERE w = 'the'), c AS (SELECT * FROM t WHERE w = 'License,')
SELECT DISTINCT a.doc_id, a.line_no FROM a JOIN b USING (doc_id, line_no) JOIN c USING (doc_id, line_no) WHERE greatest(a.i, b.i - 1, c.i - 2) - least(a.i, b.i - 1, c.i - 2) <= 2""")
def sloppy_phrase_search(spark, sf):
    return search.phrase_search(_lines(spark, sf), ["under", "the", "License,"], slop=2).select("doc_id", "line_no")


@query("wildcard_phrase_search", rf"""WITH {PASSAGES} SELECT doc_id, line_no FROM p WHERE regexp_matches(' ' || array_to_string({TOKENS}, ' ') || ' ', ' \S*nder \S+ A\S*e \S+ ')""")
def wildcard_phrase_search(spark, sf):
    return search.phrase_search(_lines(spark, sf), ["*nder", "*", "A*e", "*"]).select("doc_id", "line_no")


@query("postings", f"WITH {PASSAGES} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(pos)::INT AS first_pos FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT doc_id, {TOKENS} AS w FROM p)) GROUP BY token")
def postings(spark, sf):
    rows = search.postings(_lines(spark, sf))
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("pos").alias("first_pos"))


@query("regex_scan_numeric", f"""SELECT doc_id, 'documents' AS source, unnest(range(len(m)))::INT AS place, unnest(m) AS match FROM (SELECT doc_id, regexp_extract_all(text, '{rx.COMPLEX_NUMERIC.replace("'", "''")}') AS m FROM documents)
UNION ALL SELECT page_id, 'pages', unnest(range(len(m)))::INT, unnest(m) FROM (SELECT page_id, regexp_extract_all(html, '{rx.COMPLEX_NUMERIC.replace("'", "''")}') AS m FROM pages)""")
def regex_scan_numeric(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit("documents").alias("source"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.lit("pages").alias("source"))
    parts = [search.regex_scan(d, rx.COMPLEX_NUMERIC).select("doc_id", F.lit(s).alias("source"), "place", "match") for d, s in ((docs, "documents"), (pages, "pages"))]
    return parts[0].unionByName(parts[1])


_PART_TEXT = "'see ' || p_name || ' doi 10.' || (4000 + p_size)::VARCHAR || '/' || p_partkey::VARCHAR || '.x for details and ' || p_brand"


@query("doi_extract", f"WITH t AS (SELECT p_partkey AS doc_id, {_PART_TEXT} AS text FROM part) SELECT doc_id, trim(regexp_extract(text, '{rx.DOI}')) AS doi FROM t")
def doi_extract(spark, sf):
    text = F.concat(F.lit("see "), "p_name", F.lit(" doi 10."), (F.lit(4000) + F.col("p_size")).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".x for details and "), "p_brand")
    return search.doi_scan(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


_SUPPLIER_TEXT = "CASE WHEN s_suppkey % 3 = 0 THEN 'home www.site' || s_nationkey || '.org, call' WHEN s_suppkey % 3 = 1 THEN 'at http://x.org/' || replace(s_name, '#', '-') || ' or later' ELSE s_name END"


@query("url_extract", rf"WITH t AS (SELECT s_suppkey, {_SUPPLIER_TEXT} AS text FROM supplier) SELECT s_suppkey, nullif(regexp_extract(text, '{rx.URL}'), '') AS url FROM t")
def url_extract(spark, sf):
    k = F.col("s_suppkey") % 3
    text = F.when(k == 0, F.concat(F.lit("home www.site"), F.col("s_nationkey").cast("string"), F.lit(".org, call"))).when(k == 1, F.concat(F.lit("at http://x.org/"), F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(" or later"))).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", numeric.first_url(text).alias("url"))


@query("name_extract", f"""WITH {PASSAGES}, n AS (SELECT DISTINCT array_to_string(regexp_extract_all(text, '\\S+')[1:3], ' ') AS name FROM benchmark),
x AS (SELECT doc_id, line_no, text, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS spaced, unnest(list_distinct({TOKENS})) AS w FROM p)
SELECT doc_id, line_no, name FROM x JOIN n ON string_split(name, ' ')[1] = w AND contains(spaced, ' ' || name || ' ') AND contains(text, name)""")
def name_extract(spark, sf):
    words = textprep.tokens(F.col("text"))
    names = table(spark, sf, "benchmark").select(F.array_join(F.slice(words, 1, 3), " ").alias("name")).distinct()
    return search.name_search(_lines(spark, sf), names).select("doc_id", "line_no", "name")


_STOPS = _sql_array(strings.STOPWORDS)


def _stop_sql(c: str) -> str:
    word = f"lower(trim(regexp_replace({c}, '[[:punct:]]+', '', 'g')))"
    joined = f"len(list_filter({_STOPS}, lambda s: list_contains({_STOPS}, trim(replace({word}, s, ' '))) OR replace({word}, s, '') = '')) > 0"
    return f"(regexp_matches({c}, '^[[:punct:]\\s\\d]*$') OR regexp_full_match(trim({c}), '{rx.COMPLEX_NUMERIC.replace(chr(39), chr(39) * 2)}') OR length({word}) < 2 OR list_contains({_STOPS}, {word}) OR {joined})"


@query("pattern_search_validate", " UNION ALL ".join(
    f"""SELECT doc_id, line_no, '{name}' AS pattern, r AS reference FROM (WITH {PASSAGES} SELECT doc_id, line_no, trim(regexp_extract(text, '{regex}', 1)) AS r FROM p WHERE regexp_matches(text, '{regex}'))
WHERE r <> '' AND regexp_matches(r, '\\p{{L}}') AND lower(r) <> r AND NOT {_stop_sql('r')}""" for name, regex in rx.HANDWRITTEN.items()))
def pattern_search_validate(spark, sf):
    patterns = spark.createDataFrame(list(rx.HANDWRITTEN.items()), "pattern string, regex string")
    return search.pattern_search(_lines(spark, sf), patterns).select("doc_id", "line_no", "pattern", "reference")


@query("stopword_filter", f"WITH {PASSAGES}, t AS (SELECT unnest({TOKENS}) AS word FROM p), d AS (SELECT word, count(*) AS n FROM t GROUP BY word) SELECT word, n, {_stop_sql('word')} AS is_stopword FROM d")
def stopword_filter(spark, sf):
    words = _lines(spark, sf).select(F.explode(textprep.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.select("word", "n", strings.is_stopword(F.col("word")).alias("is_stopword"))


_N = rx.COMPLEX_NUMERIC.replace("'", "''")


@query("normalize_regex", rf"""WITH {PASSAGES} SELECT doc_id, line_no,
 regexp_replace(regexp_replace(regexp_replace(text, '{rx.PERCENT}', '<PERCENT>', 'g'), '{_N}', '<YEAR>', 'g'), '{rx.PUNCTUATION}', '<PUNCT>', 'g') AS normalized,
 trim(regexp_replace(regexp_replace(regexp_replace(text, '{rx.PERCENT}', '*', 'g'), '{_N}', '*', 'g'), '{rx.PUNCTUATION}', '*', 'g')) AS wildcards
FROM p WHERE regexp_matches(text, '\d')""")
def normalize_regex(spark, sf):
    lines = _lines(spark, sf).where(F.col("text").rlike(r"\d"))
    return lines.select("doc_id", "line_no", strings.normalize_regex(F.col("text")).alias("normalized"), strings.wildcard_word(F.col("text")).alias("wildcards"))


@query("clean_name", r"""WITH t AS (SELECT 'part' AS kind, p_partkey AS id, p_name || ' -LRB- ' || p_brand || ' -RRB- Größe/Übersicht ' || p_size AS s FROM part
 UNION ALL SELECT 'nation', n_nationkey, n_name || '*NL* (' || n_regionkey || ')' FROM nation),
c AS (SELECT kind, id, regexp_replace(regexp_replace(replace(replace(replace(s, '-LRB-', ''), '-RRB-', ''), '*NL*', ''), '\d', '', 'g'), '[[:punct:]]+', ' ', 'g') AS s FROM t)
SELECT kind, id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(s, 'ü', 'ue'), 'ä', 'ae'), 'ö', 'oe'), 'Ü', 'Ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), '\s+', ' ', 'g')) AS name FROM c""")
def clean_name(spark, sf):
    part = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" -LRB- "), "p_brand", F.lit(" -RRB- Größe/Übersicht "), F.col("p_size").cast("string")).alias("s"))
    nation = table(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit("*NL* ("), F.col("n_regionkey").cast("string"), F.lit(")")).alias("s"))
    return part.unionByName(nation).select("kind", "id", strings.clean_name(F.col("s")).alias("name"))


@query("string_functions", """SELECT p_partkey, lower(hex(encode(p_name))) AS hex, 'dataset_' || translate('10.' || p_size || '/' || p_partkey, '/.', '') AS ontology_key,
 replace(replace('https://doi.org/10.1/' || p_partkey, 'https://doi.org/', ''), 'http://dx.doi.org/', '') AS doi,
 regexp_replace(string_split('a/b/' || p_brand || '.v' || p_size || '.txt', '/')[-1], '\\.[^.]*$', '') AS stem,
 CASE WHEN length(repeat(p_name, 30)) > 500 THEN substr(repeat(p_name, 30), 1, 495) || ' (...)' ELSE repeat(p_name, 30) END AS short,
 replace(replace(replace(p_type || ' <' || p_brand || '> & "x"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;').replace('"', '&quot;') AS xml, md5(p_name) AS md5 FROM part""")
def string_functions(spark, sf):
    s = lambda *c: F.concat(*[F.lit(x[1:]) if x[0] == "=" else F.col(x).cast("string") for x in c])
    return table(spark, sf, "part").select(
        "p_partkey", strings.utf8_hex(F.col("p_name")).alias("hex"), strings.ontology_key(s("=10.", "p_size", "=/", "p_partkey")).alias("ontology_key"), strings.strip_doi_prefix(s("=https://doi.org/10.1/", "p_partkey")).alias("doi"),
        strings.file_stem(s("=a/b/", "p_brand", "=.v", "p_size", "=.txt")).alias("stem"), strings.shorten(F.repeat("p_name", F.lit(30))).alias("short"),
        strings.xml_escape(s("p_type", "= <", "p_brand", '=> & "x"')).alias("xml"), F.md5("p_name").alias("md5"),
    )


# ------------------------------------------------------------------ numeric information

_ORDER_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN 'in ' || y || '-' || (y + 1) || ' and 56.1' WHEN 1 THEN 'wave 2, ' || y WHEN 2 THEN 'the ''' || right(y::VARCHAR, 2) || ' study 12.'
 WHEN 3 THEN y || ' bis ' || (y + 3) || ', 7 %' ELSE 'none at all' END"""
_SORTED = """list_transform(list_sort(list_transform(range(1, len(m) + 1), lambda i: {'r': CASE WHEN regexp_matches(m[i], '\\d{4}') THEN 0 WHEN regexp_matches(m[i], '''\\d\\d') THEN 1 ELSE 2 END, 'i': i})), lambda s: m[s.i])"""


def _orders(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    y = F.col("y").cast("string")
    k = F.col("o_orderkey") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("in "), y, F.lit("-"), (F.col("y") + 1).cast("string"), F.lit(" and 56.1"))).when(k == 1, F.concat(F.lit("wave 2, "), y))
        .when(k == 2, F.concat(F.lit("the '"), F.right(y, F.lit(2)), F.lit(" study 12."))).when(k == 3, F.concat(y, F.lit(" bis "), (F.col("y") + 3).cast("string"), F.lit(", 7 %"))).otherwise("none at all")
    )
    return o.withColumn("text", text)


@query("numeric_info_sorted", f"""WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders), t AS (SELECT o_orderkey, {_ORDER_TEXT} AS text FROM o), m AS (SELECT o_orderkey, text, regexp_extract_all(text, '{_N}') AS m FROM t)
SELECT o_orderkey, array_to_string({_SORTED}, '|') AS info, coalesce(({_SORTED})[1], '') AS best,
 array_to_string(list_transform(regexp_extract_all(text, '{rx.NUMBER}'), lambda x: regexp_replace(x, '[.,]$', '')), '|') AS numbers FROM m""")
def numeric_info_sorted(spark, sf):
    info = numeric.sorted_info(numeric.numeric_info(F.col("text")))
    return _orders(spark, sf).select("o_orderkey", F.array_join(info, "|").alias("info"), numeric.best_info(numeric.numeric_info(F.col("text"))).alias("best"), F.array_join(numeric.numbers(F.col("text")), "|").alias("numbers"))


_OVERLAP = """CASE WHEN a0 = b0 AND a1 = b1 THEN 'same_as_temporal' WHEN b0 >= a0 AND b1 <= a1 THEN 'superset_of_temporal'
 WHEN b0 < a0 AND b1 <= a1 AND b1 >= a0 THEN CASE WHEN b1 <> a1 THEN 'part_of_temporal,superset_of_temporal' ELSE 'part_of_temporal' END
 WHEN b0 >= a0 AND b1 > a1 AND b0 <= a1 THEN CASE WHEN b0 <> a0 THEN 'part_of_temporal,superset_of_temporal' ELSE 'part_of_temporal' END
 WHEN b0 <= a0 AND b1 >= a1 THEN 'part_of_temporal' END"""


#: years of orders by customer (r), and by district of fifty and priority (g)
_YEARS = """r AS (SELECT o_custkey AS k, min(year(o_orderdate)) AS a0, max(year(o_orderdate)) AS a1 FROM orders GROUP BY o_custkey),
g AS (SELECT (o_custkey % 50)::BIGINT AS g, o_orderpriority AS p, month(o_orderdate) AS m, min(year(o_orderdate)) + 1 AS b0, max(year(o_orderdate)) AS b1 FROM orders GROUP BY 1, 2, 3)"""


def _years(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    r = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("y").alias("a0"), F.max("y").alias("a1"))
    g = o.groupBy((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("p"), F.month("o_orderdate").alias("m")).agg((F.min("y") + 1).alias("b0"), F.max("y").alias("b1")).where("b0 <= b1")
    return r.join(g, F.col("k") % 50 == F.col("g"))


@query("temporal_overlap_join", f"WITH {_YEARS} SELECT k, g, p, m, {_OVERLAP} AS relations FROM r JOIN g ON k % 50 = g AND b0 <= b1 AND a0 <= b1 AND b0 <= a1")
def temporal_overlap_join(spark, sf):
    pairs = _years(spark, sf).where((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    found = numeric.overlap(*[F.col(c).cast("string") for c in ("a0", "a1", "b0", "b1")], invert=False)
    return pairs.select("k", "g", "p", "m", F.array_join(F.array_sort(found), ",").alias("relations"))


@query("numeric_match_years", f"""WITH {_YEARS} SELECT k, g, p, m, CASE WHEN a0 = a1 AND b0 = b1 THEN CASE WHEN a0 = b0 THEN 'same_as_temporal' END
 WHEN a0 = a1 THEN CASE WHEN a0 BETWEEN b0 AND b1 THEN 'part_of_temporal' END WHEN b0 = b1 THEN CASE WHEN b0 BETWEEN a0 AND a1 THEN 'superset_of_temporal' END ELSE {_OVERLAP} END AS relations FROM r JOIN g ON k % 50 = g AND b0 <= b1""")
def numeric_match_years(spark, sf):
    """Mentions of one year or a range of years against each other: a customer's years and those of a district."""
    s = lambda c: F.col(c).cast("string")
    mention = lambda a, b, dash: F.when(F.col(a) == F.col(b), s(a)).otherwise(F.concat(s(a), F.lit(dash), s(b)))
    found = numeric.numeric_match(mention("a0", "a1", "-"), mention("b0", "b1", " bis "))
    return _years(spark, sf).select("k", "g", "p", "m", F.array_join(found, ",").alias("relations"))


# ------------------------------------------------------------------ text preparation

_LINEITEM_TEXT = """WITH l AS (SELECT l_orderkey AS doc_id, string_agg(CASE WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'References and more words of a heading that is long 1'
 WHEN l_linenumber > 2 THEN 'Author name, some title of a paper in ' || (1990 + l_linenumber) || ', pages ' || l_quantity::INT ELSE 'plain text without figures here ' || l_returnflag END, chr(10) ORDER BY l_linenumber, l_quantity, l_returnflag) AS text
 FROM lineitem GROUP BY l_orderkey),
s AS (SELECT doc_id, i // 2 AS section, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n+$', ''), chr(10)) AS ls FROM l)) GROUP BY 1, 2)"""


def _papers(spark, sf):
    n = F.col("l_linenumber")
    line = F.when((n == 2) & (F.col("l_orderkey") % 3 == 0), F.lit("References and more words of a heading that is long 1")).when(n > 2, F.concat(F.lit("Author name, some title of a paper in "), (F.lit(1990) + n).cast("string"), F.lit(", pages "), F.col("l_quantity").cast("int").cast("string"))).otherwise(F.concat(F.lit("plain text without figures here "), "l_returnflag"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"), line.alias("line")))).alias("ls"))
    return rows.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


@query("section_split", _LINEITEM_TEXT + " SELECT doc_id, section::BIGINT AS section, text FROM s")
def section_split(spark, sf):
    return textprep.sections(_papers(spark, sf), 2)


_RATIOS = r"""f AS (SELECT *, len(regexp_extract_all(text, '\d+')) / length(text) AS r, len(regexp_extract_all(text, '\d+\.\d+')) / length(text) AS d FROM s),
g AS (SELECT *, coalesce(regexp_matches(text, 'References|Literatur|Literaturverzeichnis|Bibliography|Quellen') AND r BETWEEN 0.005 AND 0.1 AND d <= 0.004, false) AS st FROM f),
h AS (SELECT *, coalesce(bool_or(st) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS started FROM g),
k AS (SELECT * FROM h WHERE NOT (st OR (started AND r BETWEEN 0.01 AND 0.1 AND d <= 0.004) OR (NOT started AND r BETWEEN 0.08 AND 0.1 AND d <= 0.004) OR length(text) = 0))
SELECT l.doc_id, coalesce(t, '') AS text FROM (SELECT DISTINCT doc_id FROM s) l LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY section) AS t FROM k GROUP BY doc_id) USING (doc_id)"""


@query("bibliography_removal", _LINEITEM_TEXT + ", " + _RATIOS)
def bibliography_removal(spark, sf):
    papers = _papers(spark, sf)
    kept = textprep.bibliography_flags(textprep.sections(papers, 2)).where(~F.col("drop"))
    parts = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("ps"))
    return papers.select("doc_id").join(parts, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("ps", lambda x: x["text"]), "\n"), F.lit("")).alias("text"))


_BROKEN = """replace(p_name, ' ', '-' || chr(10) || ' ') || ' 12-' || chr(10) || '34 a¬' || chr(10) || 'b  ' || p_type"""


@query("dehyphenate", f"""WITH t AS (SELECT p_partkey, unnest(range(len(w))) AS i, unnest(w) AS w FROM (SELECT p_partkey, list_filter(string_split({_BROKEN}, ' '), lambda x: x <> '') AS w FROM part))
SELECT p_partkey, string_agg(CASE WHEN contains(w, '¬') THEN regexp_replace(replace(w, '¬', ''), '\\s', '', 'g') || ' ' || chr(10)
 WHEN regexp_matches(w, '-\\n') AND NOT regexp_matches(w, '^\\d') THEN regexp_replace(replace(w, '-' || chr(10), chr(10)), '\\s', '', 'g') || ' ' || chr(10) ELSE w || ' ' END, '' ORDER BY i) AS text FROM t GROUP BY p_partkey""")
def dehyphenate(spark, sf):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("-\n ")), F.lit(" 12-\n34 a¬\nb  "), "p_type")
    return table(spark, sf, "part").select("p_partkey", textprep.dehyphenate(text).alias("text"))


@query("strip_controls", "SELECT p_partkey, p_name || 'x' || chr(10) || 'yz' AS text FROM part")
def strip_controls(spark, sf):
    return table(spark, sf, "part").select("p_partkey", textprep.strip_controls(F.concat("p_name", F.lit("\x07x\ny\x01\u00ad\u200bz\ue000\x9f"))).alias("text"))


@query("compound_split", r"SELECT p_partkey, regexp_replace(regexp_replace(p_type || '-' || p_brand || ' and/or ' || p_name || ' - x', '(\S)([-–/])(\S)', '\1 \2 \3', 'g'), '(\S)([-–/])(\S)', '\1 \2 \3', 'g') AS text FROM part")
def compound_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", textprep.split_compounds(F.concat("p_type", F.lit("-"), "p_brand", F.lit(" and/or "), "p_name", F.lit(" - x"))).alias("text"))


_SPLIT = r"regexp_replace({}, '(\S)([-–/])(\S)', '\1 \2 \3', 'g')"


@query("tokenize", rf"""WITH {PASSAGES}, s AS (SELECT doc_id, line_no, {_SPLIT.format(_SPLIT.format("text"))} AS text FROM p),
t AS (SELECT doc_id, line_no, ' ' || array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+(?:[''’.,/-][\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]'), ' ') AS l FROM s)
SELECT doc_id, line_no, regexp_replace(l, ' ([.!?]) (\p{{Lu}})', ' \1' || chr(10) || ' \2', 'g') AS tokens FROM t""")
def tokenize(spark, sf):
    return _lines(spark, sf).select("doc_id", "line_no", textprep.tokenize(F.col("text"), compounds=True).alias("tokens"))


@query("provenance_tags", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([o_orderpriority, o_orderstatus, 'TEXT_EXTRACTED', 'BIB_REMOVED'], lambda x: x <> 'O'))), ',') AS tags FROM orders")
def provenance_tags(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return textprep.with_tags(rows, ["TEXT_EXTRACTED", "BIB_REMOVED"], ["O"]).select("o_orderkey", F.array_join("tags", ",").alias("tags"))


def _one_each(spark, sf):
    """One row per order and line number."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))


@query("tagged_chunks", """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk, CASE WHEN l_linenumber % 2 = 0 THEN 'VC' ELSE 'NC' END AS tag, min(l_returnflag) || ' ' || min(l_linestatus) AS words FROM lineitem GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS chunk, tag, words FROM t""")
def tagged_chunks(spark, sf):
    lines = _one_each(spark, sf)
    n = F.col("l_linenumber")
    tag = F.when(n % 2 == 0, "VC").otherwise("NC")
    word = lambda c: F.concat(c, F.lit("\tNN\tlemma"))
    rows = F.array(F.concat(F.lit("<"), tag, F.lit(">")), word(F.col("l_returnflag")), word(F.col("l_linestatus")), F.concat(F.lit("</"), tag, F.lit(">")), F.lit("and\tCC\tand"))
    told = lines.select(F.col("l_orderkey").alias("doc_id"), n, F.posexplode(rows).alias("i", "line")).select("doc_id", (n * 10 + F.col("i")).alias("line_no"), "line")
    return textprep.chunks_of_tags(told).select("doc_id", "chunk", "tag", "words")


# ------------------------------------------------------------------ sources

@query("tag_search_or", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'F'")
def tag_search_or(spark, sf):
    return link.match_any(table(spark, sf, "orders"), {"o_orderpriority": ["1-URGENT", "5-LOW"], "o_orderstatus": ["F"]}).select("o_orderkey")


@query("tag_search_strict", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def tag_search_strict(spark, sf):
    return link.match_any(table(spark, sf, "orders"), {"o_orderpriority": ["1-URGENT", "5-LOW"], "o_orderstatus": ["F"]}, strict_compat=True).select("o_orderkey")


@query("json_props", "SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("search_responses", "SELECT p_brand AS service, p_partkey % 7 AS list_index, p_name AS title, '10.1/' || p_partkey AS identifier FROM part WHERE p_partkey % 3 > 0")
def search_responses(spark, sf):
    doc = F.when(F.col("p_partkey") % 3 > 0, F.struct(F.array("p_name").alias("title"), F.array(F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi"))).otherwise(F.struct(F.array("p_name").alias("title"), F.array().cast("array<string>").alias("doi")))
    place = (F.col("p_partkey") % 7).cast("int")
    blank = F.struct(F.array().cast("array<string>").alias("title"), F.array().cast("array<string>").alias("doi"))
    docs = F.concat(F.when(place > 0, F.array_repeat(blank, place)).otherwise(F.array().cast("array<struct<title:array<string>,doi:array<string>>>")), F.array(doc))
    responses = table(spark, sf, "part").select(F.col("p_brand").alias("service"), F.to_json(F.struct(F.struct(F.lit(1).alias("numFound"), docs.alias("docs")).alias("response"))).alias("json"))
    return readers.solr_docs(responses).withColumn("list_index", F.col("list_index").cast("long"))


@query("html_links", f"""SELECT page_id, unnest(range(len(a)))::INT AS place, unnest(a) AS href, unnest(b) AS label FROM (SELECT page_id, regexp_extract_all(html, '{rx.LINK_ITEM}', 1) AS a, regexp_extract_all(html, '{rx.LINK_ITEM}', 2) AS b FROM pages)""")
def html_links(spark, sf):
    return readers.html_links(table(spark, sf, "pages"))


def _records(spark, sf):
    p = dealt(table(spark, sf, "part"))
    esc = lambda c: strings.xml_escape(F.col(c).cast("string"))
    body = ["<r><Body>", "p_type", "</Body><dc:title xmlns:dc='x'>", "p_name", "</dc:title><dc:creator xmlns:dc='x'>", "p_brand", "</dc:creator><dc:subject xmlns:dc='x'>s1</dc:subject><dc:subject xmlns:dc='x'>", "p_size", "</dc:subject><dc:language xmlns:dc='x'>deu</dc:language></r>"]
    xml = F.concat(*[esc(b) if b.startswith("p_") else F.lit(b) for b in body])
    return p.select(F.concat(F.lit("dir/"), F.col("p_partkey").cast("string"), F.lit(".xml")).alias("file_name"), xml.alias("xml"))


@query("xml_metadata", "SELECT p_partkey::VARCHAR AS file_stem, p_name AS name, 'de' AS language, p_brand AS authors, 's1;' || p_size AS subjects FROM part")
def xml_metadata(spark, sf):
    r = readers.metadata_records(_records(spark, sf))
    return r.select("file_stem", "name", "language", F.array_join("authors", ";").alias("authors"), F.array_join("subjects", ";").alias("subjects"))


@query("xml_body", "SELECT 'dir/' || p_partkey || '.xml' AS file_name, p_type AS text FROM part")
def xml_body(spark, sf):
    return readers.body_text(_records(spark, sf))


@query("annotations_parse", """SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::INT AS pos, f || l_linenumber AS word,
 CASE WHEN l_linenumber % 3 = 0 THEN 'none' ELSE 'title' END AS label FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)""")
def annotations_parse(spark, sf):
    n = F.col("l_linenumber")
    text = F.concat(F.lit("1-"), n.cast("string"), F.lit("\t"), "l_returnflag", n.cast("string"), F.when(n % 3 == 0, F.lit("\t_")).when(n % 3 == 1, F.lit("\ttitle[1]\tx")).otherwise(F.lit("\ttitle")))
    lines = _one_each(spark, sf).select(F.col("l_orderkey").alias("doc_id"), n.alias("line_no"), text.alias("text"))
    heads = lines.select("doc_id").distinct().select("doc_id", F.lit(0).alias("line_no"), F.lit("#id=1").alias("text"))
    return readers.annotations(lines.unionByName(heads))


# ------------------------------------------------------------------ entities and links

_REFS = """refs AS (SELECT p_partkey AS doc_id, 'ref' || p_partkey AS ref_id, 'in the ' || (1990 + p_size % 20) || ' wave of ' AS left_text, p_name || CASE WHEN p_size % 3 = 0 THEN ' ' || (1990 + p_size % 15) ELSE '' END AS reference,
 ' see 10.' || (4000 + p_size) || '/' || p_partkey || ' x' AS right_text, 0.5 + (p_size % 5) / 10.0 AS reliability FROM part)"""


def _refs(spark, sf):
    p = table(spark, sf, "part")
    n = lambda c: c.cast("string")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("doc_id"), F.concat(F.lit("ref"), n(F.col("p_partkey"))).alias("ref_id"), F.concat(F.lit("in the "), n(F.lit(1990) + size % 20), F.lit(" wave of ")).alias("left_text"),
        F.concat("p_name", F.when(size % 3 == 0, F.concat(F.lit(" "), n(F.lit(1990) + size % 15))).otherwise("")).alias("reference"),
        F.concat(F.lit(" see 10."), n(F.lit(4000) + size), F.lit("/"), n(F.col("p_partkey")), F.lit(" x")).alias("right_text"), (F.lit(0.5) + (size % 5) / 10.0).alias("reliability"),
    )


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(reference, '\d', '', 'g'), '[[:punct:]]+', ' ', 'g'), '\s+', ' ', 'g'))"
_INFO = f"list_filter(list_concat(regexp_extract_all(reference, '{_N}'), list_concat(regexp_extract_all(right_text, '{_N}'), regexp_extract_all(left_text, '{_N}'))), lambda x: NOT regexp_matches(x, '{rx.DOI}'))"


@query("metadata_entities", f"""WITH {_REFS}, m AS (SELECT *, {_INFO} AS m FROM refs)
SELECT ref_id, {_CLEAN} AS name, array_to_string({_SORTED}, '|') AS numeric_info, nullif(trim(regexp_extract(right_text, '{rx.DOI}')), '') AS identifier, round(reliability * 0.7, 6) AS entity_reliability FROM m""")
def metadata_entities(spark, sf):
    e = link.metadata_entities(_refs(spark, sf))
    return e.select("ref_id", "name", F.array_join("numeric_info", "|").alias("numeric_info"), "identifier", F.round("entity_reliability", 6).alias("entity_reliability"))


# entities are nations' regions with a year; the catalogue has part names under two services
_ENTITIES = """ent AS (SELECT p_partkey AS id, 'e' || p_partkey AS entity_id, p_name AS name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (1990 + p_size % 20)::VARCHAR END AS year, '10.5/' || (p_partkey + 1) AS identifier FROM part),
cat AS (SELECT DISTINCT '10.5/' || p_partkey AS identifier, p_name || ' survey ' || CASE WHEN p_size % 2 = 0 THEN (1990 + p_size % 20)::VARCHAR ELSE '' END AS title,
 CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS service, CASE WHEN p_size % 2 = 0 THEN 0.8 ELSE 0.6 END AS rel, CASE WHEN p_size % 2 = 0 THEN (1990 + p_size % 20)::VARCHAR END AS ty FROM part)"""


def _entities(spark, sf):
    p = table(spark, sf, "part")
    year = (F.lit(1990) + F.col("p_size") % 20).cast("string")
    return p.select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(year)).alias("numeric_info"),
        F.concat(F.lit("10.5/"), (F.col("p_partkey") + 1).cast("string")).alias("identifier"), F.array(F.col("p_brand")).alias("tags"),
    )


def _catalogue(spark, sf):
    p, even = table(spark, sf, "part"), F.col("p_size") % 2 == 0
    year = (F.lit(1990) + F.col("p_size") % 20).cast("string")
    return p.select(F.concat(F.lit("10.5/"), F.col("p_partkey").cast("string")).alias("identifier"), F.concat("p_name", F.lit(" survey "), F.when(even, year).otherwise("")).alias("title"), F.when(even, "a").otherwise("b").alias("service"))


def _services(spark):
    return spark.createDataFrame([("a", 0.8), ("b", 0.6)], "service string, service_reliability double")


_HITS = rf"""{_ENTITIES},
q AS (SELECT DISTINCT name AS query, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS ws FROM ent),
c AS (SELECT *, list_distinct(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+')) AS ts FROM cat),
h AS (SELECT query, identifier, title, service, rel, ty, row_number() OVER (PARTITION BY query, service ORDER BY identifier) - 1 AS list_index FROM q JOIN c ON list_has_all(ts, ws)),
s AS (SELECT *, max(list_index) OVER (PARTITION BY query, service) AS last FROM h),
n AS (SELECT entity_id, s.identifier, title, service, rel, list_index, last, CASE WHEN ty IS NULL THEN 0.5 WHEN year IS NULL THEN 0.7 WHEN year = ty THEN 1.0 ELSE 0.0 END AS number_score,
 CASE WHEN ty IS NULL THEN CASE WHEN year IS NULL THEN 'same_as_temporal' ELSE 'part_of_temporal' END WHEN year IS NULL THEN 'superset_of_temporal' WHEN year = ty THEN 'same_as_temporal' ELSE '' END AS relations
 FROM ent JOIN s ON ent.name = s.query)"""


@query("search_result_scores", f"WITH {_HITS} SELECT entity_id, identifier, round(number_score, 6) AS number_score, round((number_score + rel + 1 - list_index / (last + 1)) / 3, 6) AS score, relations FROM n")
def search_result_scores(spark, sf):
    e = _entities(spark, sf)
    s = link.score_candidates(e, link.catalogue_search(e, _catalogue(spark, sf), most=None), _services(spark), (1, 1, 1))
    return s.select("entity_id", "identifier", F.round("number_score", 6).alias("number_score"), F.round("score", 6).alias("score"), F.array_join("relations", ",").alias("relations"))


def _link_rows(df):
    return df.select("entity_id", "identifier", F.array_join("relations", ",").alias("relations"), F.round("confidence", 6).alias("confidence"))


def _multi_links(spark, sf, entities):
    """Every hit, as the SQL has it: no service's page ends the list."""
    return link.multi_match_links(entities, _catalogue(spark, sf), _services(spark), most=None)


_MULTI = "m AS (SELECT entity_id, identifier, relations, round((number_score + rel) / 2, 6) AS confidence FROM n WHERE (number_score + rel) / 2 >= 0.55)"


@query("multi_match_links", f"WITH {_HITS}, {_MULTI} SELECT * FROM m")
def multi_match_links(spark, sf):
    return _link_rows(_multi_links(spark, sf, _entities(spark, sf)))


@query("best_match_links", f"""WITH {_HITS}, f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rel DESC, service, identifier) AS k FROM n WHERE list_index = 0)
SELECT entity_id, identifier, 'unknown' AS relations, round((rel + 1) / 2, 6) AS confidence FROM f WHERE k = 1""")
def best_match_links(spark, sf):
    return _link_rows(link.best_match_links(_entities(spark, sf), _catalogue(spark, sf), _services(spark)))


@query("doi_links", f"WITH {_ENTITIES} SELECT entity_id, cat.identifier, 'unknown' AS relations, round((rel + 1) / 2, 6) AS confidence FROM ent JOIN cat USING (identifier)")
def doi_links(spark, sf):
    return _link_rows(link.doi_links(_entities(spark, sf), _catalogue(spark, sf), _services(spark)))


@query("ontology_links", f"""WITH {_HITS}, {_MULTI}, o AS (SELECT 'dataset_' || translate('10.5/' || p_partkey, '/.', '') AS k FROM part)
SELECT * FROM m UNION ALL SELECT identifier, k, 'same_as', 1.0 FROM (SELECT DISTINCT identifier FROM m) JOIN o ON k = 'dataset_' || translate(identifier, '/.', '')""")
def ontology_links(spark, sf):
    """What is linked depends on names and numeric mentions alone, so one entity of each tells the targets."""
    e = _entities(spark, sf)
    targets = _multi_links(spark, sf, e.dropDuplicates(["name", "numeric_info"]))
    ontology = table(spark, sf, "part").select(strings.ontology_key(F.concat(F.lit("10.5/"), F.col("p_partkey").cast("string"))).alias("entity_id"))
    return _link_rows(link.ontology_links(_multi_links(spark, sf, e), ontology, targets))


@query("gold_links", f"""WITH {_HITS}, {_MULTI}, g AS (SELECT 'g' || p_partkey AS gid, p_name AS gname, p_brand AS gtag, (1990 + p_size % 15)::VARCHAR AS gyear FROM part),
t AS (SELECT ent.*, p_brand AS tag FROM ent JOIN part ON p_partkey = id), x AS (SELECT entity_id, gid FROM t JOIN g ON name = gname AND tag = gtag AND year = gyear)
SELECT entity_id, gid AS identifier, 'same_as' AS relations, 1.0::DOUBLE AS confidence FROM x UNION ALL SELECT * FROM m WHERE entity_id NOT IN (SELECT entity_id FROM x)""")
def gold_links(spark, sf):
    e = _entities(spark, sf)
    year = (F.lit(1990) + F.col("p_size") % 15).cast("string")
    gold = table(spark, sf, "part").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("tags"), F.array(year).alias("numeric_info"))
    return _link_rows(link.gold_links(e, gold, lambda rest: _multi_links(spark, sf, rest)))


@query("link_csv", rf"""WITH {_REFS}, e AS (SELECT 'p' || p_partkey AS id, greatest(p_partkey - 1, 1) AS k, p_name AS name, '10.5/' || p_partkey || ';x' AS ids, CASE WHEN p_size % 2 = 0 THEN (1990 + p_size)::VARCHAR ELSE ' ' END AS nums, p_partkey FROM part)
SELECT 'l' || a.p_partkey AS link_id, a.ids || '|' || a.name || '|' || doc_id || '|' || b.ids || '|' || b.name || '|' || b.nums || '|' || left_text || '**[  ' || reference || '  ]**' || right_text AS line
FROM e a JOIN e b ON b.p_partkey = a.k JOIN refs ON doc_id = a.p_partkey""")
def link_csv(spark, sf):
    p = table(spark, sf, "part")
    s = lambda c: c.cast("string")
    key = s(F.col("p_partkey"))
    entities = p.select(F.concat(F.lit("p"), key).alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("10.5/"), key), F.lit("x")).alias("identifiers"), F.when(F.col("p_size") % 2 == 0, F.array(s(F.lit(1990) + F.col("p_size")))).otherwise(F.array().cast("array<string>")).alias("numeric_info"))
    links = p.select(F.concat(F.lit("l"), key).alias("link_id"), F.concat(F.lit("p"), key).alias("from_entity"), F.concat(F.lit("p"), s(F.greatest(F.col("p_partkey") - 1, F.lit(1)))).alias("to_entity"), F.concat(F.lit("ref"), key).alias("link_reason"))
    return sinks.link_lines(links, entities, _refs(spark, sf))


@query("context_xml", f"WITH {_REFS} SELECT '<context reference=\"' || reference || '\" textFile=\"' || doc_id || '\"><leftContext>' || left_text || '</leftContext><rightContext>' || right_text || '</rightContext></context>' AS value FROM refs")
def context_xml(spark, sf):
    return sinks.context_xml(_refs(spark, sf))


@query("upsert", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def upsert(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return sinks.upsert(n, n.where("n_nationkey % 3 = 0").select("n_nationkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")), "n_nationkey")


@query("intersection_eval", """WITH f AS (SELECT source AS v, count(*) AS f FROM documents JOIN labels USING (doc_id) GROUP BY source), g AS (SELECT source AS v, count(*) AS g FROM documents WHERE lang = 'en' GROUP BY source),
s AS (SELECT sum(least(coalesce(f, 0), coalesce(g, 0))) AS b, sum(coalesce(f, 0)) AS nf, sum(coalesce(g, 0)) AS ng FROM f FULL JOIN g USING (v))
SELECT round((b / nf)::DOUBLE, 6) AS precision, round((b / ng)::DOUBLE, 6) AS recall, round((2 * (b / nf) * (b / ng) / (b / nf + b / ng))::DOUBLE, 6) AS f1 FROM s""")
def intersection_eval(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    found = link.precision_recall(docs.join(table(spark, sf, "labels"), "doc_id"), docs.where("lang = 'en'"), "source")
    return found.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("distinct_union_diff", f"WITH {PASSAGES} SELECT DISTINCT text FROM p WHERE text NOT IN (SELECT text FROM benchmark) UNION SELECT text FROM benchmark")
def distinct_union_diff(spark, sf):
    lines, items = _lines(spark, sf).select("text"), table(spark, sf, "benchmark")
    return lines.join(items.select("text"), "text", "left_anti").union(items.select("text")).distinct()


@query("keyword_top5", r"""WITH e AS (SELECT DISTINCT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS w FROM part),
t AS (SELECT DISTINCT label, unnest(list_distinct(list_filter(regexp_split_to_array(lower(label), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS w FROM (SELECT DISTINCT p_type AS label FROM part)),
n AS (SELECT p_partkey, count(*) AS n FROM e GROUP BY 1), m AS (SELECT label, count(*) AS m FROM t GROUP BY 1), b AS (SELECT p_partkey, label, count(*) AS b FROM e JOIN t USING (w) GROUP BY 1, 2),
s AS (SELECT p_partkey, label, b / (n + m - b) AS score FROM b JOIN n USING (p_partkey) JOIN m USING (label)), r AS (SELECT *, (row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, label))::INT AS rank FROM s)
SELECT p_partkey AS entity_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def keyword_top5(spark, sf):
    p = table(spark, sf, "part")
    entities = dealt(p.select("p_partkey", "p_name", "p_type")).select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", "p_type").alias("abstract"))
    found = link.keywords(entities, p.select(F.col("p_type").alias("label")).distinct())
    return found.select("entity_id", "label", F.round("score", 6).alias("score"), "rank")


# ------------------------------------------------------------------ induction and learning

_SEEDED = f"""WITH {PASSAGES}, s(seed) AS (VALUES {_sql_list(LEARNER_SEEDS + ['MIT'])}),
c AS (SELECT doc_id, line_no, seed, string_split(text, seed) AS parts FROM p JOIN s ON list_contains({TOKENS}, seed)),
x AS (SELECT doc_id, line_no, seed, CASE WHEN coalesce(parts[1], '') = '' THEN ' ' ELSE parts[1] END AS left_text, CASE WHEN coalesce(parts[2], '') = '' THEN ' ' ELSE parts[2] END AS right_text FROM c),
w AS (SELECT doc_id, line_no, seed, list_reverse({_LEFT_WORDS}) AS lw, {_RIGHT_WORDS} AS rw FROM x),
v AS (SELECT *, list_transform(lw, lambda a: trim(regexp_replace(regexp_replace(regexp_replace(a, '{rx.PERCENT}', '*', 'g'), '{_N}', '*', 'g'), '{rx.PUNCTUATION}', '*', 'g'))) AS lp,
 list_transform(rw, lambda a: trim(regexp_replace(regexp_replace(regexp_replace(a, '{rx.PERCENT}', '*', 'g'), '{_N}', '*', 'g'), '{rx.PUNCTUATION}', '*', 'g'))) AS rp FROM w WHERE len(lw) >= 2 AND len(rw) >= 2),
k(rank, nl, nr, threshold) AS (VALUES (0, 1, 1, 0.25), (1, 2, 1, 0.23), (2, 1, 2, 0.23), (3, 3, 1, 0.21), (4, 1, 3, 0.21)),
i AS (SELECT doc_id, line_no, seed, rank, threshold, list_distinct(list_concat(lw[2:nl + 1], rw[2:nr + 1])) AS words, CASE WHEN len(lw) > nl AND len(rw) > nr THEN
 regexp_replace(regexp_replace(array_to_string(list_reverse(lp[2:nl + 1]), ' ') || lw[1] || '*' || rw[1] || array_to_string(rp[2:nr + 1], ' '), '^(\\*\\s)+', ''), '(\\s\\*)+$', '') END AS phrase,
 array_to_string(list_reverse(lw[2:nl + 1]), ' ') || '#' || lw[1] || '#' || rw[1] || '#' || array_to_string(rw[2:nr + 1], ' ') AS key FROM v CROSS JOIN k)"""


def _candidates(spark, sf):
    contexts = search.seed_contexts(_lines(spark, sf), _names(spark, LEARNER_SEEDS + ["MIT"], "seed"))
    return induce.induce(contexts, 3, 0.25)


@query("induce_patterns", _SEEDED + " SELECT doc_id, line_no, seed, rank::INT AS rank, phrase, round(threshold, 6)::DOUBLE AS threshold FROM i")
def induce_patterns(spark, sf):
    return _candidates(spark, sf).select("doc_id", "line_no", "seed", "rank", "phrase", F.round("threshold", 6).alias("threshold"))


@query("pattern_frequency", _SEEDED + ", n AS (SELECT count(*) AS n FROM i WHERE rank = 0), f AS (SELECT phrase, threshold, rank, count(*) AS c FROM i WHERE phrase IS NOT NULL GROUP BY ALL) SELECT phrase, rank::INT AS rank, sum(c)::BIGINT AS n, round((sum(c) / any_value(n.n)), 6) AS score FROM f, n GROUP BY phrase, rank")
def pattern_frequency(spark, sf):
    c = _candidates(spark, sf).where("phrase is not null")
    contexts = c.where("rank = 0").agg(F.count(F.lit(1)).alias("m"))
    return c.groupBy("phrase", "rank").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(contexts)).select("phrase", "rank", "n", F.round(F.col("n") / F.col("m"), 6).alias("score"))


def _frequency(strategy):
    def run(spark, sf):
        return bootstrap.frequency_bootstrap(_lines(spark, sf), LEARNER_SEEDS, strategy)

    return run


for _s in bootstrap.STRATEGIES:
    query(f"frequency_bootstrap_{_s}")(_frequency(_s))

_HANDFOUND = " UNION ALL ".join(f"SELECT doc_id, line_no, pattern, reference FROM ({ORACLES['pattern_search_validate']})" for _ in (0,))
_ASSOC = f"""WITH f AS ({_HANDFOUND}), j AS (SELECT reference AS instance, pattern, count(*) AS joint FROM f GROUP BY ALL), i AS (SELECT reference AS instance, count(*) AS ic FROM f GROUP BY 1), q AS (SELECT pattern, count(*) AS pc FROM f GROUP BY 1),
n AS (SELECT count(*) AS n FROM documents), a AS (SELECT instance, pattern, log2(joint * n.n::DOUBLE / (ic * pc)) AS pmi FROM j JOIN i USING (instance) JOIN q USING (pattern), n)"""


def _assoc(spark, sf):
    """The passages are searched once: counts of instances and of patterns are sums of the joint ones."""
    joint = cut(bootstrap.joint_counts(pattern_search_validate(spark, sf)), "joint-counts")
    n = table(spark, sf, "documents").count()
    i = joint.groupBy("instance").agg(F.sum("joint").alias("instance_count"))
    p = joint.groupBy("pattern").agg(F.sum("joint").alias("pattern_count"))
    return bootstrap.pmi(joint, i, p, n)


@query("pmi_scores", _ASSOC + " SELECT instance, pattern, round(pmi, 6) AS pmi FROM a")
def pmi_scores(spark, sf):
    return _assoc(spark, sf).select("instance", "pattern", F.round("pmi", 6).alias("pmi"))


@query("pattern_reliability_round1", _ASSOC + ", t AS (SELECT max(pmi) AS top FROM a) SELECT pattern, round(sum(pmi / top) / count(*), 6) AS reliability FROM a, t GROUP BY pattern")
def pattern_reliability_round1(spark, sf):
    a = _assoc(spark, sf)
    r = bootstrap.pattern_reliability(a, a.select("instance").distinct().withColumn("reliability", F.lit(1.0)))
    return r.select("pattern", F.round("reliability", 6).alias("reliability"))


@query("instance_reliability_round1", _ASSOC + ", t AS (SELECT max(pmi) AS top FROM a), r AS (SELECT pattern, sum(pmi / top) / count(*) AS rel FROM a, t GROUP BY pattern) SELECT instance, round(sum(pmi / top * rel) / count(*), 6) AS reliability FROM a JOIN r USING (pattern), t GROUP BY instance")
def instance_reliability_round1(spark, sf):
    a = _assoc(spark, sf)
    p = bootstrap.pattern_reliability(a, a.select("instance").distinct().withColumn("reliability", F.lit(1.0)))
    r = bootstrap.instance_reliability(a, p, _names(spark, ["no such seed"], "seed"))
    return r.select("instance", F.round("reliability", 6).alias("reliability"))


@query("topk_patterns", _ASSOC + ", t AS (SELECT max(pmi) AS top FROM a) SELECT pattern, round(sum(pmi / top) / count(*), 6) AS reliability FROM a, t GROUP BY pattern ORDER BY 2 DESC, 1 LIMIT 2")
def topk_patterns(spark, sf):
    a = _assoc(spark, sf)
    r = bootstrap.pattern_reliability(a, a.select("instance").distinct().withColumn("reliability", F.lit(1.0)))
    return bootstrap.top_patterns(r, 2).select("pattern", F.round("reliability", 6).alias("reliability"))


@query("reliability_bootstrap")
def reliability_bootstrap(spark, sf):
    return bootstrap.reliability_bootstrap(_lines(spark, sf), LEARNER_SEEDS)
