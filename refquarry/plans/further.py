"""Further registered queries: repositories, gold links, datasets, preparation plans and reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from refquarry.functions import rx, strings
from refquarry.operators import federate, link, search, textprep
from refquarry.plans import pipelines, runner
from refquarry.plans.catalogue import _PART_TEXT, _papers, query
from refquarry.sources import readers
from refquarry.sources.tables import dealt, table

CONNECTORS = [
    federate.Connector("portal", 0.8, "portal", ("title",), 600),
    federate.Connector("solr", 0.8, "solr", ("numericInfoInTitle", "doi")),
    federate.Connector("datacite", 0.6, "datacite", ("title", "publicationDate", "doi")),
]


def _s(*parts):
    """Text of constants (after =) and columns."""
    return F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts])


# ------------------------------------------------------------------ repositories

_Q = "replace(p_name, ' ', '%20')"


@query("federated_queries", f"""WITH e AS (SELECT 'e' || p_partkey AS entity_id, {_Q} AS q, (1990 + p_size)::VARCHAR AS y, '10.5%2F' || p_partkey AS d FROM part)
SELECT entity_id, 'portal' AS service, '?q=title:' || q || '+resourceType:Dataset&lang=en&mdlang=de&max=600' AS query FROM e
UNION ALL SELECT entity_id, 'solr', 'select/?q=title:"' || q || '%20' || y || '"+doi:"' || d || '"+resourceType:Dataset&start=0&rows=1000&fl=doi,title&wt=json' FROM e
UNION ALL SELECT entity_id, 'datacite', '?query=title:"' || q || '"%20AND%20doi:"' || d || '"%20AND%20type:"dataset"&start=0&rows=1000&sort=score&order=desc' FROM e""")
def federated_queries(spark, sf):
    e = table(spark, sf, "part").select(_s("=e", "p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array((F.lit(1990) + F.col("p_size")).cast("string")).alias("numeric_info"), F.lit("1999").alias("publication_date"), _s("=10.5/", "p_partkey").alias("identifier"))
    return federate.build_queries(e, CONNECTORS)


@query("federated_search", """WITH q AS (SELECT 'e' || p_partkey AS entity_id, s AS service, p_name AS query FROM part, (VALUES ('a'), ('b')) t(s)),
c AS (SELECT CASE WHEN p_retailprice < 1400 THEN 'a' ELSE 'b' END AS service, p_name AS query, p_name AS title, '10.5/' || p_partkey AS identifier, row_number() OVER (PARTITION BY 1, p_name, p_retailprice < 1400 ORDER BY p_partkey) - 1 AS list_index FROM part)
SELECT entity_id, service, query, list_index, title, identifier FROM q JOIN c USING (service, query)""")
def federated_search(spark, sf):
    """One repository's answers stand in the cache, the other is asked."""
    p = table(spark, sf, "part")
    place = F.row_number().over(federate_window()) - 1
    answers = p.withColumn("service", F.when(F.col("p_retailprice") < 1400, "a").otherwise("b")).select("service", F.col("p_name").alias("query"), place.cast("long").alias("list_index"), F.col("p_name").alias("title"), _s("=10.5/", "p_partkey").alias("identifier"))
    queries = p.select(_s("=e", "p_partkey").alias("entity_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("service"), F.col("p_name").alias("query"))
    results, _ = federate.federated_search(queries, answers.where("service = 'a'"), lambda missing: missing.join(answers, ["service", "query"]))
    return results


def federate_window():
    from pyspark.sql import Window

    return Window.partitionBy("service", "p_name").orderBy("p_partkey")


@query("query_cache_lines", "SELECT p_brand || '@@@' || string_agg('10.5/' || p_partkey, '!!!' ORDER BY p_partkey) AS line FROM part GROUP BY p_brand")
def query_cache_lines(spark, sf):
    return federate.cache_lines(table(spark, sf, "part").select(F.lit("a").alias("service"), F.col("p_brand").alias("query"), F.col("p_partkey").alias("list_index"), _s("=10.5/", "p_partkey").alias("identifier")))


@query("datacite_responses", "SELECT p_brand AS service, 1::INT AS list_index, p_name AS title, '10.1/' || p_partkey AS identifier FROM part")
def datacite_responses(spark, sf):
    """Each response begins with an incomplete record, which is skipped."""
    record = lambda doi, title: F.struct(F.struct(doi.alias("doi"), F.lit(None).cast("string").alias("title"), F.array(F.struct(title.alias("title"))).alias("titles")).alias("attributes"))
    data = F.array(record(F.lit(""), F.col("p_type")), record(_s("=10.1/", "p_partkey"), F.col("p_name")))
    return readers.datacite_docs(table(spark, sf, "part").select(F.col("p_brand").alias("service"), F.to_json(F.struct(data.alias("data"))).alias("json")))


@query("enumeration_parts", "SELECT p_partkey AS entity_id, trim(unnest(string_split(p_type || ', ' || p_brand, ','))) AS name FROM part")
def enumeration_parts(spark, sf):
    return federate.parts_of_enumerations(table(spark, sf, "part").select(F.col("p_partkey").alias("entity_id"), F.concat("p_type", F.lit(", "), "p_brand").alias("name")))


@query("external_names", r"""WITH e AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS entity_id FROM part), n AS (SELECT p_name AS name, '10.5/' || p_partkey AS identifier, regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+') AS ws FROM part)
SELECT DISTINCT entity_id, identifier FROM e JOIN n ON list_contains(ws, lower(entity_id))""")
def external_names(spark, sf):
    p = table(spark, sf, "part")
    first = F.get(F.split("p_name", " "), F.lit(0))
    return federate.external_names(p.select(first.alias("entity_id"), first.alias("name")).distinct(), p.select(F.col("p_name").alias("name"), _s("=10.5/", "p_partkey").alias("identifier")))


# ------------------------------------------------------------------ links

@query("gold_outgoing_links", """SELECT 'e' || a.p_partkey AS entity_id, 'd' || b.p_partkey AS identifier, 'references' AS relations, 0.5::DOUBLE AS confidence
FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand WHERE b.p_retailprice < 1500""")
def gold_outgoing_links(spark, sf):
    p = table(spark, sf, "part")
    same = tuple(p.select(_s(f"={letter}", "p_partkey").alias(column), "p_name", "p_brand") for letter, column in (("e", "entity_id"), ("g", "identifier")))
    gold = p.select(_s("=g", "p_partkey").alias("entity_id"), F.array("p_brand").alias("tags"))
    tag = F.when(F.col("p_retailprice") < 1500, F.col("p_brand")).otherwise("elsewhere")
    onwards = p.select(_s("=g", "p_partkey").alias("from_entity"), _s("=d", "p_partkey").alias("to_entity"), F.array(F.lit("references")).alias("relations"), F.lit(0.5).alias("confidence"), F.array(tag).alias("tags"))
    found = link.outgoing_gold_links(same, gold, onwards)
    return found.select("entity_id", "identifier", F.array_join("relations", ",").alias("relations"), "confidence")


@query("dataset_entities", """WITH l AS (SELECT DISTINCT '10.5/' || p_size AS identifier, p_size, p_brand FROM part)
SELECT sha256('dataset|' || identifier) AS entity_id, 'Survey ' || (1990 + p_size) AS name, (1990 + p_size)::VARCHAR AS numeric_info, identifier, string_agg(p_brand, ',' ORDER BY p_brand) AS tags, 'dataset' AS entity_type FROM l GROUP BY identifier, p_size""")
def dataset_entities(spark, sf):
    p = table(spark, sf, "part")
    links = p.select(_s("=e", "p_partkey").alias("entity_id"), _s("=10.5/", "p_size").alias("identifier"), F.array(F.lit("unknown")).alias("relations"), F.lit(0.9).alias("confidence"))
    results = p.select(_s("=10.5/", "p_size").alias("identifier"), F.concat(F.lit("Survey "), (F.lit(1990) + F.col("p_size")).cast("string")).alias("title")).distinct()
    sources = p.select(_s("=e", "p_partkey").alias("entity_id"), F.array("p_brand").alias("tags"))
    entities, _ = link.dataset_entities(links, results, sources)
    return entities.withColumns({"numeric_info": F.array_join("numeric_info", ","), "tags": F.array_join("tags", ",")})


@query("imported_ontology_links", "SELECT 'e' || p_partkey AS entity_id, 'dataset_105' || p_partkey AS identifier, 'same_as' AS relations, 1.0::DOUBLE AS confidence FROM part WHERE p_retailprice < 1500")
def imported_ontology_links(spark, sf):
    ids = F.when(F.col("p_retailprice") < 1500, F.array(_s("=https://doi.org/10.5/", "p_partkey"), F.lit("x")))
    found = link.imported_ontology_links(table(spark, sf, "part").select(_s("=e", "p_partkey").alias("entity_id"), ids.alias("identifiers")))
    return found.withColumn("relations", F.array_join("relations", ","))


@query("text_metadata_join", "SELECT a.p_partkey AS doc_id, b.p_name AS name, 'de' AS language FROM part a LEFT JOIN part b ON a.p_partkey = b.p_partkey AND b.p_size < 40")
def text_metadata_join(spark, sf):
    p = table(spark, sf, "part")
    xml = F.concat(F.lit("<r><dc:title xmlns:dc='x'>"), strings.xml_escape(F.col("p_name")), F.lit("</dc:title><dc:language xmlns:dc='x'>deu</dc:language></r>"))
    records = readers.metadata_records(dealt(p.where("p_size < 40")).select(_s("=meta/", "p_partkey", "=.xml").alias("file_name"), xml.alias("xml")))
    files = p.select(F.col("p_partkey").alias("doc_id"), _s("=texts/", "p_partkey", "=.txt").alias("file_name"), F.col("p_type").alias("text"))
    return pipelines.text_and_metadata(files, records).select("doc_id", "name", F.coalesce("language", F.lit("de")).alias("language"))


# ------------------------------------------------------------------ preparation, reads and scalars

def _files(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "application/pdf").when(F.col("o_orderstatus") == "O", "text/plain")
    tag = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("BIB_REMOVED"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("TOKENIZED_STANFORD"))).when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("TOKENIZED_OPENNLP"))).otherwise(F.array().cast("array<string>"))
    return o.select("o_orderkey", kind.alias("media_type"), tag.alias("tags"))


@query("preprocessing_plan", """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 'extract' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'remove_bib' END,
 CASE WHEN o_orderpriority NOT IN ('2-HIGH', '5-LOW') THEN 'tokenize' END], lambda x: x IS NOT NULL), ',') AS steps, CASE WHEN o_orderpriority = '5-LOW' THEN 'tokenised another way' END AS warning FROM orders""")
def preprocessing_plan(spark, sf):
    return textprep.planned_steps(_files(spark, sf)).select("o_orderkey", F.array_join("steps", ",").alias("steps"), "warning")


@query("media_guard", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'FAILED' END AS status,
 CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'search does not take application/pdf' ELSE 'search does not take files of no type' END AS error FROM orders""")
def media_guard(spark, sf):
    fits, failed = textprep.media_guard(_files(spark, sf), "search")
    return fits.select("o_orderkey", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")).unionByName(failed.select("o_orderkey", "status", "error"))


@query("section_split_strict", """WITH l AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT doc_id, unnest(range(n // 2 + 1))::BIGINT AS section FROM l""")
def section_split_strict(spark, sf):
    return textprep.sections(_papers(spark, sf), 2, strict_compat=True).select("doc_id", "section")


@query("point_read", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def point_read(spark, sf):
    keys = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return readers.by_keys(table(spark, sf, "customer"), keys, "c_custkey").select("c_custkey", "c_name")


@query("content_paths", "SELECT p_partkey, '/store/' || md5(p_name) AS path, NULL::VARCHAR AS other FROM part")
def content_paths(spark, sf):
    return table(spark, sf, "part").select("p_partkey", strings.content_path("/store/", F.md5("p_name")).alias("path"), strings.content_path("/store", F.concat(F.lit("../"), "p_type")).alias("other"))


@query("gold_names", "SELECT DISTINCT n_name AS name FROM nation UNION SELECT DISTINCT r_name FROM region")
def gold_names(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" # "), F.col("n_regionkey").cast("string")).alias("value"))
    return readers.gold_names(lines.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("value"))).unionByName(table(spark, sf, "region").select(F.lit("# none").alias("value"))))


_DOI_CONTEXT = (rx.LEFT_CONTEXT + f"({rx.DOI})" + rx.RIGHT_CONTEXT).replace("'", "''")


@query("doi_contexts", f"""WITH t AS (SELECT p_partkey AS doc_id, {_PART_TEXT} || chr(10) || 'none here' AS text FROM part),
m AS (SELECT doc_id, regexp_extract_all(text, '{_DOI_CONTEXT}', 1) AS l, regexp_extract_all(text, '{_DOI_CONTEXT}', 2) AS t, regexp_extract_all(text, '{_DOI_CONTEXT}', 3) AS r FROM t)
SELECT doc_id, unnest(range(len(t)))::INT AS place, unnest(l) AS left_text, trim(unnest(t)) AS reference, unnest(r) AS right_text FROM m""")
def doi_contexts(spark, sf):
    text = F.concat(F.lit("see "), "p_name", F.lit(" doi 10."), (F.lit(4000) + F.col("p_size")).cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".x for details and "), "p_brand", F.lit("\nnone here"))
    return search.doi_contexts(table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


_ESCAPE = r"""regexp_replace({}, '([+\-!(){{}}\[\]^"~*?:\\/&|])', '\\\1', 'g')"""
_TWICE = _ESCAPE.format(_ESCAPE.format("trim(p_type || ' (' || p_brand || ')')"))


@query("escaped_queries", f"SELECT p_partkey, '\"' || {_TWICE} || '\"' AS query FROM part")
def escaped_queries(spark, sf):
    return table(spark, sf, "part").select("p_partkey", search.escaped_query(F.concat(F.lit(" "), "p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("query"))


@query("scalar_functions", """SELECT p_partkey, lower(p_type) || '/NN' AS tagged, p_size * 100 // 50 AS percent, CASE WHEN p_size < 25 THEN 2.0 ELSE 1.0 END::DOUBLE AS merged, p_type || p_name || p_brand AS plain FROM part""")
def scalar_functions(spark, sf):
    tagged = strings.lower_tagged(F.struct(F.col("p_type").alias("word"), F.lit("NN").alias("tag")))
    second = F.when(F.col("p_size") < 25, F.create_map(F.lit("k"), F.lit(2.0)))
    p = table(spark, sf, "part").withColumn("t", tagged)
    return p.select(
        "p_partkey", F.concat("t.word", F.lit("/"), "t.tag").alias("tagged"), strings.percent_done(F.col("p_size"), F.lit(50)).alias("percent"),
        strings.merged(F.create_map(F.lit("k"), F.lit(1.0)), second)["k"].alias("merged"), strings.plain_context(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("plain"),
    )


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return runner.status_counts(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))
