"""Scan and sink queries over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..registry import query
from ..session import shared_folder
from ..sources import files as S

ADAPTERS["versions"] = "SELECT concat('w', CAST(o_custkey % 300 AS STRING)) AS workbook, CAST(o_orderkey % 97 AS INT) AS version, o_orderstatus AS payload FROM orders"
ADAPTERS["inbox"] = """
    SELECT concat(CASE WHEN c_custkey % 20 = 0 THEN 'x' ELSE 'ORG' END, '-', CAST(c_custkey % 1200 AS STRING)) AS record_id, CASE c_custkey % 3 WHEN 0 THEN 'Approved' WHEN 1 THEN 'merged' ELSE 'draft' END AS status,
           concat('mail me@', c_name, '.org now') AS note, CASE WHEN c_custkey % 2 = 0 THEN CAST(45000 + c_custkey % 300 AS STRING) ELSE '2024-02-29' END AS day, CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS score,
           CASE WHEN c_custkey % 5 = 0 THEN 'Z' ELSE 'A' END AS tier, CASE WHEN c_custkey % 4 = 0 THEN 'file:///etc' WHEN c_custkey % 4 = 1 THEN concat('http://a.example.org, https://n', CAST(c_nationkey AS STRING), '.example.org/x http://a.example.org') ELSE concat('https://n', CAST(c_nationkey AS STRING), '.example.org/x') END AS url FROM customer"""
ADAPTERS["directory"] = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS org_type, CAST(c_nationkey AS STRING) AS country, concat(c_name, ' makes ', c_mktsegment, '. Founded long ago.') AS description FROM customer"


def folder(df, name):
    """A new folder of the shared one, for files that a query writes from the given tables and reads again."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"


@query("a3_read_name_list", "part", "SELECT trim(n) AS name FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN concat('  ', p_name, ', \"quoted\" ') WHEN 1 THEN '  ' ELSE p_name END AS n FROM part) WHERE trim(n) <> ''")
def a3(part):
    """The parts' names, some in quotes, some blank, as CSV files beside a number."""
    k, path = F.col("p_partkey") % 4, folder(part, "names")
    name = F.when(k == 0, F.concat(F.lit("  "), "p_name", F.lit(', "quoted" '))).when(k == 1, "  ").otherwise(F.col("p_name"))
    part.select("p_partkey", name.alias("name")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_name_list(part.sparkSession, path)


@query("a4_load_taxonomy", "part", """, t AS (SELECT p_name AS keyword, p_type AS branch, CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MED' WHEN 2 THEN 'LOW' ELSE 'NONE' END AS priority, concat('s', p_partkey) AS topic_slug, p_brand AS topic_name, CAST(p_size % 3 AS INT) AS topic_level FROM part)
SELECT *, CASE branch WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 99 END AS branch_rank, CASE priority WHEN 'HIGH' THEN 1 WHEN 'MED' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS priority_rank FROM t""")
def a4(part):
    """A taxonomy of the parts as JSON records."""
    path = folder(part, "taxonomy")
    priority = F.element_at(F.array(*map(F.lit, ("HIGH", "MED", "LOW", "NONE"))), (F.col("p_size") % 4 + 1).cast("int"))
    records = part.select(F.col("p_name").alias("keyword"), F.col("p_type").alias("branch"), priority.alias("priority"), F.concat(F.lit("s"), "p_partkey").alias("topic_slug"), F.col("p_brand").alias("topic_name"), (F.col("p_size") % 3).cast("int").alias("topic_level"))
    records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return S.load_taxonomy(part.sparkSession, path, ["ECONOMY", "PROMO"], lines=True)


#: Elements of a GraphML file. A file is read by one task, so its size must not grow with the input.
XML_ROWS = 100_000


def graph_xml(supplier, lineitem):
    """Suppliers and the parts that they deliver, written as GraphML elements and read as nodes and edges."""
    path = folder(supplier, "graph")
    pairs = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    data = lambda key, c: F.array(F.struct(F.lit(key).alias("_key"), F.col(c).cast("string").alias("_VALUE"))).alias("data")
    parts = {
        "key": supplier.sparkSession.createDataFrame([("d0", "node", "name"), ("d1", "edge", "lines")], "_id string, _for string, `_attr.name` string"), "node": supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("_id"), data("d0", "s_name")),
        "edge": pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("_source"), F.concat(F.lit("p"), "l_partkey").alias("_target"), data("d1", "n"))}
    for tag, rows in parts.items():
        rows.write.format("xml").option("rootTag", "graphml").option("rowTag", tag).option("maxRecordsPerFile", XML_ROWS).mode("append").save(path)
    return S.read_graph_xml(supplier.sparkSession, path)


@query("a8_graph_nodes", "supplier lineitem", "SELECT concat('s', s_suppkey) AS id, s_name AS name FROM supplier")
def a8(supplier, lineitem):
    return graph_xml(supplier, lineitem)[0].select("id", F.col("attrs")["name"].alias("name"))


@query("a8_graph_edges", "supplier lineitem", "SELECT concat('p', l_partkey) AS src, concat('s', l_suppkey) AS dst, CAST(count(*) AS VARCHAR) AS lines FROM lineitem GROUP BY l_partkey, l_suppkey")
def a8b(supplier, lineitem):
    return graph_xml(supplier, lineitem)[1].select("src", "dst", F.col("attrs")["lines"].alias("lines"))


@query("a5_abstract_from_inverted_index", "documents", "SELECT doc_id AS id, text AS abstract FROM documents WHERE text <> ''")
def a5(documents):
    return S.abstract_from_inverted_index(S.invert(documents.select(F.col("doc_id").alias("id"), "text"), "text"), "index")


@query("a6_flatten_publications", "papers", """SELECT CAST(id AS VARCHAR) AS external_id, 'given' AS provider, lower(doi) AS doi, coalesce(nullif(trim(name), ''), '(untitled)') AS name, year, journal, replace(authors, '; ', '; ') AS authors, 'c0; c1; c2; c3; c4; c5' AS concepts, citation_count, 'https://doi.org/' || doi AS url, abstract, 'article' AS kind FROM papers""")
def a6(papers):
    record = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("name").alias("title"), "year", F.struct(F.col("journal").alias("title")).alias("journal"), F.transform(F.split("authors", "; "), lambda a: F.struct(a.alias("name"))).alias("authors"),
                                F.array(*[F.lit(f"c{i}") for i in range(9)]).alias("concepts"), F.col("citation_count").alias("times_cited"), "abstract", F.lit("article").alias("type")))
    return S.flatten_publications(papers.select(record.alias("j")), "j", "given")


#: The batch in order: each row stands unless one of its keys is known or was taken by a row that stands.
_A7 = """, b AS (SELECT id AS pos, search_query, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN '' ELSE concat('d', id * 3 % 400) END AS doi, CASE WHEN id % 5 = 0 THEN NULL ELSE concat('e', id % 700) END AS external_id FROM papers), x AS (SELECT * FROM b WHERE pos % 9 = 0),
n AS (SELECT *, row_number() OVER (ORDER BY pos) AS i, list_filter([CASE WHEN doi <> '' THEN 'doi:' || doi END, CASE WHEN external_id <> '' THEN 'ext:' || external_id END], lambda k: k IS NOT NULL) AS ks FROM b),
k AS (SELECT list(k) AS known FROM (SELECT 'doi:' || doi AS k FROM x WHERE doi <> '' UNION SELECT 'ext:' || external_id FROM x WHERE external_id <> '')),
g AS (SELECT 0::BIGINT AS i, known AS seen, NULL::BIGINT AS stands FROM k UNION ALL SELECT n.i, CASE WHEN list_has_any(seen, ks) THEN seen ELSE list_concat(seen, ks) END, CASE WHEN NOT list_has_any(seen, ks) THEN pos END FROM g JOIN n ON n.i = g.i + 1)"""


def batch_of(papers):
    k = F.col("id")
    return papers.select(k.alias("pos"), "search_query", F.when(k % 6 == 1, "").when(k % 6 > 0, F.concat(F.lit("d"), k * 3 % 400)).alias("doi"), F.when(k % 5 > 0, F.concat(F.lit("e"), k % 700)).alias("external_id"))


def ingested(papers):
    batch = batch_of(papers)
    return S.ingest_new(batch, batch.where("pos % 9 = 0"), ["doi", "external_id"])


@query("a7_topic_links", "papers topics", f"{_A7} SELECT pos, t.id AS topic_id FROM g JOIN b ON pos = stands JOIN topics t ON t.id % 4 = CASE search_query WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END")
def a7b(papers, topics):
    langs = papers.select("search_query").distinct().withColumn("slot", F.when(F.col("search_query") == "en", 0).when(F.col("search_query") == "de", 1).when(F.col("search_query") == "fr", 2).otherwise(3))
    queries = langs.join(F.broadcast(topics.select(F.col("id").alias("topic_id"))), F.col("topic_id") % 4 == F.col("slot")).select("search_query", "topic_id")
    return S.topic_links(ingested(papers), queries)


@query("a7_ingest_new", "papers", f"{_A7} SELECT b.* FROM b JOIN g ON stands = pos")
def a7(papers):
    return ingested(papers)


@query("a9_extract_body", "pages")
def a9(pages):
    return S.extract_body(pages)


@query("a11_reconcile_import", "embeddings paper_molecules molecules", """, e AS (SELECT DISTINCT id + 3 AS id FROM molecules), i AS (SELECT DISTINCT vec_id AS id FROM embeddings), n AS (SELECT source_id AS id FROM paper_molecules UNION SELECT molecule_id FROM paper_molecules)
SELECT 'items_without_entity' AS "check", count(*) AS n FROM i WHERE id NOT IN (FROM e) UNION ALL SELECT 'entities_without_item', count(*) FROM e WHERE id NOT IN (FROM i) UNION ALL SELECT 'dangling_ends', count(*) FROM n WHERE id NOT IN (FROM e) UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'items', count(*) FROM i""")
def a11(embeddings, links, molecules):
    return S.reconcile_import(molecules.select((F.col("id") + 3).alias("id")), links.select(F.col("source_id").alias("src"), F.col("molecule_id").alias("dst")), embeddings.select(F.col("vec_id").alias("id")))


@query("a11_reconcile_evidence", "embeddings paper_molecules molecules documents", """, e AS (SELECT DISTINCT id FROM molecules), i AS (SELECT DISTINCT vec_id AS id FROM embeddings), c AS (SELECT doc_id AS chunk_id, doc_id % 50 AS document_id FROM documents), ev AS (SELECT DISTINCT vec_id AS item, vec_id * 3 AS chunk_id FROM embeddings),
st AS (SELECT DISTINCT vec_id AS item, CASE WHEN vec_id % 5 = 0 THEN vec_id ELSE vec_id * 3 END AS chunk_id FROM embeddings), n AS (SELECT source_id AS id FROM paper_molecules UNION SELECT molecule_id FROM paper_molecules)
SELECT 'items_without_entity' AS "check", count(*) AS n FROM i WHERE id NOT IN (FROM e) UNION ALL SELECT 'entities_without_item', count(*) FROM e WHERE id NOT IN (FROM i) UNION ALL SELECT 'dangling_ends', count(*) FROM n WHERE id NOT IN (FROM e) UNION ALL SELECT 'entities', count(*) FROM e UNION ALL SELECT 'items', count(*) FROM i
UNION ALL SELECT 'dangling_chunks', count(*) FROM ev WHERE chunk_id NOT IN (SELECT chunk_id FROM c) UNION ALL SELECT 'chunks_outside_documents', count(*) FROM c WHERE document_id >= 40 UNION ALL SELECT 'evidence_not_stored', count(*) FROM (FROM ev EXCEPT FROM st) UNION ALL SELECT 'stored_without_evidence', count(*) FROM (FROM st EXCEPT FROM ev)
UNION ALL SELECT 'chunks', count(*) FROM c UNION ALL SELECT 'difference_entities', count(*) - 100 FROM e UNION ALL SELECT 'difference_chunks', count(*) - 5000 FROM c""")
def a11b(embeddings, links, molecules, documents):
    v = F.col("vec_id")
    chunks = documents.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 50).alias("document_id"))
    stored = embeddings.select(v.alias("item"), F.when(v % 5 == 0, v).otherwise(v * 3).alias("chunk_id"))
    return S.reconcile_import(molecules, links.select(F.col("source_id").alias("src"), F.col("molecule_id").alias("dst")), embeddings.select(v.alias("id")), chunks, chunks.where("document_id < 40"), embeddings.select(v.alias("item"), (v * 3).alias("chunk_id")), stored, {"entities": 100, "chunks": 5000})


@query("a12_csv_safe", "papers", r"""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN regexp_matches(n, '^[=+\-@\t\r]') THEN '''' || n ELSE n END AS name, coalesce(CAST(year AS VARCHAR), '') AS year, CASE WHEN is_review THEN 'true' WHEN NOT is_review THEN 'false' ELSE '' END AS is_review, coalesce(doi, '') AS doi, 'a; ' || journal AS lists, CASE WHEN doi IS NULL THEN '' ELSE 'https://doi.org/' || doi END AS doi_url FROM (SELECT *, CASE WHEN id % 7 = 0 THEN '=' || name WHEN id % 7 = 1 THEN '-' || name ELSE name END AS n FROM papers)""")
def a12(papers):
    k = F.col("id") % 7
    name = F.when(k == 0, F.concat(F.lit("="), "name")).when(k == 1, F.concat(F.lit("-"), "name")).otherwise(F.col("name"))
    return S.csv_safe(papers.select("id", name.alias("name"), "year", "is_review", "doi", F.array(F.lit("a"), F.col("journal")).alias("lists")))


@query("a13_export_jsonl", "events orders", """SELECT 'events' AS "table", concat('{"event_id":', event_id, ',"user_id":', user_id, ',"event_type":"', event_type, '"}') AS "row" FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'
UNION ALL SELECT 'orders', concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '"}') FROM orders WHERE o_orderdate >= TIMESTAMP '2024-01-05' AND o_orderdate < TIMESTAMP '2024-01-12'""")
def a13(events, orders):
    out = S.export_jsonl({"events": (events.select("event_id", "user_id", "event_type", "ts"), "ts"), "orders": (orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderdate")}, "2024-01-05", "2024-01-11", "2024-02-01")
    return out.withColumn("row", F.regexp_replace("row", r',"(ts|o_orderdate)":"[^"]*"', ""))


@query("a15_manifest", "orders supplier events", "SELECT 'events' AS \"table\", count(*) AS rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier")
def a15(orders, supplier, events):
    return S.manifest({"orders": orders, "supplier": supplier, "events": events}).drop("digest")


@query("a16_published", "orders supplier", "SELECT 'orders' AS \"table\", count(*) AS rows, 'same' AS again FROM orders UNION ALL SELECT 'supplier', count(*), 'same' FROM supplier")
def a16b(orders, supplier):
    """Both tables published twice as version 1 and read back."""
    spark = orders.sparkSession
    base = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    again = {}
    for name, df in (("orders", orders), ("supplier", supplier)):
        S.publish(df, f"{base}/{name}", 1)
        again[name] = S.publish(df, f"{base}/{name}", 1)
    told = F.create_map(*[F.lit(x) for kv in again.items() for x in kv])
    return S.manifest({name: S.current(spark, f"{base}/{name}") for name in again}).select("table", "rows", told[F.col("table")].alias("again"))


@query("a16_publish_if_newer", "versions", ", p AS (SELECT workbook, version, count(DISTINCT payload) AS n, min(payload) AS payload, row_number() OVER (PARTITION BY workbook ORDER BY version DESC) AS k FROM versions GROUP BY 1, 2) SELECT workbook, version, CASE WHEN n = 1 THEN payload END AS payload, n > 1 AS conflict FROM p WHERE k = 1")
def a16(versions):
    return S.publish_if_newer(versions)


@query("h6_validate_matches", "directory orders", """, m AS (SELECT o_custkey * 2 AS id, min(o_orderkey) AS pos FROM orders GROUP BY 1) SELECT d.id, name, CASE WHEN pos % 2 = 0 THEN 'makes ' || org_type ELSE split_part(description, '.', 1) END AS evidence, pos FROM m JOIN directory d USING (id) WHERE org_type = 'MACHINERY'""")
def h6(directory, orders):
    k = F.col("o_orderkey")
    matches = orders.select((F.col("o_custkey") * 2).alias("id"), k.alias("pos"), F.when(k % 2 == 0, "makes MACHINERY").otherwise("invented").alias("evidence"))
    return S.validate_matches(matches, directory, "MACHINERY")


@query("h7_reviewed_records", "inbox", r""", k AS (SELECT * FROM inbox WHERE lower(status) IN ('approved', 'merged') AND regexp_matches(record_id, '^[A-Z]+-[0-9]+$')), o AS (SELECT record_id FROM k GROUP BY 1 HAVING count(*) = 1)
SELECT record_id, regexp_replace(note, '\S+@\S+', '[e-mail]', 'g') AS note, CASE WHEN regexp_matches(day, '^[0-9]+$') THEN DATE '1899-12-30' + try_cast(day AS INT) ELSE try_cast(day AS DATE) END AS day, coalesce(try_cast(score AS DOUBLE), 0) AS score, CASE WHEN tier IN ('A','B','C') THEN tier END AS tier, CASE WHEN url LIKE 'http://a.%' THEN 'http://a.example.org' WHEN url LIKE 'http%' THEN url END AS url, CASE WHEN url LIKE 'http://a.%' THEN replace(replace(url, ' http://a.example.org', ''), ', ', '|') WHEN url LIKE 'http%' THEN url ELSE '' END AS evidence FROM k JOIN o USING (record_id)""")
def h7(inbox):
    return S.reviewed_records(inbox)
