"""Knowledge graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..operators import graph as G
from ..registry import query
from ..session import checkpointed

#: Papers with all fields that names are looked for in.
ADAPTERS["mined_papers"] = """
    SELECT doc_id AS id, source AS name, CASE WHEN doc_id % 4 > 0 THEN lang ELSE '' END AS main_claim, text AS abstract, CASE WHEN doc_id % 3 = 0 THEN concat('hahahe|', lang) END AS compound_class, CASE WHEN doc_id % 5 = 0 THEN 'theron|estion' ELSE '' END AS sensory FROM documents"""
_MINE = r"""words AS (SELECT word, lead(word) OVER (PARTITION BY item_id ORDER BY i) AS next FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark)),
mined_names AS (SELECT DISTINCT trim(lower(word)) AS name FROM words UNION SELECT DISTINCT trim(lower(word || ' ' || next)) FROM words WHERE next IS NOT NULL),
blobs AS (SELECT id, lower(concat_ws(' ', nullif(name, ''), nullif(main_claim, ''), nullif(abstract, ''), nullif(replace(compound_class, '|', ' '), ''), nullif(replace(sensory, '|', ' '), ''))) AS text FROM mined_papers),
hits AS (SELECT id, name FROM blobs JOIN mined_names ON length(name) >= 6 AND NOT regexp_full_match(name, '[0-9]+') AND contains(text, name)
 AND CASE WHEN contains(text, name) THEN regexp_matches(text, '(^|[^a-z0-9])' || regexp_replace(name, '([.*+?^$|()\[\]{}\\])', '\\\1', 'g') || '($|[^a-z0-9])') ELSE false END)"""


def names_of(benchmark):
    """All words of all passages, and all pairs of neighbours."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    every = F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))
    return benchmark.select(F.explode(every).alias("name")).select(F.lower("name").alias("name")).distinct()


def mine_docs(documents):
    return documents.select(F.col("doc_id").alias("id"), "text")


def similar(edges, top=None, around=None):
    return G.jaccard_pairs(edges, "molecule_id", "odour_id", top=top, around=around)


_SIZE = "e AS (SELECT DISTINCT molecule_id AS m, odour_id AS o FROM molecule_odours), sz AS (SELECT m, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 2)"
_SIM = f"{_SIZE}, p AS (SELECT x.m AS a, y.m AS b, count(*) AS inter FROM e x JOIN e y ON x.o = y.o AND x.m < y.m GROUP BY 1, 2), sim AS (SELECT a, b, inter, round(inter / (s.n + t.n - inter), 3) AS jaccard FROM p JOIN sz s ON s.m = a JOIN sz t ON t.m = b WHERE inter >= 2 AND (inter / (s.n + t.n - inter) >= 0.34 OR inter >= 4))"


_MINABLE = r"""length(trim(name)) >= 5 AND lower(trim(name)) NOT IN ('water', 'oxygen', 'nitrogen', 'air', 'salt', 'sugar', 'acid', 'ester', 'ketone', 'alcohol', 'aldehyde', 'amine', 'protein', 'fat', 'oil', 'ash', 'gas', 'iron', 'heme', 'decline', 'increase', 'decrease', 'control',
 'response', 'sample', 'mixture', 'extract', 'residue', 'fraction', 'volatile', 'volatiles', 'compound', 'compounds', 'flavour', 'flavor', 'aroma', 'odour', 'odor', 'taste', 'texture', 'quality')
 AND (regexp_matches(name, '[0-9-]') OR regexp_matches(lower(trim(name)), '(ol|al|one|ene|ane|yne|ate|ide|ine|thiol|furan|pyrazine|pyrrole|acid|ester|aldehyde|phenol|lactone|amine|anol|enal|dienal)$'))"""
#: Parts under names that are chemical, general, junk or none of these.
ADAPTERS["named_parts"] = """
    SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'Water' WHEN 1 THEN ' Decline ' WHEN 2 THEN 'aroma' WHEN 3 THEN concat(p_name, ' hexanal') WHEN 4 THEN concat('2-', p_name) WHEN 5 THEN concat(p_name, ' Acid') WHEN 6 THEN 'urea' WHEN 7 THEN 'Amine' WHEN 8 THEN p_name ELSE concat(p_name, 'ine ') END AS name FROM part"""


@query("d1_minable_names", "named_parts", f"SELECT * FROM named_parts WHERE {_MINABLE}")
def d1(molecules):
    return G.minable_names(molecules)


@query("d1_minable_report", "named_parts", f"SELECT count(*) FILTER (WHERE {_MINABLE}) AS minable, count(*) - count(*) FILTER (WHERE {_MINABLE}) AS skipped, count(*) FILTER (WHERE lower(trim(name)) IN ('decline', 'aroma')) AS junk FROM named_parts")
def d1b(molecules):
    return G.minable_report(molecules)


@query("d2_mine_mentions", "documents benchmark")
def d2(documents, benchmark):
    return G.mine_mentions(mine_docs(documents), names_of(benchmark).where(F.length("name") >= 5))


@query("d3_mine_mentions_simple", "mined_papers benchmark", f", {_MINE} SELECT DISTINCT id, name FROM hits WHERE NOT (id % 5 = 0 AND length(name) % 2 = 0)")
def d3(papers, benchmark):
    names = names_of(benchmark)
    texts = G.searched_text(papers.withColumns({c: F.split(c, r"\|") for c in ("compound_class", "sensory")}))
    curated = G.mine_mentions_simple(texts.where("id % 5 = 0"), names.where("length(trim(name)) % 2 = 0"))
    return G.mine_mentions_simple(texts, names, curated)


@query("d4_bridge_edges", "paper_molecules lineitem", """, cur AS (SELECT DISTINCT l_orderkey AS source_id, l_partkey + l_linenumber % 2 AS molecule_id FROM lineitem), mined AS (SELECT * FROM paper_molecules)
SELECT *, 'curated' AS provenance FROM cur UNION ALL SELECT m.*, 'mined' FROM mined m ANTI JOIN cur USING (source_id, molecule_id)""")
def d4(links, lineitem):
    curated = lineitem.select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("molecule_id"))
    return G.bridge_edges(curated, links)


@query("d5_jaccard_pairs", "molecule_odours", f", {_SIM} SELECT * FROM sim ORDER BY inter DESC, jaccard DESC, a, b LIMIT 6000")
def d5(edges):
    return similar(edges, 6000)


@query("d6_match_reference", "compounds library", r""", k AS (SELECT regexp_replace(lower(compound), '[\s,''-]', '', 'g') AS key, entry_no, likely_process, row_number() OVER (PARTITION BY regexp_replace(lower(compound), '[\s,''-]', '', 'g') ORDER BY entry_no DESC) AS r FROM library)
SELECT c.*, entry_no, likely_process FROM compounds c LEFT JOIN k ON r = 1 AND key = regexp_replace(lower(name), '[\s,''-]', '', 'g')""")
def d6(compounds, library):
    return G.match_reference(compounds, library)


def facets():
    return {"venue": F.array("journal"), "lang": F.array("search_query"), "author": F.split("authors", ";"), "year": F.array(F.col("year").cast("string"))}




@query("d7_facet_index", "papers", """, v AS (SELECT id, 'venue' AS facet, journal AS value FROM papers UNION SELECT id, 'lang', search_query FROM papers UNION SELECT id, 'author', trim(unnest(string_split(authors, ';'))) FROM papers UNION SELECT id, 'year', CAST(year AS VARCHAR) FROM papers)
SELECT facet, value, count(*) AS n, min(id) AS first_id FROM v WHERE lower(trim(value)) NOT IN ('', 'none', 'n/a', 'na', 'unknown', 'not specified', 'not reported', 'null') GROUP BY 1, 2 HAVING count(*) >= 2""")
def d7(papers):
    return G.facet_index(papers, facets()).drop("ids_digest")


@query("d7_facet_members", "papers", """, v AS (SELECT id, 'venue' AS facet, journal AS value FROM papers UNION SELECT id, 'lang', search_query FROM papers UNION SELECT id, 'author', trim(unnest(string_split(authors, ';'))) FROM papers UNION SELECT id, 'year', CAST(year AS VARCHAR) FROM papers)
SELECT facet, value, id FROM v WHERE lower(trim(value)) NOT IN ('', 'none', 'n/a', 'na', 'unknown', 'not specified', 'not reported', 'null') AND (facet, value) IN (SELECT (facet, value) FROM v GROUP BY facet, value HAVING count(*) >= 2)""")
def d7b(papers):
    return G.facet_members(papers, facets())


_MN = """mn AS (SELECT m.id, substr(name, 1, 80) AS label, coalesce(p.n, 0) AS papers, coalesce(o.n, 0) AS n_odours, coalesce(o.odours, '') AS odours FROM molecules m LEFT JOIN (SELECT molecule_id, count(*) AS n FROM paper_molecules GROUP BY 1) p ON p.molecule_id = m.id
 LEFT JOIN (SELECT molecule_id, count(DISTINCT odour_id) AS n, array_to_string(list_sort(list_distinct(list(name)))[1:12], '|') AS odours FROM molecule_odours JOIN odours ON odours.id = odour_id GROUP BY 1) o ON o.molecule_id = m.id)"""


@query("d8_molecule_nodes", "molecules molecule_odours odours paper_molecules", f", {_MN} SELECT * FROM mn")
def d8(molecules, edges, odours, links):
    return G.molecule_nodes(molecules, edges, odours, links)


@query("d8_odour_nodes", "odours molecule_odours", "SELECT id, name AS label, odour_category, coalesce(n, 0) AS n_molecules FROM odours LEFT JOIN (SELECT odour_id, count(*) AS n FROM molecule_odours GROUP BY 1) ON odour_id = id")
def d8b(odours, edges):
    return G.odour_nodes(odours, edges)


ADAPTERS["faceted"] = """
    SELECT doc_id AS id, text AS name, CAST(2000 + doc_id % 27 AS INT) AS year, CASE WHEN doc_id % 6 > 0 THEN source ELSE '' END AS journal, CAST((doc_id*37) % 400 AS INT) AS citation_count, CAST(doc_id % 101 AS INT) AS relevance_llm, CAST(doc_id % 77 AS INT) AS priority,
           CASE doc_id % 3 WHEN 0 THEN 'review|x' WHEN 1 THEN ' |method' END AS study_type, CASE WHEN doc_id % 4 > 0 THEN 'a|b||c|d|e' END AS pathway, CASE WHEN doc_id % 5 > 0 THEN 'p|q' END AS method, 'm' AS matrix, '' AS compound_class, 's1|s2|s3|s4|s5|s6|s7' AS sensory,
           text AS main_claim, doc_id % 2 = 0 AS is_review FROM documents"""


@query("d8_paper_nodes", "faceted", """SELECT concat('s', id) AS id, id AS raw_id, substr(coalesce(name, ''), 1, 140) AS label, 'paper' AS type, year, nullif(journal, '') AS journal, citation_count AS citations, relevance_llm AS relevance, priority::DOUBLE AS priority,
 CASE id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'method' END AS study_type, CASE WHEN id % 4 > 0 THEN 'a|b|c|d' ELSE '' END AS pathway, CASE WHEN id % 5 > 0 THEN 'p|q' ELSE '' END AS method, 'm' AS matrix, '' AS compound_class, 's1|s2|s3|s4|s5|s6' AS sensory, substr(coalesce(main_claim, ''), 1, 400) AS main_claim, is_review FROM faceted""")
def d8c(papers):
    return G.paper_nodes(papers.withColumns({c: F.split(c, r"\|") for c in ("study_type", "pathway", "method", "matrix", "compound_class", "sensory")}))


@query("d8_topic_nodes", "topics", "SELECT concat('t', id) AS id, id AS raw_id, name AS label, 'topic' AS type, root_branch AS branch, parent_id % 3 AS level FROM topics")
def d8d(topics):
    return G.topic_nodes(topics.withColumn("level", F.col("parent_id") % 3))


def with_subgroup(molecules):
    return molecules.withColumn("subgroup", F.when(F.col("id") % 5 > 0, F.concat(F.lit("Sub, "), F.col("id") % 7)))


_KEYED = r"regexp_replace(lower(label), '[\s,''-]', '', 'g')"
_SCAF = f'''sc AS (SELECT concat('m', id) AS src, 'class' AS kind, category AS label, 'in_class' AS edge FROM molecules UNION ALL SELECT concat('m', id), 'group', chem_group, 'functional_group' FROM molecules UNION ALL SELECT concat('m', id), 'subgroup', concat('Sub, ', id % 7), 'subgroup' FROM molecules WHERE id % 5 > 0
UNION ALL SELECT concat('m', id), 'pathway', process, 'formed_by' FROM molecules WHERE process IS NOT NULL UNION ALL SELECT concat('o', id), 'odour_family', CAST(odour_category AS VARCHAR), 'odour_family' FROM odours)'''


@query("d9_chem_scaffold", "molecules odours", f", {_SCAF} SELECT 'c' || kind || ':' || {_KEYED} AS id, min(label) AS label, 'chem' AS type, kind FROM sc GROUP BY 1, kind")
def d9(molecules, odours):
    return G.chem_scaffold(with_subgroup(molecules), odours)


_EDGES = f'''{_SIM}, {_SCAF}, ed AS (SELECT concat('m', molecule_id) AS src, concat('o', odour_id) AS dst, 'smells_of' AS kind, 'molecule' AS graph, NULL::DOUBLE AS w, NULL::BIGINT AS shared, NULL::VARCHAR AS provenance FROM molecule_odours UNION ALL SELECT concat('m', a), concat('m', b), 'aroma_similar', 'molecule', jaccard, inter, NULL FROM (SELECT * FROM sim ORDER BY inter DESC, jaccard DESC, a, b LIMIT 6000)
UNION ALL SELECT concat('s', source_id), concat('t', topic_id), 'about_topic', 'paper', NULL, NULL, NULL FROM paper_topics UNION ALL SELECT concat('s', source_id), concat('m', molecule_id), 'mentions', 'bridge', NULL, NULL, CASE WHEN source_id % 4 = 0 THEN 'mined' ELSE 'curated' END FROM paper_molecules
UNION ALL SELECT src, 'c' || kind || ':' || {_KEYED}, edge, 'molecule', NULL, NULL, NULL FROM sc)'''


def bridges_of(mentions):
    return mentions.withColumn("provenance", F.when(F.col("source_id") % 4 == 0, "mined").otherwise("curated"))


def edges_of(smells, about, mentions, molecules, odours, alike=None, top=6000):
    """Every edge; of the similar pairs the first `top`, as the queries' SQL has it, or all with None."""
    return G.assemble_edges(smells, similar(smells, top) if alike is None else alike, about, bridges_of(mentions), with_subgroup(molecules), odours)


@query("d10_assemble_edges", "molecule_odours paper_topics paper_molecules molecules odours", f", {_EDGES} SELECT * FROM ed")
def d10(smells, about, mentions, molecules, odours):
    return edges_of(smells, about, mentions, molecules, odours)


@query("d11_kg_counts", "molecule_odours paper_topics paper_molecules molecules odours library topics kg_papers", rf''', {_EDGES}, ks AS (SELECT DISTINCT regexp_replace(lower(compound), '[\s,''-]', '', 'g') AS key FROM library)
SELECT 'molecules' AS counter, count(*) AS n FROM molecules UNION ALL SELECT 'odours', count(*) FROM odours UNION ALL SELECT 'molecule_odour_edges', count(*) FROM molecule_odours UNION ALL SELECT 'library_entries', count(*) FROM library UNION ALL SELECT 'sources', count(*) FROM kg_papers UNION ALL SELECT 'topics', count(*) FROM topics
UNION ALL SELECT 'source_topic_edges', count(*) FROM paper_topics UNION ALL SELECT 'bridge_curated', count(*) FROM paper_molecules WHERE source_id % 4 > 0 UNION ALL SELECT 'bridge_mined', count(*) FROM paper_molecules WHERE source_id % 4 = 0 UNION ALL SELECT 'sources_with_any_molecule', count(DISTINCT source_id) FROM paper_molecules
UNION ALL SELECT 'molecules_matched', count(*) FROM molecules WHERE regexp_replace(lower(name), '[\s,''-]', '', 'g') IN (SELECT key FROM ks WHERE key IS NOT NULL) UNION ALL SELECT 'aroma_similarity_edges', count(*) FROM ed WHERE kind = 'aroma_similar' UNION ALL SELECT 'chem_scaffold_nodes', count(DISTINCT 'c' || kind || ':' || {_KEYED}) FROM sc
UNION ALL SELECT 'total_edges', count(*) FROM ed UNION ALL SELECT 'names_skipped_as_unminable', count(*) FROM molecules WHERE NOT ({_MINABLE})''')
def d11b(smells, about, mentions, molecules, odours, library, topics, papers):
    alike = checkpointed(similar(smells, 6000))
    tables = {"molecules": molecules, "odours": odours, "molecule_odour_edges": smells, "library_entries": library, "sources": papers, "topics": topics, "source_topic_edges": about}
    edges = edges_of(smells, about, mentions, molecules, odours, alike)
    return G.kg_counts(tables, bridges_of(mentions), G.match_reference(molecules, library), alike, with_subgroup(molecules), odours, edges)


@query("d11_kg_stats", "molecule_odours paper_topics paper_molecules molecules odours", f", {_EDGES} SELECT kind, graph, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, (SELECT count(*) FROM (SELECT src FROM ed x WHERE x.kind = ed.kind UNION SELECT dst FROM ed x WHERE x.kind = ed.kind)) AS nodes FROM ed GROUP BY 1, 2")
def d11(smells, about, mentions, molecules, odours):
    return G.kg_stats(edges_of(smells, about, mentions, molecules, odours))


def words_of(benchmark):
    """Questions: benchmark passages."""
    return benchmark.select(F.col("item_id").alias("qid"), "text")


def doc_labels(documents):
    """Labels of the odours: names made of the first word, and of the first two words, of each document."""
    id_, text = (F.col("doc_id") % 100).alias("id"), F.lower("text")
    one = documents.select(id_, F.regexp_extract(text, "[a-z]+", 0).alias("label"))
    return one.union(documents.select(id_, F.regexp_extract(text, "^[a-z]+ [a-z]+", 0))).distinct()


_EN = r"""labs AS (SELECT DISTINCT doc_id % 100 AS id, regexp_extract(lower(text), '[a-z]+') AS label FROM documents UNION SELECT DISTINCT doc_id % 100, regexp_extract(lower(text), '^[a-z]+ [a-z]+') FROM documents), en AS (SELECT DISTINCT item_id AS qid, id FROM benchmark JOIN labs ON length(label) >= 4 AND regexp_matches(lower(text), '(^|[^a-z])' || label || 's?([^a-z]|$)'))"""
_SD = f"{_EN}, seeds AS (SELECT qid, molecule_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, molecule_id) AS k FROM (SELECT qid, molecule_id, count(DISTINCT id) AS hits FROM en JOIN molecule_odours ON odour_id = id GROUP BY 1, 2)) WHERE k <= 15)"
_EX = f"{_SD}, {_SIM}, bi AS (SELECT a AS m, b AS o, jaccard FROM sim UNION ALL SELECT b, a, jaccard FROM sim), ex AS (SELECT qid, o AS molecule_id, round(sum(jaccard), 6) AS score FROM seeds JOIN bi ON m = molecule_id ANTI JOIN (SELECT qid, molecule_id AS o FROM seeds) s USING (qid, o) GROUP BY 1, 2), ext AS (SELECT qid, molecule_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, molecule_id) AS k FROM ex) WHERE k <= 12)"
_RK = f"{_EX}, fd AS (SELECT qid, molecule_id FROM seeds UNION SELECT qid, molecule_id FROM ext), cv AS (SELECT qid, source_id, count(DISTINCT molecule_id) AS coverage FROM fd JOIN paper_molecules USING (molecule_id) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coverage DESC, source_id DESC) AS nth FROM (SELECT qid, source_id, coverage, relevance, round(coverage * (0.5::DOUBLE + relevance / 100), 4) AS score FROM cv JOIN kg_papers ON id = source_id))"


def seeds_of(benchmark, documents, smells):
    return G.seed_molecules(G.entry_nodes(words_of(benchmark), doc_labels(documents)), smells)


def found_of(benchmark, documents, smells):
    seeds = checkpointed(seeds_of(benchmark, documents, smells))
    return seeds.select("qid", "molecule_id").unionByName(G.expand_similar(seeds, similar(smells, around=seeds)).select("qid", "molecule_id"))


@query("d12_entry_nodes", "benchmark documents", f", {_EN} SELECT * FROM en")
def d12(benchmark, documents):
    return G.entry_nodes(words_of(benchmark), doc_labels(documents))


@query("d13_seed_molecules", "benchmark documents molecule_odours", f", {_SD} SELECT * FROM seeds")
def d13(benchmark, documents, smells):
    return seeds_of(benchmark, documents, smells)


@query("d14_expand_similar", "benchmark documents molecule_odours", f", {_EX} SELECT * FROM ext")
def d14(benchmark, documents, smells):
    seeds = checkpointed(seeds_of(benchmark, documents, smells))
    return G.expand_similar(seeds, similar(smells, around=seeds))


@query("d15_rank_papers", "benchmark documents molecule_odours paper_molecules kg_papers molecules", f""", {_RK}, nm AS (SELECT rk.qid, rk.source_id, array_to_string(list_sort(list(DISTINCT name))[1:6], '|') AS names FROM rk JOIN fd USING (qid) JOIN paper_molecules pm ON pm.source_id = rk.source_id AND pm.molecule_id = fd.molecule_id JOIN molecules m ON m.id = fd.molecule_id WHERE nth <= 6 GROUP BY 1, 2)
SELECT rk.*, names FROM rk JOIN nm USING (qid, source_id) WHERE nth <= 6""")
def d15(benchmark, documents, smells, links, papers, molecules):
    return G.rank_papers(found_of(benchmark, documents, smells), links, papers, names=molecules.select(F.col("id").alias("molecule_id"), "name"))


@query("d16_chemistry_profile", "benchmark documents molecule_odours molecules", f""", {_EX}, w AS (SELECT qid, molecule_id FROM seeds UNION SELECT qid, molecule_id FROM ext), f AS (SELECT qid, 'class' AS kind, 5 AS most, category AS value FROM w JOIN molecules ON id = molecule_id UNION ALL SELECT qid, 'pathway', 3, process FROM w JOIN molecules ON id = molecule_id UNION ALL SELECT qid, 'group', 4, chem_group FROM w JOIN molecules ON id = molecule_id),
c AS (SELECT qid, kind, most, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY 1,2,3,4) SELECT qid, kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY qid, kind ORDER BY n DESC, value) AS k FROM c) WHERE k <= most""")
def d16(benchmark, documents, smells, molecules):
    return G.chemistry_profile(found_of(benchmark, documents, smells), molecules)


@query("d17_route_overlap", "benchmark documents molecule_odours paper_molecules kg_papers", f""", {_RK}, fl AS (SELECT item_id AS qid, item_id * 11 % 5000 AS source_id FROM benchmark UNION SELECT qid, source_id FROM rk WHERE nth <= 2)
SELECT qid, count(*) FILTER (WHERE a AND b) AS common, count(*) FILTER (WHERE b IS NULL) AS only_a, count(*) FILTER (WHERE a IS NULL) AS only_b FROM (SELECT qid, source_id, true AS a FROM rk WHERE nth <= 6) FULL JOIN (SELECT *, true AS b FROM fl) USING (qid, source_id) GROUP BY 1""")
def d17(benchmark, documents, smells, links, papers):
    graph = G.rank_papers(found_of(benchmark, documents, smells), links, papers)
    flat = benchmark.select(F.col("item_id").alias("qid"), (F.col("item_id") * 11 % 5000).alias("source_id")).union(graph.where("nth <= 2").select("qid", "source_id")).distinct()
    return G.route_overlap(graph, flat)


_SUB = f"""{_MN}, tm AS (SELECT id FROM mn ORDER BY papers DESC, n_odours DESC, id LIMIT 320), tp AS (SELECT id FROM kg_papers WHERE id IN (SELECT source_id FROM paper_molecules WHERE molecule_id IN (FROM tm)) ORDER BY relevance + (id * 7 % 3000) / 50.0::DOUBLE DESC, id DESC LIMIT 260),
sb AS (SELECT * FROM paper_molecules WHERE molecule_id IN (FROM tm) AND source_id IN (FROM tp))"""


def subset_of(molecules, smells, odours, links, papers):
    return G.display_subset(G.molecule_nodes(molecules, smells, odours, links), links, papers.withColumn("citations", F.col("id") * 7 % 3000))


@query("d18_display_subset", "molecules molecule_odours odours paper_molecules kg_papers", f", {_SUB} SELECT * FROM sb")
def d18(molecules, smells, odours, links, papers):
    return subset_of(molecules, smells, odours, links, papers)


@query("d18_touched_nodes", "molecules molecule_odours odours paper_molecules kg_papers", f", {_SUB} SELECT concat('m', molecule_id) AS id FROM sb UNION SELECT concat('s', source_id) FROM sb")
def d18b(molecules, smells, odours, links, papers):
    return G.touched_nodes(subset_of(molecules, smells, odours, links, papers))
