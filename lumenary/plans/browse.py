"""Browse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..registry import query

PAPER = ["id", "name", "journal", "year", "citation_count", "relevance_llm", "doi"]
_P = "id, name, journal, year, citation_count, relevance_llm, doi"
SLUGS = ["nation_1", "nation_3", "nation_8"]


@query("a1_scan_table", "papers", "SELECT id, name, journal, search_query, year, citation_count, relevance_llm, doi, is_review, authors FROM papers")
def a1(papers):
    return papers.drop("abstract")


@query("a2_newest_snapshot", "orders", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100")
def a2(orders):
    return orders.select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.col("o_orderdate").desc_nulls_last(), F.desc("o_orderkey")).limit(100)


@query("b1_search_tokens", "papers", f"SELECT {_P} FROM papers WHERE (contains(lower(name),'the') OR contains(lower(journal),'the')) AND (contains(lower(name),'src1') OR contains(lower(journal),'src1'))")
def b1(papers):
    return B.search_tokens(papers, " The  SRC1 ", ["name", "journal"]).select(PAPER)


@query("b2_range_filter", "papers", f"SELECT {_P} FROM papers WHERE year BETWEEN 2005 AND 2020 AND relevance_llm >= 40 AND citation_count <= 300")
def b2(papers):
    return B.range_filter(papers, year=("2005", "2020"), relevance_llm=("40", "many"), citation_count=(None, 300)).select(PAPER)


@query("b3_in_list_filter", "papers", f"SELECT {_P} FROM papers WHERE journal IN ('src1','src7')")
def b3(papers):
    return B.in_list_filter(papers, "journal", "src1, ,src7,").select(PAPER)


@query("b4_has_topic", "papers paper_topics topics", f"SELECT {_P} FROM papers WHERE id IN (SELECT source_id FROM paper_topics p JOIN topics t ON t.id = p.topic_id WHERE slug IN ('nation_1','nation_3','nation_8'))")
def b4(papers, junction, topics):
    return B.has_topic(papers, junction, topics, SLUGS).select(PAPER)


@query("b5_presence_filter", "papers", f"SELECT {_P} FROM papers WHERE NOT coalesce(doi IS NOT NULL AND trim(doi) <> '', FALSE)")
def b5(papers):
    return B.presence_filter(papers, "doi", 0).select(PAPER)


@query("b6_is_review_filter", "papers", f"SELECT {_P} FROM papers WHERE is_review IS NOT TRUE")
def b6(papers):
    return B.is_review_filter(papers, 0).select(PAPER)


@query("b7_order_papers", "papers", f"SELECT {_P} FROM papers ORDER BY relevance_llm DESC NULLS LAST, id DESC LIMIT 200")
def b7(papers):
    return papers.orderBy(*B.order_papers(papers, "relevance_llm", "desc")).limit(200).select(PAPER)


@query("b7_order_by_journal", "papers", f"SELECT {_P} FROM papers ORDER BY lower(coalesce(CASE WHEN id % 3 > 0 THEN journal END, search_query)) ASC NULLS LAST, id ASC LIMIT 300")
def b7b(papers):
    venued = papers.withColumns({"venue": F.col("search_query"), "journal_": F.col("journal"), "journal": F.when(F.col("id") % 3 > 0, F.col("journal"))})
    return venued.orderBy(*B.order_papers(venued, "journal", "asc")).limit(300).withColumn("journal", F.col("journal_")).select(PAPER)


@query("b8_page", "papers", f"SELECT {_P}, (SELECT count(*) FROM papers) AS total, CAST(ceil((SELECT count(*) FROM papers) / 40.0) AS BIGINT) AS pages FROM papers ORDER BY lower(name) ASC NULLS LAST, id ASC LIMIT 40 OFFSET 80")
def b8(papers):
    return B.page(papers.select(PAPER), B.order_papers(papers, "name", "asc"), 3, 40)


@query("b9_rows_by_ids", "papers benchmark", ", asked AS (SELECT min(item_id) AS pos, CAST(item_id * 7 % 90 - 3 AS BIGINT) AS id FROM benchmark GROUP BY 2) SELECT a.pos, a.id, p.name, p.id IS NOT NULL AS found FROM asked a LEFT JOIN papers p ON p.id = a.id WHERE a.id >= 0")
def b9(papers, items):
    wanted = items.select(F.col("item_id").alias("pos"), (F.col("item_id") * 7 % 90 - 3).cast("long").alias("id"))
    return B.rows_by_ids(papers.select("id", "name"), wanted).select("pos", "id", "name", "found")


@query("b10_facets", "papers paper_topics topics", """
, totals AS (SELECT count(*) AS total, count(*) FILTER (WHERE doi IS NOT NULL AND trim(doi) <> '') AS with_doi, count(*) FILTER (WHERE is_review) AS reviews, min(year) AS min_year, max(year) AS max_year FROM papers)
SELECT 'totals' AS facet, 'total' AS value, total AS n FROM totals UNION ALL SELECT 'totals','with_doi',with_doi FROM totals UNION ALL SELECT 'totals','reviews',reviews FROM totals
UNION ALL SELECT 'totals','min_year',min_year FROM totals UNION ALL SELECT 'totals','max_year',max_year FROM totals
UNION ALL SELECT 'journal', journal, count(*) FROM papers WHERE trim(journal) <> '' GROUP BY 2 UNION ALL SELECT 'search_query', search_query, count(*) FROM papers WHERE trim(search_query) <> '' GROUP BY 2
UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM papers WHERE year IS NOT NULL GROUP BY 2
UNION ALL (SELECT 'topic', slug, count(DISTINCT source_id) FROM paper_topics p JOIN topics t ON t.id = p.topic_id GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 200)""")
def b10(papers, junction, topics):
    return B.facets(papers, junction, topics)


@query("b11_list_experts", "people", "SELECT * FROM people WHERE relevance_score IS NOT NULL AND contains(lower(name), 'ann') AND relevance_score >= 6000 ORDER BY relevance_score DESC NULLS LAST, id LIMIT 100")
def b11(people):
    return B.list_experts(people, "ann", min_relevance=6000)


@query("b12_country_facets", "people", "SELECT country, count(*) AS n FROM people WHERE relevance_score IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM people WHERE relevance_score IS NOT NULL")
def b12(people):
    return B.country_facets(people)


@query("b13_recent_papers", "papers", f"SELECT {_P} FROM papers WHERE year IS NOT NULL ORDER BY year DESC, id DESC LIMIT 6")
def b13(papers):
    return B.recent_papers(papers.select(PAPER))


@query("b14_list_molecules", "molecules paper_molecules", """
, c AS (SELECT molecule_id, count(*) AS m FROM paper_molecules GROUP BY 1), f AS (SELECT * FROM molecules WHERE contains(lower(name), 're') OR contains(lower(category), 're'))
SELECT f.*, coalesce(m, 0) AS mentions, (SELECT count(*) FROM f) AS total FROM f LEFT JOIN c ON c.molecule_id = f.id ORDER BY mentions DESC, lower(name), id LIMIT 50 OFFSET 20""")
def b14(molecules, edges):
    return B.list_molecules(molecules, edges, q="re", offset=20)


@query("b15_list_sources", "papers paper_topics topics", f"""SELECT {_P} FROM papers WHERE (contains(lower(name), 'on') OR contains(lower(abstract), 'on')) AND relevance_llm >= 60
AND id IN (SELECT source_id FROM paper_topics p JOIN topics t ON t.id = p.topic_id WHERE slug IN ('nation_1','nation_3','nation_8')) ORDER BY relevance_llm DESC NULLS LAST, id DESC LIMIT 50""")
def b15(papers, junction, topics):
    return B.list_sources(papers, junction, topics, "on", SLUGS, 60).select(PAPER)


_STAFF = "people_ AS (SELECT id, current_org, concat('of ', country) AS affiliation, country, CASE id % 3 WHEN 0 THEN 'maker' WHEN 1 THEN 'lab' END AS org_type, id % 10 = 1 AS is_academic FROM people)"


def staff_of(people):
    k = F.col("id")
    return people.withColumns({"affiliation": F.concat(F.lit("of "), "country"), "org_type": F.when(k % 3 == 0, "maker").when(k % 3 == 1, "lab"), "is_academic": k % 10 == 1})


@query("b16_companies", "people", f"""
, {_STAFF}, n AS (SELECT *, coalesce(current_org, affiliation) AS org FROM people_ WHERE NOT is_academic), c AS (SELECT org, country, row_number() OVER (PARTITION BY org ORDER BY count(*) DESC, country) AS k FROM n GROUP BY org, country),
t AS (SELECT org, org_type, row_number() OVER (PARTITION BY org ORDER BY count(*) DESC, org_type) AS k FROM n WHERE org_type IS NOT NULL GROUP BY org, org_type)
SELECT org, id, country, org_type, people FROM (SELECT org, min(id) AS id, count(*) AS people FROM n GROUP BY 1) LEFT JOIN (FROM c WHERE k = 1) USING (org) LEFT JOIN (FROM t WHERE k = 1) USING (org)""")
def b16(people):
    return B.companies(staff_of(people))


@query("b16_organizations", "people supplier", "SELECT s_name AS org, s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS country, 'maker' AS org_type, CAST(NULL AS BIGINT) AS people FROM supplier")
def b16b(people, supplier):
    return B.companies(staff_of(people), supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("country"), F.lit("maker").alias("org_type")))


@query("b17_distinct_facets", "molecules", "SELECT DISTINCT 'category' AS facet, category AS value FROM molecules UNION SELECT DISTINCT 'chem_group', chem_group FROM molecules UNION SELECT DISTINCT 'process', process FROM molecules WHERE process IS NOT NULL")
def b17(molecules):
    return B.distinct_facets(molecules, ["category", "chem_group", "process"])


@query("b17_year_range", "papers", "SELECT min(year) AS min_year, max(year) AS max_year FROM papers")
def b17b(papers):
    return B.year_range(papers)


@query("b18_phase_topics", "papers paper_topics topics", "SELECT slug, count(DISTINCT source_id) AS papers FROM topics t LEFT JOIN paper_topics p ON t.id = p.topic_id WHERE slug IN ('nation_1','nation_3','nation_8','nation_24') GROUP BY slug")
def b18(papers, junction, topics):
    return B.phase_topics(papers, junction, topics, [*SLUGS, "nation_24"])


@query("b18_phase_totals", "paper_topics topics paper_molecules", """, o AS (SELECT DISTINCT source_id FROM paper_topics p JOIN topics t ON t.id = p.topic_id WHERE slug IN ('nation_1','nation_3','nation_8'))
SELECT (SELECT count(*) FROM o) AS papers, count(DISTINCT molecule_id) AS molecules FROM paper_molecules WHERE source_id IN (FROM o)""")
def b18t(junction, topics, mentions):
    return B.phase_totals(junction, topics, mentions, SLUGS)


@query("b18_phase_papers", "papers paper_topics topics", """
, o AS (SELECT source_id, array_to_string(list_sort(list_distinct(list(slug))), '|') AS slugs FROM paper_topics p JOIN topics t ON t.id = p.topic_id WHERE slug IN ('nation_1','nation_3','nation_8') GROUP BY 1)
SELECT id, year, relevance_llm, slugs FROM papers JOIN o ON o.source_id = id ORDER BY relevance_llm DESC NULLS LAST, id DESC LIMIT 50""")
def b18p(papers, junction, topics):
    return B.phase_papers(papers, junction, topics, SLUGS)


TEXT = "A red widget and an economy ring in one text"


@query("b19_suggest_molecules", "molecules paper_molecules", f"""
, c AS (SELECT molecule_id, count(*) AS m FROM paper_molecules GROUP BY 1)
SELECT id, name, CASE WHEN trim(name) <> '' AND contains('{TEXT.lower()}', lower(name)) THEN 2 WHEN trim(category) <> '' AND contains('{TEXT.lower()}', lower(category)) THEN 1 ELSE 0 END AS rank, coalesce(m, 0) AS mentions
FROM molecules LEFT JOIN c ON molecule_id = id WHERE id NOT IN (1, 2) ORDER BY rank DESC, mentions DESC, id LIMIT 10""")
def b19(molecules, edges):
    return B.suggest_molecules(molecules, edges, TEXT, [1, 2])


@query("b20_molecule_detail", "molecules paper_molecules kg_papers", """
, c AS (SELECT molecule_id, count(*) AS m FROM paper_molecules GROUP BY 1),
r AS (SELECT molecule_id, source_id, relevance, row_number() OVER (PARTITION BY molecule_id ORDER BY CASE WHEN source_id % 6 > 0 THEN source_id % 40 END DESC NULLS LAST, 1990 + source_id % 30 DESC NULLS LAST, source_id DESC) AS nth FROM paper_molecules JOIN kg_papers k ON k.id = source_id)
SELECT m.*, c.m AS mentions, r.nth, r.source_id, r.relevance FROM molecules m JOIN c ON c.molecule_id = m.id JOIN r ON r.molecule_id = m.id AND r.nth <= 10""")
def b20(molecules, edges, papers):
    k = F.col("id")
    return B.molecule_detail(molecules, edges, papers.withColumns({"priority": F.when(k % 6 > 0, k % 40), "year": 1990 + k % 30}))


@query("b21_resolve_names", "molecules paper_molecules odours", """
, c AS (SELECT molecule_id, count(*) AS m FROM paper_molecules GROUP BY 1), n AS (SELECT id, lower(name) AS k, coalesce(m, 0) AS m FROM molecules LEFT JOIN c ON molecule_id = id),
a AS (SELECT DISTINCT upper(name) AS name FROM molecules WHERE id % 100 = 0 UNION SELECT DISTINCT substr(name, 2, 5) FROM molecules WHERE id % 100 = 0 UNION SELECT name FROM odours WHERE id < 3),
e AS (SELECT name, (SELECT min(id) FROM n WHERE k = lower(a.name)) AS id FROM a)
SELECT name, coalesce(id, (SELECT arg_min(n.id, struct_pack(x := -n.m, y := n.id)) FROM n WHERE contains(k, lower(e.name)))) AS id FROM e""")
def b21(molecules, edges, odours):
    # Names asked for: of the molecules whose id is divisible by 100, whole and in part, and of a few odours.
    asked = molecules.where("id % 100 = 0").select(F.upper("name").alias("name")).union(molecules.where("id % 100 = 0").select(F.substring("name", 2, 5))).union(odours.where("id < 3").select("name"))
    return B.resolve_names(molecules, edges, asked)


@query("b22_compare_profiles", "molecules", """
, p AS (SELECT id AS a, id * 3 + 1 AS b FROM molecules), f AS (SELECT unnest(['name','category','process']) AS field),
w AS (SELECT id, name, category, process FROM molecules),
x AS (SELECT p.a, p.b, l.id IS NULL OR r.id IS NULL AS missing, field, CASE field WHEN 'name' THEN l.name WHEN 'category' THEN l.category ELSE l.process END AS "left",
 CASE field WHEN 'name' THEN r.name WHEN 'category' THEN r.category ELSE r.process END AS "right" FROM p CROSS JOIN f LEFT JOIN w l ON l.id = p.a LEFT JOIN w r ON r.id = p.b)
SELECT *, "left" IS DISTINCT FROM "right" AS differs FROM x""")
def b22(molecules):
    pairs = molecules.select(F.col("id").alias("a"), (F.col("id") * 3 + 1).alias("b"))
    return B.compare_profiles(molecules, pairs, ["name", "category", "process"])


@query("c1_or_join", "library compounds", """
SELECT entry_no, id, CASE WHEN lower(name) = lower(compound) THEN 'exact_name' ELSE 'cas_match' END AS match_type FROM library JOIN compounds ON lower(name) = lower(compound) OR cas = cas_number""")
def c1(library, compounds):
    return B.or_join(library, compounds)


@query("c2_gaps", "library compounds", """
SELECT entry_no, compound, cas_number, beef_relevance_score FROM library l WHERE NOT EXISTS (SELECT 1 FROM compounds c WHERE lower(c.name) = lower(l.compound)) AND NOT EXISTS (SELECT 1 FROM compounds c WHERE c.cas = l.cas_number)""")
def c2(library, compounds):
    return B.gaps(library, compounds)


@query("c3_unique_key_join", "library compounds", """
, k AS (SELECT translate(lower(compound), ' ,-', '') AS key, min(cas_number) AS value FROM library GROUP BY 1 HAVING count(DISTINCT cas_number) = 1)
SELECT id, name, k.key, value FROM compounds JOIN k ON translate(lower(name), ' ,-', '') = k.key""")
def c3(library, compounds):
    key = lambda c: F.translate(F.lower(c), " ,-", "")
    return B.unique_key_join(compounds, library, key("name"), key("compound"), F.col("cas_number")).select("id", "name", "key", "value")
