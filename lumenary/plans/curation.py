"""Curation queries. Audits are derived from orders, taxonomies from topics and words of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..operators import curation as C
from ..registry import query

ADAPTERS["audits"] = """
    SELECT o_orderkey AS audit_id, o_custkey % 900 AS source_id, o_orderdate AS audited_at, CAST(o_orderkey % 40 AS INT) AS run_id,
           CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'review' ELSE 'quarantine' END AS verdict FROM orders"""
ADAPTERS["terms"] = """
    SELECT slug, slug AS name, rank FROM (SELECT DISTINCT lower(substr(text, 1, 4)) AS slug, CAST(item_id % 9 AS INT) AS rank FROM benchmark) b WHERE length(slug) = 4 AND slug NOT LIKE '% %'"""
ADAPTERS["scored"] = """
    SELECT d.doc_id AS id, d.text AS abstract, CAST((d.doc_id*37) % 400 AS INT) AS citation_count, CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(l.quality*55 + d.doc_id % 45 AS INT) END AS relevance_llm,
           CASE WHEN d.doc_id % 8 = 0 THEN NULL ELSE CAST((d.doc_id * 13) % 1000 AS DOUBLE) / 10 END AS priority, CASE WHEN d.doc_id % 3 > 0 THEN CAST(d.doc_id % 90 AS INT) END AS days_since_audit,
           CAST(d.doc_id % 2 AS INT) AS audit_count, d.doc_id % 5 < 3 AS tagged, d.doc_id % 7 > 1 AS has_queries, d.source AS branch, d.lang AS second_branch FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
#: Papers under titles and venues that reach every rule, with tags, claims and facets.
ADAPTERS["titled"] = """
    SELECT d.doc_id AS id, concat(CASE d.doc_id % 7 WHEN 0 THEN 'A systematic review: ' WHEN 1 THEN 'Beef aroma. ' WHEN 2 THEN 'Advances in state-of-the-art Umami ' WHEN 3 THEN 'Reviewers and overviews ' ELSE '' END, substr(d.text,1,80)) AS name, d.text AS abstract,
           CASE d.source WHEN 'src1' THEN 'Food Chemistry' WHEN 'src2' THEN 'LWT - Food Science and Technology' WHEN 'src3' THEN NULL WHEN 'src4' THEN '' WHEN 'src5' THEN 'Trends in Food Science' ELSE d.source END AS journal,
           CASE WHEN d.doc_id % 13 > 0 THEN CAST(2000 + d.doc_id % 27 AS INT) END AS year, CAST((d.doc_id*37) % 400 AS INT) AS citation_count, CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(l.quality*55 + d.doc_id % 45 AS INT) END AS relevance_llm,
           CASE WHEN d.doc_id % 10 = 0 THEN NULL ELSE concat('10.', CAST(d.doc_id AS STRING)) END AS doi, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id % 3 = 0 END AS is_review, d.lang AS search_query,
           CASE d.doc_id % 4 WHEN 1 THEN 'Beef flavour' WHEN 2 THEN 'Beef flavour|xyzzy|of' WHEN 3 THEN 'abc|Reviewers only|aroma|a b c|Sulfur chemistry|lipids|reaction|Systematic work' END AS tag_names,
           CASE WHEN d.doc_id % 9 > 0 THEN substr(d.text, 5, 60) ELSE '' END AS main_claim, CASE d.doc_id % 4 WHEN 0 THEN 'beef' WHEN 1 THEN 'beef|pork|duck|fish' WHEN 3 THEN 'soy| |pea' END AS matrix, CASE d.doc_id % 3 WHEN 1 THEN 'GC-MS' WHEN 2 THEN 'GC-O| panel ' END AS method,
           CASE WHEN d.doc_id % 5 < 2 THEN 'Maillard' END AS pathway, CASE WHEN d.doc_id % 2 = 0 THEN 'roasted|meaty' END AS sensory FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
_CORE = " OR ".join(f"contains(lower(journal), '{v}')" for v in ("food chemistry", "journal of agricultural and food chemistry", "meat science", "food research international", "comprehensive reviews in food science", "flavour and fragrance",
                                                                "journal of the science of food and agriculture", "trends in food science", "npj science of food", "lwt", "molecules", "foods"))
PRIORITY = rf"""
, marked AS (SELECT p.*, p.id IN (SELECT source_id FROM paper_topics) AS has_tag, regexp_matches(name, '(?i)\b(review|meta-analysis|systematic|state[- ]of[- ]the[- ]art|overview|advances in)\b') AS is_review_guess FROM titled p),
scored AS (SELECT *, least(1000, (10 * (CASE WHEN regexp_matches(name || ' ' || abstract, '(?i)(meat|beef|pork|chicken|poultry|flavou?r|aroma|volatile|umami|maillard|strecker|lipid oxidation|sensory|odou?r|hydrolysate|yeast extract)') THEN 25.0 ELSE 0.0 END
 + CASE WHEN coalesce(journal, '') = '' THEN 0.0 WHEN {_CORE} THEN 20.0 ELSE 8.0 END + CASE WHEN is_review_guess THEN 15.0 ELSE 0.0 END
 + CASE WHEN year >= 2021 THEN 10.0 WHEN year >= 2015 THEN 5.0 ELSE 0.0 END + CASE WHEN has_tag THEN 10.0 ELSE 0.0 END))::BIGINT
 + CASE WHEN citation_count > 0 AND year > 0 THEN least(200, (60 * citation_count + greatest(1, 2026 - year)) // (2 * greatest(1, 2026 - year))) ELSE 0 END)::DOUBLE / 10 AS base FROM marked),
final AS (SELECT *, CASE WHEN relevance_llm IS NOT NULL THEN round(relevance_llm * 0.6::DOUBLE + base * 0.4::DOUBLE, 1) ELSE base END AS priority FROM scored)
"""


def scored(papers, junction):
    return C.priority_score(papers, junction)


@query("f1_priority_score", "titled paper_topics", PRIORITY + "SELECT id, base, priority, is_review_guess FROM final")
def f1(papers, junction):
    return scored(papers, junction).select("id", "base", "priority", "is_review_guess")


@query("f1_priority_top", "titled paper_topics", PRIORITY + "SELECT id, name, year, priority FROM final ORDER BY priority DESC NULLS LAST, id DESC LIMIT 20")
def f1_top(papers, junction):
    return scored(papers, junction).orderBy(F.col("priority").desc_nulls_last(), F.desc("id")).limit(20).select("id", "name", "year", "priority")


@query("f2_score_buckets", "titled paper_topics", PRIORITY + "SELECT count(*) FILTER (WHERE priority >= 80) AS b80, count(*) FILTER (WHERE priority >= 60 AND priority < 80) AS b60, count(*) FILTER (WHERE priority >= 40 AND priority < 60) AS b40, count(*) FILTER (WHERE priority < 40) AS b0, count(*) FILTER (WHERE is_review_guess) AS reviews FROM final")
def f2(papers, junction):
    return C.score_buckets(scored(papers, junction))


@query("f3_dedupe_by_title", "papers", "SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY citation_count DESC NULLS LAST, doi IS NULL, abstract IS NULL, id) AS k FROM papers) WHERE k = 1")
def f3(papers):
    return C.dedupe_by_title(papers).select("id", "name")


@query("f3_drop_orphans", "papers paper_topics", "SELECT source_id, topic_id FROM paper_topics WHERE source_id IN (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY citation_count DESC NULLS LAST, doi IS NULL, abstract IS NULL, id) AS k FROM papers) WHERE k = 1)")
def f3b(papers, junction):
    return C.drop_orphans(junction, C.dedupe_by_title(papers))


_T = "t AS (SELECT slug, min(name) AS term, min(rank) AS rank FROM terms WHERE length(name) >= 4 GROUP BY 1), h AS (SELECT id, slug, rank FROM papers JOIN t ON contains(lower(abstract), lower(term))), hn AS (SELECT id, slug FROM papers JOIN t ON contains(lower(name || ' ' || abstract), lower(term)))"


@query("f4_classify_topics", "papers terms", f", {_T} SELECT id, slug, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, slug) AS k FROM h) WHERE k <= 3")
def f4(papers, terms):
    return C.classify_topics(papers, terms)


def facets():
    return {"venue": F.array("journal"), "lang": F.array("search_query", "journal"), "author": F.split("authors", ";")}


_V = """v AS (SELECT id, 'venue' AS category, trim(journal) AS name FROM papers UNION ALL SELECT id, 'lang', trim(search_query) FROM papers UNION ALL SELECT id, 'lang', trim(journal) FROM papers
 UNION ALL SELECT id, 'author', trim(unnest(string_split(authors, ';'))) FROM papers), s AS (SELECT *, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM v WHERE name <> '')"""


@query("f5_tag_vocabulary", "papers", f", {_V} SELECT category, slug, min(name) AS name FROM s WHERE slug <> '' GROUP BY 1, 2")
def f5(papers):
    return C.promote_tags(papers, facets())[0]


@query("f5_paper_tags", "papers", f", {_V} SELECT DISTINCT id, category, slug FROM s WHERE slug <> ''")
def f5b(papers):
    return C.promote_tags(papers, facets())[1]


@query("f6_tag_stats", "papers", f", {_V}, j AS (SELECT DISTINCT id, category, slug FROM s WHERE slug <> '') SELECT category, count(DISTINCT slug) AS tags, count(*) AS links, count(DISTINCT id) AS papers FROM j GROUP BY 1")
def f6(papers):
    return C.tag_stats(C.promote_tags(papers, facets())[1])


def values():
    return F.array(F.concat(F.lit("Nation "), (F.col("id") % 40).cast("string")), F.concat(F.lit("NATION_"), (F.col("id") % 7).cast("string")), F.col("journal"))


_B = """b AS (SELECT * FROM papers WHERE id NOT IN (SELECT source_id FROM paper_topics)), s AS (SELECT DISTINCT id, unnest([concat('Nation ', id % 40), concat('NATION_', id % 7), journal]) AS value FROM b),
n AS (SELECT id, trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')) AS key FROM s), k AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key, min(id) AS topic_id FROM topics GROUP BY 1)"""


@query("f7_backfill_links", "papers topics paper_topics", f", {_B} SELECT DISTINCT id AS source_id, topic_id FROM n JOIN k USING (key)")
def f7(papers, topics, junction):
    return C.backfill_topics(papers, topics, junction, values())[0]


@query("f7_backfill_unmatched", "papers topics paper_topics", f", {_B} SELECT key, count(*) AS n FROM n WHERE key NOT IN (SELECT key FROM k) GROUP BY 1 ORDER BY n DESC, key LIMIT 12")
def f7b(papers, topics, junction):
    return C.backfill_topics(papers, topics, junction, values())[1].orderBy(F.desc("n"), "key").limit(12)


@query("f8_sync_taxonomy", "topics supplier", """
, x AS (SELECT lower(concat('nation_', s_suppkey % 40)) AS slug, concat('Topic ', s_suppkey % 40) AS name, 'ASIA' AS branch, 7 AS parent FROM supplier GROUP BY ALL)
SELECT coalesce(t.slug, x.slug) AS slug, coalesce(x.name, t.name) AS name, coalesce(x.branch, t.root_branch) AS branch, coalesce(t.parent_id, x.parent) AS parent, CASE WHEN t.slug IS NULL THEN 'insert' WHEN x.slug IS NULL THEN 'keep' ELSE 'update' END AS action
FROM topics t FULL JOIN x ON x.slug = t.slug""")
def f8(topics, supplier):
    new = supplier.select(F.concat(F.lit("nation_"), (F.col("s_suppkey") % 40).cast("string")).alias("slug"), F.concat(F.lit("Topic "), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.lit("ASIA").alias("branch"), F.lit(7).alias("parent")).distinct()
    return C.sync_taxonomy(new, topics)


@query("f9_topic_tree", "part", """
, n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 5 THEN CAST(floor((p_partkey - 5) / 3) AS BIGINT) END AS parent FROM part), t AS (SELECT id, id AS ancestor, 0 AS depth FROM n UNION ALL SELECT t.id, n.parent, depth + 1 FROM t JOIN n ON n.id = t.ancestor WHERE n.parent IS NOT NULL)
SELECT id, ancestor, depth FROM t""")
def f9(part):
    return C.topic_tree(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 5, F.floor((F.col("p_partkey") - 5) / 3)).alias("parent")))


_COV = """cov AS (SELECT t.id, t.slug, t.root_branch, t.priority, count(DISTINCT p.id) AS papers, count(DISTINCT CASE WHEN relevance_llm >= 60 THEN p.id END) AS high FROM topics t LEFT JOIN paper_topics j ON j.topic_id = t.id LEFT JOIN papers p ON p.id = j.source_id GROUP BY 1,2,3,4)"""


#: A taxonomy that leaves some topics out, has its own priorities, and lists topics that the table lacks.
ADAPTERS["bible"] = """
    SELECT lower(n_name) AS slug, CASE WHEN n_nationkey % 3 = 1 THEN 'HIGH' WHEN n_nationkey % 3 = 2 THEN 'MED' ELSE 'LOW' END AS priority, r_name AS branch FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 > 0
    UNION ALL SELECT concat('absent_', lower(r_name)), 'HIGH', r_name FROM region WHERE r_regionkey > 1"""
_BIB = """, lk AS (SELECT topic_id, count(DISTINCT source_id) AS papers, count(DISTINCT CASE WHEN relevance_llm >= 60 THEN source_id END) AS high FROM paper_topics j JOIN papers p ON p.id = j.source_id GROUP BY 1),
bc AS (SELECT t.id, t.slug, root_branch, b.priority, coalesce(papers, 0) AS papers, coalesce(high, 0) AS high, b.slug IS NOT NULL AS in_bible FROM topics t LEFT JOIN bible b ON b.slug = t.slug LEFT JOIN lk ON lk.topic_id = t.id)"""


@query("f10_topic_coverage", "topics paper_topics papers bible", f"{_BIB} SELECT * FROM bc")
def f10(topics, junction, papers, bible):
    return C.topic_coverage(topics, junction, papers, bible)


@query("f11_branch_rollup", "topics paper_topics papers bible", """
, r AS (SELECT root_branch, count(DISTINCT source_id) AS papers, count(DISTINCT CASE WHEN relevance_llm >= 60 THEN source_id END) AS high FROM topics t LEFT JOIN paper_topics j ON j.topic_id = t.id LEFT JOIN papers p ON p.id = j.source_id GROUP BY 1)
SELECT root_branch, (SELECT count(DISTINCT slug) FROM bible WHERE branch = root_branch) AS topics, papers, high, CASE WHEN papers > 0 THEN round(high * 100.0::DOUBLE / papers, 1) ELSE 0 END AS high_share FROM r""")
def f11(topics, junction, papers, bible):
    return C.branch_rollup(topics, junction, papers, bible)


@query("f12_white_space", "topics paper_topics papers bible", f"{_BIB} SELECT *, (SELECT count(*) FROM bc WHERE priority = 'HIGH' AND papers = 0) AS without_papers FROM bc WHERE priority = 'HIGH' ORDER BY papers, high, slug LIMIT 15")
def f12(topics, junction, papers, bible):
    return C.white_space(C.topic_coverage(topics, junction, papers, bible))


@query("f12_missing_topics", "topics bible", "SELECT DISTINCT slug FROM bible WHERE slug NOT IN (SELECT slug FROM topics)")
def f12b(topics, bible):
    return C.missing_topics(bible, topics)


@query("f13_thin_layers", "orders lineitem molecules", """SELECT 'claims' AS layer, count(*) AS n FROM orders UNION ALL SELECT 'claims_with_sources', count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT 'claims_with_molecules', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'molecules', count(*) FROM molecules
UNION ALL SELECT 'category: ' || coalesce(CASE WHEN id % 9 > 0 THEN category END, '(uncategorized)'), count(*) FROM molecules GROUP BY 1""")
def f13b(orders, lineitem, molecules):
    links = lineitem.select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("molecule_id"), "l_quantity")
    return C.thin_layers(orders, links.where("l_quantity > 45"), links, molecules.withColumn("category", F.when(F.col("id") % 9 > 0, F.col("category"))))


@query("f13_corpus_totals", "papers paper_topics", """SELECT count(*) AS papers, count(relevance_llm) AS scored, count(*) FILTER (WHERE relevance_llm >= 60) AS ge60, count(*) FILTER (WHERE relevance_llm >= 80) AS ge80,
 count(*) FILTER (WHERE id IN (SELECT source_id FROM paper_topics)) AS tagged, count(*) FILTER (WHERE id NOT IN (SELECT source_id FROM paper_topics)) AS untagged, (SELECT count(*) FROM paper_topics) AS links FROM papers""")
def f13(papers, junction):
    return C.corpus_totals(papers, junction)


_REC = f"""{_T}, u AS (SELECT id, slug, false AS own FROM hn UNION SELECT source_id, slug, true FROM paper_topics j JOIN topics t ON t.id = j.topic_id), c AS (SELECT id, count(DISTINCT slug) AS hits, bool_or(own) AS tagged FROM u GROUP BY 1),
g AS (SELECT p.id, relevance_llm, search_query, coalesce(hits, 0) AS hits, coalesce(tagged, false) AS tagged FROM papers p LEFT JOIN c USING (id)),
rec AS (SELECT *, CASE WHEN hits = 0 THEN 'off-topic' WHEN hits = 1 THEN 'weak' ELSE 'on-topic' END AS signal,
 CASE WHEN relevance_llm IS NULL THEN 'unscored' WHEN relevance_llm >= 60 AND hits = 0 AND NOT tagged THEN 'coverage_gap' WHEN relevance_llm >= 60 THEN 'agree' WHEN relevance_llm >= 40 THEN 'borderline' WHEN hits >= 2 THEN 'disagreement' ELSE 'agree' END AS reconciliation,
 CASE WHEN relevance_llm IS NULL THEN 'review' WHEN relevance_llm >= 60 THEN 'keep' WHEN relevance_llm >= 40 THEN 'review' WHEN hits >= 2 THEN 'off_topic_check_first' ELSE 'off_topic_high_confidence' END AS action FROM g)"""


@query("f14_relevance_reconcile", "papers terms paper_topics topics", f", {_REC} SELECT * FROM rec")
def f14(papers, terms, junction, topics):
    return C.relevance_reconcile(papers, terms, junction, topics)


@query("f15_latest_audit", "audits", "SELECT source_id, audit_id, verdict, audited_at FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY audited_at DESC, audit_id DESC) AS k FROM audits) WHERE k = 1")
def f15(audits):
    return C.latest_audit(audits)


@query("f16_relevance_summary", "papers terms paper_topics topics", f", {_REC} SELECT signal, reconciliation, action, count(*) AS n FROM rec GROUP BY 1, 2, 3")
def f16(papers, terms, junction, topics):
    return C.relevance_summary(C.relevance_reconcile(papers, terms, junction, topics))


_BUCKET = "CASE WHEN {0} >= 80 AND {0} < 1000 THEN '>=80' WHEN {0} >= 60 AND {0} < 80 THEN '60-79' WHEN {0} >= 40 AND {0} < 60 THEN '40-59' WHEN {0} >= 0 AND {0} < 40 THEN '<40' END"


@query("f16_relevance_report", "papers terms paper_topics topics", f""", {_REC}, br AS (SELECT DISTINCT source_id AS id, root_branch FROM paper_topics j JOIN topics t ON t.id = j.topic_id), f AS (SELECT r.*, p.abstract, (r.id * 13) % 120 AS priority_score FROM rec r JOIN papers p USING (id)),
l AS (SELECT 'papers' AS section, 'all' AS key FROM f UNION ALL SELECT 'papers', 'citable' FROM f WHERE trim(abstract) <> '' UNION ALL SELECT 'papers', CASE WHEN tagged THEN 'tagged' ELSE 'untagged' END FROM f UNION ALL SELECT 'relevance', {_BUCKET.format('relevance_llm')} FROM f UNION ALL SELECT 'priority', {_BUCKET.format('priority_score')} FROM f
UNION ALL SELECT 'signal', signal FROM f UNION ALL SELECT 'reconciliation', reconciliation FROM f UNION ALL SELECT 'action', action FROM f UNION ALL SELECT 'branch', root_branch FROM br) SELECT section, key, count(*) AS n FROM l WHERE key IS NOT NULL GROUP BY 1, 2""")
def f16b(papers, terms, junction, topics):
    branches = junction.join(topics.select(F.col("id").alias("topic_id"), "root_branch").hint("merge"), "topic_id").groupBy(F.col("source_id").alias("id")).agg(F.collect_set("root_branch").alias("branches"))
    rec = C.relevance_reconcile(papers, terms, junction, topics).join(papers.select("id", "abstract").hint("merge"), "id").join(branches.hint("merge"), "id", "left")
    return C.relevance_report(rec.withColumn("priority_score", (F.col("id") * 13) % 120))


@query("f17_query_quality", "papers terms paper_topics topics", f", {_REC}, q AS (SELECT coalesce(nullif(search_query, ''), '(none)') AS search_query, count(*) AS total, count(*) FILTER (WHERE action IN ('off_topic_high_confidence', 'off_topic_check_first')) AS off_topic FROM rec GROUP BY 1 HAVING count(*) >= 5) SELECT *, round(off_topic * 100.0::DOUBLE / total, 1) AS off_share FROM q ORDER BY off_topic DESC, search_query LIMIT 15")
def f17(papers, terms, junction, topics):
    return C.query_quality(C.relevance_reconcile(papers, terms, junction, topics))


@query("f18_audit_pool", "scored audits", """
, k AS (SELECT source_id, max(audited_at) AS last_audited, count(*) AS audit_count FROM audits GROUP BY 1)
SELECT id, priority, last_audited, coalesce(k.audit_count, 0) AS audit_count FROM scored LEFT JOIN k ON source_id = id ORDER BY last_audited ASC NULLS FIRST, priority DESC NULLS LAST, id LIMIT 300""")
def f18(papers, audits):
    return C.audit_pool(papers.drop("audit_count"), audits, 300).select("id", "priority", "last_audited", "audit_count")


@query("f19_attach_tags", "papers paper_topics topics", """
, o AS (SELECT source_id, string_agg(slug, '|' ORDER BY root_branch, priority <> 'HIGH', slug) AS tags, string_agg(DISTINCT root_branch, '|' ORDER BY root_branch) AS branches FROM paper_topics j JOIN topics t ON t.id = j.topic_id GROUP BY 1)
SELECT id, tags, branches FROM papers LEFT JOIN o ON source_id = id""")
def f19(papers, junction, topics):
    return C.attach_tags(papers.select("id"), junction, topics)


@query("f20_audit_priority", "scored", """
, b AS (SELECT *, (CASE branch WHEN 'src1' THEN 1.5 WHEN 'src2' THEN 0.7 ELSE 1 END::DOUBLE + CASE second_branch WHEN 'en' THEN 1.25 ELSE 1 END::DOUBLE) / 2 AS times FROM scored)
SELECT id, round(100 * times * (0.28::DOUBLE * coalesce(priority / 100, 0.5::DOUBLE) + 0.08::DOUBLE * least(1.0::DOUBLE, ln(1 + citation_count::DOUBLE) / ln(201::DOUBLE)) + 0.09::DOUBLE * CASE WHEN branch = 'src3' THEN 1 ELSE 0 END
 + 0.25::DOUBLE * CASE WHEN days_since_audit IS NOT NULL THEN 1.0::DOUBLE - pow(0.5::DOUBLE, days_since_audit / 30.0::DOUBLE) WHEN audit_count > 0 THEN 0.6::DOUBLE ELSE 1 END
 + 0.18::DOUBLE * coalesce(exp(-pow(relevance_llm - 55, 2) / (2 * 22.0::DOUBLE * 22)), 0.85::DOUBLE) + 0.12::DOUBLE * CASE WHEN tagged AND has_queries THEN 0 WHEN tagged OR has_queries THEN 0.5::DOUBLE ELSE 1 END), 2) AS audit_priority FROM b""")
def f20(papers):
    papers = papers.withColumn("branches", F.array("branch", "second_branch"))
    return C.audit_priority(papers, {"src1": 1.5, "src2": 0.7, "en": 1.25}, ["src3"]).select("id", "audit_priority")


@query("f21_heuristic_rank", "scored", """
SELECT id, round(CASE WHEN days_since_audit IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, days_since_audit / 14.0::DOUBLE) END + coalesce(priority, 0.0::DOUBLE) / 100 + 0.8::DOUBLE * coalesce(1.0::DOUBLE - relevance_llm / 100.0::DOUBLE, 0.4::DOUBLE)
 + 0.6::DOUBLE * CASE WHEN tagged THEN 0 ELSE 1 END + 0.4::DOUBLE * least(1.0::DOUBLE, citation_count / 200.0::DOUBLE), 4) AS rank_score FROM scored""")
def f21(papers):
    return C.heuristic_rank(papers).select("id", "rank_score")


@query("f22_heuristic_verdict", "titled", rf"""
, w AS (SELECT *, lower(name || ' ' || abstract) AS t, string_split(tag_names, '|') AS tags FROM titled),
h AS (SELECT *, len(list_filter(tags, lambda g: len(list_filter(regexp_split_to_array(lower(g), '[^a-z0-9]+'), lambda x: length(x) > 3 AND contains(t, x))) > 0)) AS held FROM w),
q AS (SELECT id, CASE WHEN tags IS NULL THEN 20 ELSE CAST(round_even(40 + 60 * (held::DOUBLE / len(tags)), 0) AS INT) END AS tag_score,
 coalesce(relevance_llm, CASE WHEN regexp_matches(t, '(?i)(meat|beef|pork|chicken|poultry|flavou?r|aroma|volatile|umami|maillard|strecker|lipid oxidation|sensory|odou?r|hydrolysate|yeast extract|process flavou?r|precursor|thiamine|furan|sulf)') THEN 70 ELSE 30 END) AS relevance_score,
 CAST(round_even(least(100, CASE WHEN coalesce(journal, '') = '' THEN 0 WHEN {_CORE} THEN 30 ELSE 12 END + 12 * (doi IS NOT NULL)::INT + 12 * (abstract <> '')::INT + 12 * coalesce(is_review, false)::INT
  + CASE WHEN citation_count > 0 AND year > 0 THEN least(22.0::DOUBLE, citation_count::DOUBLE / greatest(1, 2026 - year) * 3) ELSE 0 END + 10 * coalesce(year >= 2018, false)::INT), 0) AS INT) AS quality_score FROM h)
SELECT *, CASE WHEN relevance_score < 40 THEN 'quarantine' WHEN relevance_score >= 60 AND tag_score >= 50 AND quality_score >= 40 THEN 'keep' ELSE 'review' END AS verdict FROM q""")
def f22(papers):
    return C.heuristic_verdict(papers.withColumn("tags", F.split("tag_names", r"\|"))).select("id", "tag_score", "relevance_score", "quality_score", "verdict")


@query("f23_repair_judgments", "audits", """
, j AS (SELECT audit_id, source_id * 0.2::DOUBLE - 20 AS relevance, CASE WHEN audit_id % 9 > 0 THEN (audit_id % 120)::DOUBLE END AS quality, (run_id * 3)::DOUBLE AS tag_fit, CASE WHEN audit_id % 3 = 0 THEN verdict ELSE 'maybe' END AS verdict FROM audits),
c AS (SELECT audit_id, greatest(0, least(100, coalesce(relevance, 50))) AS relevance, greatest(0, least(100, coalesce(quality, 50))) AS quality, greatest(0, least(100, coalesce(tag_fit, 50))) AS tag_fit, verdict FROM j)
SELECT audit_id, relevance, quality, tag_fit, CASE WHEN verdict <> 'maybe' THEN verdict WHEN relevance < 40 OR quality < 35 THEN 'quarantine' WHEN relevance >= 65 AND quality >= 55 AND tag_fit >= 55 THEN 'keep' ELSE 'review' END AS verdict,
 CASE WHEN audit_id % 2 = 0 THEN 'a|b|c|d|e|f|g|h' ELSE 'a' END AS issues, repeat('n', least(240, audit_id % 300)) AS notes FROM c""")
def f23(audits):
    text = lambda c: c.cast("double").cast("string")
    raw = audits.select("audit_id", text(F.col("source_id") * 0.2 - 20).alias("relevance"), F.when(F.col("audit_id") % 9 > 0, text(F.col("audit_id") % 120)).alias("quality"), text(F.col("run_id") * 3).alias("tag_fit"),
                        F.when(F.col("audit_id") % 3 == 0, F.col("verdict")).otherwise("maybe").alias("verdict"), F.when(F.col("audit_id") % 2 == 0, F.split(F.lit("a,b,c,d,e,f,g,h,i"), ",")).otherwise(F.array(F.lit("a"))).alias("issues"),
                        F.expr("repeat('n', cast(audit_id % 300 as int))").alias("notes"))
    return C.repair_judgments(raw)


@query("f24_branch_boost", "audits scored", """
, b AS (SELECT DISTINCT branch FROM scored UNION SELECT DISTINCT second_branch FROM scored), p AS (SELECT branch, 0.4::DOUBLE + ascii(right(branch, 1)) % 7 * 0.6::DOUBLE AS boost FROM b),
r AS (SELECT branch, verdict FROM audits JOIN scored ON id = source_id WHERE branch <> 'src5' UNION ALL SELECT second_branch, verdict FROM audits JOIN scored ON id = source_id WHERE branch <> 'src5'), s AS (SELECT branch, avg(CASE WHEN verdict = 'quarantine' THEN 1.0::DOUBLE ELSE 0 END) AS share FROM r GROUP BY 1),
m AS (SELECT branch, coalesce(boost + 0.5::DOUBLE * (1 + 1.2::DOUBLE * share - boost), boost) AS moved FROM p LEFT JOIN s USING (branch))
SELECT branch, round(greatest(0.5::DOUBLE, least(3.0::DOUBLE, 1 + 0.8::DOUBLE * (moved - 1))), 3) AS boost FROM m""")
def f24(audits, papers):
    branches = papers.select("branch").union(papers.select("second_branch")).distinct()
    previous = branches.withColumn("boost", 0.4 + F.ascii(F.right("branch", F.lit(1))) % 7 * 0.6)
    results = audits.join(papers.select(F.col("id").alias("source_id"), "branch", F.array("branch", "second_branch").alias("branches")), "source_id").where("branch <> 'src5'")
    return C.update_branch_boost(previous, results)


@query("f25_audit_run_report", "audits papers paper_topics topics", """
, n AS (SELECT source_id, string_agg(DISTINCT slug, ', ' ORDER BY slug) AS topics FROM paper_topics j JOIN topics t ON t.id = j.topic_id GROUP BY 1)
SELECT a.audit_id, a.source_id, a.verdict, p.name, n.topics FROM audits a JOIN papers p ON p.id = a.source_id LEFT JOIN n ON n.source_id = a.source_id WHERE run_id = (SELECT run_id FROM audits ORDER BY audited_at DESC, run_id DESC LIMIT 1)""")
def f25(audits, papers, junction, topics):
    out = C.audit_run_report(audits, papers.withColumn("priority", F.lit(0.0)), junction, topics)
    return out.select("audit_id", "source_id", "verdict", "name", "topics")


def _list_sql(c):
    kept = f"list_filter(list_transform(string_split(coalesce({c}, ''), '|'), lambda x: trim(x)), lambda x: x <> '')[1:3]"
    return f"CASE WHEN len({kept}) <= 1 THEN array_to_string({kept}, '') ELSE array_to_string({kept}[1:len({kept}) - 1], ', ') || ' and ' || {kept}[len({kept})] END AS {c}"


@query("f26_tailored_abstract", "titled", rf"""
, f AS (SELECT id, relevance_llm, main_claim, trim(regexp_replace(abstract, '\s+', ' ', 'g')) AS flat, {_list_sql('matrix')}, {_list_sql('method')}, {_list_sql('pathway')}, {_list_sql('sensory')} FROM titled WHERE abstract <> '' AND main_claim <> ''),
s AS (SELECT *, coalesce(nullif(regexp_extract(flat, '^(.*?[.!?])\s+[A-Z]', 1), ''), flat) AS first FROM f),
c AS (SELECT *, CASE WHEN length(first) > 400 THEN regexp_replace(regexp_replace(substr(first, 1, 400), ' [^ ]*$', ''), '[,;:]+$', '') || ' …' ELSE first END AS cut, 'Main claim: ' || regexp_replace(main_claim, '^\s+|\s+$', '', 'g') AS claim FROM s)
SELECT id, relevance_llm, concat_ws(' ', CASE WHEN regexp_matches(trim(cut), '[.!?…]$') THEN trim(cut) ELSE trim(cut) || '.' END,
 CASE WHEN matrix <> '' AND method <> '' THEN 'The work concerns ' || matrix || ', using ' || method || '.' WHEN matrix <> '' THEN 'The work concerns ' || matrix || '.' WHEN method <> '' THEN 'The work uses ' || method || '.' END,
 CASE WHEN regexp_matches(trim(claim), '[.!?…]$') THEN trim(claim) ELSE trim(claim) || '.' END,
 'For Lumenary, this ' || CASE WHEN pathway <> '' AND sensory <> '' THEN 'is evidence on ' || pathway || ' chemistry with reported ' || sensory || ' sensory relevance for building meaty flavor.'
  WHEN pathway <> '' THEN 'is evidence on ' || pathway || ' chemistry relevant to building meaty flavor.' WHEN sensory <> '' THEN 'carries reported ' || sensory || ' sensory relevance for building meaty flavor.' ELSE 'adds source-backed evidence for building meaty flavor.' END) AS tailored FROM c""")
def f26(papers):
    return C.tailored_abstract(papers.withColumns({c: F.split(c, r"\|") for c in ("matrix", "method", "pathway", "sensory")}), "Lumenary")


@query("f27_profile", "papers", """
, n AS (SELECT count(*) AS rows FROM papers), u AS (
SELECT 'journal' AS "column", count(journal) AS filled, count(DISTINCT journal) AS "distinct" FROM papers UNION ALL SELECT 'year', count(year), count(DISTINCT year) FROM papers UNION ALL SELECT 'relevance_llm', count(relevance_llm), count(DISTINCT relevance_llm) FROM papers
UNION ALL SELECT 'doi', count(doi), count(DISTINCT doi) FROM papers UNION ALL SELECT 'is_review', count(is_review), count(DISTINCT is_review) FROM papers)
SELECT rows, u.*, CASE WHEN filled = 0 THEN 'empty' WHEN "distinct" = 1 AND filled = rows THEN 'constant' WHEN filled < rows THEN 'partial' ELSE 'full' END AS kind FROM u, n""")
def f27(papers):
    return C.profile_table(papers.select("journal", "year", "relevance_llm", "doi", "is_review"))


@query("f27_top_values", "papers", """
, u AS (SELECT 'journal' AS "column", journal AS value FROM papers UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM papers UNION ALL SELECT 'lang', search_query FROM papers), c AS (SELECT "column", value, count(*) AS n FROM u WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT "column", value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k FROM c) WHERE k <= 12""")
def f27b(papers):
    return C.top_values(papers.withColumnRenamed("search_query", "lang"), ["journal", "year", "lang"])


@query("f28_system_counts", "papers audits paper_topics", """SELECT 'audits' AS metric, count(*) AS n FROM audits UNION ALL SELECT 'paper_topics', count(*) FROM paper_topics UNION ALL SELECT 'papers', count(*) FROM papers
UNION ALL SELECT 'quarantined_above_gate', count(*) FROM papers WHERE relevance_llm >= 60 AND id IN (SELECT source_id FROM audits WHERE verdict = 'quarantine')""")
def f28(papers, audits, junction):
    above = papers.where("relevance_llm >= 60").join(audits.where("verdict = 'quarantine'").select(F.col("source_id").alias("id")), "id", "left_semi")
    return C.system_counts({"papers": papers, "audits": audits, "paper_topics": junction, "quarantined_above_gate": above})
