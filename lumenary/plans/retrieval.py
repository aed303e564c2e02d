"""Retrieval and evaluation queries. Questions are benchmark passages, documents the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..operators import retrieval as R
from ..operators import vectors as V
from ..registry import query
from ..session import checkpointed

_quoted = lambda words: "(" + ",".join(f"'{w}'" for w in words) + ")"
#: Words of the documents with their positions, all words of the questions, and the terms of an OR query.
_IX = rf"""wp AS (SELECT id, word AS term, place FROM (SELECT doc_id AS id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+') AS w FROM documents)) WHERE word NOT IN {_quoted(R.INDEX_STOP)}),
ix AS (SELECT id, term, count(*) AS tf, string_agg(place, ',' ORDER BY place) AS places FROM wp GROUP BY 1, 2)"""
_QT = rf"qt AS (SELECT DISTINCT qid, term FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS term FROM benchmark) WHERE term NOT IN {_quoted(R.INDEX_STOP)})"
_TM = rf"tm AS (SELECT DISTINCT qid, unnest((list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+'), lambda t: length(t) >= 3 AND t NOT IN {_quoted(R.STOP_WORDS)}))[1:24]) AS term FROM (SELECT item_id AS qid, text FROM benchmark))"
#: All-terms hits: for each entry the latest place of every term; where the earliest of these first appears, a cover ends.
_AND = f"""{_IX}, {_QT}, gt AS (SELECT id FROM papers WHERE relevance_llm IS NULL OR relevance_llm >= 60), wt AS (SELECT qid, count(*) AS wanted FROM qt GROUP BY 1),
fu AS (SELECT qid, id, any_value(wanted) AS wanted FROM qt JOIN ix USING (term) JOIN wt USING (qid) WHERE id IN (FROM gt) GROUP BY qid, id HAVING count(*) = any_value(wanted)),
en AS (SELECT qid, id, wanted, term, place, row_number() OVER (PARTITION BY qid, id ORDER BY place) AS i FROM fu JOIN qt USING (qid) JOIN wp USING (id, term)),
la AS (SELECT a.qid, a.id, a.wanted, a.i, a.place, b.term, max(b.i) AS i_b, max(b.place) AS place_b FROM en a JOIN en b ON a.qid = b.qid AND a.id = b.id AND b.i <= a.i GROUP BY 1, 2, 3, 4, 5, 6),
ru AS (SELECT qid, id, i, place, min(i_b) AS f, min(place_b) AS f_place FROM la GROUP BY qid, id, wanted, i, place HAVING count(*) = wanted),
co AS (SELECT qid, id, f, f_place, min(i) AS i, min(place) AS place FROM ru GROUP BY 1, 2, 3, 4),
st AS (SELECT qid, id, round(sum(0.1::DOUBLE / (1 + (place - f_place) - (i - f))), 6) AS rank FROM co GROUP BY 1, 2),
strict AS (SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank DESC, id) AS nth FROM st QUALIFY nth <= 6)"""
_FB = f"""{_AND}, lo AS (SELECT qid, id, round(0.1::DOUBLE * sum(tf), 6) AS rank FROM qt JOIN ix USING (term) WHERE id IN (FROM gt) AND qid NOT IN (SELECT qid FROM strict) GROUP BY 1, 2),
fb AS (SELECT *, false AS used_fallback FROM strict UNION ALL SELECT qid, id, rank, row_number() OVER (PARTITION BY qid ORDER BY rank DESC, id) AS nth, true FROM lo QUALIFY nth <= 6)"""


def texts_of(documents):
    return documents.select(F.col("doc_id").alias("id"), "text")


def questions_of(benchmark):
    return benchmark.select(F.col("item_id").alias("qid"), "text")


def index_of(documents, terms):
    return checkpointed(R.build_term_index(texts_of(documents), terms=terms))


def search(documents, benchmark, papers):
    terms = R.question_terms(questions_of(benchmark))
    return R.lexical_search_with_fallback(index_of(documents, terms), terms, papers)


@query("r1_term_index", "documents", f", {_IX} SELECT * FROM ix")
def r1(documents):
    return R.build_term_index(texts_of(documents)).withColumn("places", F.array_join(F.transform("places", lambda p: p.cast("string")), ","))


@query("r2_lexical_search", "documents benchmark papers", f", {_AND} SELECT * FROM strict")
def r2(documents, benchmark, papers):
    terms = R.question_terms(questions_of(benchmark))
    return R.lexical_search(index_of(documents, terms), terms, papers)


#: Questions of a few words, so that many documents hold all of them: the fourth to sixth word of each passage.
ADAPTERS["short_questions"] = "SELECT item_id, concat_ws(' ', split_part(text, ' ', 4), split_part(text, ' ', 5), split_part(text, ' ', 6)) AS text FROM benchmark"


@query("r2_cover_density", "documents short_questions papers", f", {_AND.replace('FROM benchmark', 'FROM short_questions')} SELECT * FROM strict")
def r2b(documents, questions, papers):
    terms = R.question_terms(questions_of(questions))
    return R.lexical_search(index_of(documents, terms), terms, papers)


@query("r3_lexical_fallback", "documents benchmark papers", f", {_FB} SELECT * FROM fb")
def r3(documents, benchmark, papers):
    return search(documents, benchmark, papers)


@query("r4_or_terms", "benchmark", f", {_TM} SELECT * FROM tm")
def r4(benchmark):
    return R.or_terms(questions_of(benchmark))


@query("r5_keyword_count", "papers", """, h AS (SELECT id, relevance_llm, (length(abstract) - length(replace(lower(abstract), 'that', ''))) // 4 + (length(abstract) - length(replace(lower(abstract), 'with', ''))) // 4 AS hits FROM papers)
SELECT id, hits, round(hits * (0.5::DOUBLE + coalesce(relevance_llm, 0) / 100), 4) AS score FROM h WHERE hits > 0 ORDER BY score DESC, hits DESC, id DESC LIMIT 50""")
def r5(papers):
    return R.keyword_count_search(papers.withColumnRenamed("abstract", "text"), ["that", "with", "of"], 50)


@query("a10_admit_vectors", "embeddings", "SELECT vec_id, label, CASE WHEN len(embedding) <> 64 THEN 'dimension' WHEN vec_id % 50 = 3 THEN 'zero' WHEN vec_id % 70 = 5 THEN 'not finite' END AS reason FROM embeddings")
def a10(embeddings):
    spoiled = embeddings.withColumn("embedding", F.when(F.col("vec_id") % 50 == 3, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 70 == 5, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    return R.admit_vectors(spoiled, 64).select("vec_id", "label", F.when((F.col("vec_id") % 50 == 3) & (F.col("vec_id") % 70 == 5), "zero").otherwise(F.col("reason")).alias("reason"))


_COS = "s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)"


@query("r6_vector_search", "embeddings", f", {_COS} SELECT qid, vec_id, similarity, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS nth FROM s) WHERE nth <= 20")
def r6(embeddings):
    return R.vector_search(embeddings, embeddings.where("vec_id % 100 = 0"))


@query("r6_lsh_search", "embeddings")
def r6b(embeddings):
    return R.lsh_search(embeddings, embeddings.where("vec_id % 100 = 0"))


@query("r6_inverted_file_search", "embeddings")
def r6c(embeddings):
    return V.inverted_search(V.build_inverted_file(embeddings), embeddings.where("vec_id % 100 = 0"))


@query("r6_inverted_file_recall", "embeddings")
def r6d(embeddings):
    return V.recall_by_probes(V.build_inverted_file(embeddings), embeddings.where("vec_id % 100 = 0"))


@query("r7_check_vector_space", "embeddings", "SELECT vec_id, 1.0::DOUBLE AS cosine, 'vector' AS mode FROM embeddings ORDER BY label, vec_id LIMIT 1")
def r7(embeddings):
    return R.check_vector_space(embeddings.withColumn("length", F.col("label")), embeddings.withColumn("embedding", F.transform("embedding", lambda x: x * 2)))


_REL = "rl AS (SELECT a.vec_id * 100000 + b.vec_id AS relation_id, a.vec_id AS src, b.vec_id AS dst, (a.vec_id * 7 + b.vec_id * 3) % 11 AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND b.vec_id - a.vec_id <= 5)"
_HOP = f"{_REL}, sd AS (SELECT label AS qid, vec_id AS item, vec_id % 7 AS rank FROM embeddings), en AS (SELECT relation_id, weight, src AS item FROM rl UNION SELECT relation_id, weight, dst FROM rl), hp AS (SELECT qid, relation_id, weight, nth FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, relation_id) AS nth FROM (SELECT DISTINCT qid, relation_id, weight FROM sd JOIN en USING (item))) WHERE nth <= 10)"


def relations(e):
    """Each item with the next five ids of its label, found by id."""
    near = e.select("label", "vec_id", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("dst"))
    pairs = near.join(e.select("label", F.col("vec_id").alias("dst")).hint("merge"), ["label", "dst"])
    return pairs.select((F.col("vec_id") * 100000 + F.col("dst")).alias("relation_id"), F.col("vec_id").alias("src"), "dst", ((F.col("vec_id") * 7 + F.col("dst") * 3) % 11).alias("weight"))


def seeds(e):
    return e.select(F.col("label").alias("qid"), F.col("vec_id").alias("item"), (F.col("vec_id") % 7).alias("rank"))


@query("r8_expand_one_hop", "embeddings", f", {_HOP} SELECT * FROM hp")
def r8(e):
    return R.expand_one_hop(seeds(e), relations(e), 10)


_MG = f"{_HOP}, nb AS (SELECT qid, unnest([src, dst]) AS item, nth AS rank FROM hp JOIN rl USING (relation_id)), bo AS (SELECT qid, item, 0 AS o, rank, 'seed' AS origin FROM sd UNION ALL SELECT qid, item, 1, rank, 'graph_neighbor' FROM nb), fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, item ORDER BY o, rank) AS k FROM bo) WHERE k = 1), mg AS (SELECT qid, item, rank, origin, row_number() OVER (PARTITION BY qid ORDER BY o, rank, item) AS pos FROM fi)"


def merged(e):
    hop = R.expand_one_hop(seeds(e), relations(e), 10).join(relations(e).drop("weight").hint("merge"), "relation_id")
    near = hop.select("qid", F.explode(F.array("src", "dst")).alias("item"), F.col("nth").cast("long").alias("rank"))
    return R.merge_seed_expansion(seeds(e), near)


@query("r9_merge_seed_expansion", "embeddings", f", {_MG} SELECT * FROM mg")
def r9(e):
    return merged(e)


_EV = "ev AS (SELECT vec_id AS item, vec_id % 13 AS source_id, vec_id % 5 AS chunk_id FROM embeddings WHERE vec_id % 3 > 0 UNION ALL SELECT vec_id, vec_id % 17, 9 FROM embeddings WHERE vec_id % 3 = 2)"


def evidence(e):
    return e.where("vec_id % 3 > 0").select(F.col("vec_id").alias("item"), (F.col("vec_id") % 13).alias("source_id"), (F.col("vec_id") % 5).alias("chunk_id")).unionByName(e.where("vec_id % 3 = 2").select(F.col("vec_id").alias("item"), (F.col("vec_id") % 17).alias("source_id"), F.lit(9).cast("long").alias("chunk_id")))


@query("r10_attach_evidence", "embeddings", f", {_MG}, {_EV} SELECT qid, item, coalesce(string_agg(DISTINCT CAST(source_id AS VARCHAR), '|' ORDER BY CAST(source_id AS VARCHAR)), '') AS source_ids, coalesce(string_agg(DISTINCT CAST(chunk_id AS VARCHAR), '|' ORDER BY CAST(chunk_id AS VARCHAR)), '') AS chunk_ids FROM mg LEFT JOIN ev USING (item) GROUP BY 1, 2")
def r10(e):
    return R.attach_evidence(merged(e), evidence(e))


#: Evidence of each question: its hits in order, each with the hit itself and, for every other one, a second source.
def packed(documents, benchmark, papers):
    hits = search(documents, benchmark, papers).select("qid", F.col("nth").alias("pos"), F.col("id").alias("source_id"))
    sources = F.when(F.col("pos") % 2 == 0, F.array("source_id", F.col("source_id") + 1)).otherwise(F.array("source_id"))
    texts = documents.select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    return R.pack_evidence(hits.join(texts.hint("merge"), "source_id").select("qid", "pos", sources.alias("source_ids"), "content"), 3000)


@query("r11_pack_evidence", "documents benchmark papers", f""", {_FB}, it AS (SELECT qid, nth AS pos, id, substr(text, 1, 1200) AS content, CASE WHEN nth % 2 = 0 THEN 2 ELSE 1 END AS n FROM fb JOIN documents ON doc_id = id),
ct AS (SELECT *, lead(length(content)) OVER (PARTITION BY qid ORDER BY pos) AS ahead FROM it), pk AS (
 SELECT qid, pos, id, content, n, least(n, CASE WHEN length(content) = 0 THEN n ELSE 3000 // length(content) END) AS took, 3000 - least(n, CASE WHEN length(content) = 0 THEN n ELSE 3000 // length(content) END) * length(content) AS left_ FROM ct WHERE pos = 1 AND length(content) <= 3000
 UNION ALL SELECT c.qid, c.pos, c.id, c.content, c.n, least(c.n, CASE WHEN length(c.content) = 0 THEN c.n ELSE p.left_ // length(c.content) END), p.left_ - least(c.n, CASE WHEN length(c.content) = 0 THEN c.n ELSE p.left_ // length(c.content) END) * length(c.content) FROM pk p JOIN ct c ON c.qid = p.qid AND c.pos = p.pos + 1 WHERE length(c.content) <= p.left_)
SELECT qid, CAST(pos AS INTEGER) AS pos, id + s AS source_id, content FROM pk, range(0, 2) t(s) WHERE s < took""")
def r11(documents, benchmark, papers):
    return packed(documents, benchmark, papers)


@query("r12_source_block", "papers", r""", f AS (SELECT *, trim(regexp_replace(abstract, '\s+', ' ', 'g')) AS flat FROM papers)
SELECT id, '[' || id || '] ' || coalesce(nullif(trim(name), ''), '(untitled)') || ' (' || concat_ws(' · ', CAST(year AS VARCHAR), journal) || ') ' || coalesce(nullif(CASE WHEN length(flat) <= 500 THEN flat ELSE regexp_replace(substr(flat, 1, 500), ' \S*$', '') || '…' END, ''), '(no abstract)') AS block FROM f""")
def r12(papers):
    return R.source_block(papers)


@query("r13_claims_per_source", "claims orders", "SELECT claim_id, source_id, confidence, nth FROM (SELECT claim_id, source_id, ph + tier_code AS confidence, row_number() OVER (PARTITION BY source_id ORDER BY ph + tier_code DESC NULLS LAST, claim_id) AS nth FROM claims WHERE source_id IN (SELECT o_orderkey FROM orders)) WHERE nth <= 5")
def r13(claims, orders):
    rows = claims.select("claim_id", "source_id", (F.col("ph") + F.col("tier_code")).alias("confidence"))
    return R.claims_per_source(rows, orders.select(F.col("o_orderkey").alias("source_id")))


@query("r14_consensus_tally", "documents benchmark papers", f", {_FB}, sn AS (SELECT qid, id, CASE (qid + id) % 5 WHEN 0 THEN 'agree' WHEN 1 THEN 'oppose' WHEN 2 THEN 'neutral' WHEN 3 THEN 'odd' END AS stance FROM fb) SELECT qid, count(*) FILTER (WHERE stance = 'agree') AS agree, count(*) FILTER (WHERE stance = 'oppose') AS oppose, count(*) FILTER (WHERE stance = 'neutral') AS neutral, count(*) FILTER (WHERE stance IS NULL OR stance = 'odd') AS unassessed, count(*) AS total FROM sn GROUP BY 1")
def r14(documents, benchmark, papers):
    found = search(documents, benchmark, papers)
    x = (F.col("qid") + F.col("id")) % 5
    stances = found.select("qid", "id", F.when(x == 0, "agree").when(x == 1, "oppose").when(x == 2, "neutral").when(x == 3, "odd").alias("stance")).where("stance IS NOT NULL")
    return R.consensus_tally(found, stances)


@query("r15_conversation_query", "turns", "SELECT conversation_id, substr(string_agg(content, ' ' ORDER BY turn_index DESC), 1, 600) AS query FROM turns WHERE role = 'user' AND trim(content) <> '' GROUP BY 1")
def r15(turns):
    return R.conversation_query(turns)


@query("r16_clean_history", "turns", r""", k AS (SELECT conversation_id, turn_index, role, substr(trim(content), 1, 200) AS content, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_index DESC) AS back FROM turns WHERE role IN ('user', 'assistant') AND trim(content) <> ''),
l AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY turn_index) AS u FROM k WHERE back <= 6),
c AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conversation_id ORDER BY turn_index) THEN 1 ELSE 0 END AS ch FROM l WHERE u > 0), i AS (SELECT *, sum(ch) OVER (PARTITION BY conversation_id ORDER BY turn_index) AS island FROM c)
SELECT conversation_id, role, min(turn_index) AS turn_index, string_agg(content, chr(10) ORDER BY turn_index) AS content FROM i GROUP BY conversation_id, island, role""")
def r16(turns):
    return R.clean_history(turns)


@query("k1_retrieval_eval", "documents benchmark papers", f", {_FB} SELECT b.item_id AS qid, count(id) AS hits, coalesce(bool_or(used_fallback), false) AS used_fallback FROM benchmark b LEFT JOIN fb ON fb.qid = b.item_id GROUP BY 1")
def k1(documents, benchmark, papers):
    return R.retrieval_eval(questions_of(benchmark), search(documents, benchmark, papers))


@query("k2_citation_check", "documents benchmark papers", f""", {_FB}, kn AS (SELECT qid, id FROM fb), an AS (SELECT DISTINCT qid, unnest([CASE WHEN id % 2 = 0 THEN id ELSE id + 1000000 END]) AS c FROM fb WHERE nth <= 3)
SELECT q.qid, coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM an WHERE an.qid = q.qid), '') AS cited, coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM an WHERE an.qid = q.qid AND c NOT IN (SELECT id FROM kn WHERE kn.qid = q.qid)), '') AS invented,
coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM kn WHERE kn.qid = q.qid AND id NOT IN (SELECT c FROM an WHERE an.qid = q.qid)), '') AS ignored FROM (SELECT DISTINCT qid FROM fb) q""")
def k2(documents, benchmark, papers):
    found = search(documents, benchmark, papers)
    refs = found.where("nth <= 3").withColumn("c", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1000000))
    answers = refs.groupBy("qid").agg(F.concat_ws(" and ", F.collect_list(F.concat(F.lit("see ["), F.col("c"), F.lit("]")))).alias("answer"))
    return R.citation_check(answers, found)


_PT = "pt AS (SELECT o_custkey AS qid, o_orderkey % 4 AS file, o_orderkey AS line, CAST(o_orderkey % 10 AS DOUBLE) AS grounded, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS cited, CAST(o_orderkey % 8 AS DOUBLE) AS covered FROM orders), mg AS (SELECT qid, grounded, cited, covered FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY file, line) AS k FROM pt) WHERE k = 1)"


def partials(orders):
    k = F.col("o_orderkey")
    return R.merge_partials(orders.select(F.col("o_custkey").alias("qid"), (k % 4).alias("file"), k.alias("line"), (k % 10).cast("double").alias("grounded"), F.when(k % 7 > 0, (k % 9).cast("double")).alias("cited"), (k % 8).cast("double").alias("covered")))


@query("k3_merge_partials", "orders", f", {_PT} SELECT * FROM mg")
def k3(orders):
    return partials(orders)


@query("k3_average_scores", "orders", f", {_PT} SELECT count(*) AS n, round(avg(grounded), 1) AS grounded, round(avg(cited), 1) AS cited, round(avg(covered), 1) AS covered FROM mg WHERE cited IS NOT NULL")
def k3b(orders):
    return R.average_scores(partials(orders))


_JQ = """pr AS (SELECT CASE WHEN d.n_chars < 300 THEN 'quarantine' WHEN d.n_chars > 4000 THEN 'keep' ELSE 'review' END AS verdict, CASE WHEN l.quality = 0 THEN 'quarantine' WHEN l.toxic = 1 THEN 'review' ELSE 'keep' END AS gold FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT verdict, gold, count(*)::DOUBLE AS n FROM pr GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE verdict = gold) AS same, sum(n) FILTER (WHERE verdict = 'quarantine' AND gold = 'quarantine') AS tp, sum(n) FILTER (WHERE verdict = 'quarantine') AS v, sum(n) FILTER (WHERE gold = 'quarantine') AS g FROM c),
m AS (SELECT sum(a * b) AS ab FROM (SELECT verdict AS k, sum(n) AS a FROM c GROUP BY 1) JOIN (SELECT gold AS k, sum(n) AS b FROM c GROUP BY 1) USING (k))"""


@query("k4_judge_quality", "documents labels", f", {_JQ} SELECT CAST(n AS BIGINT) AS n, round(coalesce(tp, 0) / v, 4) AS precision, round(coalesce(tp, 0) / g, 4) AS recall, round((same / n - ab / (n * n)) / (1 - ab / (n * n)), 4) AS kappa FROM t, m")
def k4(documents, labels):
    pairs = documents.join(labels, "doc_id").select(F.when(F.col("n_chars") < 300, "quarantine").when(F.col("n_chars") > 4000, "keep").otherwise("review").alias("verdict"), F.when(F.col("quality") == 0, "quarantine").when(F.col("toxic") == 1, "review").otherwise("keep").alias("gold"))
    return R.judge_quality(pairs)
