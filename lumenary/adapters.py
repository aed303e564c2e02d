"""Projections of the given tables onto the corpus schemas: papers, topics, molecules, claims, people, telemetry and others.

The same text runs in Spark and in the SQL that checks the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import table

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ADAPTERS = {
    "papers": """
        SELECT d.doc_id AS id, substr(d.text,1,80) AS name, d.text AS abstract, d.source AS journal, d.lang AS search_query,
               CAST(2000 + d.doc_id % 27 AS INT) AS year, CAST((d.doc_id*37) % 400 AS INT) AS citation_count,
               CASE WHEN l.quality IS NULL THEN NULL ELSE CAST(l.quality*55 + d.doc_id % 45 AS INT) END AS relevance_llm,
               CASE WHEN d.doc_id % 10 = 0 THEN NULL
                    ELSE concat('10.', CAST(1000 + d.doc_id % 7 AS STRING), '/', CAST(d.doc_id AS STRING)) END AS doi,
               CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.doc_id % 3 = 0 END AS is_review,
               concat('Ann ', translate(CAST(1000 + d.doc_id % 97 AS STRING),'0123456789','abcdefghij'), ' Poe; Bo ',
                      translate(CAST(1000 + d.doc_id % 53 AS STRING),'0123456789','abcdefghij'), ' Lee') AS authors
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "topics": """
        SELECT n_nationkey AS id, lower(n_name) AS slug, n_name AS name, n_regionkey AS parent_id, r_name AS root_branch,
               CASE WHEN n_nationkey % 3 = 0 THEN 'MED' ELSE 'HIGH' END AS priority
        FROM nation JOIN region ON r_regionkey = n_regionkey""",
    "paper_topics": """
        SELECT doc_id AS source_id, CAST(doc_id % 23 AS INT) AS topic_id FROM documents WHERE doc_id % 5 < 3
        UNION SELECT doc_id, CAST((doc_id*7) % 23 AS INT) FROM documents WHERE doc_id % 5 = 0""",
    "molecules": """
        SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS chem_group,
               CASE WHEN p_size % 3 = 0 THEN 'Maillard' WHEN p_size % 3 = 1 THEN 'Lipid oxidation' END AS process FROM part""",
    "molecule_odours": "SELECT DISTINCT l_partkey AS molecule_id, l_suppkey AS odour_id FROM lineitem WHERE l_quantity < 10",
    "odours": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS odour_category FROM supplier",
    "kg_papers": "SELECT o_orderkey AS id, o_orderpriority AS label, CAST(floor(o_totalprice) AS BIGINT) % 101 AS relevance FROM orders",
    "paper_molecules": "SELECT DISTINCT l_orderkey AS source_id, l_partkey AS molecule_id FROM lineitem",
    "claims": """
        SELECT concat(CAST(l_orderkey AS STRING),'-',CAST(l_linenumber AS STRING),'-',CAST(l_partkey AS STRING),'-',CAST(l_suppkey AS STRING)) AS claim_id,
               l_partkey % 200 AS subject, l_returnflag AS axis, l_suppkey % 10 AS object,
               CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS polarity, l_linenumber % 4 AS tier_code, l_suppkey % 9 AS method_code,
               l_partkey % 5 AS directness_code, l_orderkey AS source_id, l_orderkey % 50 AS source_group,
               CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE concat('m', CAST(l_orderkey % 3 AS STRING)) END AS matrix,
               l_quantity * 4 AS temp_c, 4 + (l_orderkey % 5) AS ph, l_extendedprice / 1000 AS low, l_extendedprice / 1000 + 5 AS high
        FROM lineitem""",
    "people": """
        SELECT c_custkey AS id, concat('Dr. Ann ', translate(CAST(1000 + c_custkey % 97 AS STRING),'0123456789','abcdefghij'), ' Poé (emer.)') AS name,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS current_org, n_name AS country,
               CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS relevance_score
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "telemetry": """
        SELECT event_id, user_id AS session_id, ts AS created_at,
               CASE event_type WHEN 'signup' THEN 'session.started' WHEN 'view' THEN 'scene.viewed' WHEN 'click' THEN 'module.clicked'
                               WHEN 'purchase' THEN 'oracle.completed' ELSE 'oracle.failed' END AS name,
               CASE event_id % 4 WHEN 0 THEN 'oracle' WHEN 1 THEN 'research' WHEN 2 THEN 'map' ELSE 'papers' END AS scene,
               CASE WHEN event_type = 'purchase' THEN CAST(floor(value*10) AS BIGINT) END AS duration_ms
        FROM events""",
    "turns": "SELECT conv_id AS conversation_id, turn AS turn_index, role, text AS content FROM conversations",
    # A curated reference library: the parts again, named apart, some under a CAS number that molecules carry too.
    "library": """
        SELECT p_partkey AS entry_no, concat(CAST(50 + p_partkey % 700 AS STRING), '-', CAST(10 + p_partkey % 90 AS STRING), '-', CAST(p_partkey % 10 AS STRING)) AS cas_number,
               CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN '  ' ELSE concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE ', ' END, CAST(p_partkey % 400 AS STRING)) END AS compound,
               CASE WHEN p_size % 4 = 0 THEN 'Maillard' WHEN p_size % 4 = 1 THEN 'Lipid oxidation' WHEN p_size % 4 = 2 THEN 'Both' END AS likely_process,
               p_type AS chemical_group, p_brand AS subgroup, CASE WHEN p_size % 5 = 0 THEN 'roasted, fatty' WHEN p_size % 5 = 1 THEN 'green, sweet' ELSE 'meaty' END AS odor_descriptor,
               CASE WHEN p_size % 4 = 0 THEN '0.5' WHEN p_size % 4 = 1 THEN '1-3, in water' WHEN p_size % 4 = 2 THEN '<2, in oil' END AS odor_threshold,
               CASE WHEN p_size % 2 = 0 THEN '[beef, pork][lamb]' WHEN p_size % 3 = 0 THEN '[beef]' END AS cooked_meats_reported,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 10 END AS beef_relevance_score
        FROM part""",
    "compounds": """
        SELECT p_partkey AS id, concat(p_name, ' ', CAST(p_partkey % 400 AS STRING)) AS name,
               CASE WHEN p_partkey % 5 < 2 THEN concat(CAST(50 + p_partkey % 700 AS STRING), '-', CAST(10 + p_partkey % 90 AS STRING), '-', CAST(p_partkey % 10 AS STRING)) END AS cas,
               p_type AS category FROM part""",
}


def needed(names: tuple[str, ...]) -> list[str]:
    return [n for n in ADAPTERS if n in names]


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter, or a given table, as a DataFrame; nothing is registered in the session."""
    if name in GIVEN:
        return table(spark, sf_dir, name)
    sql = ADAPTERS[name]
    used = {t: table(spark, sf_dir, t) for t in GIVEN if re.search(rf"(FROM|JOIN) {t}\b", sql)}
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql), **used)


def oracle(names: tuple[str, ...], body: str) -> str:
    """SQL with the adapters as common table expressions; `body` may add its own after a comma."""
    parts = ", ".join(f"{n} AS ({ADAPTERS[n]})" for n in needed(names))
    body = body.strip()
    if not parts:
        return f"WITH RECURSIVE {body[1:]}" if body.startswith(",") else body
    return f"WITH RECURSIVE {parts} {body}"
