"""Claim queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..operators import claims as E
from ..registry import query

ADAPTERS["studies"] = """
    SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'Review' WHEN 1 THEN 'experimental' WHEN 2 THEN 'method' WHEN 3 THEN 'Modeling' WHEN 4 THEN 'other' WHEN 5 THEN 'survey' END AS study_type,
           CASE c_nationkey % 6 WHEN 0 THEN 'GC-MS;GC-Olfactometry' WHEN 1 THEN 'HS-SPME;trained panel;descriptive analysis' WHEN 2 THEN 'titration' WHEN 3 THEN 'lipidomics' WHEN 4 THEN 'OAV' END AS methods,
           CASE c_custkey % 6 WHEN 0 THEN 'beef;broth' WHEN 1 THEN 'beef analogue' WHEN 2 THEN 'soy isolate' WHEN 3 THEN 'model system' WHEN 4 THEN 'water' END AS matrices FROM customer"""
#: Names for the codes of the claims adapter: scored names, and texts from which the names and factors are derived.
TIER = ["T1_experimental", "T2_review", "T3_inferred", "T4_conjecture"]
METHOD = ["gco_aeda_quant", "gcms_quantified", "sensory_trained", "gcms_identification", "model_system", "consumer_panel", "in_silico", "library_compilation", "unspecified"]
DIRECT = ["target_matrix", "analogous_matrix", "model_system", "extrapolated", "hearsay"]
STUDY_TEXTS = ["Experimental", "review", "modeling", None]
METHOD_TEXTS = ["GC-O", "Trained sensory panel", "consumer survey", "HS-SPME", "Metabolomics by GC-MS", "library", "kinetic model", "titration", None]
MATRIX_TEXTS = ["beef", "pea protein", "beef analogue", "model system", None]


def _named(names, code):
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(code).cast("int") + 1)


def named(claims):
    """The adapter's claims with names for their codes, and with quantities and units."""
    listed = lambda names, code: F.when(_named(names, code).isNotNull(), F.array(_named(names, code)))
    return claims.withColumns({
        "evidence_tier": _named(TIER, "tier_code"), "method": _named(METHOD, "method_code"), "directness": _named(DIRECT, "directness_code"), "study_type": _named(STUDY_TEXTS, "tier_code"),
        "methods": listed(METHOD_TEXTS, "method_code"), "matrices": listed(MATRIX_TEXTS, "directness_code"), "quantity": F.when(F.col("tier_code") < 2, "OAV").otherwise("concentration"), "unit": F.when(F.col("method_code") < 5, "ug/kg")})


_BASE = """base AS (SELECT *, CASE WHEN tier_code < 2 THEN 'OAV' ELSE 'concentration' END AS quantity, CASE WHEN method_code < 5 THEN 'ug/kg' END AS unit, coalesce(matrix, 'any_matrix') AS bucket,
 [1.0, 0.75, 0.45, 0.25][tier_code + 1]::DOUBLE * [1.0, 0.9, 0.85, 0.7, 0.65, 0.6, 0.4, 0.45, 0.5][method_code + 1]::DOUBLE * [1.0, 0.75, 0.6, 0.45, 0.55][directness_code + 1]::DOUBLE AS base FROM claims)"""
_CONF = f"""{_BASE}, sz AS (SELECT subject, axis, object FROM claims GROUP BY 1,2,3 HAVING count(*) <= 150),
pairs AS (SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, CASE WHEN a.polarity <> b.polarity THEN 'polarity' ELSE 'interval' END AS conflict,
 CASE WHEN coalesce(a.matrix <> b.matrix, false) OR coalesce(abs(a.temp_c - b.temp_c) > 20, false) OR coalesce(abs(a.ph - b.ph) > 1, false) THEN 'divergence' ELSE 'contradiction' END AS kind
 FROM base a JOIN sz USING (subject, axis, object) JOIN base b USING (subject, axis, object) WHERE a.claim_id < b.claim_id
 AND (a.polarity <> b.polarity OR (a.quantity = b.quantity AND a.unit IS NOT DISTINCT FROM b.unit AND (a.high * (1.0::DOUBLE + 0.1::DOUBLE) < b.low * (1.0::DOUBLE - 0.1::DOUBLE) OR b.high * (1.0::DOUBLE + 0.1::DOUBLE) < a.low * (1.0::DOUBLE - 0.1::DOUBLE)))))"""
_NEFF = """neff AS (SELECT subject, axis, object, polarity, bucket, greatest(1.0, sum(1 + 0.35::DOUBLE * (k - 1)))::DOUBLE AS n_eff
 FROM (SELECT subject, axis, object, polarity, coalesce(matrix, 'any_matrix') AS bucket, source_group, count(*) AS k FROM claims GROUP BY 1,2,3,4,5,6) GROUP BY 1,2,3,4,5)"""
_W = f"""{_CONF}, {_NEFF}, opp AS (SELECT x.claim_id, sum(base) AS o FROM (SELECT claim_a AS claim_id, claim_b AS other FROM pairs WHERE kind = 'contradiction' UNION SELECT claim_b, claim_a FROM pairs WHERE kind = 'contradiction') x JOIN base b ON b.claim_id = other GROUP BY 1),
w AS (SELECT b.*, n_eff, coalesce(o, 0) AS opposition, greatest(0, least(1, base * least(1, (1 + ln(n_eff)) / (1 + ln(10.0::DOUBLE))) - CASE WHEN o > 0 THEN 0.35::DOUBLE * o / (o + base) ELSE 0 END)) AS weight FROM base b JOIN neff USING (subject, axis, object, polarity, bucket) LEFT JOIN opp o ON o.claim_id = b.claim_id)"""
GROUP = ["subject", "axis", "object"]


@query("e1_evidence_tier", "studies", """SELECT id, CASE lower(study_type) WHEN 'experimental' THEN 1.0 WHEN 'review' THEN 0.8 ELSE 0.6 END::DOUBLE AS tier,
 CASE WHEN lower(study_type) IN ('experimental', 'review', 'method', 'modeling', 'other') THEN lower(study_type) ELSE 'unknown' END AS label FROM studies""")
def e1(studies):
    tier, label = E.evidence_tier(F.col("study_type"))
    return studies.select("id", tier.alias("tier"), label.alias("label"))


@query("e2_method_strength", "studies", """SELECT id, (CASE methods WHEN 'GC-MS;GC-Olfactometry' THEN 1.0 WHEN 'HS-SPME;trained panel;descriptive analysis' THEN 0.9 WHEN 'lipidomics' THEN 0.8 WHEN 'OAV' THEN 1.0 ELSE 0.4 END)::DOUBLE AS strength,
 CASE methods WHEN 'GC-MS;GC-Olfactometry' THEN 'gc-olfactometry' WHEN 'HS-SPME;trained panel;descriptive analysis' THEN 'trained panel' WHEN 'lipidomics' THEN 'lipidomics' WHEN 'OAV' THEN 'oav' END AS label FROM studies""")
def e2(studies):
    strength, label = E.method_strength(F.split("methods", ";"))
    return studies.select("id", strength.alias("strength"), label.alias("label"))


@query("e3_directness", "studies", """SELECT id, (CASE WHEN regexp_matches(matrices, '(?i)beef|pork|chicken|steak|sausage|burger|meat|broth|stock|duck|lamb|pigeon|turkey|fish|bacon|ham') AND NOT contains(lower(matrices), 'analogue') THEN 1.0
 WHEN regexp_matches(matrices, '(?i)analogue|analog|plant protein|pea|soy|hybrid|cultivated|fermentation-derived|fat system|seasoning|process flavor') THEN 0.7 ELSE 0.5 END)::DOUBLE AS directness, replace(matrices, ';', ' | ') AS label FROM studies""")
def e3(studies):
    factor, label = E.directness(F.split("matrices", ";"))
    return studies.select("id", factor.alias("directness"), label.alias("label"))


@query("e4_descriptor_claims", "molecule_odours molecules odours", "SELECT concat('A-', molecule_id, '-', odour_id) AS claim_id, molecule_id AS subject, m.name AS subject_name, 'smells_of' AS predicate, odour_id AS object, o.name AS object_name FROM molecule_odours JOIN molecules m ON m.id = molecule_id JOIN odours o ON o.id = odour_id")
def e4(edges, molecules, odours):
    return E.descriptor_claims(edges, molecules, odours)


_BC = "cur AS (SELECT DISTINCT l_orderkey AS source_id, l_partkey + l_linenumber % 2 AS molecule_id FROM lineitem), mined AS (SELECT source_id, molecule_id FROM paper_molecules)"


@query("e5_reported_claims", "paper_molecules lineitem", f", {_BC} SELECT concat('B-', source_id, '-', molecule_id) AS claim_id, source_id, molecule_id, CASE WHEN min(r) = 0 THEN 'curated' ELSE 'mined' END AS provenance FROM (SELECT *, 0 AS r FROM cur UNION ALL SELECT *, 1 FROM mined) GROUP BY source_id, molecule_id")
def e5(links, lineitem):
    curated = lineitem.select(F.col("l_orderkey").alias("source_id"), (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("molecule_id"))
    return E.reported_claims(curated, links)


_KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("e6_pathway_claims", "library compounds", f""", j AS (SELECT DISTINCT entry_no, id AS molecule_id, nullif(cooked_meats_reported, '') AS matrix, nullif(odor_threshold, '') AS value, unnest(CASE likely_process WHEN 'Maillard' THEN ['Maillard reaction'] WHEN 'Both' THEN ['Maillard reaction', 'Lipid oxidation'] WHEN 'Lipid oxidation' THEN ['Lipid oxidation'] ELSE [] END) AS pathway
 FROM compounds JOIN library ON trim(cas) = trim(cas_number) AND trim(cas) <> '')
SELECT concat('C-mvl-', entry_no, '-', molecule_id, '-', {_KEY.format('pathway')}) AS claim_id, molecule_id, {_KEY.format('pathway')} AS object, pathway, matrix, value, CAST(NULL AS BIGINT) AS source_id, 0.8::DOUBLE AS tier, CASE WHEN value IS NULL THEN 0.4 ELSE 0.8 END::DOUBLE AS method, 1.0::DOUBLE AS directness FROM j""")
def e6(library, compounds):
    return E.pathway_claims(library.withColumn("cas_number", F.concat(F.lit(" "), "cas_number")), compounds)


@query("e6_reported_pathways", "studies paper_molecules", f""", pw AS (SELECT id, unnest(CASE WHEN id % 3 = 0 THEN ['Strecker / degradation', 'Lipid oxidation'] WHEN id % 3 = 1 THEN ['Maillard reaction'] ELSE [] END) AS pathway FROM studies)
SELECT concat('C-src-', source_id, '-', molecule_id, '-', {_KEY.format('pathway')}) AS claim_id, molecule_id, {_KEY.format('pathway')} AS object, pathway, source_id, 0.6::DOUBLE AS tier, 0.4::DOUBLE AS method, 0.5::DOUBLE AS directness FROM paper_molecules JOIN pw ON id = source_id""")
def e6b(studies, links):
    k = F.col("id")
    paths = F.when(k % 3 == 0, F.array(F.lit("Strecker / degradation"), F.lit("Lipid oxidation"), F.lit(""))).when(k % 3 == 1, F.array(F.lit("Maillard reaction"), F.lit(None).cast("string")))
    papers = studies.select("id", paths.alias("pathway"), F.lit("survey").alias("study_type"), F.array(F.lit("titration")).alias("methods"), F.array(F.lit("none of them")).alias("matrices"))
    return E.reported_pathways(links, papers)


_NORM = "trim(regexp_replace(lower(main_claim), '[^a-z0-9]+', ' ', 'g'))"
_CLAIMS = """p AS (SELECT id, name AS main_claim FROM papers)"""


@query("e7_paper_claims", "papers", rf""", {_CLAIMS} SELECT concat('D-', id) AS claim_id, id AS source_id, 'asserts' AS predicate, concat('main_claim:', id) AS object, 'paperclaim|' || substr({_NORM}, 1, 120) AS group_key,
 substr(regexp_replace({_NORM}, '\b(increas\w*|decreas\w*|reduc\w*|enhanc\w*|inhibit\w*|suppress\w*|mask\w*|not|no|does)\b', '', 'g'), 1, 160) AS object_key, 'positive' AS polarity FROM p WHERE main_claim <> ''""")
def e7(papers):
    return E.paper_claims(papers.withColumn("main_claim", F.col("name")))


_CURATED = r"""cl AS (SELECT o_orderkey AS id, concat(o_orderpriority, CASE o_orderkey % 9 WHEN 0 THEN ' Reduced aroma' WHEN 1 THEN ' has no significant effect' WHEN 2 THEN ' does not change' WHEN 3 THEN ' lowers it' ELSE ' increases it' END) AS claim_text,
 CASE o_orderstatus WHEN 'F' THEN 'supports' WHEN 'O' THEN 'contradicts' END AS stance, o_custkey % 10 + 0.5::DOUBLE AS confidence FROM orders),
mo AS (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS molecule_id FROM lineitem WHERE l_orderkey % 3 > 0), so AS (SELECT DISTINCT l_orderkey AS claim_id, l_suppkey AS source_id FROM lineitem WHERE l_orderkey % 4 > 0)"""


@query("e7_curated_claims", "orders lineitem", rf""", {_CURATED} SELECT concat('E-', id, '-', coalesce(CAST(molecule_id AS VARCHAR), 'None'), '-', coalesce(CAST(source_id AS VARCHAR), 'nosrc')) AS claim_id, CASE WHEN molecule_id IS NULL THEN 'claim_only' ELSE 'molecule' END AS subject_type, molecule_id,
 'curated_claim' AS predicate, concat('claim:', id) AS object, source_id, CASE WHEN stance = 'contradicts' OR id % 9 < 4 THEN 'negative' ELSE 'positive' END AS polarity, stance, confidence,
 'E|mol:' || coalesce(CAST(molecule_id AS VARCHAR), 'None') || '|' || substr(trim(regexp_replace(lower(claim_text), '[^a-z0-9]+', ' ', 'g')), 1, 120) AS group_key
 FROM cl LEFT JOIN mo ON mo.claim_id = id LEFT JOIN so ON so.claim_id = id""")
def e7b(orders, lineitem):
    """Orders as curated claims: a third names no molecule and a quarter no source, so that placeholders occur."""
    text = F.concat("o_orderpriority", F.element_at(F.array(*[F.lit(t) for t in (" Reduced aroma", " has no significant effect", " does not change", " lowers it", *[" increases it"] * 5)]), (F.col("o_orderkey") % 9 + 1).cast("int")))
    claims = orders.select(F.col("o_orderkey").alias("id"), text.alias("claim_text"), F.when(F.col("o_orderstatus") == "F", "supports").when(F.col("o_orderstatus") == "O", "contradicts").alias("stance"), (F.col("o_custkey") % 10 + 0.5).alias("confidence"))
    molecules = lineitem.where("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("molecule_id")).distinct()
    sources = lineitem.where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source_id")).distinct()
    return E.curated_claims(claims, molecules, sources)


@query("e8_corroborate", "claims", ", g AS (SELECT subject, axis, object, count(DISTINCT source_id) AS n FROM claims GROUP BY 1,2,3) SELECT claim_id, n AS n_sources, round(1 + ln(n), 6) AS corroboration FROM claims JOIN g USING (subject, axis, object)")
def e8(claims):
    return E.corroborate(claims, GROUP).select("claim_id", "n_sources", F.round("corroboration", 6).alias("corroboration"))


@query("e9_contradicted_groups", "claims", "SELECT subject, axis, object, count(DISTINCT polarity) AS polarities, 0.25::DOUBLE AS penalty FROM claims GROUP BY 1,2,3 HAVING count(DISTINCT polarity) > 1")
def e9(claims):
    return E.contradicted_groups(claims, GROUP)


@query("e10_normalised_weight", "claims", """, b AS (SELECT *, [1.0, 0.8, 0.6, 0.6][tier_code + 1]::DOUBLE * [0.4, 0.9, 0.4, 0.8, 0.8, 0.4, 0.4, 0.4, 0.4][method_code + 1]::DOUBLE * [1.0, 0.7, 0.7, 0.5, 0.5][directness_code + 1]::DOUBLE AS base FROM claims),
g AS (SELECT subject, axis, object, 1 + ln(count(DISTINCT source_id)) AS c, CASE WHEN count(DISTINCT polarity) > 1 THEN 0.25::DOUBLE ELSE 0 END AS p FROM claims GROUP BY 1,2,3),
r AS (SELECT claim_id, base * c - p AS raw FROM b JOIN g USING (subject, axis, object)) SELECT claim_id, round(greatest(0, least(1, raw / (SELECT max(raw) FROM r))), 4) AS weight FROM r""")
def e10(claims):
    return E.normalised_weight(named(claims), GROUP).select("claim_id", "weight")


@query("e11_consensus_clusters", "claims", "SELECT subject, axis, object, count(DISTINCT source_id) AS n_sources, count(*) AS n_claims FROM claims GROUP BY 1,2,3 HAVING count(DISTINCT source_id) >= 2 ORDER BY n_sources DESC, n_claims DESC, subject, axis, object LIMIT 50")
def e11(claims):
    return E.consensus_clusters(claims, GROUP)


@query("e12_triplet_report", "claims", "SELECT axis AS class, count(*) AS n, count(matrix) AS with_matrix, count(low) AS with_value, count(DISTINCT subject) AS subjects, count(DISTINCT source_id) AS sources, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS share FROM claims GROUP BY axis")
def e12(claims):
    return E.triplet_report(claims, "axis")


@query("e12_triplet_coverage", "claims molecules kg_papers", """, c AS (SELECT *, CASE WHEN source_id % 3 > 0 THEN 'p' END AS process, method_code < 5 AS methods, CASE WHEN source_id % 4 > 0 THEN ph END AS ph2, CASE WHEN source_id % 4 = 2 THEN temp_c END AS temp2, CASE WHEN source_id % 8 = 4 THEN 5 END AS time2 FROM claims),
t AS (SELECT count(*) AS n, count(DISTINCT subject) AS a, count(DISTINCT source_id) AS b, count(matrix) AS c, count(process) AS d, count(*) FILTER (WHERE methods) AS e, count(low) AS f, count(*) FILTER (WHERE ph2 IS NOT NULL OR temp2 IS NOT NULL OR time2 IS NOT NULL) AS g, count(*) FILTER (WHERE matrix IS NULL AND process IS NULL) AS h FROM c),
x AS (SELECT unnest(['molecules', 'papers', 'with_matrix', 'with_process', 'with_method', 'with_value', 'with_numbers', 'without_conditions']) AS measure, unnest([a, b, c, d, e, f, g, h]) AS n, n AS total FROM t)
SELECT measure, x.n, round(100.0::DOUBLE * x.n / CASE measure WHEN 'molecules' THEN (SELECT count(*) FROM molecules) WHEN 'papers' THEN (SELECT count(*) FROM kg_papers) ELSE total END, 1) AS share FROM x""")
def e12b(claims, molecules, papers):
    k = F.col("source_id")
    told = claims.withColumns({"process": F.when(k % 3 > 0, "p"), "methods": F.when(F.col("method_code") < 5, F.array(F.lit("m"))), "value": F.col("low"), "time_min": F.when(k % 8 == 4, 5)})
    told = told.withColumns({"ph": F.when(k % 4 > 0, F.col("ph")), "temp_c": F.when(k % 4 == 2, F.col("temp_c"))})
    return E.triplet_coverage(told, molecules, papers)


def nested(claims):
    """Claims in their nested form, from the flat adapter."""
    ends = lambda c, prefix: F.struct(F.col(c).alias("id"), F.concat(F.lit(prefix), F.col(c)).alias("name"), F.lit("thing").alias("type")).alias(c)
    return claims.select(
        "claim_id", ends("subject", "s"), F.lit("affects").alias("predicate"), ends("object", "o"), F.when(F.col("polarity") == "-", "negative").otherwise("positive").alias("polarity"),
        F.struct(F.when(F.col("matrix").isNull(), F.array().cast("array<string>")).otherwise(F.array("matrix", F.lit("x"))).alias("matrix"), F.col("temp_c").alias("temperature_c"), F.col("ph"), F.when(F.col("tier_code") > 0, F.array(F.lit("roasting"), F.lit("frying"))).alias("process")).alias("conditions"),
        F.struct(F.filter(F.array(_named(METHOD_TEXTS, "method_code"), F.lit("note")), lambda x: x.isNotNull()).alias("method"), F.col("low").alias("value"), F.when(F.col("method_code") < 5, "ug/kg").alias("unit")).alias("measurement"),
        F.struct("source_id", _named(STUDY_TEXTS, "tier_code").alias("tier"), F.lit(None).cast("string").alias("study_type"), (2000 + F.col("source_id") % 20).alias("year"), (F.col("source_id") % 90).alias("citation_count")).alias("evidence"),
        F.concat(F.lit("class "), "axis").alias("class"), (F.col("tier_code") / 4).alias("weight"), (F.col("method_code") + 1).alias("n_independent_sources"), F.lit("derived").alias("provenance"))


@query("e13_normalise_claims", "claims", """SELECT claim_id, concat('s', subject) AS subject, 'affects' AS predicate, concat('o', object) AS object, 'affects' AS axis, polarity, ['T1_experimental', 'T2_review', 'T4_conjecture', 'T3_inferred'][tier_code + 1] AS evidence_tier,
 ['gco_aeda_quant', 'sensory_trained', 'consumer_panel', 'gcms_identification', 'gcms_quantified', 'library_compilation', 'in_silico', 'unspecified', 'unspecified'][method_code + 1] AS method,
 CASE WHEN matrix IS NULL THEN 'unknown' ELSE 'analogous_matrix' END AS directness, source_id, CAST(source_id AS VARCHAR) AS source_group, matrix, temp_c, ph, CASE WHEN method_code < 5 THEN 'ug/kg' ELSE 'value' END AS quantity, CASE WHEN method_code < 5 THEN 'ug/kg' END AS unit, low, low AS high FROM claims""")
def e13(claims):
    return E.normalise_claims(nested(claims))


@query("a14_flat_triplets", "claims", """SELECT claim_id, 'class ' || axis AS class, 'thing' AS subject_type, subject AS subject_id, concat('s', subject) AS subject_name, 'affects' AS predicate, 'thing' AS object_type, object AS object_id, concat('o', object) AS object_name, CASE polarity WHEN '-' THEN 'negative' ELSE 'positive' END AS polarity,
 coalesce(matrix || '|x', '') AS matrix, CASE WHEN tier_code > 0 THEN 'roasting|frying' ELSE '' END AS process, coalesce(['GC-O', 'Trained sensory panel', 'consumer survey', 'HS-SPME', 'Metabolomics by GC-MS', 'library', 'kinetic model', 'titration', NULL][method_code + 1] || '|', '') || 'note' AS method,
 CAST(NULL AS VARCHAR) AS study_type, 2000 + source_id % 20 AS year, source_id % 90 AS citation_count, tier_code / 4.0::DOUBLE AS weight, method_code + 1 AS n_independent_sources, 'derived' AS provenance FROM claims""")
def a14(claims):
    return E.flat_triplets(nested(claims))


@query("e14_base_score", "claims", f", {_BASE} SELECT claim_id, round(base, 6) AS base FROM base")
def e14(claims):
    return E.base_score(named(claims)).select("claim_id", F.round("base", 6).alias("base"))


@query("e15_effective_n", "claims", f", {_NEFF} SELECT * FROM neff")
def e15(claims):
    return E.effective_n(claims)


@query("e16_corroboration", "claims", f", {_NEFF} SELECT subject, axis, object, polarity, bucket, round(least(1, (1 + ln(n_eff)) / (1 + ln(10.0::DOUBLE))), 6) AS corroboration FROM neff")
def e16(claims):
    return E.effective_n(claims).select(*E.CLUSTER, F.round(E.corroboration(F.col("n_eff")), 6).alias("corroboration"))


@query("e17_claim_conflicts", "claims", f", {_CONF} SELECT * FROM pairs")
def e17(claims):
    return E.conflict_pairs(named(claims))


@query("e17_oversized_edges", "claims", "SELECT subject, axis, object, count(*) AS n FROM claims GROUP BY 1,2,3 HAVING count(*) > 15")
def e17b(claims):
    return E.oversized_edges(claims, 15)


@query("e18_claim_weights", "claims", f", {_W} SELECT claim_id, round(weight, 6) AS weight, round(opposition, 6) AS opposition FROM w")
def e18(claims):
    return E.claim_weights(named(claims)).select("claim_id", F.round("weight", 6).alias("weight"), F.round("opposition", 6).alias("opposition"))


@query("e19_edge_consensus", "claims", f""", {_W} SELECT subject, axis, object, bucket AS matrix, round(greatest(0, (1 - product(CASE WHEN polarity <> '-' THEN 1 - weight ELSE 1 END)) - (1 - product(CASE WHEN polarity = '-' THEN 1 - weight ELSE 1 END))), 9) AS consensus,
 count(*) FILTER (WHERE polarity <> '-') AS supporting, count(*) FILTER (WHERE polarity = '-') AS opposing FROM w GROUP BY 1,2,3,4""")
def e19(claims):
    return E.edge_consensus(E.claim_weights(named(claims))).withColumn("consensus", F.round("consensus", 9))


@query("e20_weight_summary", "claims", f", {_W}, s AS (SELECT weight AS w, row_number() OVER (ORDER BY weight) - 1 AS i, count(*) OVER () AS n FROM w) SELECT round(min(w), 6) AS least, round(max(w), 6) AS most, count(*) AS n, round(min(w) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)), 6) AS median, round(min(w) FILTER (WHERE i = CAST(floor(n * 0.9) AS BIGINT)), 6) AS p90 FROM s")
def e20(claims):
    return E.weight_summary(E.claim_weights(named(claims))).withColumns({c: F.round(c, 6) for c in ("least", "most", "median", "p90")})


@query("e20_tier_mix", "claims", "SELECT ['T1_experimental', 'T2_review', 'T3_inferred', 'T4_conjecture'][tier_code + 1] AS evidence_tier, count(*) AS n FROM claims GROUP BY 1")
def e20b(claims):
    return E.tier_mix(named(claims))


@query("e20_stored_difference", "claims", f", {_W}, f AS (SELECT claim_id, tier_code / 4.0::DOUBLE AS old FROM claims WHERE tier_code > 0 ORDER BY claim_id LIMIT 400) SELECT count(*) AS n, round(avg(abs(old - weight)), 6) AS difference, round(avg(old), 6) AS stored, round(avg(weight), 6) AS recomputed FROM f JOIN w USING (claim_id)")
def e20c(claims):
    stored = claims.select("claim_id", F.col("claim_id").alias("pos"), F.when(F.col("tier_code") > 0, F.col("tier_code") / 4.0).alias("weight"))
    return E.stored_difference(E.claim_weights(named(claims)), stored).withColumns({c: F.round(c, 6) for c in ("difference", "stored", "recomputed")})


@query("e21_evidence_view", "claims kg_papers molecules", "SELECT claim_id, c.subject, source_id, polarity, k.label AS source_label, relevance, m.name AS subject_name FROM claims c LEFT JOIN kg_papers k ON k.id = source_id LEFT JOIN molecules m ON m.id = c.subject")
def e21(claims, papers, molecules):
    return E.evidence_view(claims, papers, molecules).select("claim_id", "subject", "source_id", "polarity", "source_label", "relevance", "subject_name")
