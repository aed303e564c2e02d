"""Identity queries: compounds from parts, people from customers, journals and authors from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import ADAPTERS
from ..operators import identity as I
from ..registry import query

#: Names as they come in, some known, with candidates and a registry drawn from the parts.
ADAPTERS["incoming"] = "SELECT o_orderkey AS pos, concat('n', CAST(o_custkey % 700 AS STRING)) AS key FROM orders"
ADAPTERS["candidates"] = "SELECT concat('n', CAST(p_partkey % 900 AS STRING)) AS key, p_partkey % 450 AS molecule FROM part WHERE p_size % 3 > 0"
ADAPTERS["registry"] = "SELECT concat('n', CAST(s_suppkey % 500 AS STRING)) AS key, min(s_suppkey % 450) AS molecule FROM supplier GROUP BY 1"
ADAPTERS["synonyms"] = """
    SELECT p_partkey % 300 AS molecule, p_partkey AS pos, CASE p_size % 5 WHEN 0 THEN concat(CAST(50 + p_partkey % 40 AS STRING), '-', CAST(10 + p_partkey % 90 AS STRING), '-', CAST(p_partkey % 10 AS STRING)) WHEN 1 THEN concat('chebi:', CAST(p_partkey % 99 AS STRING))
           WHEN 2 THEN concat('HMDB', CAST(10000 + p_partkey AS STRING)) WHEN 3 THEN concat('C', CAST(10000 + p_partkey % 80000 AS STRING)) ELSE p_name END AS synonym FROM part"""
ADAPTERS["rungs"] = "SELECT l_orderkey % 3000 AS id, CAST(l_linenumber AS INT) AS rung, l_suppkey % 3 AS cid FROM lineitem WHERE l_quantity < 6"
ADAPTERS["org_rows"] = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS org_type, concat('N', CAST(c_nationkey % 30 AS STRING)) AS country, concat('Lab of ', c_mktsegment, ' Inc, NATION_', CAST(c_nationkey % 5 AS STRING), ' x@y.z; rest') AS affiliation FROM customer"
_OUT = """fk AS (SELECT key, min(pos) AS first_pos FROM incoming GROUP BY 1), ca AS (SELECT key, count(DISTINCT molecule) AS n, min(molecule) AS candidate FROM candidates GROUP BY 1), kn AS (SELECT key, min(molecule) AS known FROM registry GROUP BY 1),
j AS (SELECT i.pos, i.key, first_pos, known, n, candidate, candidate IN (SELECT molecule FROM registry) AS held FROM incoming i JOIN fk USING (key) LEFT JOIN ca USING (key) LEFT JOIN kn USING (key)),
cr AS (SELECT candidate, min(pos) AS creator FROM j WHERE known IS NULL AND n = 1 AND NOT held GROUP BY 1),
oc AS (SELECT pos, key, coalesce(known, CASE WHEN n = 1 THEN j.candidate END) AS molecule, CASE WHEN known IS NOT NULL THEN 'exists' WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL THEN 'unresolved' WHEN held THEN CASE WHEN pos = first_pos THEN 'attached' ELSE 'exists' END
 WHEN pos = creator THEN 'created' WHEN pos = first_pos THEN 'attached' ELSE 'exists' END AS outcome FROM j LEFT JOIN cr ON cr.candidate = j.candidate)"""


#: Parts under names in quotes, with blanks in all places, and some without any name.
ADAPTERS["quoted_names"] = """
    SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN concat('  "', p_name, '" ') WHEN 1 THEN concat('“', upper(p_name), '»') WHEN 2 THEN replace(p_name, ' ', '   ') WHEN 3 THEN concat('`', p_name) WHEN 4 THEN '  ' WHEN 5 THEN NULL WHEN 6 THEN concat(p_name, ' ', chr(39), 'x', chr(39)) ELSE p_name END AS name FROM part"""
_DISPLAY = r"""regexp_replace(trim(trim(trim(coalesce(name, '')), '"''`“”‘’«»')), '\s+', ' ', 'g')"""


@query("g1_normalise_names", "quoted_names", f"SELECT id, name, lower({_DISPLAY}) AS key, {_DISPLAY} AS display FROM quoted_names")
def g1(names):
    return I.normalise_names(names)


@query("g2_resolve_synonyms", "incoming candidates registry", f", {_OUT} SELECT * FROM oc")
def g2(incoming, candidates, registry):
    return I.resolve_synonyms(incoming, candidates, registry)


@query("g3_attach_synonyms", "candidates registry", ", a AS (SELECT key, min(molecule) AS m FROM candidates GROUP BY 1) SELECT coalesce(r.key, a.key) AS key, coalesce(molecule, m) AS molecule, coalesce(molecule <> m, false) AS conflict FROM registry r FULL JOIN a ON a.key = r.key")
def g3(candidates, registry):
    return I.attach_synonyms(registry, candidates)


@query("g4_backfill_nulls", "compounds library", ", l AS (SELECT entry_no AS id, min(cas_number) AS c, min(chemical_group) AS g FROM library GROUP BY 1) SELECT id, coalesce(cas, c) AS cas, coalesce(category, g) AS category FROM compounds LEFT JOIN l USING (id)")
def g4(compounds, library):
    return I.backfill_nulls(compounds, library.select(F.col("entry_no").alias("id"), F.col("cas_number").alias("cas"), F.col("chemical_group").alias("category")), "id", ["cas", "category"])


@query("g5_classify_identifiers", "synonyms", r""", s AS (SELECT molecule, pos, upper(synonym) AS value, CASE WHEN regexp_matches(synonym, '^\d{2,7}-\d{2}-\d$') THEN 'CAS' WHEN regexp_matches(synonym, '(?i)^chebi:\d+$') THEN 'ChEBI' WHEN regexp_matches(synonym, '(?i)^hmdb\d{5,}$') THEN 'HMDB' WHEN regexp_matches(synonym, '(?i)^c\d{5}$') THEN 'KEGG' END AS scheme FROM synonyms)
SELECT DISTINCT molecule, scheme, value, scheme = 'CAS' AND value = first_value(value) OVER (PARTITION BY molecule, scheme ORDER BY pos, value) AS is_primary FROM s WHERE scheme IS NOT NULL""")
def g5(synonyms):
    return I.classify_identifiers(synonyms)


@query("g6_registry_stats", "incoming candidates registry", f", {_OUT} SELECT outcome, count(*) AS n, count(DISTINCT molecule) AS molecules, count(DISTINCT key) AS keys FROM oc GROUP BY 1")
def g6(incoming, candidates, registry):
    return I.registry_stats(I.resolve_synonyms(incoming, candidates, registry))


@query("g6_review_queue", "incoming candidates registry", f", {_OUT} SELECT outcome, key, count(*) AS seen FROM oc WHERE outcome IN ('ambiguous', 'unresolved') GROUP BY 1, 2")
def g6b(incoming, candidates, registry):
    return I.review_queue(I.resolve_synonyms(incoming, candidates, registry))


#: Library compounds with a synonym in parenthesis, and what comes of such a name: fixed forms, so that SQL can tell them.
ADAPTERS["spelled"] = """
    SELECT p_partkey AS id, concat('part', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN ', x' WHEN 1 THEN ' - y' ELSE '' END) AS head, CASE p_partkey % 3 WHEN 0 THEN '(E)-' WHEN 1 THEN 'cis-' ELSE '' END AS stereo, CASE WHEN p_partkey % 5 < 2 THEN 'gamma-nut' END AS inner_ FROM part"""


@query("g7_name_keys", "spelled", r""", n AS (SELECT id, stereo || head AS h, head AS b, inner_ AS i, stereo || head || coalesce(' (' || inner_ || ')', '') AS name FROM spelled),
t AS (SELECT id, name, unnest([{'k': 1, 'v': h, 'w': 'strip_parenthetical'}, {'k': 2, 'v': i, 'w': 'parenthetical_synonym'}, {'k': 3, 'v': b || coalesce(' (' || i || ')', ''), 'w': 'strip_stereo'}, {'k': 4, 'v': CASE WHEN i IS NOT NULL THEN b END, 'w': 'strip_stereo+head'},
 {'k': 5, 'v': replace(name, ', ', ','), 'w': 'tighten_commas'}, {'k': 6, 'v': replace(name, ' - ', '-'), 'w': 'tighten_hyphens'}, {'k': 7, 'v': replace(name, ' ', ''), 'w': 'drop_spaces'},
 {'k': 8, 'v': CASE WHEN i IS NOT NULL THEN replace(h, ', ', ',') END, 'w': 'tighten_commas'}, {'k': 9, 'v': CASE WHEN i IS NOT NULL THEN replace(h, ' - ', '-') END, 'w': 'tighten_hyphens'}, {'k': 10, 'v': CASE WHEN i IS NOT NULL THEN replace(h, ' ', '') END, 'w': 'drop_spaces'},
 {'k': 11, 'v': replace(b || coalesce(' (' || i || ')', ''), ', ', ','), 'w': 'tighten_commas'}, {'k': 12, 'v': replace(b || coalesce(' (' || i || ')', ''), ' - ', '-'), 'w': 'tighten_hyphens'}, {'k': 13, 'v': replace(b || coalesce(' (' || i || ')', ''), ' ', ''), 'w': 'drop_spaces'}]) AS x FROM n),
u AS (SELECT id, x.v AS variant, min_by(x.w, x.k) AS reason, min(x.k) AS k FROM t WHERE x.v IS NOT NULL AND lower(x.v) <> lower(name) GROUP BY id, x.v)
SELECT id, variant, reason, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INTEGER) AS pos FROM u""")
def g7(spelled):
    return I.name_keys(spelled.select("id", F.concat("stereo", "head", F.coalesce(F.concat(F.lit(" ("), "inner_", F.lit(")")), F.lit(""))).alias("name")))


@query("g8_identity_ladder", "rungs", """, r AS (SELECT id, rung, count(DISTINCT cid) AS n, min(cid) AS cid FROM rungs GROUP BY 1, 2), b AS (SELECT id, min(rung) FILTER (WHERE n = 1) AS o, min(rung) FILTER (WHERE n > 1) AS m FROM r GROUP BY 1), i AS (SELECT DISTINCT id FROM rungs UNION SELECT 100000 + min(id) FROM rungs)
SELECT i.id, CASE WHEN o IS NOT NULL THEN 'resolved' WHEN m IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS status, coalesce(o, m) AS rung, (SELECT cid FROM r WHERE r.id = i.id AND r.rung = b.o) AS cid FROM i LEFT JOIN b USING (id)""")
def g8(rungs):
    ids = rungs.select("id").distinct().unionByName(rungs.agg((F.min("id") + 100000).alias("id")))
    return I.identity_ladder(ids, rungs)


@query("g9_verify_identity", "compounds", """, v AS (SELECT id, cas, id % 3 = 0 AS named, id % 7 = 1 AS silent, cas IS NOT NULL AND id % 2 = 0 AS listed, id % 4 < 2 AS by_cas, CASE WHEN id % 4 = 0 THEN 'cas_lookup' WHEN id % 4 = 1 THEN 'mvl_cas' ELSE 'name' END AS rung FROM compounds)
SELECT id, silent OR named OR (listed AND by_cas) AS accepted, CASE WHEN silent THEN '+no_synonym_list' WHEN named THEN '' WHEN listed AND by_cas THEN '+verified_by_cas' ELSE 'unverified:' || rung END AS note, coalesce(id % 2 = 1 AND id % 5 > 0 AND cas IS NOT NULL, false) AS cas_mismatch FROM v""")
def g9(compounds):
    s = lambda c: c.cast("string")
    k = F.col("id")
    keys = F.when(k % 7 == 1, F.when(k % 2 == 0, F.array().cast("array<string>"))).when(k % 3 == 0, F.array(s(k))).otherwise(F.array(F.lit("z")))
    frame = compounds.select("id", "cas", F.when(k % 4 == 0, "cas_lookup").when(k % 4 == 1, "mvl_cas").otherwise("name").alias("rung"), F.array(F.lit("a"), s(k)).alias("query_keys"), keys.alias("synonym_keys"),
                             F.when(k % 2 == 0, F.array(F.coalesce("cas", F.lit("?")), F.lit("1-1-1"))).when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1-1-1"))).alias("cas_list"))
    return I.verify_identity(frame)


@query("g10_unambiguous_map", "compounds", "SELECT name AS key, min(category) AS value FROM compounds GROUP BY 1 HAVING count(DISTINCT category) = 1")
def g10(compounds):
    from ..operators.browse import unambiguous

    return unambiguous(compounds, F.col("name"), F.col("category"))


@query("g11_identity_report", "compounds", ", k AS (SELECT translate(lower(split_part(name, ' ', 1)), ' ,-', '') AS key, id, name FROM compounds), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM k) SELECT key, count(*) AS n, string_agg(concat_ws(':', id, name), '; ' ORDER BY id) FILTER (WHERE r <= 20) AS members FROM n GROUP BY 1 HAVING count(*) > 1")
def g11(compounds):
    return I.identity_report(compounds.select(I.norm_mvl(F.split_part("name", F.lit(" "), F.lit(1))).alias("key"), "id", "name"))


#: Compounds with what found them.
ADAPTERS["matched"] = """
    SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS cas, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS inchikey,
           CASE p_partkey % 9 WHEN 0 THEN 'ambiguous:name' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'cas_lookup:50-00-0+verified_by_cas' WHEN 3 THEN 'name_exact(cas_mismatch)' WHEN 4 THEN 'normalized:drop_spaces' WHEN 5 THEN 'mvl_cas:1-1-1' WHEN 6 THEN 'name_exact' WHEN 7 THEN 'odd' END AS id_match_method,
           p_partkey % 4 < 3 AS id_needs_review FROM part"""


@query("g11_fill_counts", "matched", "SELECT 'rows' AS field, count(*) AS n FROM matched UNION ALL SELECT 'cas', count(cas) FROM matched UNION ALL SELECT 'inchikey', count(inchikey) FROM matched")
def g11b(matched):
    return I.fill_counts(matched, ["cas", "inchikey"])


@query("g11_rung_breakdown", "matched", "SELECT split_part(split_part(split_part(coalesce(id_match_method, 'not attempted'), ':', 1), '+', 1), '(', 1) AS rung, count(*) AS n FROM matched GROUP BY 1")
def g11c(matched):
    return I.rung_breakdown(matched)


@query("g11_review_reasons", "matched", "SELECT CASE WHEN id_match_method LIKE 'ambiguous%' THEN 'ambiguous (>1 CID)' WHEN id_match_method LIKE 'unresolved%' THEN 'unresolved (no match)' WHEN id_match_method LIKE '%cas_mismatch%' THEN 'CAS mismatch vs PubChem' ELSE 'other' END AS reason, count(*) AS n FROM matched WHERE id_needs_review GROUP BY 1")
def g11d(matched):
    return I.review_reasons(matched)


_ENDS = ["limonene", "menthol", "dimethylpyrazine", "thiophene", "dithiolane", "furfural", "pyrrole", "methylamine", "methanethiol", "dimethyl disulfide", "palmitic acid", "linoleic acid", "decalactone", "pantolide", "guaiacol", "thymol", "butanoic acid",
         "ethyl acetate", "methyl decanoate", "hexanal", "benzaldehyde", "butanone", "ethyl ketone", "ethanol", "butanediol", "amyl alcohol", "toluene", "octane", "hexyne", "water", "Decline", "aroma", "ester", "tube"]
#: Parts under names that reach every class of the ladder; a third of them has a category of its own.
ADAPTERS["chemicals"] = f"""
    SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END, ' ', CASE p_partkey % {len(_ENDS) + 1} {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS))} ELSE '' END) AS name,
           CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Unclassified' ELSE p_type END AS category FROM part"""
_CLASS = r"""cl AS (SELECT id, CASE WHEN regexp_matches(n, 'limonene|pinene|terpin|myrcene|carene|terpineol|linalool|geraniol|citronell|caryophyllene|farnesene|ocimene|camphene|sabinene|menthol|menthone|borneol|cadinene|humulene|nerol|citral|terpene') THEN 'Terpenes'
 WHEN regexp_matches(n, 'pyrazine') THEN 'Pyrazines' WHEN regexp_matches(n, 'thiophene|thiazol|thiadiazol|dithiazine|dithiol|dithian|trithiolane|trithiane|tetrathiane') THEN 'Sulfur compounds' WHEN regexp_matches(n, 'furan|furfur') THEN 'Furans'
 WHEN regexp_matches(n, 'pyrrol|pyridin|pyrimidin|oxazol|indol|skatole|piperidin|morpholin|quinoxalin|imidazol|amine') THEN 'Nitrogen compounds' WHEN regexp_matches(n, 'thio|mercapto|sulfid|sulfanyl|disulf|trisulf|sulfur|sulfhydryl') THEN 'Sulfur compounds'
 WHEN regexp_matches(n, 'palmit|stear|oleic|olei|linole|myrist|lauric|caproic|caprylic|capric|glycer|fatty|arachid') THEN 'Fats' WHEN regexp_matches(n, 'lactone|olide$') THEN 'Lactones'
 WHEN regexp_matches(n, 'phenol|guaiacol|cresol|eugenol|vanillin|vanillate|catechol|thymol|carvacrol') THEN 'Phenols' WHEN contains(n, 'acid') THEN 'Acids'
 WHEN regexp_matches(n, 'acetate|propanoate|butanoate|hexanoate|octanoate|benzoate|formate|butyrate|caproate|valerate|propionate|oate$') THEN 'Esters' WHEN regexp_matches(n, 'al$|aldehyde') THEN 'Aldehydes' WHEN regexp_matches(n, 'one$|ketone') THEN 'Ketones'
 WHEN regexp_matches(n, 'ol$|alcohol') THEN 'Alcohols' WHEN regexp_matches(n, 'naphthalene|benzene|toluene|xylene|styrene|indene|anthracene|biphenyl|(ane|ene|yne)$') THEN 'Hydrocarbons' ELSE 'Other' END AS class
 FROM (SELECT id, lower(trim(name)) AS n FROM chemicals WHERE category IS NULL OR category = 'Unclassified'))"""


@query("g12_chemical_class", "chemicals", f", {_CLASS} SELECT * FROM cl")
def g12(molecules):
    return I.categorize(molecules)


@query("g12_class_tally", "chemicals", f", {_CLASS} SELECT class, count(*) AS n FROM cl GROUP BY 1")
def g12b(molecules):
    return I.class_tally(I.categorize(molecules))


@query("g13_flag_junk", "molecules", "SELECT id, name, coalesce(lower(trim(name)) IN ('red widget', 'small ring'), false) AS is_junk FROM molecules")
def g13(molecules):
    return I.flag_junk(molecules.select("id", "name"), ["red widget", "small ring"])


@query("g14_backfill_from_reference", "compounds library", """, k AS (SELECT translate(lower(compound), ' ,-', '') AS key, min(cas_number) AS c, min(likely_process) AS pathway, min(cooked_meats_reported) AS meats FROM library GROUP BY 1 HAVING count(*) = 1)
SELECT id, coalesce(cas, c) AS cas, pathway, CASE meats WHEN '[beef]' THEN 'beef' WHEN '[beef, pork][lamb]' THEN 'beef|lamb|pork' END AS found_in FROM compounds LEFT JOIN k ON k.key = translate(lower(name), ' ,-', '')""")
def g14(compounds, library):
    return I.backfill_from_reference(compounds, library)


ADAPTERS["thresholds"] = """
    SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '0.5' WHEN 1 THEN '1-3, in water' WHEN 2 THEN '<2, in oil' WHEN 3 THEN 'greater than 5' WHEN 4 THEN '1 – 2' WHEN 5 THEN ' 12 ,  in air, dry' WHEN 6 THEN '~3' WHEN 7 THEN 'trace'
           WHEN 8 THEN '' WHEN 9 THEN '1 to 4,' WHEN 10 THEN '≤ 0.1-0.2' END AS odor_threshold FROM part"""


@query("g15_parse_threshold", "thresholds", """SELECT id, CASE id % 12 WHEN 0 THEN 0.5 WHEN 5 THEN 12 END::DOUBLE AS threshold, CASE id % 12 WHEN 1 THEN 'in water' WHEN 2 THEN 'in oil' WHEN 5 THEN 'in air, dry' END AS threshold_matrix,
 CASE id % 12 WHEN 0 THEN 'unit_not_stated_in_source' WHEN 1 THEN 'matrix_qualified|range_not_point_value|unit_not_stated_in_source' WHEN 2 THEN 'matrix_qualified|limit_not_point_value|unit_not_stated_in_source' WHEN 3 THEN 'limit_not_point_value|unit_not_stated_in_source'
  WHEN 4 THEN 'range_not_point_value|unit_not_stated_in_source' WHEN 5 THEN 'matrix_qualified|unit_not_stated_in_source' WHEN 6 THEN 'range_not_point_value|unit_not_stated_in_source' WHEN 7 THEN 'unit_not_stated_in_source' WHEN 9 THEN 'range_not_point_value|unit_not_stated_in_source'
  WHEN 10 THEN 'limit_not_point_value|unit_not_stated_in_source' ELSE 'empty' END AS flags FROM thresholds""")
def g15(thresholds):
    return I.parse_threshold(thresholds).drop("odor_threshold")


#: Properties with unit, method, confidence and flags.
PROPS = {"p_retailprice": ("g/mol", "computed", 1.0, []), "p_size": (None, "estimated", 0.6, ["estimated_not_measured", "polarity_proxy"]), "groups": (None, "patterns", 0.95, []), "p_brand": (None, "listed", 0.9, ["polarity_proxy"])}
_PL = """pl AS (SELECT id, x.p AS property, x.r AS value_raw, x.v AS value, x.u AS unit, 'system_derived' AS derivation, x.m AS method, x.c AS confidence, x.f AS flags FROM (SELECT p_partkey AS id, unnest([
 {'p': 'p_retailprice', 'r': 'n', 'v': CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END, 'u': 'g/mol', 'm': 'computed', 'c': 1.0::DOUBLE, 'f': ''}, {'p': 'p_size', 'r': CAST(p_size AS VARCHAR), 'v': p_size::DOUBLE, 'u': NULL, 'm': 'estimated', 'c': 0.6::DOUBLE, 'f': 'estimated_not_measured|polarity_proxy'},
 {'p': 'groups', 'r': CASE WHEN p_size % 3 > 0 THEN 'a,' || p_brand END, 'v': NULL, 'u': NULL, 'm': 'patterns', 'c': 0.95::DOUBLE, 'f': ''}, {'p': 'p_brand', 'r': p_brand, 'v': NULL, 'u': NULL, 'm': 'listed', 'c': 0.9::DOUBLE, 'f': 'polarity_proxy'}]) AS x FROM part) WHERE x.r IS NOT NULL AND NOT (x.p = 'p_retailprice' AND x.v IS NULL))"""


def props(part):
    return I.properties_long(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("p_retailprice"), "p_size", F.when(F.col("p_size") % 3 > 0, F.array(F.lit("a"), F.col("p_brand"))).alias("groups"), "p_brand"), PROPS)


@query("g16_properties_long", "part", f", {_PL} SELECT * FROM pl")
def g16(part):
    """The spelling of a number as text differs between engines, so it is checked for its presence only."""
    out = props(part).withColumn("flags", F.array_join("flags", "|"))
    return out.withColumn("value_raw", F.when(F.col("property") == "p_retailprice", "n").otherwise(F.col("value_raw")))


@query("g16_latest_property", "lineitem", "SELECT id, property, reference, value FROM (SELECT l_partkey AS id, l_returnflag AS property, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE l_linestatus END AS reference, l_quantity AS value, row_number() OVER (PARTITION BY l_partkey, l_returnflag, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE l_linestatus END ORDER BY l_shipdate DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1")
def g16b(lineitem):
    return I.latest_property(lineitem.select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("property"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linestatus")).alias("reference"), F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("at")))


@query("g17_crosscheck", "part", "SELECT count(*) AS compared, count(*) FILTER (WHERE abs(p_retailprice - (p_retailprice + (p_partkey % 4) * 0.25::DOUBLE)) > 0.6::DOUBLE) AS mismatched FROM part")
def g17(part):
    a = part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"))
    b = part.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + (F.col("p_partkey") % 4) * 0.25).alias("value"))
    return I.crosscheck(a, b, 0.6)


@query("g18_property_summary", "part", f", {_PL} SELECT property, derivation, count(*) AS n, count(value) AS numeric, round(avg(confidence), 2) AS confidence FROM pl GROUP BY 1, 2")
def g18(part):
    return I.property_summary(props(part))


@query("g18_flag_counts", "part", f", {_PL} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM pl WHERE flags <> '') GROUP BY 1")
def g18b(part):
    return I.flag_counts(props(part))


_FOLD = "regexp_replace(lower(translate({}, 'ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿĆćČčĘęŁłŃńŚśŠšŹźŻżŽžŐőŰűĞğİıŞş', 'AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyyCcCcEeLlNnSsSsZzZzZzOoUuGgIiSs')), '[^a-z]', '', 'g')"
_EK = _FOLD.format(r"regexp_replace(regexp_replace(name, '^(prof\.?\s*)?(dr\.?\s*)?', '', 'i'), '\s*\(.*\)$', '')")
_ML = rf"ml AS (SELECT DISTINCT person_key, paper_id FROM (SELECT id AS paper_id, {_FOLD.format('author')} AS person_key FROM (SELECT id, unnest(regexp_split_to_array(authors, '\s*[;,]\s*')) AS author FROM papers WHERE relevance_llm >= 60)) WHERE length(person_key) >= 6 AND person_key IN (SELECT {_EK} FROM people))"


@query("h1_match_authors", "papers people", f", {_ML} SELECT * FROM ml")
def h1(papers, people):
    return I.match_authors(papers, people)


@query("h2_merge_people", "papers people", f""", {_ML}, k AS (SELECT *, {_EK} AS person_key, CASE WHEN id % 13 = 0 THEN concat('A', id) END AS openalex_id FROM people), o AS (SELECT person_key, min(id) AS id, arg_min(current_org, id) FILTER (WHERE current_org IS NOT NULL) AS current_org, arg_min(country, id) AS country, arg_min(relevance_score, id) FILTER (WHERE relevance_score IS NOT NULL) AS relevance_score, arg_min(openalex_id, id) FILTER (WHERE openalex_id IS NOT NULL) AS openalex_id FROM k GROUP BY 1),
p AS (SELECT person_key, count(*) AS papers, min(paper_id) AS first_paper, max(paper_id) AS last_paper FROM ml GROUP BY 1) SELECT * FROM o JOIN p USING (person_key) WHERE papers >= 40 OR openalex_id IS NOT NULL""")
def h2(papers, people):
    return I.merge_people(people.withColumn("openalex_id", F.when(F.col("id") % 13 == 0, F.concat(F.lit("A"), "id"))), I.match_authors(papers, people), 40)


@query("h3_people_papers", "papers paper_topics topics", "SELECT id, len(string_split(authors, ';')) AS authors, coalesce((SELECT string_agg(DISTINCT slug, '|' ORDER BY slug) FROM paper_topics j JOIN topics t ON t.id = j.topic_id WHERE j.source_id = papers.id), '') AS slugs FROM papers")
def h3(papers, junction, topics):
    return I.people_papers(papers, junction, topics)


#: Affiliations that reach the rules of cleaning, country and sector: by remainder, what is given and what must come out.
_AFFILIATIONS = [
    ("'Jiangnan University, School of Food, 1800 Lihu Road, Wuxi; second lab'", "NULL", "'Jiangnan University, School of Food'", "'CN'", "'academic'"),
    ("'Nestle Research. a.b@nestle.com Electronic address: c@d.ch'", "'Switzerland'", "'Nestle Research'", "'CH'", "'industry'"),
    ("'Wageningen Food Institute of Health, P.O. Box 16, Wageningen'", "'nl'", "'Wageningen Food Institute of Health'", "'NL'", "'ngo'"),
    ("'Lab 5, Tokyo'", "''", "'Lab 5, Tokyo'", "'JP'", "'academic'"),
    ("NULL", "'USA'", "NULL", "'US'", "'unknown'"),
    ("'x@y.org'", "'Atlantis'", "NULL", "NULL", "'academic'"),
    ("'Acme Meats Ltd, Leeds, UK.'", "NULL", "'Acme Meats Ltd, Leeds, UK'", "'GB'", "'industry'"),
    ("'Universität Hohenheim, , Stuttgart'", "NULL", "'Universität Hohenheim, Stuttgart'", "'DE'", "'academic'"),
    ("'CSIRO, Queensland 4108'", "NULL", "'CSIRO'", "'AU'", "'ngo'"),
    ("'Somewhere'", "'United Kingdom '", "'Somewhere'", "'GB'", "'academic'"),
    ("concat(repeat('long ', 30), ', Gent')", "NULL", "substr(repeat('long ', 30), 1, 120)", "'BE'", "'academic'"),
]


def _by_remainder(at):
    return f"CASE c_custkey % {len(_AFFILIATIONS)} " + " ".join(f"WHEN {i} THEN {row[at]}" for i, row in enumerate(_AFFILIATIONS)) + " END"


ADAPTERS["affiliations"] = f"SELECT c_custkey AS id, {_by_remainder(0)} AS affiliation, {_by_remainder(1)} AS country FROM customer"


@query("h4_infer_affiliation", "affiliations customer", f"SELECT c_custkey AS id, {_by_remainder(2)} AS clean, {_by_remainder(4)} AS sector, {_by_remainder(3)} AS iso FROM customer")
def h4(affiliations, customer):
    return I.infer_affiliation(affiliations, "affiliation", "country").select("id", "clean", "sector", "iso")


@query("h5_org_directory", "org_rows nation", "SELECT o.id, o.name, o.org_type, o.country, a.iso, a.region FROM org_rows o LEFT JOIN (SELECT concat('N', n_nationkey) AS country, concat('I', n_nationkey) AS iso, concat('R', n_regionkey) AS region FROM nation) a ON a.country = o.country WHERE org_type = 'MACHINERY' AND region = 'R1' ORDER BY name, id LIMIT 20")
def h5(orgs, nation):
    aliases = nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("country"), F.concat(F.lit("I"), F.col("n_nationkey")).alias("iso"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("region"))
    return I.org_directory(orgs, aliases, "MACHINERY", "R1", 50).select("id", "name", "org_type", "country", "iso", "region")


@query("h5_org_directory_country", "org_rows nation", "SELECT o.id, o.name, o.org_type, o.country, a.iso, a.region FROM org_rows o LEFT JOIN (SELECT concat('N', n_nationkey) AS country, concat('I', n_nationkey) AS iso, concat('R', n_regionkey) AS region FROM nation) a ON a.country = o.country WHERE iso = 'I7' ORDER BY name, id LIMIT 5")
def h5b(orgs, nation):
    aliases = nation.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("country"), F.concat(F.lit("I"), F.col("n_nationkey")).alias("iso"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("region"))
    return I.org_directory(orgs, aliases, limit=5, country="I7").select("id", "name", "org_type", "country", "iso", "region")


@query("h8_import_new_orgs", "org_rows supplier", ", c AS (SELECT id, concat('Supplier#', lpad(CAST(id % 300 AS VARCHAR), 9, '0')) AS name, org_type FROM org_rows) SELECT id, name, org_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS k FROM c WHERE lower(name) NOT IN (SELECT lower(trim(upper(s_name))) FROM supplier)) WHERE k = 1")
def h8(orgs, supplier):
    candidates = orgs.select("id", F.concat(F.lit("Supplier#"), F.lpad((F.col("id") % 300).cast("string"), 9, "0")).alias("name"), "org_type")
    return I.import_new_orgs(candidates, supplier.select(F.upper("s_name").alias("name")))


_JV = """jv AS (SELECT *, CASE id % 5 WHEN 0 THEN upper(journal) WHEN 1 THEN journal WHEN 2 THEN concat(journal, ' (Basel, Switzerland)') WHEN 3 THEN concat(journal, ' : An Open Access Journal from MDPI') ELSE concat(journal, ' & Co:') END AS j2 FROM papers)"""
_JK = r"trim(regexp_replace(regexp_replace(replace(lower(regexp_replace(regexp_replace(trim(j2), '(?i)\s*:?\s*an open access journal from mdpi\s*$', ''), '\s*\([^)]*\)', '', 'g')), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def journals_of(papers):
    k, ends = F.col("id") % 5, {2: " (Basel, Switzerland)", 3: " : An Open Access Journal from MDPI", 4: " & Co:"}
    name = F.when(k == 0, F.upper("journal")).when(k == 1, F.col("journal"))
    for at, end in ends.items():
        name = name.when(k == at, F.concat("journal", F.lit(end)))
    return papers.withColumn("journal", name)


@query("h9_group_journals", "papers", rf""", {_JV}, v AS (SELECT {_JK} AS key, j2 AS journal, count(*) AS n, count(*) FILTER (WHERE doi IS NULL) AS no_doi, min(year) AS first, max(year) AS last, count(*) FILTER (WHERE is_review) AS reviews FROM jv GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(regexp_replace(journal, '[^A-Z]', '', 'g')) DESC, length(journal), journal) AS k FROM v)
SELECT key, regexp_replace(trim(regexp_replace(regexp_replace(max(journal) FILTER (WHERE k = 1), '\s*\([^)]*\)', '', 'g'), '(?i)\s*:?\s*an open access journal from mdpi\s*$', '')), '[,;:]+$', '') AS journal, CAST(sum(n) AS BIGINT) AS n, CAST(sum(no_doi) AS BIGINT) AS no_doi, min(first) AS first, max(last) AS last, CAST(sum(reviews) AS BIGINT) AS reviews, string_agg(journal, '|' ORDER BY journal) AS variants FROM r GROUP BY 1""")
def h9(papers):
    return I.group_journals(journals_of(papers))


_PUB = "pb AS (SELECT concat('10.', 1000 + n_nationkey) AS prefix, n_name AS publisher, CASE n_nationkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'mixed' END AS access FROM nation WHERE n_nationkey <> 5)"
_JA = f"""{_PUB}, px AS (SELECT journal, nullif(split_part(coalesce(doi, ''), '/', 1), '') AS prefix, count(*) AS n FROM papers GROUP BY 1, 2), md AS (SELECT journal, CAST(sum(n) AS BIGINT) AS n, (SELECT p2.prefix FROM px p2 WHERE p2.journal = px.journal AND p2.prefix IS NOT NULL ORDER BY p2.n DESC, p2.prefix LIMIT 1) AS prefix FROM px GROUP BY 1),
ja AS (SELECT journal, md.prefix, n, coalesce(publisher, 'unknown') AS publisher, CASE WHEN md.prefix IS NULL THEN 'none' ELSE coalesce(access, 'unknown') END AS access FROM md LEFT JOIN pb ON pb.prefix = md.prefix)"""


def access_of(papers, nation):
    k = F.col("n_nationkey")
    publishers = nation.where(k != 5).select(F.concat(F.lit("10."), (k + 1000).cast("string")).alias("prefix"), F.col("n_name").alias("publisher"), F.when(k % 3 == 0, "free").when(k % 3 == 1, "paid").otherwise("mixed").alias("access"))
    return I.journal_access(papers, publishers)


@query("h10_journal_access", "papers nation", f", {_JA} SELECT * FROM ja")
def h10(papers, nation):
    return access_of(papers, nation)


_CODE = "CASE access WHEN 'paid' THEN 'SUB' WHEN 'free' THEN CASE WHEN length(journal) % 2 = 0 THEN 'PRE' ELSE 'OA' END WHEN 'mixed' THEN 'MIX' ELSE 'UNK' END"


def coded(journals):
    """Journals under the codes of access; some free ones as preprints."""
    free = F.when(F.length("journal") % 2 == 0, "PRE").otherwise("OA")
    return journals.withColumn("access", F.when(F.col("access") == "paid", "SUB").when(F.col("access") == "free", free).when(F.col("access") == "mixed", "MIX").otherwise("UNK"))


@query("h11_platform_rollup", "papers nation", f""", {_JA}, jc AS (SELECT * REPLACE ({_CODE} AS access) FROM ja), r AS (SELECT publisher, count(*) AS journals, CAST(sum(n) AS BIGINT) AS papers, CAST(sum(CASE WHEN access = 'SUB' THEN n ELSE 0 END) AS BIGINT) AS paid, CAST(sum(CASE WHEN access IN ('OA', 'PRE') THEN n ELSE 0 END) AS BIGINT) AS free FROM jc GROUP BY 1)
SELECT *, papers - paid - free AS other, round(papers * 100.0::DOUBLE / sum(papers) OVER (), 4) AS share, CASE WHEN paid > 0 AND free = 0 THEN 'Paid subscription' WHEN free > 0 AND paid = 0 THEN 'Open access (free)' WHEN paid > 0 AND free > 0 THEN 'Mixed paid + free' ELSE 'Hybrid / unknown' END AS access_label FROM r""")
def h11(papers, nation):
    return I.platform_rollup(coded(access_of(papers, nation)))


@query("h11_access_rollup", "papers nation", f""", {_JA}, jc AS (SELECT * REPLACE ({_CODE} AS access) FROM ja), r AS (SELECT access, CAST(sum(n) AS BIGINT) AS n FROM jc GROUP BY 1)
SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (), 4) AS share, CASE access WHEN 'SUB' THEN 'Paid subscription' WHEN 'MIX' THEN 'Hybrid / varies' WHEN 'UNK' THEN 'Unknown (no DOI)' WHEN 'PRE' THEN 'Preprint (free)' ELSE 'Open access (free)' END AS access_label FROM r""")
def h11b(papers, nation):
    return I.access_rollup(coded(access_of(papers, nation)))


@query("h12_paid_shortlist", "papers nation", f", {_JA} SELECT journal, n, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM ja WHERE access = 'paid'), 2) AS paid_share, round(n * 100.0::DOUBLE / (SELECT sum(n) FROM ja), 2) AS corpus_share FROM ja WHERE access = 'paid'")
def h12(papers, nation):
    return I.paid_shortlist(access_of(papers, nation))


_TI = "ti AS (SELECT 'paper' AS entity, id, CASE WHEN relevance_llm IS NULL THEN 'unscored' WHEN relevance_llm >= 80 THEN 'A' WHEN relevance_llm >= 60 THEN 'B' ELSE 'C' END AS tier FROM papers UNION ALL SELECT 'expert', id, CASE WHEN relevance_score IS NULL THEN 'unscored' WHEN relevance_score >= 8000 THEN 'A' WHEN relevance_score >= 6000 THEN 'B' ELSE 'C' END FROM people)"


def tiers_of(papers, people):
    return I.tiers(papers, "relevance_llm", "paper", (80, 60)).unionByName(I.tiers(people, "relevance_score", "expert", (8000, 6000)))


@query("h13_tiers", "papers people", f", {_TI} SELECT * FROM ti")
def h13(papers, people):
    return tiers_of(papers, people)


@query("h13_tier_summary", "papers people", f", {_TI} SELECT entity, tier, count(*) AS n FROM ti GROUP BY 1, 2")
def h13b(papers, people):
    return tiers_of(papers, people).groupBy("entity", "tier").agg(F.count("*").alias("n"))


@query("h14_intelligence_record", "papers paper_topics topics", """SELECT id, coalesce((SELECT string_agg(DISTINCT slug, '|' ORDER BY slug) FROM paper_topics j JOIN topics t ON t.id = j.topic_id WHERE j.source_id = p.id), '') AS topics,
coalesce((SELECT string_agg(DISTINCT root_branch, '|' ORDER BY root_branch) FROM paper_topics j JOIN topics t ON t.id = j.topic_id WHERE j.source_id = p.id), '') AS branches, coalesce((SELECT string_agg(DISTINCT trim(a), '|' ORDER BY trim(a)) FROM (SELECT unnest(string_split(authors, ';')) AS a)), '') AS people FROM papers p""")
def h14(papers, junction, topics):
    tied = junction.join(topics.withColumnRenamed("id", "topic_id"), "topic_id")
    authors = papers.select("id", F.explode(F.split("authors", ";")).alias("value")).withColumn("value", F.trim("value"))
    return I.intelligence_record(papers, {"topics": tied.select(F.col("source_id").alias("id"), F.col("slug").alias("value")), "branches": tied.select(F.col("source_id").alias("id"), F.col("root_branch").alias("value")), "people": authors})


PROCESSES = ["Maillard", "Both"]
_PR = "likely_process IN ('Maillard', 'Both')"


@query("i1_top_volatiles", "library", f"SELECT entry_no, compound, chemical_group, length(coalesce(cooked_meats_reported, '')) - length(replace(coalesce(cooked_meats_reported, ''), ']', '')) AS mentions, beef_relevance_score FROM library WHERE {_PR} AND trim(compound) <> '' ORDER BY mentions DESC, beef_relevance_score DESC NULLS LAST, compound, entry_no LIMIT 12")
def i1(library):
    return I.top_volatiles(library, PROCESSES)


@query("i2_detected_aligned", "library compounds", f"SELECT count(*) AS detected, count(*) FILTER (WHERE lower(compound) IN (SELECT lower(name) FROM compounds)) AS aligned, greatest(0, count(*) - count(*) FILTER (WHERE lower(compound) IN (SELECT lower(name) FROM compounds))) AS test_only FROM library WHERE {_PR} AND trim(compound) <> ''")
def i2(library, compounds):
    return I.detected_aligned(library, compounds, PROCESSES)


@query("i3_sensory_radar", "library", f""", l AS (SELECT count(*) FILTER (WHERE odor_descriptor = 'roasted, fatty') AS a, count(*) FILTER (WHERE odor_descriptor = 'green, sweet') AS b, count(*) FILTER (WHERE odor_descriptor = 'meaty') AS c FROM library WHERE {_PR} AND compound IS NOT NULL),
h AS (SELECT unnest(['Roasted', 'Meaty', 'Fatty', 'Green', 'Sulfurous', 'Nutty', 'Caramel', 'Rancid']) AS axis, unnest([a, c, a, b, 0, 0, b, 0]) AS hits FROM l)
SELECT axis, hits::DOUBLE AS hits, round(hits::DOUBLE / greatest(1, max(hits) OVER ()), 2) AS value FROM h""")
def i3(library):
    return I.sensory_radar(library, PROCESSES)


#: A curated network over the regions, and reactions of the classes that library entries have.
MAPPING = {"PROMO": "r:oxidation", "ECONOMY": "r:strecker", "LARGE": "r:unknown"}
_NET = f"""v AS (SELECT compound AS name, chemical_group AS class FROM library WHERE {_PR} AND trim(compound) <> '' ORDER BY length(coalesce(cooked_meats_reported, '')) - length(replace(coalesce(cooked_meats_reported, ''), ']', '')) DESC, beef_relevance_score DESC NULLS LAST, compound, entry_no LIMIT 12),
ed AS (SELECT concat('p:', lower(r_name)) AS src, CASE WHEN r_regionkey % 2 = 0 THEN 'r:oxidation' ELSE 'r:strecker' END AS dst FROM region UNION ALL SELECT CASE split_part(class, ' ', 1) WHEN 'PROMO' THEN 'r:oxidation' WHEN 'ECONOMY' THEN 'r:strecker' ELSE 'r:other' END, 'v:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') FROM v)"""


def network_of(library, region):
    volatiles = I.top_volatiles(library, PROCESSES).select(F.col("compound").alias("name"), F.concat(F.lit(" "), F.split_part("chemical_group", F.lit(" "), F.lit(1)), F.lit(" ")).alias("class"))
    skeleton = region.select(F.concat(F.lit("p:"), F.lower("r_name")).alias("src"), F.when(F.col("r_regionkey") % 2 == 0, "r:oxidation").otherwise("r:strecker").alias("dst"))
    reactions = region.select(F.explode(F.array(*map(F.lit, ("r:oxidation", "r:strecker", "r:other", "r:idle")))).alias("id")).distinct()
    return I.reaction_edges(volatiles, skeleton, reactions, MAPPING, "r:other"), reactions


@query("i4_reaction_edges", "library region", f", {_NET} SELECT * FROM ed")
def i4(library, region):
    return network_of(library, region)[0]


@query("i4_backed_reactions", "library region", f", {_NET}, r AS (SELECT unnest(['r:oxidation', 'r:strecker', 'r:other', 'r:idle']) AS id) SELECT id, count(dst) AS volatiles, count(dst) > 0 AS backed FROM r LEFT JOIN ed ON src = id AND dst LIKE 'v:%' GROUP BY 1")
def i4b(library, region):
    return I.backed_reactions(*network_of(library, region))
