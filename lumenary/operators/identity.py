"""Identity of compounds, people, journals and organizations, and volatile profiles."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Identifier schemes by pattern.
SCHEMES = [("CAS", r"^\d{2,7}-\d{2}-\d$"), ("ChEBI", r"(?i)^chebi:\d+$"), ("HMDB", r"(?i)^hmdb\d{5,}$"), ("KEGG", r"(?i)^c\d{5}$")]
#: The ladder of chemical classes. The first step whose parts occur in a name, or whose endings end it, tells its class.
CLASS_LADDER = [
    ("Terpenes", ["limonene", "pinene", "terpin", "myrcene", "carene", "terpineol", "linalool", "geraniol", "citronell", "caryophyllene", "farnesene", "ocimene", "camphene", "sabinene", "menthol", "menthone", "borneol", "cadinene",
                  "humulene", "nerol", "citral", "terpene"], []),
    ("Pyrazines", ["pyrazine"], []),
    ("Sulfur compounds", ["thiophene", "thiazol", "thiadiazol", "dithiazine", "dithiol", "dithiole", "dithian", "trithiolane", "trithiane", "tetrathiane"], []),
    ("Furans", ["furan", "furfur", "furanone"], []),
    ("Nitrogen compounds", ["pyrrol", "pyridin", "pyrimidin", "oxazol", "isoxazol", "indol", "skatole", "piperidin", "morpholin", "quinoxalin", "imidazol", "amine"], []),
    ("Sulfur compounds", ["thio", "mercapto", "sulfid", "sulfanyl", "disulf", "trisulf", "sulfur", "sulfhydryl"], []),
    ("Fats", ["palmit", "stear", "oleic", "olei", "linole", "myrist", "lauric", "caproic", "caprylic", "capric", "glycer", "fatty", "arachid"], []),
    ("Lactones", ["lactone"], ["olide"]),
    ("Phenols", ["phenol", "guaiacol", "cresol", "eugenol", "vanillin", "vanillate", "catechol", "thymol", "carvacrol"], []),
    ("Acids", ["acid"], []),
    ("Esters", ["acetate", "propanoate", "butanoate", "hexanoate", "octanoate", "benzoate", "formate", "butyrate", "caproate", "valerate", "propionate"], ["oate"]),
    ("Aldehydes", ["aldehyde"], ["al"]),
    ("Ketones", ["ketone"], ["one"]),
    ("Alcohols", ["alcohol"], ["ol", "diol"]),
    ("Hydrocarbons", ["naphthalene", "benzene", "toluene", "xylene", "styrene", "indene", "anthracene", "biphenyl"], ["ane", "ene", "yne"]),
]
#: Sensory axes and the parts of odour words that count for each.
AXES = {
    "Roasted": ["roast", "toast", "popcorn", "coffee", "grilled", "burnt"], "Meaty": ["meat", "broth", "bouillon", "savor", "savour", "umami", "brothy"],
    "Fatty": ["fat", "oily", "tallow", "lard", "waxy", "creamy"], "Green": ["green", "grass", "fresh", "herbal", "cucumber", "leaf"],
    "Sulfurous": ["sulf", "sulph", "onion", "garlic", "potato", "egg", "cabbage"], "Nutty": ["nut", "almond", "hazelnut", "peanut"],
    "Caramel": ["caramel", "sweet", "honey", "malt", "butter", "chocolate", "vanilla"], "Rancid": ["rancid", "sour", "chees", "sweaty", "putrid", "pungent", "paint"],
}
#: Accented letters and what they fold to; titles before and remarks after the name of an expert.
ACCENTS = ("ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿĆćČčĘęŁłŃńŚśŠšŹźŻżŽžŐőŰűĞğİıŞş", "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyyCcCcEeLlNnSsSsZzZzZzOoUuGgIiSs")
TITLES, REMARKS = r"(?i)^(prof\.?\s*)?(dr\.?\s*)?", r"\s*\(.*\)$"


#: Quotes that may stand around a name.
QUOTES = "\"'`“”‘’«»"


def display_name(text: str | None) -> str:
    """NFKC, no blanks or quotes at either end, single blanks within; empty if nothing is left."""
    if text is None:
        return ""
    bare = unicodedata.normalize("NFKC", text).strip().strip(QUOTES).strip()
    return re.sub(r"\s+", " ", bare)


def norm_synonym(text: str | None) -> str:
    """The key of a name: as displayed, case folded."""
    return display_name(text).casefold()


def normalise_names(df: DataFrame, col: str = "name") -> DataFrame:
    """`key` (normalised) and `display` (the same in its own case); both are empty for a blank or missing name."""
    def mapped(f):
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(f)
        return run(F.col(col))
    return df.withColumn("key", mapped(norm_synonym)).withColumn("display", mapped(display_name))


def resolve_synonyms(names: DataFrame, candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(pos, key, molecule, outcome): exists, ambiguous, unresolved, attached or created; the first name of a new molecule creates it.

    names: pos, key; candidates: key, molecule; registry: key, molecule.
    """
    per_key = candidates.groupBy("key").agg(F.countDistinct("molecule").alias("n"), F.min("molecule").alias("candidate"))
    known_keys = registry.groupBy("key").agg(F.min("molecule").alias("known"))
    known_molecules = registry.select(F.col("molecule").alias("candidate")).distinct().withColumn("held", F.lit(True))
    first = names.groupBy("key").agg(F.min("pos").alias("first_pos"))
    out = names.join(first, "key").join(known_keys, "key", "left").join(per_key, "key", "left").join(known_molecules, "candidate", "left")
    fresh = F.col("known").isNull() & (F.coalesce("n", F.lit(0)) == 1) & F.col("held").isNull()
    creator = out.where(fresh).groupBy("candidate").agg(F.min("pos").alias("creator"))
    out = out.join(creator, "candidate", "left")
    outcome = (F.when(F.col("known").isNotNull(), "exists").when(F.col("n") > 1, "ambiguous").when(F.coalesce("n", F.lit(0)) == 0, "unresolved")
               .when(F.col("held"), F.when(F.col("pos") == F.col("first_pos"), "attached").otherwise("exists")).when(F.col("pos") == F.col("creator"), "created").when(F.col("pos") == F.col("first_pos"), "attached").otherwise("exists"))
    molecule = F.coalesce("known", F.when(F.col("n") == 1, F.col("candidate")))
    return out.select("pos", "key", molecule.alias("molecule"), outcome.alias("outcome"))


def attach_synonyms(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry after new synonyms: unresolved ones may become resolved, a collision is reported and changes nothing."""
    added = new.groupBy("key").agg(F.min("molecule").alias("new_molecule"))
    out = registry.join(added, "key", "full_outer")
    conflict = F.col("molecule").isNotNull() & F.col("new_molecule").isNotNull() & (F.col("molecule") != F.col("new_molecule"))
    return out.select("key", F.coalesce("molecule", "new_molecule").alias("molecule"), F.coalesce(conflict, F.lit(False)).alias("conflict"))


def backfill_nulls(master: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Empty fields filled from the other table, known ones kept."""
    other = new.groupBy(key).agg(*[F.min(c).alias(f"{c}_new") for c in cols])
    return master.join(other, key, "left").select(key, *[F.coalesce(F.col(c), F.col(f"{c}_new")).alias(c) for c in cols])


def classify_identifiers(synonyms: DataFrame) -> DataFrame:
    """(molecule, scheme, value, primary): distinct identifiers; a molecule's first CAS number is its primary one."""
    scheme = reduce(lambda acc, s: F.when(F.col("synonym").rlike(s[1]), s[0]).otherwise(acc), reversed(SCHEMES), F.lit(None).cast("string"))
    found = synonyms.withColumn("scheme", scheme).where(F.col("scheme").isNotNull()).withColumn("value", F.upper("synonym"))
    first = found.groupBy("molecule", "scheme").agg(F.min_by("value", F.struct("pos", "value")).alias("first"))
    distinct = found.select("molecule", "scheme", "value").distinct()
    return distinct.join(first, ["molecule", "scheme"]).select("molecule", "scheme", "value", ((F.col("scheme") == "CAS") & (F.col("value") == F.col("first"))).alias("is_primary"))


def registry_stats(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("molecule").alias("molecules"), F.countDistinct("key").alias("keys"))


def review_queue(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("ambiguous", "unresolved")).groupBy("outcome", "key").agg(F.count("*").alias("seen"))


#: Dashes that count as hyphens, what tells stereochemistry at the beginning of a name and within one, and tags in brackets.
#: Positions (alpha-, gamma-, ortho-, N-) and iso-, sec-, tert- tell other compounds and stay.
DASHES = "‐‑‒–—―−"
STEREO_PREFIXES = [r"(?i)^\(\s*(?:[0-9]{0,2}[EZRS](?:\s*,\s*[0-9]{0,2}[EZRS])*|\+|-|±|\+/-|RS|SR)\s*\)-\s*", r"(?i)^(?:cis|trans|dl|rac|d|l|\(\+\)|\(-\)|\(±\)|z|e|n)\s*-\s*"]
STEREO_INLINE = [r"\(\s*[0-9ezrs+\-±,\s]*\s*\)", r"\b(?:cis|trans|rac|racemic)\b"]
BRACKETS = r"\[[^\]]*\]"
MOST_PREFIXES = 4


def clean_name(text: str | None) -> str:
    """The displayed form with hyphens for all dashes and no full stops, commas or semicolons at the end."""
    hyphens = unicodedata.normalize("NFKC", text or "").translate({ord(d): "-" for d in DASHES})
    return display_name(hyphens).rstrip(".,;").strip()


def without_stereo(name: str) -> str:
    """A name without up to four stereo prefixes; a bracketed one is looked for first."""
    for _ in range(MOST_PREFIXES):
        shorter = next((s for s in (re.sub(p, "", name, count=1) for p in STEREO_PREFIXES) if s != name), name)
        if shorter == name:
            break
        name = shorter
    return name.strip()


def match_key(name: str | None) -> str:
    """Letters and digits of a name without stereochemistry and tags; tells whether two spellings are one name."""
    key = without_stereo(re.sub(BRACKETS, " ", clean_name(name).lower()))
    for pattern in STEREO_INLINE:
        key = re.sub(pattern, " ", key)
    return re.sub(r"[^a-z0-9]", "", key)


def around_parenthesis(name: str | None) -> tuple[str | None, str | None]:
    """What stands before and within the balanced parenthesis that ends a name, if both are there."""
    text = clean_name(name)
    opened = []
    begin = None
    for i, c in enumerate(text):
        if c == "(":
            opened.append(i)
        elif c == ")" and opened:
            begin = opened.pop()
            if i < len(text) - 1:
                begin = None
    if not text.endswith(")") or not begin:
        return None, None
    head, inner = text[:begin].strip().rstrip("-,").strip(), text[begin + 1 : -1].strip()
    return (head, inner) if head and inner else (None, None)


#: Other spacings of a name and why they are tried.
SPACINGS = [("tighten_commas", [(", ", ",")]), ("tighten_hyphens", [(" - ", "-"), (" -", "-"), ("- ", "-")]), ("drop_spaces", [(" ", "")])]


def name_variants(name: str | None) -> list[tuple[str, str]]:
    """(variant, reason) in the order in which they are looked up: other spellings of a name but itself, each once whatever its case."""
    clean = clean_name(name)
    head, inner = around_parenthesis(clean)
    tried = [(clean, "base_clean"), (head, "strip_parenthetical"), (inner, "parenthetical_synonym")]
    tried += [(without_stereo(x), "strip_stereo" + tag) for x, tag in ((clean, ""), (head, "+head"), (inner, "+synonym")) if x]
    for x in (clean, head, inner, without_stereo(clean)):
        for why, changes in SPACINGS if x else ():
            tried.append((reduce(lambda text, change: text.replace(*change), changes, x), why))
    known, out = {(name or "").strip().lower()}, []
    for variant, why in ((v.strip(), w) for v, w in tried if v):
        if len(variant) > 1 and variant.lower() not in known:
            known.add(variant.lower())
            out.append((variant, why))
    return out


def query_keys(name: str | None) -> list[str]:
    """Match keys of a name, of what stands before and within its last parenthesis, and of these without stereo prefixes."""
    parts = [x for x in (clean_name(name), *around_parenthesis(name)) if x]
    return sorted({k for x in parts for k in (match_key(x), match_key(without_stereo(x))) if k})


def name_keys(df: DataFrame) -> DataFrame:
    """(id, variant, reason, pos) of each name."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, v, why, k) for i, name in zip(pdf["id"], pdf["name"], strict=True) for k, (v, why) in enumerate(name_variants(name))]
            yield pd.DataFrame(rows, columns=["id", "variant", "reason", "pos"])
    return df.select("id", "name").mapInPandas(run, "id long, variant string, reason string, pos int")


def identity_ladder(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first rung with one candidate wins; else the first with several is ambiguous; else unresolved. candidates: id, rung, cid."""
    per_rung = candidates.groupBy("id", "rung").agg(F.countDistinct("cid").alias("n"), F.min("cid").alias("cid"))
    best = per_rung.groupBy("id").agg(F.min_by(F.struct("rung", "cid"), F.when(F.col("n") == 1, F.col("rung"))).alias("one"), F.min(F.when(F.col("n") == 1, F.col("rung"))).alias("one_rung"), F.min(F.when(F.col("n") > 1, F.col("rung"))).alias("many_rung"))
    out = names.select("id").join(best, "id", "left")
    status = F.when(F.col("one_rung").isNotNull(), "resolved").when(F.col("many_rung").isNotNull(), "ambiguous").otherwise("unresolved")
    return out.select("id", status.alias("status"), F.coalesce("one_rung", "many_rung").alias("rung"), F.when(F.col("one_rung").isNotNull(), F.col("one.cid")).alias("cid"))


#: Rungs that looked a compound up by its CAS number.
CAS_RUNGS = ["cas_lookup", "mvl_cas"]


def verify_identity(resolved: DataFrame) -> DataFrame:
    """(id, accepted, note, cas_mismatch): whether a compound's own names confirm what was looked up.

    Accepted if it lists no names at all (which is noted), if a query key is among its names' keys, or if it was found by its
    CAS number and lists that. A listed CAS number that is another one is flagged. Columns: id, cas, rung, query_keys,
    synonym_keys, cas_list.
    """
    silent = F.coalesce(F.size("synonym_keys") < 1, F.lit(True))
    named = F.coalesce(F.arrays_overlap("query_keys", "synonym_keys"), F.lit(False))
    listed = F.coalesce(F.array_contains("cas_list", F.col("cas")), F.lit(False))
    by_cas = listed & F.coalesce(F.col("rung").isin(CAS_RUNGS), F.lit(False))
    note = F.when(silent, "+no_synonym_list").when(named, "").when(by_cas, "+verified_by_cas").otherwise(F.concat(F.lit("unverified:"), F.coalesce("rung", F.lit(""))))
    return resolved.select("id", (silent | named | by_cas).alias("accepted"), note.alias("note"), (F.coalesce(F.size("cas_list") > 0, F.lit(False)) & F.col("cas").isNotNull() & ~listed).alias("cas_mismatch"))


def identity_report(df: DataFrame) -> DataFrame:
    """Groups of rows that share a key, with the id:name list of their first 20; no task holds more of a group than that."""
    n = df.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    first = df.select("key", "id", "name").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id", "name"))).where("nth <= 20")
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: F.concat_ws(":", x["id"].cast("string"), x["name"])), "; ")
    return n.join(first.groupBy("key").agg(members.alias("members")).hint("merge"), "key")


def fill_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n): rows, and how many of them have each field."""
    one = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in ("rows", *columns)])).alias("x")).select("x.*")


def rung_breakdown(df: DataFrame) -> DataFrame:
    """(rung, n): what found each compound, without the value it was looked up by, remarks and notes."""
    return df.groupBy(F.regexp_extract(F.coalesce("id_match_method", F.lit("not attempted")), r"^[^:+(]*", 0).alias("rung")).agg(F.count("*").alias("n"))


def review_reasons(df: DataFrame) -> DataFrame:
    """(reason, n): why compounds need a review."""
    method = F.col("id_match_method")
    reason = F.when(method.startswith("ambiguous"), "ambiguous (>1 CID)").when(method.startswith("unresolved"), "unresolved (no match)").when(method.contains("cas_mismatch"), "CAS mismatch vs PubChem").otherwise("other")
    return df.where("id_needs_review").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def chemical_class(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.lit("Other")
    for label, parts, endings in reversed(CLASS_LADDER):
        hit = reduce(lambda a, b: a | b, [low.contains(p) for p in parts] + [low.endswith(e) for e in endings])
        out = F.when(hit, label).otherwise(out)
    return out


def categorize(molecules: DataFrame) -> DataFrame:
    """The class by name of molecules without a category or with `Unclassified`."""
    return molecules.where(F.col("category").isNull() | (F.col("category") == "Unclassified")).select("id", chemical_class(F.col("name")).alias("class"))


def class_tally(categorized: DataFrame) -> DataFrame:
    return categorized.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def flag_junk(df: DataFrame, artifacts: list[str]) -> DataFrame:
    return df.withColumn("is_junk", F.coalesce(F.lower(F.trim("name")).isin(artifacts), F.lit(False)))


def norm_mvl(c: Column) -> Column:
    return F.translate(F.lower(c), " ,-", "")


def backfill_from_reference(molecules: DataFrame, library: DataFrame) -> DataFrame:
    """CAS, pathway and sorted matrices from the library entry whose normalised name is the only one."""
    keyed = library.withColumn("key", norm_mvl(F.col("compound")))
    one = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cas_number").alias("cas_ref"), F.min("likely_process").alias("pathway"), F.min("cooked_meats_reported").alias("meats")).where("n = 1")
    found_in = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.translate("meats", "[]", ",,"), ","), lambda x: F.trim(x)), lambda x: x != ""))), "|")
    return molecules.withColumn("key", norm_mvl(F.col("name"))).join(one, "key", "left").select("id", F.coalesce("cas", "cas_ref").alias("cas"), "pathway", F.nullif(found_in, F.lit("")).alias("found_in"))


def parse_threshold(df: DataFrame, col: str = "odor_threshold") -> DataFrame:
    """threshold, threshold_matrix and flags: head and matrix at the first comma, a number only for a bare one, units never guessed."""
    text = F.trim(F.coalesce(F.col(col), F.lit("")))
    head = F.trim(F.split_part(text, F.lit(","), F.lit(1)))
    matrix = F.nullif(F.trim(F.substring(text, F.length(F.split_part(text, F.lit(","), F.lit(1))) + 2, F.length(text))), F.lit(""))
    limit = head.rlike(r"(?i)greater than|less than|[<>≥≤]")
    span = head.rlike(r"(?i)[~–—-]|\bto\b")
    number = F.when(~limit & ~span & head.rlike(r"^[0-9]+(\.[0-9]+)?$"), head.try_cast("double"))
    kind = F.when(limit, "limit_not_point_value").when(span, "range_not_point_value")
    flags = F.when(text == "", F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(F.when(matrix.isNotNull(), "matrix_qualified"), kind, F.lit("unit_not_stated_in_source"))))
    return df.withColumns({"threshold": number, "threshold_matrix": matrix, "flags": F.array_join(flags, "|")})


def properties_long(df: DataFrame, props: dict[str, tuple[str | None, str, float, list[str]]], derivation: str = "system_derived") -> DataFrame:
    """A row for each known property, with where it comes from: (id, property, value_raw, value, unit, derivation, method, confidence, flags).

    props: by property its unit, method, confidence and flags. A value that is text has no number; a list is joined by commas.
    """
    def row(p: str, unit: str | None, method: str, confidence: float, flags: list[str]) -> Column:
        kind = df.schema[p].dataType.typeName()
        raw = F.array_join(p, ",") if kind == "array" else F.col(p).cast("string")
        number = F.lit(None).cast("double") if kind in ("array", "string") else F.col(p).cast("double")
        fields = {"property": F.lit(p), "value_raw": raw, "value": number, "unit": F.lit(unit).cast("string"), "derivation": F.lit(derivation), "method": F.lit(method), "confidence": F.lit(confidence), "flags": F.array(*map(F.lit, flags)).cast("array<string>")}
        return F.struct(*[c.alias(name) for name, c in fields.items()])
    rows = F.explode(F.array(*[row(p, *about) for p, about in props.items()])).alias("x")
    return df.select("id", rows).select("id", "x.*").where(F.col("value_raw").isNotNull())


def latest_property(rows: DataFrame) -> DataFrame:
    """The newest value by molecule, property and reference (none counts as '')."""
    return rows.groupBy("id", "property", F.coalesce("reference", F.lit("")).alias("reference")).agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def crosscheck(a: DataFrame, b: DataFrame, tolerance: float = 0.5) -> DataFrame:
    both = a.select("id", F.col("value").alias("x")).join(b.select("id", F.col("value").alias("y")), "id")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("mismatched"))


def property_summary(rows: DataFrame) -> DataFrame:
    """By property and derivation: rows, rows with a number, and mean confidence."""
    return rows.groupBy("property", "derivation").agg(F.count("*").alias("n"), F.count("value").alias("numeric"), F.round(F.avg("confidence"), 2).alias("confidence"))


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# People, journals and organizations.

def author_key(c: Column) -> Column:
    """Accents folded, lower case, letters only."""
    return F.regexp_replace(F.lower(F.translate(c, *ACCENTS)), "[^a-z]", "")


def expert_key(c: Column) -> Column:
    """The key of an expert's name, without titles in front and remarks in parentheses behind."""
    return author_key(F.regexp_replace(F.regexp_replace(c, TITLES, ""), REMARKS, ""))


def match_authors(papers: DataFrame, people: DataFrame, gate: int = 60) -> DataFrame:
    """(person_key, paper_id): authors of papers past the gate that are known people."""
    names = papers.where(F.col("relevance_llm") >= gate).select("id", F.explode(F.split("authors", r"\s*[;,]\s*")).alias("author"))
    keys = names.select(F.col("id").alias("paper_id"), author_key(F.col("author")).alias("person_key")).where(F.length("person_key") >= 6)
    known = people.select(expert_key(F.col("name")).alias("person_key")).distinct()
    return keys.join(known.hint("merge"), "person_key", "left_semi").distinct()


def merge_people(people: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """People of one key as one: smallest id, first known attributes in id order, papers; kept with an open id, or with `least` papers.

    `links` is the list of a person's papers; here they are counted.
    """
    known = [c for c in ("current_org", "country", "relevance_score", "h_index", "orcid", "openalex_id") if c in people.columns]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    one = people.withColumn("person_key", expert_key(F.col("name"))).groupBy("person_key").agg(F.min("id").alias("id"), *map(first, known))
    papers = links.groupBy("person_key").agg(F.count("*").alias("papers"), F.min("paper_id").alias("first_paper"), F.max("paper_id").alias("last_paper"))
    open_ = F.col("openalex_id").isNotNull() if "openalex_id" in known else F.lit(False)
    return one.join(papers.hint("merge"), "person_key").where(open_ | (F.col("papers") >= least))


def people_papers(papers: DataFrame, junction: DataFrame, topics: DataFrame) -> DataFrame:
    tags = junction.join(topics.select(F.col("id").alias("topic_id"), "slug"), "topic_id").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("slug")), "|").alias("slugs"))
    return papers.join(tags, "id", "left").select("id", F.size(F.split("authors", ";")).cast("long").alias("authors"), F.coalesce("slugs", F.lit("")).alias("slugs"))


#: Names of countries, and places that tell a country where none is given, first match first.
COUNTRIES = {
    "china": "CN", "usa": "US", "united states": "US", "uk": "GB", "united kingdom": "GB", "germany": "DE", "france": "FR", "spain": "ES", "belgium": "BE", "canada": "CA", "switzerland": "CH", "netherlands": "NL", "italy": "IT",
    "japan": "JP", "korea": "KR",
}
PLACES = [
    ("CA", r"agri-food canada|\bcanada\b|toronto|guelph|alberta|manitoba|saskatchewan|mcgill|british columbia"),
    ("CN", r"\bchina\b|chinese|people's republic|beijing|shanghai|jiangnan|jiangsu|hubei|hunan|henan|anhui|gansu|guangdong|guangxi|guangzhou|harbin|hefei|huazhong|jinan|ludong|nanjing|qinghai|shaanxi|sichuan|tianjin|zhengzhou|zhongkai|"
           r"xihua|xi'an|bohai|minzu|lanzhou|changchun|ningbo|xinjiang|zhejiang|hangzhou|shandong|wuhan|shenzhen|chongqing|fujian|yunnan|northeast agricultural|north ?west agricult|southwest university|ministry of agriculture and rural affairs"),
    ("KR", r"korea|seoul|jeonbuk|keimyung|sunchon|konkuk|chungnam|chonnam|pusan|busan|kyung"),
    ("JP", r"japan|tokyo|kyoto|osaka"),
    ("US", r"\busa\b|united states|alabama|new jersey|rutgers|tufts|miami university|parkland college|california|texas|florida|iowa|illinois|kansas|oklahoma|nebraska|purdue|cornell|massachusetts|ohio|michigan|wisconsin|minnesota|appalachian|"
           r"north carolina"),
    ("GB", r"united kingdom|\buk\b|england|scotland|london|university of reading|nottingham|leeds"),
    ("DE", r"germany|munich|münchen|hohenheim|berlin|hamburg|bonn|dresden"),
    ("NL", r"netherlands|nederland|amsterdam|wageningen|utrecht|delft"),
    ("BE", r"belgium|gembloux|ghent|\bgent\b|leuven|liège|brussels"),
    ("CH", r"switzerland|nestl|zurich|zürich|geneva|lausanne"),
    ("FR", r"\bfrance\b|paris|inrae|dijon|nantes"),
    ("ES", r"\bspain\b|españa|galicia|valencia|madrid|barcelona|instituto de agroqu"),
    ("IT", r"\bitaly\b|milan|bologna|napoli|naples|parma|torino"),
    ("SE", r"sweden|chalmers|uppsala|\blund\b|stockholm"),
    ("DK", r"denmark|copenhagen|aarhus"),
    ("FI", r"finland|helsinki|turku"),
    ("EE", r"estonia|tallinn|tftak"),
    ("AT", r"austria|austrian|vienna|wien|graz"),
    ("PL", r"poland|warsaw|poznan|krakow"),
    ("IE", r"ireland|dublin|teagasc"),
    ("NZ", r"new zealand|auckland|massey|otago|agresearch"),
    ("AU", r"australia|sydney|unsw|melbourne|queensland|csiro"),
    ("SG", r"singapore|a\*star"),
    ("TH", r"thailand|songkla|bangkok|chulalongkorn|kasetsart"),
    ("IN", r"\bindia\b|mysore|delhi|cftri"),
    ("BR", r"brazil|são paulo|sao paulo|campinas|utfpr"),
    ("IL", r"israel|tel aviv|hebrew university|technion|volcani"),
    ("RS", r"serbia|belgrade"),
]
#: Words that tell a sector, first match first; the default, and what no affiliation at all is.
SECTORS = [
    ("industry", r"\bco\.|\bltd\b|\binc\b|gmbh|\bb\.v\.|nestl|corp\b|company|\bgroup\b|\badm\b|distillery|tobacco|\bas\b|\bs\.a\b|zuivel o+nderzoek|\bnizo\b"),
    ("academic", r"universit|college|school|hochschule|polytechnic|institute of technology"),
    ("ngo", r"ministry|academy of|national institute|research institute|state key laboratory|agri-food canada|inrae|agresearch|a\*star|competence cent|instituut|institute of|instituto|centro tecnol|teagasc|csiro"),
]
OTHER_SECTOR, NO_SECTOR = "academic", "unknown"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)+"


def clean_affiliation(raw: Column) -> Column:
    """Without e-mails and what follows `electronic address:` or a semicolon, up to the first later part with a digit; 120 characters."""
    text = F.split_part(F.split(F.regexp_replace(raw, EMAIL, ""), "(?i)electronic address:").getItem(0), F.lit(";"), F.lit(1))
    parts = F.split(text, ",")
    numbered = F.filter(F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("[0-9]"), i)), lambda i: i.isNotNull())
    kept = F.slice(parts, 1, F.coalesce(F.get(numbered, F.lit(0)), F.size(parts)))
    joined = F.array_join(F.filter(F.transform(kept, lambda p: F.trim(p)), lambda p: p != ""), ", ")
    return F.nullif(F.substring(F.regexp_replace(joined, r"^[ ,.]+|[ ,.]+$", ""), 1, 120), F.lit(""))


def infer_country(value: Column, affiliation: Column) -> Column:
    """The ISO code given, or of the name given, or of the first place that the affiliation names."""
    v = F.trim(F.coalesce(value, F.lit("")))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv]), F.lower(v))
    place = reduce(lambda acc, s: F.when(F.lower(affiliation).rlike(s[1]), s[0]).otherwise(acc), reversed(PLACES), F.lit(None).cast("string"))
    return F.when(v.rlike("^[A-Za-z]{2}$"), F.upper(v)).otherwise(F.coalesce(named, place))


def infer_sector(affiliation: Column) -> Column:
    out = reduce(lambda acc, s: F.when(F.lower(affiliation).rlike(s[1]), s[0]).otherwise(acc), reversed(SECTORS), F.lit(OTHER_SECTOR))
    return F.when(F.coalesce(affiliation, F.lit("")) == "", NO_SECTOR).otherwise(out)


def infer_affiliation(df: DataFrame, col: str, country: str) -> DataFrame:
    """`clean`, `sector` and `iso` of an affiliation and a country as it is known."""
    return df.withColumns({"clean": clean_affiliation(F.col(col)), "sector": infer_sector(F.col(col)), "iso": infer_country(F.col(country), F.col(col))})


def org_directory(orgs: DataFrame, aliases: DataFrame, sector: str | None = None, region: str | None = None, limit: int = 20, country: str | None = None) -> DataFrame:
    """Organizations by type, region and country, countries through their alias table; 20 rows at most."""
    out = orgs.join(aliases.hint("merge"), "country", "left")
    if country:
        out = out.where((F.col("country") == country) | (F.col("iso") == country))
    if sector:
        out = out.where(F.col("org_type") == sector)
    if region:
        out = out.where(F.col("region") == region)
    return out.orderBy("name", "id").limit(min(20, max(1, limit)))


def import_new_orgs(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """The first candidate of each name that is not known, ignoring case."""
    known = existing.select(F.lower(F.trim("name")).alias("key")).distinct()
    return candidates.withColumn("key", F.lower(F.trim("name"))).join(known, "key", "left_anti").groupBy("key").agg(F.min_by(F.struct("id", "name", "org_type"), "id").alias("o")).select("o.*")


#: The tail that a publisher adds to its journals' names.
TAIL, PARENTHESES = r"(?i)\s*:?\s*an open access journal from mdpi\s*$", r"\s*\([^)]*\)"


def journal_key(c: Column) -> Column:
    """One key for the spellings of a journal: no tail, no parentheses, lower case, `&` as and, letters and digits only."""
    bare = F.replace(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), TAIL, ""), PARENTHESES, "")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9 ]+", " "), r"\s+", " "))


def group_journals(papers: DataFrame) -> DataFrame:
    """Journals by key: counts, years, variants; shown under the most frequent variant, then most capitals, then shortest."""
    keyed = papers.where(F.trim("journal") != "").withColumn("key", journal_key(F.col("journal")))
    variants = keyed.groupBy("key", "journal").agg(F.count("*").alias("n"), F.count_if(F.col("doi").isNull()).alias("no_doi"), F.min("year").alias("first"), F.max("year").alias("last"), F.count_if("is_review").alias("reviews"))
    capitals = F.length(F.regexp_replace("journal", "[^A-Z]", ""))
    best = F.min_by("journal", F.struct(-F.col("n"), -capitals, F.length("journal"), F.col("journal")))
    shown = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(best, PARENTHESES, ""), TAIL, "")), "[,;:]+$", "")
    return variants.groupBy("key").agg(shown.alias("journal"), F.sum("n").alias("n"), F.sum("no_doi").alias("no_doi"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("reviews").alias("reviews"), F.array_join(F.array_sort(F.collect_set("journal")), "|").alias("variants"))


def journal_access(papers: DataFrame, publishers: DataFrame) -> DataFrame:
    """The most frequent DOI prefix of each journal and what is known about its publisher."""
    prefixes = papers.withColumn("prefix", F.nullif(F.split_part(F.coalesce("doi", F.lit("")), F.lit("/"), F.lit(1)), F.lit(""))).groupBy("journal", "prefix").agg(F.count("*").alias("n"))
    modal = prefixes.groupBy("journal").agg(F.min_by("prefix", F.when(F.col("prefix").isNotNull(), F.struct(-F.col("n"), F.col("prefix")))).alias("prefix"), F.sum("n").alias("n"))
    out = modal.join(publishers, "prefix", "left")
    access = F.when(F.col("prefix").isNull(), "none").otherwise(F.coalesce("access", F.lit("unknown")))
    return out.select("journal", "prefix", "n", F.coalesce("publisher", F.lit("unknown")).alias("publisher"), access.alias("access"))


#: Kinds of access in their order, and what they are called.
ACCESS = {"SUB": "Paid subscription", "MIX": "Hybrid / varies", "UNK": "Unknown (no DOI)", "PRE": "Preprint (free)", "OA": "Open access (free)"}


def _share(n: Column) -> Column:
    return F.round(n * 100.0 / F.sum(n).over(Window.partitionBy()), 4)


def platform_rollup(journals: DataFrame) -> DataFrame:
    """Journals, papers, paid and free papers, label and share of each publisher; most paid papers first. `access` is a key of ACCESS."""
    kinds = lambda ks: F.sum(F.when(F.col("access").isin(ks), F.col("n")).otherwise(0))
    out = journals.groupBy("publisher").agg(F.count("*").alias("journals"), F.sum("n").alias("papers"), kinds(["SUB"]).alias("paid"), kinds(["OA", "PRE"]).alias("free"))
    paid, free = F.col("paid") > 0, F.col("free") > 0
    label = F.when(paid & ~free, "Paid subscription").when(free & ~paid, "Open access (free)").when(paid & free, "Mixed paid + free").otherwise("Hybrid / unknown")
    return out.withColumns({"other": F.col("papers") - F.col("paid") - F.col("free"), "share": _share(F.col("papers")), "access_label": label}).orderBy(F.desc("paid"), F.desc("papers"), "publisher")


def access_rollup(journals: DataFrame) -> DataFrame:
    """Papers and share of each kind of access, in the kinds' order."""
    out = journals.groupBy("access").agg(F.sum("n").alias("n")).withColumn("share", _share(F.col("n")))
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv]), "access")
    return out.withColumn("access_label", name).orderBy(F.array_position(F.array(*map(F.lit, ACCESS)), F.col("access")))


def paid_shortlist(journals: DataFrame) -> DataFrame:
    """Paid journals with their share of paid papers and of the corpus."""
    total = journals.agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("access") == "paid", F.col("n"))).alias("paid_n"))
    return journals.where(F.col("access") == "paid").crossJoin(F.broadcast(total)).select("journal", "n", F.round(F.col("n") * 100.0 / F.col("paid_n"), 2).alias("paid_share"), F.round(F.col("n") * 100.0 / F.col("all_n"), 2).alias("corpus_share"))


def tiers(df: DataFrame, col: str, kind: str, cuts: tuple[float, float]) -> DataFrame:
    t = F.when(F.col(col).isNull(), "unscored").when(F.col(col) >= cuts[0], "A").when(F.col(col) >= cuts[1], "B").otherwise("C")
    return df.select(F.lit(kind).alias("entity"), "id", t.alias("tier"))


def intelligence_record(papers: DataFrame, junctions: dict[str, DataFrame]) -> DataFrame:
    """One row per paper with a sorted list from each junction (id, value), each grouped on its own before the join."""
    out = papers.select("id")
    for name, j in junctions.items():
        out = out.join(j.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias(name)), "id", "left")
    return out.select("id", *[F.coalesce(n, F.lit("")).alias(n) for n in junctions])


# Volatile profiles.

def named_compound() -> Column:
    return F.coalesce(F.trim("compound") != "", F.lit(False))


def top_volatiles(library: DataFrame, processes: list[str], k: int = 12) -> DataFrame:
    """Entries by number of citations (closing brackets), then score, then name."""
    cited = F.length(F.coalesce("cooked_meats_reported", F.lit(""))) - F.length(F.replace(F.coalesce("cooked_meats_reported", F.lit("")), F.lit("]"), F.lit("")))
    return library.where(F.col("likely_process").isin(processes) & named_compound()).withColumn("mentions", cited).select("entry_no", "compound", "chemical_group", "mentions", "beef_relevance_score").orderBy(F.desc("mentions"), F.col("beef_relevance_score").desc_nulls_last(), "compound", "entry_no").limit(k)


def detected_aligned(library: DataFrame, molecules: DataFrame, processes: list[str]) -> DataFrame:
    names = molecules.select(F.lower("name").alias("key")).distinct().withColumn("known", F.lit(True))
    own = library.where(F.col("likely_process").isin(processes) & named_compound()).withColumn("key", F.lower("compound")).join(names.hint("merge"), "key", "left")
    return own.agg(F.count("*").alias("detected"), F.count_if("known").alias("aligned")).withColumn("test_only", F.greatest(F.lit(0), F.col("detected") - F.col("aligned")))


def sensory_radar(library: DataFrame, processes: list[str]) -> DataFrame:
    """Keyword hits over all descriptors by axis, over the busiest axis."""
    text = F.lower(F.coalesce("odor_descriptor", F.lit("")))
    count = lambda k: (F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)
    wide = library.where(F.col("likely_process").isin(processes) & F.col("compound").isNotNull()).agg(*[F.sum(reduce(lambda a, b: a + b, map(count, keys))).alias(axis) for axis, keys in AXES.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit(0.0)).alias("hits")) for a in AXES])).alias("x")).select("x.*")
    return long.withColumn("value", F.round(F.col("hits") / F.greatest(F.lit(1.0), F.max("hits").over(Window.partitionBy())), 2))


def reaction_edges(volatiles: DataFrame, skeleton: DataFrame, reactions: DataFrame, mapping: dict[str, str], default: str) -> DataFrame:
    """(src, dst): the curated edges, and one from its class's reaction to each listed volatile.

    volatiles: name, class (those of `top_volatiles`); skeleton: src, dst; reactions: id. A class without a reaction, or with
    one that the network doesn't have, goes to the default.
    """
    told = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), F.trim(F.coalesce("class", F.lit("")))), F.lit(default))
    known = reactions.select(F.col("id").alias("told"), F.lit(True).alias("known"))
    own = volatiles.select("name", told.alias("told")).join(F.broadcast(known), "told", "left")
    slug = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return skeleton.select("src", "dst").unionByName(own.select(F.when(F.col("known"), F.col("told")).otherwise(F.lit(default)).alias("src"), F.concat(F.lit("v:"), slug).alias("dst")))


def backed_reactions(edges: DataFrame, reactions: DataFrame) -> DataFrame:
    """(id, volatiles, backed): how many listed volatiles each reaction leads to, and whether there is any."""
    counts = edges.where(F.startswith("dst", F.lit("v:"))).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("volatiles"))
    return reactions.select("id").join(F.broadcast(counts), "id", "left").select("id", F.coalesce("volatiles", F.lit(0)).alias("volatiles"), (F.coalesce("volatiles", F.lit(0)) > 0).alias("backed"))
