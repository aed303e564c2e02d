"""Corpus curation: priority scores, duplicates, tags, topic coverage, audits and audit feedback."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .substring import containing

#: Patterns of topics and of titles of reviews, and venues of the field (a venue is one if its name holds one of these).
TOPIC_WORDS = r"(?i)(meat|beef|pork|chicken|poultry|flavou?r|aroma|volatile|umami|maillard|strecker|lipid oxidation|sensory|odou?r|hydrolysate|yeast extract)"
REVIEW_WORDS = r"(?i)\b(review|meta-analysis|systematic|state[- ]of[- ]the[- ]art|overview|advances in)\b"
CORE_VENUES = [
    "food chemistry", "journal of agricultural and food chemistry", "meat science", "food research international",
    "comprehensive reviews in food science", "flavour and fragrance", "journal of the science of food and agriculture",
    "trends in food science", "npj science of food", "lwt", "molecules", "foods",
]
#: Most points of each signal; a paper from 2021 on is recent, one from 2015 on half so.
POINTS = {"topic": 25.0, "core": 20.0, "other": 8.0, "review": 15.0, "cites": 20.0, "recent": 10.0, "tagged": 10.0}
RECENT, FAIRLY_RECENT = 2021, 2015


def is_core(journal: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(journal), F.lit(v)) for v in CORE_VENUES])


def _per_year(year: int) -> Column:
    """Three points for each citation per year of age, none without citations or year."""
    return F.when((F.col("citation_count") > 0) & (F.col("year") > 0), F.col("citation_count") / F.greatest(F.lit(1), year - F.col("year")) * 3).otherwise(0.0)


def _per_year_tenths(year: int) -> Column:
    """The same in tenths, halves up."""
    age = F.greatest(F.lit(1), year - F.col("year"))
    return F.when((F.col("citation_count") > 0) & (F.col("year") > 0), F.floor((60 * F.col("citation_count").cast("long") + age) / (2 * age))).otherwise(F.lit(0))


def priority_score(df: DataFrame, tagged: DataFrame | None = None, year: int = 2026) -> DataFrame:
    """base (0-100), priority (blended with the relevance where there is one) and is_review_guess.

    Both are rounded to a tenth, halves up. Points are counted in whole tenths and blended as decimals, so a half is one.
    """
    p = POINTS
    if tagged is not None:
        df = df.join(tagged.select(F.col("source_id").alias("id")).distinct().withColumn("has_tag", F.lit(True)), "id", "left")
    else:
        df = df.withColumn("has_tag", F.lit(False))
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("abstract", F.lit("")))
    review = F.coalesce(F.col("name").rlike(REVIEW_WORDS), F.lit(False))
    venue = F.when(F.coalesce("journal", F.lit("")) == "", 0.0).when(is_core(F.col("journal")), p["core"]).otherwise(p["other"])
    cites = F.least(F.lit(int(10 * p["cites"])), _per_year_tenths(year))
    recent = F.when(F.col("year") >= RECENT, p["recent"]).when(F.col("year") >= FAIRLY_RECENT, p["recent"] / 2).otherwise(0.0)
    points = lambda yes, n: F.when(yes, n).otherwise(0.0)
    score = points(text.rlike(TOPIC_WORDS), p["topic"]) + venue + points(review, p["review"]) + recent + points(F.col("has_tag"), p["tagged"])
    tenths = F.least(F.lit(1000), (10 * score).cast("long") + cites)
    blend = F.when(F.col("relevance_llm").isNotNull(), F.round(F.col("relevance_llm").cast("decimal(18,6)") * F.lit(Decimal("0.6")) + F.col("tenths").cast("decimal(5,0)") * F.lit(Decimal("0.04")), 1).cast("double")).otherwise(F.col("base"))
    return df.withColumn("tenths", tenths).withColumn("base", F.col("tenths") / 10).withColumn("priority", blend).drop("tenths").withColumn("is_review_guess", review)


def score_buckets(df: DataFrame, col: str = "priority") -> DataFrame:
    x = F.col(col)
    return df.agg(F.count_if(x >= 80).alias("b80"), F.count_if((x >= 60) & (x < 80)).alias("b60"), F.count_if((x >= 40) & (x < 60)).alias("b40"), F.count_if(x < 40).alias("b0"), F.count_if("is_review_guess").alias("reviews"))


def dedupe_by_title(df: DataFrame) -> DataFrame:
    """One paper of each title, ignoring case: most citations, then with DOI, with abstract, lowest id. Aggregation, so a hot title is no hot task."""
    rank = F.struct(-F.coalesce("citation_count", F.lit(-1)), F.col("doi").isNull().cast("int"), F.col("abstract").isNull().cast("int"), F.col("id"))
    best = df.groupBy(F.lower("name").alias("title")).agg(F.min_by("id", rank).alias("id"))
    return df.join(best, "id", "left_semi")


def drop_orphans(junction: DataFrame, kept: DataFrame) -> DataFrame:
    return junction.join(kept.select(F.col("id").alias("source_id")), "source_id", "left_semi")


#: Terms that are broadcast: names of topics, so a few hundred kilobytes at most.
MOST_TERMS = 2000


def classify_topics(df: DataFrame, taxonomy: DataFrame, k: int | None = 3, text: str = "abstract", most: int = MOST_TERMS) -> DataFrame:
    """(id, slug, rank): topics whose name (4 letters or more) occurs in the text, one per slug, the k first in canonical order.

    The terms are counted: up to `most` of them are broadcast and each text is held against them; more are found by an
    equi-join on runs of four characters.
    """
    terms = taxonomy.where(F.length("name") >= 4).groupBy("slug").agg(F.min("name").alias("term"), F.min("rank").alias("rank"))
    terms = terms.select("slug", F.lower("term").alias("key"), "rank")
    texts = df.select("id", F.lower(text).alias("text"))
    if terms.limit(most + 1).count() <= most:
        hits = texts.join(F.broadcast(terms), F.col("text").contains(F.col("key"))).select("id", "slug", "rank")
    else:
        hits = containing(texts, terms, shortest=4, longest=4).join(terms.hint("merge"), "key").select("id", "slug", "rank")
    if k is None:
        return hits
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("rank", "slug"))).where(F.col("nth") <= k).drop("nth")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def promote_tags(df: DataFrame, facets: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (category, slug, smallest name) and junction (id, category, slug) of array facets."""
    flat = df.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), v.alias("values")) for c, v in facets.items()])).alias("f"))
    values = flat.select("id", "f.category", F.explode("f.values").alias("name")).withColumn("name", F.trim("name")).where(F.col("name") != "")
    named = values.withColumn("slug", slug(F.col("name"))).where(F.col("slug") != "")
    return named.groupBy("category", "slug").agg(F.min("name").alias("name")), named.select("id", "category", "slug").distinct()


def tag_stats(junction: DataFrame) -> DataFrame:
    return junction.groupBy("category").agg(F.countDistinct("slug").alias("tags"), F.count("*").alias("links"), F.countDistinct("id").alias("papers"))


def norm_words(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def backfill_topics(papers: DataFrame, topics: DataFrame, junction: DataFrame, values: Column) -> tuple[DataFrame, DataFrame]:
    """New links of papers without any topic, by name or slug; and how often each other value was seen."""
    bare = papers.join(junction.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")
    seen = bare.select("id", F.explode(F.array_distinct(values)).alias("value")).withColumn("key", norm_words(F.col("value"))).where(F.col("key") != "")
    keys = topics.select(norm_words(F.col("name")).alias("key"), F.lit(0).alias("order"), F.col("id").alias("topic_id")).unionByName(topics.select(norm_words(F.col("slug")).alias("key"), F.lit(1).alias("order"), F.col("id").alias("topic_id")))
    first = keys.groupBy("key").agg(F.min_by("topic_id", F.struct("order", "topic_id")).alias("topic_id"))
    linked = seen.join(checkpointed(first).hint("merge"), "key", "left")
    return linked.where(F.col("topic_id").isNotNull()).select(F.col("id").alias("source_id"), "topic_id").distinct(), linked.where(F.col("topic_id").isNull()).groupBy("key").agg(F.count("*").alias("n"))


def sync_taxonomy(taxonomy: DataFrame, topics: DataFrame) -> DataFrame:
    """Upsert by slug: name and branch from the taxonomy, a known parent stays; nothing is deleted; `action` says what happened."""
    new = taxonomy.select("slug", F.col("name").alias("new_name"), F.col("branch").alias("new_branch"), F.col("parent").alias("new_parent"))
    out = topics.join(new, "slug", "full_outer")
    action = F.when(F.col("name").isNull(), "insert").when(F.col("new_name").isNull(), "keep").otherwise("update")
    return out.select("slug", F.coalesce("new_name", "name").alias("name"), F.coalesce("new_branch", "root_branch").alias("branch"), F.coalesce("parent_id", "new_parent").alias("parent"), action.alias("action"))


def topic_tree(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of a parent-pointer table, itself included, by the shortest way.

    Ways double their length each round and are written. A shortest way of more than `reach` steps is one of just `reach` and a
    shorter one, so only those of just `reach` are joined; where there is none, no longer one is, and a cycle of parents ends too.
    """
    own = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    pairs = checkpointed(own.unionByName(nodes.where(F.col("parent").isNotNull()).select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
    reach = 1
    while True:
        longest = pairs.where(F.col("depth") == reach)
        if longest.isEmpty():
            return pairs
        further = pairs.where("depth > 0").toDF("middle", "ancestor", "more")
        longer = longest.select("id", F.col("ancestor").alias("middle"), "depth").join(further.hint("merge"), "middle").select("id", "ancestor", (F.col("depth") + F.col("more")).alias("depth"))
        pairs = checkpointed(pairs.unionByName(longer).groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2


def topic_coverage(topics: DataFrame, junction: DataFrame, papers: DataFrame, taxonomy: DataFrame | None = None, gate: int = 60) -> DataFrame:
    """Papers and highly relevant papers of each topic, zero included.

    With a taxonomy (slug, priority) the priority is its own, null for a topic that it doesn't list, and in_bible tells which it lists.
    """
    linked = checkpointed(junction.join(papers.select(F.col("id").alias("source_id"), "relevance_llm").hint("merge"), "source_id").groupBy(F.col("topic_id").alias("id")).agg(F.countDistinct("source_id").alias("papers"), F.countDistinct(F.when(F.col("relevance_llm") >= gate, F.col("source_id"))).alias("high")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    if taxonomy is not None:
        listed = taxonomy.groupBy("slug").agg(F.min("priority").alias("priority"), F.lit(True).alias("listed"))
        topics = topics.drop("priority").join(listed.hint("merge"), "slug", "left")
    more = [F.coalesce("listed", F.lit(False)).alias("in_bible")] if taxonomy is not None else []
    return topics.join(linked.hint("merge"), "id", "left").select("id", "slug", "root_branch", "priority", zero("papers"), zero("high"), *more)


def branch_rollup(topics: DataFrame, junction: DataFrame, papers: DataFrame, taxonomy: DataFrame, gate: int = 60) -> DataFrame:
    """By branch: topics that the taxonomy (slug, branch) lists, distinct papers, highly relevant ones and their share, 0 where there is no paper."""
    linked = topics.select("root_branch", F.col("id").alias("topic_id")).join(junction.hint("merge"), "topic_id", "left").join(papers.select(F.col("id").alias("source_id"), "relevance_llm").hint("merge"), "source_id", "left")
    out = linked.groupBy("root_branch").agg(F.countDistinct("source_id").alias("papers"), F.countDistinct(F.when(F.col("relevance_llm") >= gate, F.col("source_id"))).alias("high"))
    listed = taxonomy.groupBy(F.col("branch").alias("root_branch")).agg(F.countDistinct("slug").alias("topics"))
    share = F.when(F.col("papers") > 0, F.round(F.col("high") * 100.0 / F.col("papers"), 1)).otherwise(0.0)
    return out.join(listed.hint("merge"), "root_branch", "left").select("root_branch", F.coalesce("topics", F.lit(0)).alias("topics"), "papers", "high", share.alias("high_share"))


def white_space(coverage: DataFrame, top: int = 15) -> DataFrame:
    """The topics of high priority with the fewest papers, and how many of high priority have none at all."""
    high = coverage.where(F.col("priority") == "HIGH")
    none = high.agg(F.count_if(F.col("papers") == 0).alias("without_papers"))
    return high.orderBy("papers", "high", "slug").limit(top).crossJoin(F.broadcast(none))


def missing_topics(taxonomy: DataFrame, topics: DataFrame) -> DataFrame:
    """(slug): what the taxonomy lists and the table of topics doesn't have."""
    return taxonomy.select("slug").distinct().join(topics.select("slug").hint("merge"), "slug", "left_anti")


def thin_layers(claims: DataFrame, claim_sources: DataFrame, claim_molecules: DataFrame, molecules: DataFrame) -> DataFrame:
    """(layer, n): claims, claims with sources and with molecules, molecules, and molecules by category."""
    one = lambda name, df, n: df.agg(n.alias("n")).select(F.lit(name).alias("layer"), "n")
    categories = molecules.groupBy(F.concat(F.lit("category: "), F.coalesce("category", F.lit("(uncategorized)"))).alias("layer")).agg(F.count("*").alias("n"))
    parts = [one("claims", claims, F.count("*")), one("claims_with_sources", claim_sources, F.countDistinct("claim_id")), one("claims_with_molecules", claim_molecules, F.countDistinct("claim_id")), one("molecules", molecules, F.count("*")), categories]
    return reduce(DataFrame.unionByName, parts)


def corpus_totals(papers: DataFrame, junction: DataFrame) -> DataFrame:
    tagged = junction.select(F.col("source_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
    links = junction.agg(F.count("*").alias("links"))
    r = F.col("relevance_llm")
    return papers.join(tagged, "id", "left").agg(F.count("*").alias("papers"), F.count(r).alias("scored"), F.count_if(r >= 60).alias("ge60"), F.count_if(r >= 80).alias("ge80"), F.count_if("tagged").alias("tagged"), F.count_if(F.col("tagged").isNull()).alias("untagged")).crossJoin(links)


def signal_and_action(df: DataFrame) -> DataFrame:
    """From `hits`, `tagged` and relevance_llm: signal, reconciliation and action."""
    signal = F.when(F.col("hits") == 0, "off-topic").when(F.col("hits") == 1, "weak").otherwise("on-topic")
    r, hits = F.col("relevance_llm"), F.col("hits")
    gap = (hits == 0) & ~F.col("tagged")
    verdict = (F.when(r.isNull(), "unscored").when(r >= 60, F.when(gap, "coverage_gap").otherwise("agree")).when(r >= 40, "borderline").when(hits >= 2, "disagreement").otherwise("agree"))
    action = F.when(r.isNull(), "review").when(r >= 60, "keep").when(r >= 40, "review").when(hits >= 2, "off_topic_check_first").otherwise("off_topic_high_confidence")
    return df.withColumn("signal", signal).withColumn("reconciliation", verdict).withColumn("action", action)


def relevance_reconcile(papers: DataFrame, taxonomy: DataFrame, junction: DataFrame, topics: DataFrame) -> DataFrame:
    """Distinct topics named in title, abstract or keywords, or attached, of each paper, and what they say against its relevance."""
    attached = junction.join(topics.select(F.col("id").alias("topic_id"), "slug"), "topic_id").select(F.col("source_id").alias("id"), "slug")
    parts = [c for c in ("name", "abstract", "top_keywords") if c in papers.columns]
    named = classify_topics(papers.select("id", F.concat_ws(" ", *parts).alias("words")), taxonomy, None, "words").select("id", "slug", F.lit(False).alias("own"))
    hits = named.unionByName(attached.withColumn("own", F.lit(True))).groupBy("id").agg(F.countDistinct("slug").alias("hits"), F.bool_or("own").alias("tagged"))
    known = papers.select("id", "relevance_llm", "search_query").join(hits, "id", "left")
    return signal_and_action(known.withColumns({"hits": F.coalesce("hits", F.lit(0)), "tagged": F.coalesce("tagged", F.lit(False))}))


def latest_audit(audits: DataFrame) -> DataFrame:
    return audits.groupBy("source_id").agg(F.max_by(F.struct("audit_id", "verdict", "audited_at"), F.struct("audited_at", "audit_id")).alias("a")).select("source_id", "a.*")


#: Buckets of a score, each up to the next.
SCORE_BUCKETS = [(">=80", 80, 1000), ("60-79", 60, 80), ("40-59", 40, 60), ("<40", 0, 40)]


def relevance_summary(reconciled: DataFrame) -> DataFrame:
    """Counts by signal, reconciliation and action together."""
    return reconciled.groupBy("signal", "reconciliation", "action").agg(F.count("*").alias("n"))


def relevance_report(reconciled: DataFrame) -> DataFrame:
    """(section, key, n): papers, citable, tagged and untagged ones; relevance and priority by bucket; signals, reconciliations, actions; papers by branch.

    reconciled: abstract, tagged, relevance_llm, priority_score, signal, reconciliation, action, branches (an array of
    distinct names). A paper is one row of each section that it belongs to, counted in one aggregation.
    """
    tell = lambda section, key: F.struct(F.lit(section).alias("section"), key.alias("key"))
    total = [tell("papers", F.lit("all")), F.when(F.coalesce(F.trim("abstract") != "", F.lit(False)), tell("papers", F.lit("citable"))), tell("papers", F.when(F.coalesce("tagged", F.lit(False)), "tagged").otherwise("untagged"))]
    score = [tell(section, F.coalesce(*[F.when((F.col(c) >= low) & (F.col(c) < high), name) for name, low, high in SCORE_BUCKETS])) for section, c in (("relevance", "relevance_llm"), ("priority", "priority_score"))]
    kinds = [tell(c, F.col(c)) for c in ("signal", "reconciliation", "action")]
    branches = F.transform(F.coalesce("branches", F.array().cast("array<string>")), lambda b: tell("branch", b))
    rows = reconciled.select(F.explode(F.concat(F.array(*total, *score, *kinds), branches)).alias("x")).select("x.*").where(F.col("key").isNotNull())
    return rows.groupBy("section", "key").agg(F.count("*").alias("n"))


def query_quality(reconciled: DataFrame, least: int = 5, top: int = 15) -> DataFrame:
    """Queries by how many of their papers are to be looked at as off topic, by the recommended action; a missing query is `(none)`."""
    out = reconciled.groupBy(F.coalesce(F.nullif("search_query", F.lit("")), F.lit("(none)")).alias("search_query")).agg(F.count("*").alias("total"), F.count_if(F.col("action").isin("off_topic_high_confidence", "off_topic_check_first")).alias("off_topic")).where(F.col("total") >= least)
    return out.withColumn("off_share", F.round(F.col("off_topic") * 100.0 / F.col("total"), 1)).orderBy(F.desc("off_topic"), "search_query").limit(top)


def audit_pool(papers: DataFrame, audits: DataFrame, n: int) -> DataFrame:
    """Never audited first, then the oldest audit, then the highest priority."""
    known = audits.groupBy(F.col("source_id").alias("id")).agg(F.max("audited_at").alias("last_audited"), F.count("*").alias("audit_count"))
    out = papers.join(known, "id", "left").withColumn("audit_count", F.coalesce("audit_count", F.lit(0)))
    return out.orderBy(F.col("last_audited").asc_nulls_first(), F.col("priority").desc_nulls_last(), "id").limit(n)


def attach_tags(papers: DataFrame, junction: DataFrame, topics: DataFrame) -> DataFrame:
    """Each paper's topics in canonical order (branch, HIGH first, slug) and its distinct branches."""
    order = F.struct("root_branch", (F.col("priority") != "HIGH").cast("int").alias("p"), "slug")
    own = junction.join(topics.select(F.col("id").alias("topic_id"), "slug", "root_branch", "priority"), "topic_id").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(order)).alias("tags"), F.array_sort(F.collect_set("root_branch")).alias("branches"))
    return papers.join(own, "id", "left").withColumns({"tags": F.array_join(F.transform("tags", lambda t: t["slug"]), "|"), "branches": F.array_join("branches", "|")})


#: Weights of the audit priority, the citations and half-life of its curves, the relevance that is least sure, and
#: what stands for an unknown priority, an unknown relevance and an audit without a date.
AUDIT_WEIGHTS = {"priority": 0.28, "citations": 0.08, "thin": 0.09, "stale": 0.25, "uncertain": 0.18, "untagged": 0.12}
CITE_SCALE, HALF_LIFE, UNSURE_AT, UNSURE_WIDTH = 200.0, 30.0, 55.0, 22.0
NO_PRIORITY, NO_RELEVANCE, NO_DATE = 0.5, 0.85, 0.6
#: Weights of the heuristic rank, days until an audit is stale, relevance gap of an unknown relevance.
RANK_WEIGHTS = {"stale": 1.0, "priority": 1.0, "gap": 0.8, "tags": 0.6, "cites": 0.4}
STALE_DAYS, NO_GAP = 14.0, 0.4
#: Pattern of topics in the heuristic verdict.
VERDICT_WORDS = r"(?i)(meat|beef|pork|chicken|poultry|flavou?r|aroma|volatile|umami|maillard|strecker|lipid oxidation|sensory|odou?r|hydrolysate|yeast extract|process flavou?r|precursor|thiamine|furan|sulf)"
#: How a branch's boost learns.
LEARN = {"gain": 1.2, "rate": 0.5, "decay": 0.8, "least": 0.5, "most": 3.0}


def _unit(c: Column) -> Column:
    """Within 0..1; null stays null (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def audit_priority(df: DataFrame, boost: dict[str, float] | None = None, thin_branches: list[str] | None = None) -> DataFrame:
    """100 * mean boost of the branches * weighted sum of importance, staleness and uncertainty.

    df: priority, citation_count, days_since_audit, audit_count, relevance_llm, branches (array), tagged and has_queries.
    """
    w = AUDIT_WEIGHTS
    cites = _unit(F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("citation_count").cast("double"), F.lit(0.0)))) / F.log1p(F.lit(CITE_SCALE)))
    thin = F.arrays_overlap(F.coalesce("branches", F.array().cast("array<string>")), F.array(*[F.lit(b) for b in thin_branches or []]).cast("array<string>"))
    stale = F.when(F.col("days_since_audit").isNotNull(), _unit(1.0 - F.pow(F.lit(0.5), F.col("days_since_audit") / HALF_LIFE))).when(F.col("audit_count") > 0, NO_DATE).otherwise(1.0)
    unsure = F.coalesce(F.exp(-F.pow(F.col("relevance_llm") - UNSURE_AT, F.lit(2.0)) / (2.0 * UNSURE_WIDTH * UNSURE_WIDTH)), F.lit(NO_RELEVANCE))
    untagged = F.when(F.col("tagged") & F.col("has_queries"), 0.0).when(F.col("tagged") | F.col("has_queries"), 0.5).otherwise(1.0)
    important = w["priority"] * F.coalesce(_unit(F.col("priority") / 100.0), F.lit(NO_PRIORITY)) + w["citations"] * cites + w["thin"] * F.when(thin, 1.0).otherwise(0.0)
    total = important + w["stale"] * stale + (w["uncertain"] * unsure + w["untagged"] * untagged)
    of_branch = F.create_map(*[F.lit(x) for kv in (boost or {"": 1.0}).items() for x in kv])
    summed = F.aggregate("branches", F.lit(0.0), lambda acc, b: acc + F.coalesce(F.try_element_at(of_branch, b), F.lit(1.0)))
    times = F.when(F.size("branches") > 0, summed / F.size("branches")).otherwise(1.0)
    return df.withColumn("audit_priority", F.round(100.0 * total * times, 2))


def heuristic_rank(df: DataFrame) -> DataFrame:
    """Weighted sum of staleness over 14 days, priority, missing relevance, missing tags and citations."""
    w = RANK_WEIGHTS
    stale = F.when(F.col("days_since_audit").isNull(), 1.0).otherwise(_unit(F.col("days_since_audit") / STALE_DAYS))
    gap = F.coalesce(1.0 - F.col("relevance_llm") / 100.0, F.lit(NO_GAP))
    cites = F.least(F.lit(1.0), F.coalesce("citation_count", F.lit(0)) / 200.0)
    total = w["stale"] * stale + w["priority"] * (F.coalesce("priority", F.lit(0.0)) / 100.0) + w["gap"] * gap + w["tags"] * F.when(F.col("tagged"), 0.0).otherwise(1.0) + w["cites"] * cites
    return df.withColumn("rank_score", F.round(total, 4))


def heuristic_verdict(df: DataFrame, year: int = 2026) -> DataFrame:
    """tag_score, relevance_score and quality_score of a paper with the array `tags`, and keep, review or quarantine.

    A tag is supported if one of its words of over 3 letters occurs in title or abstract. Halves round to even numbers.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("abstract", F.lit(""))))
    words = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+"), lambda x: F.length(x) > 3)
    held = F.size(F.filter("tags", lambda t: F.exists(words(t), lambda x: F.contains(F.col("text"), x))))
    tag_score = F.when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, 20).otherwise(F.bround(40 + 60 * (held / F.size("tags"))))
    relevance = F.coalesce(F.col("relevance_llm"), F.when(F.col("text").rlike(VERDICT_WORDS), 70).otherwise(30))
    points = lambda yes, n: F.when(yes, n).otherwise(0.0)
    venue = F.when(F.coalesce("journal", F.lit("")) == "", 0.0).when(is_core(F.col("journal")), 30.0).otherwise(12.0)
    cites = F.least(F.lit(22.0), _per_year(year))
    quality = venue + points(F.col("doi") != "", 12.0) + points(F.col("abstract") != "", 12.0) + points(F.col("is_review"), 12.0) + cites + points(F.col("year") >= 2018, 10.0)
    out = df.withColumn("text", text).withColumns({"tag_score": tag_score.cast("int"), "relevance_score": relevance.cast("int"), "quality_score": F.bround(F.least(F.lit(100.0), quality)).cast("int")})
    keep = (F.col("relevance_score") >= 60) & (F.col("tag_score") >= 50) & (F.col("quality_score") >= 40)
    return out.withColumn("verdict", F.when(F.col("relevance_score") < 40, "quarantine").when(keep, "keep").otherwise("review")).drop("text")


def repair_judgments(df: DataFrame) -> DataFrame:
    """Scores clamped to 0..100 (50 if missing), 8 issues and 240 characters of notes at most, an unknown verdict worked out again."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.try_to_number(F.col(c), F.lit("S9999D99")).cast("double"), F.col(c).try_cast("double"), F.lit(50.0))))
    out = df.withColumns({"relevance": clamp("relevance"), "quality": clamp("quality"), "tag_fit": clamp("tag_fit")})
    guess = F.when((F.col("relevance") < 40) | (F.col("quality") < 35), "quarantine").when((F.col("relevance") >= 65) & (F.col("quality") >= 55) & (F.col("tag_fit") >= 55), "keep").otherwise("review")
    valid = F.col("verdict").isin("keep", "review", "quarantine")
    return out.withColumns({"verdict": F.when(valid, F.col("verdict")).otherwise(guess), "issues": F.array_join(F.slice("issues", 1, 8), "|"), "notes": F.substring("notes", 1, 240)})


def update_branch_boost(previous: DataFrame, results: DataFrame) -> DataFrame:
    """A branch's boost moves half way to 1 + gain * its share of quarantines; then every branch falls back towards 1.

    previous: branch, boost; results: branches (array), verdict.
    """
    p = LEARN
    seen = results.select(F.explode(F.array_distinct("branches")).alias("branch"), F.lower(F.trim("verdict")).alias("verdict")).groupBy("branch").agg(F.avg((F.col("verdict") == "quarantine").cast("double")).alias("share"))
    out = previous.join(seen, "branch", "left")
    moved = F.coalesce(F.col("boost") + p["rate"] * (1.0 + p["gain"] * F.col("share") - F.col("boost")), F.col("boost"))
    return out.select("branch", F.round(F.greatest(F.lit(p["least"]), F.least(F.lit(p["most"]), 1.0 + p["decay"] * (moved - 1.0))), 3).alias("boost"))


def audit_run_report(audits: DataFrame, papers: DataFrame, junction: DataFrame, topics: DataFrame) -> DataFrame:
    """Audits of the latest run with their papers and sorted topics."""
    latest = audits.agg(F.max_by("run_id", F.struct("audited_at", "run_id")).alias("run_id"))
    names = junction.join(topics.select(F.col("id").alias("topic_id"), "slug"), "topic_id").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("slug")), ", ").alias("topics"))
    return audits.join(F.broadcast(latest), "run_id", "left_semi").join(papers.select(F.col("id").alias("source_id"), "name", "priority"), "source_id").join(names, "source_id", "left")


def first_sentence(text: Column, most: int = 400) -> Column:
    """The text up to the first end of a sentence before a capital; a longer one is cut at a word and marked."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    first = F.coalesce(F.nullif(F.regexp_extract(flat, r"^(.*?[.!?])(?=\s+[A-Z])", 1), F.lit("")), flat)
    cut = F.regexp_replace(F.regexp_replace(F.substring(first, 1, most), r" [^ ]*$", ""), r"[,;:]+$", "")
    return F.when(F.length(first) > most, F.concat(cut, F.lit(" …"))).otherwise(first)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def end_period(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare.rlike(r"[.!?…]\z"), bare).otherwise(F.concat(bare, F.lit(".")))


def join_list(items: Column, most: int = 3) -> Column:
    """`a`, `a and b` or `a, b and c`; an empty string without any."""
    kept = F.slice(F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: strip(x)), lambda x: x != ""), 1, most)
    return F.when(F.size(kept) <= 1, F.array_join(kept, "")).otherwise(F.concat(F.array_join(F.slice(kept, 1, F.size(kept) - 1), ", "), F.lit(" and "), F.element_at(kept, -1)))


def tailored_abstract(df: DataFrame, project: str, limit: int | None = None) -> DataFrame:
    """First sentence, matrix and method, main claim, and what it means for `project`; papers with abstract and claim, most relevant first.

    df: abstract, main_claim, and the arrays matrix, method, pathway and sensory.
    """
    rows = df.where((F.coalesce("abstract", F.lit("")) != "") & (F.coalesce("main_claim", F.lit("")) != "")).select("*", *[join_list(F.col(c)).alias(f"_{c}") for c in ("matrix", "method", "pathway", "sensory")])
    mx, me, pw, sd = (F.col(f"_{c}") for c in ("matrix", "method", "pathway", "sensory"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    work = F.when((mx != "") & (me != ""), say("The work concerns ", mx, ", using ", me, ".")).when(mx != "", say("The work concerns ", mx, ".")).when(me != "", say("The work uses ", me, "."))
    start = f"For {project}, this "
    means = (F.when((pw != "") & (sd != ""), say(start + "is evidence on ", pw, " chemistry with reported ", sd, " sensory relevance for building meaty flavor."))
             .when(pw != "", say(start + "is evidence on ", pw, " chemistry relevant to building meaty flavor.")).when(sd != "", say(start + "carries reported ", sd, " sensory relevance for building meaty flavor."))
             .otherwise(start + "adds source-backed evidence for building meaty flavor."))
    text = F.concat_ws(" ", end_period(first_sentence(F.col("abstract"))), work, end_period(say("Main claim: ", strip(F.col("main_claim")))), means)
    out = rows.select("id", "relevance_llm", text.alias("tailored"))
    return out.orderBy(F.col("relevance_llm").desc_nulls_last(), "id").limit(limit) if limit else out


def profile_table(df: DataFrame, top: int = 12) -> DataFrame:
    """Fill and distinct count of each column, one pass, and a class: empty, constant, partial or full."""
    cols = df.columns
    wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"{c}__n") for c in cols], *[F.countDistinct(c).alias(f"{c}__d") for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("filled"), F.col(f"{c}__d").alias("distinct")) for c in cols])).alias("x")
    out = wide.select("rows", rows).select("rows", "x.*")
    kind = F.when(F.col("filled") == 0, "empty").when((F.col("distinct") == 1) & (F.col("filled") == F.col("rows")), "constant").when(F.col("filled") < F.col("rows"), "partial").otherwise("full")
    return out.withColumn("kind", kind)


def top_values(df: DataFrame, cols: list[str], most: int = 12) -> DataFrame:
    """The `most` frequent values of each column."""
    flat = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("x")).select("x.*").where(F.col("value").isNotNull())
    counts = flat.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("nth", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("nth") <= most).drop("nth")


def system_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out
