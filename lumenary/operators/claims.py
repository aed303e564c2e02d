"""Claims: evidence factors, corroboration, contradiction, weights and consensus."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Factors of a scored claim by evidence tier, method and directness, and what an unknown name counts as.
TIERS = {"T1_experimental": 1.00, "T2_review": 0.75, "T3_inferred": 0.45, "T4_conjecture": 0.25}
METHODS = {
    "gco_aeda_quant": 1.00, "gcms_quantified": 0.90, "sensory_trained": 0.85, "gcms_identification": 0.70, "model_system": 0.65,
    "consumer_panel": 0.60, "in_silico": 0.40, "library_compilation": 0.45, "unspecified": 0.50,
}
DIRECT = {"target_matrix": 1.00, "analogous_matrix": 0.75, "model_system": 0.60, "extrapolated": 0.45, "unknown": 0.55}
UNKNOWN = {"tier": 0.45, "method": 0.50, "direct": 0.55}
#: Names that tiers and methods go by; a method counts where a fragment occurs in its text.
TIER_ALIASES = {
    "experimental": "T1_experimental", "review": "T2_review", "compiled_library": "T3_inferred", "method": "T3_inferred",
    "other": "T3_inferred", "modeling": "T4_conjecture", "none": "T3_inferred", "": "T3_inferred",
}
METHOD_ALIASES = [
    ("gc-o", "gco_aeda_quant"), ("aeda", "gco_aeda_quant"), ("olfactom", "gco_aeda_quant"), ("trained sensory", "sensory_trained"),
    ("descriptive analysis", "sensory_trained"), ("consumer", "consumer_panel"), ("spme", "gcms_identification"),
    ("gc-ims", "gcms_identification"), ("gc-ms", "gcms_identification"), ("gcms", "gcms_identification"),
    ("metabolomic", "gcms_quantified"), ("quantif", "gcms_quantified"), ("library", "library_compilation"), ("model", "in_silico"),
    ("silico", "in_silico"),
]
#: Factors of a derived claim by study type, fragments of methods, and patterns of matrices.
STUDY_TYPES = {"experimental": 1.0, "review": 0.8, "method": 0.6, "modeling": 0.6, "other": 0.6}
METHOD_FRAGMENTS = [(("olfactometr", "oav", "sniff"), 1.0), (("panel", "descriptive analysis", "sensory"), 0.9), (("gc-ms", "gc/ms", "spme", "metabolomic", "lipidomic"), 0.8)]
OTHER_METHOD = 0.4
MEAT = r"(?i)beef|pork|chicken|steak|sausage|burger|meat|broth|stock|duck|lamb|pigeon|turkey|fish|bacon|ham"
ANALOGUE = r"(?i)analogue|analog|plant protein|pea|soy|hybrid|cultivated|fermentation-derived|fat system|seasoning|process flavor"
#: Words that deny in a curated claim, and words that only tell its direction.
NEGATIVE = r"(?i)\b(decreas|reduc|inhibit|suppress|mask|lower|no (?:significant )?effect|does not|not associated)[a-z0-9_]*"
POLARITY_WORDS = r"(?i)\b(increas[a-z0-9_]*|decreas[a-z0-9_]*|reduc[a-z0-9_]*|enhanc[a-z0-9_]*|inhibit[a-z0-9_]*|suppress[a-z0-9_]*|mask[a-z0-9_]*|not|no|does)\b"
#: Weight of a further claim of one group, of opposition, differences that make conditions others, slack of intervals.
BETA, LAMBDA, SATURATION = 0.35, 0.35, 10.0
TEMPERATURE_APART, PH_APART, SLACK = 20.0, 1.0, 0.10
EDGE = ["subject", "axis", "object"]


def evidence_tier(study: Column) -> tuple[Column, Column]:
    """Factor and label of a study type; a type that is not known by its whole name is `unknown`."""
    st = F.lower(F.coalesce(study, F.lit("")))
    known = st.isin(list(STUDY_TYPES))
    return lookup(STUDY_TYPES, st, 0.6), F.when(known, st).otherwise("unknown")


def method_strength(methods: Column) -> tuple[Column, Column]:
    """Factor of the strongest method of a list, and that method (the first of equals; null if none is better than any)."""
    def one(m: Column, i: Column) -> Column:
        value = F.lit(OTHER_METHOD)
        for fragments, factor in reversed(METHOD_FRAGMENTS):
            value = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(m), F.lit(f)) for f in fragments]), F.lit(factor)).otherwise(value)
        return F.struct(value.alias("value"), (-i).alias("order"), F.lower(m).alias("label"))
    best = F.array_max(F.filter(F.transform(methods, one), lambda x: x["value"] > OTHER_METHOD))
    return F.coalesce(best["value"], F.lit(OTHER_METHOD)), best["label"]


def directness(matrices: Column) -> tuple[Column, Column]:
    """Factor of the matrices and what they say; meat counts fully unless an analogue is spelt out."""
    text = F.when(F.size(matrices) > 0, F.array_join(matrices, " | "))
    factor = F.when(text.rlike(MEAT) & ~F.contains(F.lower(text), F.lit("analogue")), 1.0).when(text.rlike(ANALOGUE), 0.7).otherwise(0.5)
    return factor, text


def lookup(values: dict, key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def base_score(claims: DataFrame) -> DataFrame:
    """base = tier * method * directness, by the names in evidence_tier, method and directness."""
    tier, method = lookup(TIERS, F.col("evidence_tier"), UNKNOWN["tier"]), lookup(METHODS, F.col("method"), UNKNOWN["method"])
    return claims.withColumn("base", tier * method * lookup(DIRECT, F.col("directness"), UNKNOWN["direct"]))


def corroborate(claims: DataFrame, group: list[str]) -> DataFrame:
    """n_sources of each group and 1 + ln n, joined back."""
    counts = claims.groupBy(*group).agg(F.greatest(F.lit(1), F.countDistinct("source_id")).alias("n_sources"))
    return claims.join(counts, group).withColumn("corroboration", 1 + F.log(F.col("n_sources").cast("double")))


def norm_key(text: Column) -> Column:
    """Lower case, everything but letters and digits a blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def object_key(text: Column) -> Column:
    """A claim's normalised wording without words of polarity, 160 characters at most."""
    return F.substring(F.regexp_replace(norm_key(text), POLARITY_WORDS, ""), 1, 160)


def contradicted_groups(claims: DataFrame, group: list[str], penalty: float = 0.25) -> DataFrame:
    """Groups that hold both polarities, with their penalty."""
    return claims.groupBy(*group).agg(F.countDistinct("polarity").alias("polarities")).where(F.col("polarities") > 1).withColumn("penalty", F.lit(penalty))


def normalised_weight(claims: DataFrame, group: list[str]) -> DataFrame:
    """Raw weight (tier * method * directness of study_type, methods and matrices, * corroboration - penalty) over the largest of the run, within 0..1."""
    base = evidence_tier(F.col("study_type"))[0] * method_strength(F.col("methods"))[0] * directness(F.col("matrices"))[0]
    raw = corroborate(claims.withColumn("base", base), group).join(contradicted_groups(claims, group), group, "left")
    raw = raw.withColumn("raw", F.col("base") * F.col("corroboration") - F.coalesce("penalty", F.lit(0.0)))
    top = raw.agg(F.max("raw").alias("top"))
    share = F.coalesce(F.col("raw") / F.nullif(F.col("top"), F.lit(0.0)), F.col("raw"))
    return raw.crossJoin(F.broadcast(top)).withColumn("weight", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4))


def consensus_clusters(claims: DataFrame, group: list[str], top: int = 50) -> DataFrame:
    return claims.groupBy(*group).agg(F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_claims")).where(F.col("n_sources") >= 2).orderBy(F.desc("n_sources"), F.desc("n_claims"), *group).limit(top)


def triplet_report(claims: DataFrame, kind: str) -> DataFrame:
    """Counts by class with their share of all claims and the fill of conditions and measurements."""
    total = Window.partitionBy()
    out = claims.groupBy(F.col(kind).alias("class")).agg(F.count("*").alias("n"), F.count("matrix").alias("with_matrix"), F.count("low").alias("with_value"), F.countDistinct("subject").alias("subjects"), F.countDistinct("source_id").alias("sources"))
    return out.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(total), 2))


def triplet_coverage(claims: DataFrame, molecules: DataFrame, papers: DataFrame) -> DataFrame:
    """(measure, n, share): molecules and papers that claims cover, in per cent of their pools, and what claims tell, in per cent of claims.

    claims: subject (a molecule), source_id, matrix, process, methods, value, ph, temp_c, time_min.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    numeric = F.col("ph").isNotNull() | F.col("temp_c").isNotNull() | F.col("time_min").isNotNull()
    counts = {"with_matrix": told("matrix"), "with_process": told("process"), "with_method": F.coalesce(F.size("methods") > 0, F.lit(False)), "with_value": told("value"), "with_numbers": numeric, "without_conditions": ~told("matrix") & ~told("process")}
    one = claims.agg(F.count("*").alias("claims"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    for name, pool, c in (("molecules", molecules, "subject"), ("papers", papers, "source_id")):
        covered = claims.select(F.col(c).alias("id")).where(F.col("id").isNotNull()).distinct().agg(F.count("*").alias(name))
        one = one.crossJoin(F.broadcast(covered)).crossJoin(F.broadcast(pool.agg(F.count("*").alias(f"all_{name}"))))
    of = {"molecules": "all_molecules", "papers": "all_papers"}
    rows = [F.struct(F.lit(name).alias("measure"), F.col(name).alias("n"), F.round(F.try_divide(100.0 * F.col(name), F.col(of.get(name, "claims"))), 1).alias("share")) for name in (*of, *counts)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


CLUSTER = [*EDGE, "polarity", "bucket"]


def _bucketed(claims: DataFrame) -> DataFrame:
    return claims.withColumn("bucket", F.coalesce(F.nullif("matrix", F.lit("")), F.lit("any_matrix")))


def effective_n(claims: DataFrame, beta: float = BETA) -> DataFrame:
    """Per cluster (edge, polarity, matrix): each source group counts 1 and its further claims `beta` each; 1 at least."""
    groups = _bucketed(claims).groupBy(*CLUSTER, F.coalesce("source_group", "source_id").alias("g")).agg(F.count("*").alias("k"))
    return groups.groupBy(*CLUSTER).agg(F.greatest(F.lit(1.0), F.sum(1 + beta * (F.col("k") - 1))).alias("n_eff"))


def corroboration(n_eff: Column, saturation: float = SATURATION) -> Column:
    return F.least(F.lit(1.0), (1 + F.log(n_eff)) / (1 + F.log(F.lit(saturation))))


def comparable(a: Column, b: Column) -> Column:
    """Whether two claims were made under like conditions; what is not stated is no difference."""
    other = (a["matrix"] != b["matrix"]) & (a["matrix"] != "") & (b["matrix"] != "")
    return ~(F.coalesce(other, F.lit(False)) | F.coalesce(F.abs(a["temp_c"] - b["temp_c"]) > TEMPERATURE_APART, F.lit(False)) | F.coalesce(F.abs(a["ph"] - b["ph"]) > PH_APART, F.lit(False)))


def intervals_apart(a: Column, b: Column) -> Column:
    """Whether two measured intervals of one quantity and unit do not meet, each widened by the slack."""
    low, high = (lambda x: x["low"] * (1 - SLACK)), (lambda x: x["high"] * (1 + SLACK))
    same = a["quantity"].eqNullSafe(b["quantity"]) & a["unit"].eqNullSafe(b["unit"])
    return F.coalesce(same & ((high(a) < low(b)) | (high(b) < low(a))), F.lit(False))


_COMPARED = ["claim_id", "polarity", "matrix", "temp_c", "ph", "low", "high", "quantity", "unit"]


def guarded(claims: DataFrame, guard: int = 150) -> DataFrame:
    """The claims of edges with `guard` claims at most; larger edges are left out, as the operator is defined."""
    small = checkpointed(claims.groupBy(*EDGE).agg(F.count("*").alias("n")).where(F.col("n") <= guard).drop("n"))
    return claims.join(small.hint("merge"), EDGE, "left_semi")


def conflict_pairs(claims: DataFrame, guard: int = 150) -> DataFrame:
    """Unordered pairs of one edge that disagree in polarity or interval: contradictions, or divergences where conditions differ.

    A join on the edge of the written claims with themselves, so its sides are plain sorted shuffles. Edges of more than
    `guard` claims are left out, as the operator defines it; `oversized_edges` counts them. No score needs these pairs.
    """
    kept = checkpointed(guarded(claims, guard).select(*EDGE, *_COMPARED))
    a, b = kept.alias("a"), kept.select(*[F.col(c).alias(f"{c}_b") for c in kept.columns]).alias("b")
    met = a.join(b.hint("merge"), [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in EDGE] + [F.col("claim_id") < F.col("claim_id_b")])
    one, other = {c: F.col(c) for c in _COMPARED}, {c: F.col(f"{c}_b") for c in _COMPARED}
    found = met.withColumn("conflict", F.when(~one["polarity"].eqNullSafe(other["polarity"]), "polarity").when(intervals_apart(one, other), "interval")).where("conflict IS NOT NULL")
    return found.select(F.col("claim_id").alias("claim_a"), F.col("claim_id_b").alias("claim_b"), "conflict", F.when(comparable(one, other), "contradiction").otherwise("divergence").alias("kind"))


def oversized_edges(claims: DataFrame, guard: int = 150) -> DataFrame:
    return claims.groupBy(*EDGE).agg(F.count("*").alias("n")).where(F.col("n") > guard)


#: Claims by condition and measure from which on they are sorted.
REPEATS = 8


def _sweep(ids: np.ndarray, base: np.ndarray, side: np.ndarray, condition: np.ndarray, meets: np.ndarray, measure: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The summed base of all claims of one edge that contradict each claim.

    condition: the claims' distinct conditions, by number; meets: which of these are comparable; measure: quantity and unit by
    number, -1 where there is no interval. Claims of other polarity count by condition. For those of the same polarity the
    claims of each measure and condition are sorted by both ends of their intervals, with prefix sums of base: what ends below
    a claim's interval and what begins above it are two looked-up sums.
    """
    n = len(meets)
    out = np.zeros(len(base))
    for s in np.unique(side):
        own = side == s
        out[own] += (meets @ np.bincount(condition[~own], base[~own], n))[condition[own]]
    below, above = high * (1 + SLACK), low * (1 - SLACK)
    order = np.lexsort((condition, measure, side))
    key = np.stack([side, measure, condition], axis=1)[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(order) else order
    if len(edge) * REPEATS > len(order):  # conditions hardly repeat: sorting each would cost more than looking at the edge's few claims at once
        apart = (below[None, :] < above[:, None]) | (below[:, None] < above[None, :])
        out += (apart & (side[:, None] == side[None, :]) & (measure[:, None] == measure[None, :]) & (measure[:, None] >= 0) & meets[condition[:, None], condition[None, :]]) @ base
        edge = edge[:0]
    for a, b in zip(edge, np.append(edge[1:], len(order))[: len(edge)], strict=True):
        mine = order[a:b]
        s, m, c = key[a]
        if m < 0:
            continue
        asks = np.flatnonzero((side == s) & (measure == m) & meets[c][condition])
        ends, begins = mine[np.argsort(below[mine])], mine[np.argsort(above[mine])]
        ended, begun = np.append(0, np.cumsum(base[ends])), np.append(0, np.cumsum(base[begins]))
        out[asks] += ended[np.searchsorted(below[ends], above[asks], "left")] + begun[-1] - begun[np.searchsorted(above[begins], below[asks], "right")]
    # Rows that repeat an id are one claim and do not contradict each other.
    known, of = np.unique(ids, return_inverse=True)
    if len(known) < len(ids):
        for i in np.flatnonzero(np.bincount(of)[of] > 1):
            twin = np.flatnonzero((of == of[i]) & meets[condition[i]][condition])
            apart = (measure[twin] == measure[i]) & (measure[i] >= 0) & ((below[twin] < above[i]) | (below[i] < above[twin]))
            out[i] -= base[twin[(side[twin] != side[i]) | apart]].sum()
    return np.where(out > 1e-12, out, 0.0)


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """A number for each distinct value of some columns; null is a value."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code = c.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        out = np.unique(out * (code.max(initial=0) + 1) + code, return_inverse=True)[1].reshape(-1)
    return out


def _opposed(rows: pa.Table) -> pa.RecordBatch:
    """claim_id and opposition of some whole edges, rows in the order of edges."""
    number = lambda c: rows[c].cast(pa.float64()).combine_chunks().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    low, high, temp, ph, base = (number(c) for c in ("low", "high", "temp_c", "ph", "base"))
    edge, side, place, ids = _codes(*[rows[c] for c in EDGE]), _codes(rows["polarity"]), _codes(rows["matrix"]), _codes(rows["claim_id"])
    blank = np.isin(rows["matrix"].combine_chunks().fill_null("").to_numpy(zero_copy_only=False), [""])
    condition = _codes(rows["matrix"], rows["temp_c"], rows["ph"])
    measure = np.where(np.isnan(low) | np.isnan(high), -1, _codes(rows["quantity"], rows["unit"]))
    out = np.zeros(len(base))
    border = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1], [True]])) if len(edge) else np.zeros(1, np.int64)
    for a, b in zip(border[:-1], border[1:], strict=True):
        if b - a < 2:
            continue
        first, own = np.unique(condition[a:b], return_index=True, return_inverse=True)[1:]
        first = first + a
        apart = lambda x, most, first=first: np.abs(x[first][:, None] - x[first][None, :]) > most  # noqa: E731  unknown is not apart
        other = (place[first][:, None] != place[first][None, :]) & ~blank[first][:, None] & ~blank[first][None, :]
        meets = ~(other | apart(temp, TEMPERATURE_APART) | apart(ph, PH_APART))
        out[a:b] = _sweep(ids[a:b], base[a:b], side[a:b], own, meets, measure[a:b], low[a:b], high[a:b])
    return pa.RecordBatch.from_arrays([rows["claim_id"].cast(pa.string()).combine_chunks(), pa.array(out)], names=["claim_id", "opposition"])


def _by_edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by edge; what is worked on is some whole edges."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        edge = _codes(*[held[c] for c in EDGE])
        before = np.flatnonzero(edge != edge[-1]) if len(edge) else edge
        if len(before):
            yield _opposed(held.slice(0, int(before[-1]) + 1))
            held = held.slice(int(before[-1]) + 1)
    if held is not None:
        yield _opposed(held)


def oppositions(scored: DataFrame, guard: int = 150) -> DataFrame:
    """(claim_id, opposition) of claims that others contradict: the base of these, without any pairs. scored: claims with base.

    Edges are worked on one after the other, each a bounded group of at most `guard` claims.
    """
    dealt = guarded(scored, guard).select(*EDGE, *_COMPARED, "base").repartition(*EDGE).sortWithinPartitions(*EDGE)
    return dealt.mapInArrow(_by_edge, "claim_id string, opposition double").where("opposition > 0").dropDuplicates(["claim_id"])


def claim_weights(claims: DataFrame, lam: float = LAMBDA, beta: float = BETA, saturation: float = SATURATION) -> DataFrame:
    """weight = base * corroboration - lam * opposition / (opposition + base), within 0..1; opposition is the base of all that contradict a claim."""
    scored = base_score(claims)
    opposition = checkpointed(oppositions(scored)).hint("merge")
    out = _bucketed(scored).join(effective_n(claims, beta), CLUSTER).join(opposition, "claim_id", "left").withColumn("opposition", F.coalesce("opposition", F.lit(0.0)))
    penalty = F.when(F.col("opposition") > 0, lam * F.col("opposition") / (F.col("opposition") + F.col("base"))).otherwise(0.0)
    weight = F.col("base") * corroboration(F.col("n_eff"), saturation) - penalty
    return out.withColumn("weight", F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight)))


def edge_consensus(weights: DataFrame) -> DataFrame:
    """Noisy-OR of support less that of opposition by edge and matrix, floored at 0."""
    minus = F.col("polarity") == "-"
    side = lambda own: 1 - F.product(F.when(own, 1 - F.col("weight")).otherwise(1.0))
    return weights.groupBy(*EDGE, F.col("bucket").alias("matrix")).agg(F.greatest(F.lit(0.0), side(~minus) - side(minus)).alias("consensus"), F.count_if(~minus).alias("supporting"), F.count_if(minus).alias("opposing"))


def nearest_rank(df: DataFrame, col: str, shares: dict[str, float]) -> DataFrame:
    """ws[int(p * n)] of the sorted values for each p, by counts of distinct values, so that no task sorts all rows."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return ranked.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("total") * p), F.col("v"))).alias(name) for name, p in shares.items()])


def weight_summary(weights: DataFrame) -> DataFrame:
    """Least, most, median and ninth decile of the weights; ranks by the weights as they are."""
    return weights.agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.count("*").alias("n")).crossJoin(F.broadcast(nearest_rank(weights, "weight", {"median": 0.5, "p90": 0.9})))


def tier_mix(claims: DataFrame) -> DataFrame:
    return claims.groupBy("evidence_tier").agg(F.count("*").alias("n"))


def stored_difference(weights: DataFrame, stored: DataFrame, most: int = 400) -> DataFrame:
    """One row: mean distance of the new weights from the stored ones of the first claims, and both means. stored: claim_id, pos, weight."""
    first = stored.where(F.col("weight").isNotNull()).orderBy("pos").limit(most).select("claim_id", F.col("weight").alias("old"))
    both = checkpointed(weights.select("claim_id", "weight")).join(F.broadcast(first), "claim_id")
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("old") - F.col("weight"))).alias("difference"), F.avg("old").alias("stored"), F.avg("weight").alias("recomputed"))


def evidence_view(claims: DataFrame, sources: DataFrame, subjects: DataFrame) -> DataFrame:
    """Claims with their sources and subjects, kept where either is unknown."""
    return claims.join(sources.select(F.col("id").alias("source_id"), F.col("label").alias("source_label"), "relevance"), "source_id", "left").join(subjects.select(F.col("id").alias("subject"), F.col("name").alias("subject_name")), "subject", "left")


def descriptor_claims(edges: DataFrame, molecules: DataFrame, odours: DataFrame) -> DataFrame:
    """Class A: a molecule smells of an odour."""
    return edges.join(molecules.select(F.col("id").alias("molecule_id"), F.col("name").alias("subject_name")), "molecule_id").join(odours.select(F.col("id").alias("odour_id"), F.col("name").alias("object_name")), "odour_id").select(
        F.concat(F.lit("A-"), F.col("molecule_id"), F.lit("-"), F.col("odour_id")).alias("claim_id"), F.col("molecule_id").alias("subject"), "subject_name", F.lit("smells_of").alias("predicate"), F.col("odour_id").alias("object"), "object_name")


#: Curated links for each partition of all links: an aggregation holds nearly every row, as links hardly repeat.
LINKS_EACH = 500_000


def reported_claims(curated: DataFrame, mined: DataFrame, each: int = LINKS_EACH) -> DataFrame:
    """Class B: a paper reports a molecule; a curated link beats a mined one. Links may repeat.

    The number of partitions grows with the counted curated links, so what a task holds does not; adaptive execution would
    join partitions until their compressed bytes suffice.
    """
    spark = curated.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-curated.count() // each))
    every = curated.select("source_id", "molecule_id", F.lit(0).alias("rank")).unionByName(mined.select("source_id", "molecule_id", F.lit(1).alias("rank"))).repartition(n, "source_id", "molecule_id")
    return every.groupBy("source_id", "molecule_id").agg(F.min("rank").alias("rank")).select(F.concat(F.lit("B-"), F.col("source_id"), F.lit("-"), F.col("molecule_id")).alias("claim_id"), "source_id", "molecule_id", F.when(F.col("rank") == 0, "curated").otherwise("mined").alias("provenance"))


#: The names of pathways by the process of a library entry; another process is a pathway of its own name.
PATHWAYS = {"Maillard": ["Maillard reaction"], "Lipid oxidation": ["Lipid oxidation"], "Both": ["Maillard reaction", "Lipid oxidation"]}
#: Factors of a library claim, the second method factor where the entry has no odour threshold.
LIBRARY_TIER, LIBRARY_METHOD, LIBRARY_DIRECT = 0.8, (0.8, 0.4), 1.0


def pathway_claims(library: DataFrame, compounds: DataFrame) -> DataFrame:
    """Class C from the library: a compound forms along the pathways of each entry with its CAS number, blanks around it aside.

    (claim_id, molecule_id, object, pathway, matrix, value, source_id, tier, method, directness). An entry that is listed
    twice claims once.
    """
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    other = F.when(F.coalesce("likely_process", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("likely_process"))
    paths = reduce(lambda out, kv: F.when(F.col("likely_process") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(out), PATHWAYS.items(), other)
    entries = library.select("entry_no", blank("cas_number").alias("cas"), F.explode(paths).alias("pathway"), F.nullif("cooked_meats_reported", F.lit("")).alias("matrix"), F.nullif("odor_threshold", F.lit("")).alias("value")).where(F.col("cas").isNotNull())
    known = compounds.select(F.col("id").alias("molecule_id"), blank("cas").alias("cas")).where(F.col("cas").isNotNull())
    # The claims grow with the square of a number's rows, so repeats go before the join. Only what is listed under several
    # numbers, or under no id, can meet twice after it.
    entries = checkpointed(entries.withColumn("object", norm_key(F.col("pathway"))).dropDuplicates(["entry_no", "cas", "object"]))
    known = checkpointed(known.distinct())
    numbers = entries.groupBy("entry_no").agg(F.min("cas").alias("least"), F.max("cas").alias("most"))
    several = checkpointed(numbers.where((F.col("least") != F.col("most")) | F.col("entry_no").isNull()).select(F.col("entry_no").alias("twice")))
    nameless = not known.where(F.col("molecule_id").isNull()).isEmpty()
    method = F.when(F.col("value").isNotNull(), LIBRARY_METHOD[0]).otherwise(LIBRARY_METHOD[1])

    def claims(some: DataFrame) -> DataFrame:
        return some.join(known.hint("merge"), "cas").select(
            F.concat_ws("-", F.lit("C-mvl"), "entry_no", "molecule_id", "object").alias("claim_id"), "molecule_id", "object", "pathway", "matrix", "value", F.lit(None).cast("long").alias("source_id"),
            F.lit(LIBRARY_TIER).alias("tier"), method.alias("method"), F.lit(LIBRARY_DIRECT).alias("directness"))
    if nameless:
        return claims(entries).dropDuplicates(["claim_id"])
    if several.isEmpty():
        return claims(entries)
    listed = lambda how: entries.join(several.hint("merge"), F.col("entry_no").eqNullSafe(F.col("twice")), how)
    return claims(listed("left_anti")).unionByName(claims(listed("left_semi")).dropDuplicates(["claim_id"]))


def reported_pathways(reported: DataFrame, papers: DataFrame) -> DataFrame:
    """Class C from papers: a molecule forms along each pathway of a paper that reports it.

    reported: source_id, molecule_id (class B); papers: id, pathway (an array), study_type, methods, matrices, from which the
    factors are derived.
    """
    paths = papers.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.filter("pathway", lambda x: F.coalesce(x, F.lit("")) != ""))).alias("pathway"), evidence_tier(F.col("study_type"))[0].alias("tier"), method_strength(F.col("methods"))[0].alias("method"), directness(F.col("matrices"))[0].alias("directness"))
    met = checkpointed(reported.select("source_id", "molecule_id").distinct()).join(checkpointed(paths).hint("merge"), "source_id")
    return met.select(F.concat_ws("-", F.lit("C-src"), "source_id", "molecule_id", norm_key(F.col("pathway"))).alias("claim_id"), "molecule_id", norm_key(F.col("pathway")).alias("object"), "pathway", "source_id", "tier", "method", "directness").dropDuplicates(["claim_id"])


def paper_claims(papers: DataFrame) -> DataFrame:
    """Class D: a paper asserts its main claim; corroborated by its normalised wording."""
    return papers.where(F.col("main_claim") != "").select(
        F.concat(F.lit("D-"), F.col("id")).alias("claim_id"), F.col("id").alias("source_id"), F.lit("asserts").alias("predicate"), F.concat(F.lit("main_claim:"), F.col("id")).alias("object"),
        F.concat(F.lit("paperclaim|"), F.substring(norm_key(F.col("main_claim")), 1, 120)).alias("group_key"), object_key(F.col("main_claim")).alias("object_key"), F.lit("positive").alias("polarity"))


def curated_claims(claims: DataFrame, molecules: DataFrame, sources: DataFrame) -> DataFrame:
    """Class E: each curated claim with each of its molecules and sources, a placeholder where it has none.

    claims: id, claim_text, stance, confidence; molecules: claim_id, molecule_id; sources: claim_id, source_id. A claim is
    negative if its stance contradicts or its text denies.
    """
    negative = (F.col("stance") == "contradicts") | F.col("claim_text").rlike(NEGATIVE)
    mols, srcs = (df.withColumnRenamed("claim_id", "id") for df in (molecules, sources))
    every = claims.join(mols, "id", "left").join(srcs, "id", "left")
    name = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    return every.select(
        F.concat(F.lit("E-"), F.col("id"), F.lit("-"), name("molecule_id", "None"), F.lit("-"), name("source_id", "nosrc")).alias("claim_id"), F.when(F.col("molecule_id").isNull(), "claim_only").otherwise("molecule").alias("subject_type"),
        "molecule_id", F.lit("curated_claim").alias("predicate"), F.concat(F.lit("claim:"), F.col("id")).alias("object"), "source_id", F.when(F.coalesce(negative, F.lit(False)), "negative").otherwise("positive").alias("polarity"), "stance",
        F.col("confidence").cast("double").alias("confidence"), F.concat(F.lit("E|mol:"), name("molecule_id", "None"), F.lit("|"), F.substring(norm_key(F.col("claim_text")), 1, 120)).alias("group_key"))


def flat_triplets(claims: DataFrame) -> DataFrame:
    """Nested claims as the nineteen flat columns of the export, lists joined by bars and the object's name cut to 200."""
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    end = lambda c: [F.col(f"{c}.type").alias(f"{c}_type"), F.col(f"{c}.id").alias(f"{c}_id"), (F.substring(F.coalesce(f"{c}.name", F.lit("")), 1, 200) if c == "object" else F.col(f"{c}.name")).alias(f"{c}_name")]
    return claims.select(
        "claim_id", "class", *end("subject"), "predicate", *end("object"), "polarity", joined("conditions.matrix").alias("matrix"), joined("conditions.process").alias("process"), joined("measurement.method").alias("method"),
        F.col("evidence.study_type").alias("study_type"), F.col("evidence.year").alias("year"), F.col("evidence.citation_count").alias("citation_count"), "weight", "n_independent_sources", "provenance")


def normalise_claims(claims: DataFrame) -> DataFrame:
    """Nested claims in the internal shape: strongest method, tier by alias, analogous where a matrix is given."""
    hits = lambda m: F.filter(F.array(*[F.when(F.contains(F.lower(m), F.lit(part)), F.struct(F.lit(METHODS[key]).alias("value"), F.lit(key).alias("key"))) for part, key in METHOD_ALIASES]), lambda x: x.isNotNull())
    method = F.array_max(F.flatten(F.transform("measurement.method", hits)))["key"]
    tier = F.try_element_at(F.create_map(*[F.lit(x) for kv in TIER_ALIASES.items() for x in kv]), F.lower(F.coalesce("evidence.tier", "evidence.study_type", F.lit("none"))))
    matrix, value = F.get(F.col("conditions.matrix"), 0), F.col("measurement.value").cast("double")
    named = lambda c: F.coalesce(F.nullif(F.col(f"{c}.name"), F.lit("")), F.col(f"{c}.type"), F.lit("?"))
    predicate = F.coalesce("predicate", F.lit("relates_to"))
    unit = F.when(value.isNotNull(), F.col("measurement.unit"))
    return claims.select(
        "claim_id", named("subject").alias("subject"), predicate.alias("predicate"), named("object").alias("object"), predicate.alias("axis"), F.when(F.startswith("polarity", F.lit("neg")), "-").otherwise("+").alias("polarity"),
        F.coalesce(tier, F.lit("T3_inferred")).alias("evidence_tier"), F.coalesce(method, F.lit("unspecified")).alias("method"), F.when(matrix != "", "analogous_matrix").otherwise("unknown").alias("directness"),
        F.col("evidence.source_id").alias("source_id"), F.coalesce(F.col("evidence.source_id").cast("string"), "claim_id").alias("source_group"), matrix.alias("matrix"), F.col("conditions.temperature_c").alias("temp_c"), F.col("conditions.ph").alias("ph"),
        F.when(value.isNotNull(), F.coalesce(F.nullif(unit, F.lit("")), F.lit("value"))).alias("quantity"), unit.alias("unit"), value.alias("low"), value.alias("high"))
