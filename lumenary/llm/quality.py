"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional.

Statistics of each text are computed with array functions inside its row. A list of rules (conjunctions of thresholds on
those statistics) is grown by information gain on two thirds of the labelled rows, pruned on the rest and kept while it
holds there; each rule takes what the rules before it left over. The verdict is CASE WHEN rule 1 THEN ... ELSE kept.

Defined results: a null text has no words; an empty text fails the base rule; a null doc_id gets its statistics and a
verdict, but no label; rows that repeat each keep a row, and repeated labels count once each; without labels (or with one
class only) the list is empty and nothing but the base rule decides; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import SPACE, checkpointed, table

log = logging.getLogger(__name__)

#: Labelled rows used for fitting, about; where there are more, those with the smallest hashes of their doc_id.
FIT_ROWS = 50_000
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "caps_share", "digit_share", "line_words")
CUTS = 16
MAX_RULES, MAX_TERMS = 8, 3
#: A rule needs this precision on the rows it was not grown on, and this many of them.
LEAST_PRECISION, LEAST_ROWS = 0.9, 5


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.cut) if self.above else F.col(self.feature) < F.lit(self.cut)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text, one row per row; texts themselves are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split("t", f"{SPACE}+"), "")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    left = lambda drop: F.length(F.regexp_replace("t", drop, "")).cast("long")
    counted = docs.select("doc_id", text.alias("t")).select(
        "doc_id", words.alias("w"), left(f"{SPACE}+").alias("word_chars"), left(r"[^#*$%&|<>]+").alias("n_symbols"), lines.alias("lines"),
        left(r"[^A-Z]+").alias("n_caps"), left(r"[^0-9]+").alias("n_digits"))
    hashed = counted.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), "n_caps", "n_digits",
        F.expr("CASE WHEN size(w) > 2 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) ELSE CAST(array() AS array<bigint>) END").alias("h"))
    # Only texts with some window twice need places: windows sorted by (hash, place) put equal ones side by side.
    sorted_ = hashed.withColumn("p", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END"))
    twice = "transform(filter(p, (x, k) -> x.h = get(p, k - 1).h OR x.h = get(p, k + 1).h), x -> x.i)"
    covered = f"""aggregate(sort_array({twice}), struct(0L AS n, 0 AS upto),
        (a, i) -> struct(a.n + 3 - greatest(0, a.upto - i) AS n, i + 3 AS upto), a -> a.n)"""
    stats = sorted_.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_caps", "n_digits",
                           F.expr(f"CASE WHEN p IS NULL THEN 0L ELSE {covered} END").alias("n_repeat_words"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return stats.withColumns({
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "caps_share": share("n_caps", "word_chars"), "digit_share": share("n_digits", "word_chars"), "line_words": share("n_words", "n_lines")})


def labelled(stats: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Statistics of a bounded, hash-chosen sample of the labelled rows, with `bad` (quality 0) and `grow` (two thirds)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, rows / max(1, known.count()))
    picked = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.lit(int(share * 2**62)))
    return checkpointed(stats.join(picked.hint("merge"), "doc_id").select(
        *FEATURES, (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow")))


def _cuts(sample: DataFrame) -> dict[str, list[float]]:
    """Thresholds by feature: quantiles of the bad rows and of all rows."""
    at = [i / CUTS for i in range(1, CUTS)]
    row = sample.agg(*[F.percentile_approx(F.when(F.col("bad"), F.col(f)), at, 2000).alias(f"bad_{f}") for f in FEATURES],
                     *[F.percentile_approx(F.col(f), at, 2000).alias(f"all_{f}") for f in FEATURES]).first()
    return {f: sorted({*map(float, row[f"bad_{f}"] or []), *map(float, row[f"all_{f}"] or [])}) for f in FEATURES}


def _matches(rule: list[Term]) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column()
    return out


def _at_most(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= value))


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[int, int, dict[Term, tuple[int, int]]]:
    """Bad rows and all rows, in total and under each term, from one histogram per feature."""
    bins = F.array(*[_at_most(cuts[f], F.col(f)) for f in FEATURES])
    found = rows.select("bad", F.posexplode(bins).alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("bad").alias("p"), F.count("*").alias("n")).collect()
    out: dict[Term, tuple[int, int]] = {}
    p = n = 0
    for i, f in enumerate(FEATURES):
        own = [(r["bin"], r["p"], r["n"]) for r in found if r["f"] == i]
        p, n = sum(x[1] for x in own), sum(x[2] for x in own)
        for k, cut in enumerate(cuts[f]):
            above = [x for x in own if x[0] > k]
            pa, na = sum(x[1] for x in above), sum(x[2] for x in above)
            out[Term(f, True, cut)], out[Term(f, False, cut)] = (pa, na), (p - pa, n - na)
    return p, n, out


def _grow(rest: DataFrame, cuts: dict[str, list[float]]) -> list[Term]:
    """Add the term of highest information gain until no bad row is mixed with good ones, or nothing is gained."""
    rule: list[Term] = []
    while len(rule) < MAX_TERMS:
        p, n, under = _counts(rest.where(F.col("grow") & _matches(rule)), cuts)
        if not p or p == n:
            break
        base = math.log2(p / n)
        gain = {t: x * (math.log2(x / y) - base) if x else 0.0 for t, (x, y) in under.items()}
        best = max(gain, key=lambda t: (gain[t], t.feature, t.above, -t.cut), default=None)
        if best is None or gain[best] <= 1e-9:
            break
        rule.append(best)
    return rule


def _prune(rest: DataFrame, rule: list[Term]) -> tuple[list[Term], int, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on the other third; the shorter one at a tie."""
    heads = [rule[:k] for k in range(1, len(rule) + 1)]
    row = rest.where(~F.col("grow")).agg(*[F.count_if(_matches(h) & F.col("bad")).alias(f"p{k}") for k, h in enumerate(heads)], *[F.count_if(_matches(h)).alias(f"n{k}") for k, h in enumerate(heads)]).first()
    worth = [((2 * row[f"p{k}"] - row[f"n{k}"]) / row[f"n{k}"] if row[f"n{k}"] else -1.0, -k) for k in range(len(heads))]
    k = -max(worth)[1]
    return heads[k], row[f"p{k}"], row[f"n{k}"]


def learn_decision_list(sample: DataFrame) -> list[list[Term]]:
    """Sequential covering for the class `bad`: rules in the order in which they apply."""
    rules: list[list[Term]] = []
    cuts = _cuts(sample)
    rest = sample
    while len(rules) < MAX_RULES:
        rule = _grow(rest, cuts)
        if not rule:
            break
        rule, p, n = _prune(rest, rule)
        if n < LEAST_ROWS or p < LEAST_PRECISION * n:
            break
        rules.append(rule)
        rest = rest.where(~_matches(rule))
    return rules


def decision(rules: list[list[Term]]) -> Column:
    """Number of the first rule that matches, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(_matches(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def describe(rules: list[list[Term]]) -> list[str]:
    return [" AND ".join(f"{t.feature} {'>=' if t.above else '<'} {t.cut:g}" for t in r) for r in rules]


def apply_rules(stats: DataFrame, rules: list[list[Term]]) -> DataFrame:
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return stats.withColumn("base_failed", failed).withColumn("rule", decision(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    stats = checkpointed(text_statistics(docs))
    rules = learn_decision_list(labelled(stats, labels))
    log.info("decision list: %s", "; ".join(describe(rules)))
    return apply_rules(stats, rules)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
