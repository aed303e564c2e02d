"""Retrieval: term index, ranked lexical search, vector search, one-hop expansion, evidence packing and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, counted
from .positions import positions
from .products import QUERIES, nearest, packed

#: The words that full-text search in English leaves out (the Snowball project's list).
INDEX_STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
#: Words that no OR term may be.
STOP_WORDS = ["what", "which", "where", "when", "does", "with", "from", "that", "this", "have", "their", "about", "into", "would", "could", "should", "there", "these", "those"]
#: Runs of letters and digits of any script, underscores and hyphens.
WORD = r"[\p{L}\p{N}_-]+"
#: Weight of a cover, and of a word where any term will do.
COVER_WEIGHT = 0.1


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, term): all words of a question that are no stop words, each once."""
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).where(~F.col("term").isin(INDEX_STOP))


def build_term_index(docs: DataFrame, text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, places): each term of a document with its word positions in order; stop words have positions but no rows.

    With `terms` (a column term) only these are indexed. Rows are inverted where they lie, and only the texts of an id that stands in several rows are shuffled.
    """
    rows = docs.select("id", text)
    seen = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = checkpointed(seen)
    index = _terms_of(rows, text, terms)
    if again.isEmpty():
        return index
    # Texts of one id make one document; only these are brought together.
    same = F.array_sort(F.flatten(F.collect_list("places")))
    texts_of_one = _terms_of(rows.join(again.hint("merge"), "id", "left_semi"), text, terms).groupBy("id", "term").agg(F.sum("tf").alias("tf"), same.alias("places"))
    return _terms_of(rows.join(again.hint("merge"), "id", "left_anti"), text, terms).unionByName(texts_of_one)


def _terms_of(docs: DataFrame, text: str, terms: DataFrame | None) -> DataFrame:
    """The entries of each row, inverted where it lies."""
    entries = docs.select("id", F.explode(positions(tokens(F.col(text)))).alias("e"))
    out = entries.select("id", F.col("e.word").alias("term"), F.size("e.places").cast("long").alias("tf"), F.col("e.places").alias("places")).where(~F.col("term").isin(INDEX_STOP))
    return out.join(counted(terms.select("term").distinct()), "term", "left_semi").select("id", "term", "tf", "places") if terms is not None else out


def or_terms(questions: DataFrame, least: int = 3, most: int = 24) -> DataFrame:
    """(qid, term): of a question's words of three letters or more that are no stop words the first 24, each once."""
    kept = F.filter(tokens(F.col("text")), lambda t: (F.length(t) >= least) & ~t.isin(STOP_WORDS))
    return questions.select("qid", F.explode(F.array_distinct(F.slice(kept, 1, most))).alias("term"))


def top_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= k)


def cover_density(entries: Column, n_terms: Column) -> Column:
    """Sum over all minimal covers of weight / (1 + words between that are no terms).

    entries: (place, term number from 1) in order of places. A cover is a run from one entry to another that holds all
    terms and no shorter such run. The scan keeps the latest entry of each term; whenever the earliest of these moves on,
    the run from it to the entry just read is the next minimal cover.
    """
    start = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("latest"), F.lit(-1).alias("from"), F.lit(0).alias("at"), F.lit(0.0).alias("score"))

    def step(s: Column, e: Column) -> Column:
        latest = F.transform(s["latest"], lambda x, i: F.when(i == e["term"] - 1, s["at"]).otherwise(x))
        return F.struct(latest.alias("latest"), s["from"].alias("from"), s["at"].alias("at"), s["score"].alias("score"))

    def close(s: Column) -> Column:
        first = F.array_min(s["latest"])
        span = F.get(entries, s["at"])["place"] - F.get(entries, first)["place"]
        noise = span - (s["at"] - first)
        found = first > s["from"]
        return F.struct(s["latest"].alias("latest"), F.greatest(first, s["from"]).alias("from"), (s["at"] + 1).alias("at"), (s["score"] + F.when(found, COVER_WEIGHT / (1 + noise)).otherwise(0.0)).alias("score"))

    return F.aggregate(entries, start, lambda s, e: close(step(s, e)), lambda s: s["score"])


def gated(hits: DataFrame, papers: DataFrame | None, min_relevance: int | None) -> DataFrame:
    if papers is None or min_relevance is None:
        return hits
    return hits.join(papers.where(F.col("relevance_llm").isNull() | (F.col("relevance_llm") >= min_relevance)).select("id").hint("merge"), "id", "left_semi")


def all_terms_hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, rank) of documents with all terms of a question, by cover density.

    A question meets the documents of its rarest term only, and these are asked for its other terms by document and term,
    so a common term brings no documents together with questions.
    """
    often = index.groupBy("term").agg(F.count("*").alias("df"))
    numbered = terms.join(counted(often), "term", "left").select("qid", "term", F.coalesce("df", F.lit(0)).alias("df"))
    asked = checkpointed(numbered.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("df", "term"))).withColumn("wanted", F.count("*").over(Window.partitionBy("qid"))))
    rarest = asked.where("nth = 1 AND df > 0").select("qid", "term", "wanted")
    first = checkpointed(index.select("id", "term").join(counted(rarest), "term").select("qid", "id", "wanted"))
    every = first.join(asked.select("qid", "term", "nth").hint("merge"), "qid")
    held = checkpointed(every).join(index.select("id", "term", "places").hint("merge"), ["id", "term"])
    both = held.groupBy("qid", "id", "wanted").agg(F.count("*").alias("matched"), F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("place"), F.col("nth").alias("term")))))).alias("entries")).where("matched = wanted")
    return both.select("qid", "id", F.round(cover_density(F.col("entries"), F.col("wanted").cast("int")), 6).alias("rank"))


def any_term_hits(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, id, rank) of documents with a term of a question; every occurrence is a cover of its own."""
    return index.select("id", "term", "tf").join(counted(terms), "term").groupBy("qid", "id").agg(F.round(COVER_WEIGHT * F.sum("tf"), 6).alias("rank"))


def lexical_search(index: DataFrame, terms: DataFrame, papers: DataFrame | None = None, k: int = 6, min_relevance: int | None = 60) -> DataFrame:
    """Documents with all terms of a question, the k of highest rank."""
    return top_k(gated(all_terms_hits(index, terms), papers, min_relevance), "qid", [F.desc("rank"), F.col("id")], k).select("qid", "id", "rank", "nth")


def lexical_search_with_fallback(index: DataFrame, terms: DataFrame, papers: DataFrame | None = None, k: int = 6, min_relevance: int | None = 60) -> DataFrame:
    """All-terms hits where a question has any, else any-term hits; for all questions at once."""
    strict = checkpointed(lexical_search(index, terms, papers, k, min_relevance))
    open_ = terms.join(strict.select("qid").distinct().hint("merge"), "qid", "left_anti")
    loose = top_k(gated(any_term_hits(index, open_), papers, min_relevance), "qid", [F.desc("rank"), F.col("id")], k).select("qid", "id", "rank", "nth")
    return strict.withColumn("used_fallback", F.lit(False)).unionByName(loose.withColumn("used_fallback", F.lit(True)))


def keyword_count_search(docs: DataFrame, terms: list[str], k: int = 6) -> DataFrame:
    """Non-overlapping occurrences of terms over three letters, times (0.5 + relevance / 100)."""
    text = F.lower("text")
    hits = sum(((F.length(text) - F.length(F.replace(text, F.lit(t.lower())))) / len(t) for t in terms if len(t) > 3), F.lit(0.0))
    scored = docs.withColumn("hits", hits.cast("long")).where(F.col("hits") > 0).withColumn("score", F.round(F.col("hits") * (0.5 + F.coalesce("relevance_llm", F.lit(0)) / 100), 4))
    return scored.select("id", "hits", "score").orderBy(F.desc("score"), F.desc("hits"), F.desc("id")).limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def admit_vectors(df: DataFrame, dim: int) -> DataFrame:
    """`reason` for each vector that is not accepted: its size, a coordinate that is not finite, no length, or an id used twice."""
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    per_id = df.groupBy("vec_id").agg(F.count("*").alias("uses"))
    reason = F.when(F.col("embedding").isNull() | (F.size("embedding") != dim), "dimension").when(odd, "not finite").when(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) < 1e-8, "zero").when(F.col("uses") > 1, "duplicate id")
    return df.join(per_id, "vec_id").withColumn("reason", reason)


def vectors_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("id"), "embedding")


def dealt(items: DataFrame) -> DataFrame:
    """Rows dealt evenly to a few tasks for each core, however they lie."""
    return items.repartition(2 * items.sparkSession.sparkContext.defaultParallelism)


def vector_search(items: DataFrame, queries: DataFrame, k: int = 20, block: int = QUERIES) -> DataFrame:
    """Exact cosine similarity of a stated set of queries against all items, the k best of each; ties by item.

    Queries are broadcast in blocks of about `block`, a checked bound; every block meets all items. The k best per task come
    before the shuffle.
    """
    k = min(20, max(1, k))
    found = nearest(packed(dealt(vectors_of(items))), vectors_of(queries), k, most=block)
    return top_k(found, "qid", [F.desc("similarity"), F.col("vec_id")], k)


def sign_planes(items: DataFrame, bits: int, tables: int) -> np.ndarray:
    """Whole numbers from -1000 to 1000 by component and plane, hashes of both; a fixed number for each component."""
    size = items.agg(F.max(F.size("embedding"))).first()[0] or 0
    at = F.col("id").cast("int")
    planes = items.sparkSession.range(max(0, size) * tables * bits).select((at / (tables * bits)).cast("int").alias("i"), (at % (tables * bits)).alias("p"))
    code = (F.col("p") / bits).cast("int") * 64 + F.col("p") % bits
    rows = planes.select("i", "p", (F.pmod(F.hash("i", code), F.lit(2001)) - 1000).alias("w")).collect()
    out = np.zeros((max(0, size), tables * bits))
    for r in rows:
        out[r.i, r.p] = r.w
    return out


def lsh_search(items: DataFrame, queries: DataFrame, k: int = 20, bits: int = 6, tables: int = 64) -> DataFrame:
    """Approximate vector search: vectors that have all signs in common for one of the tables of random hyperplanes are candidates, re-ranked by exact cosine.

    Vectors stay in their blocks: codes are compared where blocks meet, so neither codes nor candidates are shuffled.
    """
    planes = sign_planes(items, bits, tables)
    weights = 1 << np.arange(bits)

    def codes(x: np.ndarray) -> np.ndarray:
        signs = ~(x @ planes[: x.shape[1]] < 0)
        return (signs.reshape(len(x), tables, bits) @ weights).astype(np.uint32 if bits > 8 else np.uint8)

    def meets(_: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = (np.ascontiguousarray(c if bits <= 8 else c.view(np.uint32)).T.copy() for c in (a, b))
        out = np.zeros((b.shape[1], a.shape[1]), bool)
        for t in range(tables):
            out |= b[t][:, None] == a[t]
        return out

    found = nearest(packed(dealt(vectors_of(items)), codes), vectors_of(queries), k, codes, meets)
    return top_k(found, "qid", [F.desc("similarity"), F.col("vec_id")], k)


def check_vector_space(reference: DataFrame, new: DataFrame, least: float = 0.99) -> DataFrame:
    """Mode by the cosine of the shortest item in both spaces: vector, or lexical if they disagree."""
    first = reference.agg(F.min_by(F.struct("vec_id", "embedding"), F.struct("length", "vec_id")).alias("r")).select("r.*")
    both = first.join(new.select("vec_id", F.col("embedding").alias("other")), "vec_id")
    cosine = dot(F.col("embedding"), F.col("other")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("other"), F.col("other")))
    return both.select("vec_id", F.round(cosine, 6).alias("cosine"), F.when(cosine >= least, "vector").otherwise("lexical").alias("mode"))


def expand_one_hop(seeds: DataFrame, relations: DataFrame, k: int) -> DataFrame:
    """The k heaviest relations that touch any seed of a question."""
    ends = relations.select("relation_id", "weight", F.explode(F.array("src", "dst")).alias("item")).distinct()
    touched = seeds.select("qid", "item").distinct().join(checkpointed(ends).hint("merge"), "item").select("qid", "relation_id", "weight").distinct()
    return top_k(touched, "qid", [F.desc("weight"), F.col("relation_id")], k)


def merge_seed_expansion(seeds: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Seeds first, then neighbours, each item once; `origin` says which."""
    both = seeds.select("qid", "item", "rank", F.lit("seed").alias("origin"), F.lit(0).alias("o")).unionByName(neighbours.select("qid", "item", "rank", F.lit("graph_neighbor").alias("origin"), F.lit(1).alias("o")))
    first = both.groupBy("qid", "item").agg(F.min(F.struct("o", "rank", "origin")).alias("b")).select("qid", "item", "b.o", "b.rank", "b.origin")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("o", "rank", "item"))).drop("o")


def attach_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sorted distinct sources and chunks of each item."""
    joined = items.select("qid", "item").join(evidence.hint("merge"), "item", "left")
    lists = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(f"{c}s")
    return joined.groupBy("qid", "item").agg(lists("source_id"), lists("chunk_id"))


def pack_evidence(items: DataFrame, budget: int = 8000, cut: int = 1200) -> DataFrame:
    """(qid, pos, source_id, content): what fits a question's budget, items in order and cut, spent once per source.

    items: qid, pos, source_ids, content. An item that is larger than what is left ends the packing; within an item, a source
    is passed over once its content no longer fits, and the next item follows. One question's items form one small group.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in pdf.sort_values("pos", kind="stable").itertuples():
            content = (r.content or "")[:cut]
            if len(content) > left:
                break
            for source in r.source_ids:
                if len(content) <= left:
                    out.append((r.qid, r.pos, source, content))
                    left -= len(content)
        return pd.DataFrame(out, columns=["qid", "pos", "source_id", "content"])
    return items.groupBy("qid").applyInPandas(run, "qid long, pos int, source_id long, content string")


def source_block(df: DataFrame) -> DataFrame:
    """A line per paper: title, (year, journal), and a snippet of 500 characters, cut at the last space."""
    text = F.trim(F.regexp_replace(F.coalesce("abstract", F.lit("")), r"\s+", " "))
    snippet = F.when(F.length("flat") <= 500, F.col("flat")).otherwise(F.concat(F.regexp_replace(F.substring("flat", 1, 500), r" \S*$", ""), F.lit("…")))
    return df.withColumn("flat", text).select("id", F.concat(F.lit("["), F.col("id"), F.lit("] "), F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("(untitled)")), F.lit(" ("), F.concat_ws(" · ", F.col("year").cast("string"), F.col("journal")), F.lit(") "),
                                                             F.coalesce(F.nullif(snippet, F.lit("")), F.lit("(no abstract)"))).alias("block"))


def claims_per_source(claims: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    best = Window.partitionBy("source_id").orderBy(F.col("confidence").desc_nulls_last(), "claim_id")
    return claims.join(ids, "source_id", "left_semi").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def consensus_tally(retrieved: DataFrame, stances: DataFrame) -> DataFrame:
    """Every retrieved row counts as agree, oppose, neutral, or unassessed."""
    joined = retrieved.select("qid", "id").join(stances, ["qid", "id"], "left")
    is_ = lambda s: F.count_if(F.col("stance") == s)
    return joined.groupBy("qid").agg(is_("agree").alias("agree"), is_("oppose").alias("oppose"), is_("neutral").alias("neutral"), F.count_if(~F.coalesce(F.col("stance").isin("agree", "oppose", "neutral"), F.lit(False))).alias("unassessed"), F.count("*").alias("total"))


def conversation_query(turns: DataFrame, most: int = 600) -> DataFrame:
    """User turns newest first, joined and cut."""
    own = turns.where((F.col("role") == "user") & (F.trim("content") != ""))
    newest = F.sort_array(F.collect_list(F.struct("turn_index", "content")), asc=False)
    return own.groupBy("conversation_id").agg(F.substring(F.array_join(F.transform(newest, lambda x: x["content"]), " "), 1, most).alias("query"))


def clean_history(turns: DataFrame, most: int = 3, cap: int = 200) -> DataFrame:
    """The last 2 * most turns of users and assistants, trimmed and cut, same roles merged, from the first user turn on."""
    own = Window.partitionBy("conversation_id")
    kept = turns.where(F.col("role").isin("user", "assistant") & (F.trim("content") != "")).withColumn("content", F.substring(F.trim("content"), 1, cap))
    last = kept.withColumn("back", F.row_number().over(own.orderBy(F.desc("turn_index")))).where(F.col("back") <= 2 * most)
    started = last.withColumn("users", F.sum((F.col("role") == "user").cast("int")).over(own.orderBy("turn_index"))).where(F.col("users") > 0)
    change = F.coalesce(F.col("role") != F.lag("role").over(own.orderBy("turn_index")), F.lit(True)).cast("int")
    island = started.withColumn("change", change).withColumn("island", F.sum("change").over(own.orderBy("turn_index")))
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "content"))), lambda x: x["content"]), "\n")
    return island.groupBy("conversation_id", "island", "role").agg(F.min("turn_index").alias("turn_index"), merged.alias("content")).drop("island")


def retrieval_eval(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Hits and fallback of each question, questions without any hit included."""
    per = results.groupBy("qid").agg(F.count("*").alias("hits"), F.max("used_fallback").alias("used_fallback"))
    return questions.select("qid").join(per, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("used_fallback", F.lit(False)).alias("used_fallback"))


def citation_check(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited `[n]`, sorted; cited but not retrieved; retrieved but not cited."""
    known = retrieved.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("known"))
    cited = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))))
    both = answers.join(known, "qid", "left").withColumn("cited", cited).withColumn("known", F.coalesce("known", F.array().cast("array<bigint>")))
    text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ",")
    return both.select("qid", text(F.col("cited")).alias("cited"), text(F.array_except("cited", "known")).alias("invented"), text(F.array_except("known", "cited")).alias("ignored"))


def merge_partials(parts: DataFrame) -> DataFrame:
    """The first record of each question, in file order."""
    return parts.groupBy("qid").agg(F.min_by(F.struct("grounded", "cited", "covered"), F.struct("file", "line")).alias("r")).select("qid", "r.*")


def average_scores(merged: DataFrame) -> DataFrame:
    full = merged.where(F.col("grounded").isNotNull() & F.col("cited").isNotNull() & F.col("covered").isNotNull())
    return full.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in ("grounded", "cited", "covered")])


def judge_quality(pairs: DataFrame) -> DataFrame:
    """Precision and recall of quarantine, and Cohen's kappa over the classes of `verdict` and `gold`."""
    cross = pairs.groupBy("verdict", "gold").agg(F.count("*").alias("n"))
    total = F.sum("n")
    margins = cross.groupBy("verdict").agg(total.alias("a")).withColumnRenamed("verdict", "k").join(cross.groupBy("gold").agg(total.alias("b")).withColumnRenamed("gold", "k"), "k").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    q = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    v, g = F.col("verdict") == "quarantine", F.col("gold") == "quarantine"
    one = cross.agg(total.alias("n"), q(F.col("verdict") == F.col("gold")).alias("same"), q(v & g).alias("tp"), q(v).alias("v"), q(g).alias("g")).crossJoin(F.broadcast(margins))
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("ab"), F.lit(0)) / (F.col("n") * F.col("n"))
    return one.select("n", F.round(F.try_divide(F.col("tp"), F.col("v")), 4).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("g")), 4).alias("recall"), F.round(F.try_divide(po - pe, 1 - pe), 4).alias("kappa"))


