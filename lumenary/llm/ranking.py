"""Ranked lexical search, term at a time with limited accumulators, over documents that are dealt to tasks.

1. Vectors. One pass over the texts keeps, for each document, its length and how often it holds each term of the questions.
   Texts and other terms go no further.
2. Weights. Sums over the vectors give the counts of the corpus and of each term, and the most that one occurrence list of a
   term adds to any score.
3. Tiers. A question's terms go from the rarest on, in tiers that each hold about four times the postings of the one before.
   After each tier every task reports its best partial scores; the kth of all of them is the question's bar. Once what the
   remaining terms can add at most is under the bar, a document without an accumulator can no longer get into the result:
   the question creates no more accumulators. Until then a tier creates only those that can still reach the bar, and drops
   what can't.
4. Survivors get the remaining terms added exactly, and each task gives its best k.

Accumulators live in the task that holds their document. They are not stored between tiers but made again by the next pass
from the vectors and the bars so far: tiers grow geometrically, so this adds a third at most, nothing but bars and best scores
leaves a task, and a lost executor costs its tasks only. Questions are taken in blocks of bounded number and size, and each
block is searched in all documents.

Defined results: a null text, or one without terms, is in no count and in no result; every row of `docs` is a document of its
own, rows with equal doc_id too, whose equal scores take neighbouring ranks; a null doc_id sorts before all others; every row
of `items` is a question of its own, a null or empty one has no result; a term that all documents hold may weigh 0, and scores
of 0 are left out; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import alnum_words, fold, pieces, ragged, starts_of, string_parts
from .runtime import NULL_ID, checkpointed, small_batches, table

BEST = 10
#: Bounds of a block of questions.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: Postings of a question's first tier, and by how much tiers grow.
FIRST_TIER, TIER_GROWTH = 4096, 4
SLICE_BYTES = 1 << 20
#: Accumulators that a task may make at once.
_CELLS = 1 << 18
_VECTOR = "doc_id long, n long, terms array<int>, tfs array<int>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased terms of all texts as bytes, and where each text's begin; gaps between terms are left out by taking every other string."""
    data, offsets = string_parts(texts)
    data = np.ascontiguousarray(fold(data))
    start, end, first = alnum_words(data, offsets)
    border = np.empty(2 * len(start), np.int64)
    border[0::2], border[1::2] = start, end
    both = pa.Array.from_buffers(pa.large_binary(), max(len(border) - 1, 0), [None, pa.py_buffer(border if len(border) else np.zeros(1, np.int64)), pa.py_buffer(data)])
    return both, first


class Questions:
    """A block of questions: their distinct terms, and how often each question holds each."""

    def __init__(self, rows: list) -> None:
        self.ids = [r.item_id for r in rows]
        both, first = words_of(pa.array([r.text or "" for r in rows], pa.string()))
        coded = both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        self.terms = coded.dictionary
        key = np.repeat(np.arange(len(rows)), np.diff(first)) * max(1, len(self.terms)) + coded.indices.to_numpy()
        key, self.times = np.unique(key, return_counts=True)
        self.item, self.term = key // max(1, len(self.terms)), key % max(1, len(self.terms))


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (piece for whole in batches for piece in pieces(whole, SLICE_BYTES)):
            both, first = words_of(batch.column("text").fill_null(""))
            code = pc.fill_null(pc.index_in(both, value_set=known), -1).to_numpy(zero_copy_only=False)[0::2]
            n = np.diff(first)
            hit = np.flatnonzero(code >= 0)
            doc = np.repeat(np.arange(len(n)), n)[hit]
            key, tf = np.unique(doc * max(1, len(known)) + code[hit], return_counts=True)
            at = starts_of(np.bincount(key // max(1, len(known)), minlength=len(n))).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int32)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists(key % max(1, len(known))), lists(tf)], names=["doc_id", "n", "terms", "tfs"])
    return run


def document_vectors(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """doc_id, n and the counts of the given terms, by their place in `terms`, for each row."""
    read = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_vectors(docs.sparkSession.sparkContext.broadcast(terms)), _VECTOR)


def _postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of a batch; the impact is the score's factor beside the term's weight."""
    size = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), size)
    term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
    m = 25 + 75 * batch.column("n").to_numpy(zero_copy_only=False) * n_docs // max(1, n_terms)
    return doc, term, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])


def _weights(n_terms_known: int, n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own document counts and largest impacts, a row for each of its terms."""
        df, most = np.zeros(n_terms_known, np.int64), np.zeros(n_terms_known, np.int64)
        for batch in batches:
            _, term, impact = _postings(batch, n_docs, n_terms)
            df += np.bincount(term, minlength=n_terms_known)
            np.maximum.at(most, term, impact)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.array(most[at])], names=["term", "df", "most"])
    return run


class Search:
    """What tasks know of a block of questions: its tiers, bars and which tiers may create accumulators."""

    def __init__(self, asked: Questions, df: np.ndarray, most: np.ndarray, n_docs: int, n_terms: int, best: int, first_tier: int) -> None:
        self.n_docs, self.n_terms, self.best, self.n_items = n_docs, n_terms, best, len(asked.ids)
        held = df[asked.term] > 0
        item, term, times = asked.item[held], asked.term[held], asked.times[held]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        gain = weight[term] * times
        # Rarest first; a tier ends where a question's summed postings pass its bound.
        order = np.lexsort((term, df[term], item))
        item, term, gain = item[order], term[order], gain[order]
        cost = np.cumsum(df[term])
        cost -= np.concatenate([[0], cost])[np.searchsorted(item, item)]
        tier = np.ceil(np.log(np.maximum(cost / first_tier, 1)) / math.log(TIER_GROWTH)).astype(np.int64)
        self.n_tiers = int(tier.max()) + 1 if len(tier) else 0
        self.tiers = []
        added = np.zeros((self.n_tiers, self.n_items), np.int64)
        np.add.at(added, (tier, item), gain * most[term])
        #: By tier and question, the most that later tiers can add.
        self.rest = added.sum(axis=0) - np.cumsum(added, axis=0)
        for t in range(self.n_tiers):
            mine = np.flatnonzero(tier == t)
            mine = mine[np.argsort(term[mine], kind="stable")]
            count = np.bincount(term[mine], minlength=len(df))
            self.tiers.append((starts_of(count)[:-1], count, item[mine], gain[mine]))
        #: By tier and question: the kth best partial score of all documents after it, and whether it creates accumulators.
        self.bars = np.zeros((self.n_tiers, self.n_items), np.int64)
        self.creates = np.ones((self.n_tiers, self.n_items), bool)

    def raise_bars(self, t: int, bars: np.ndarray) -> bool:
        """Note the bars after tier t; whether any question creates accumulators in the next one."""
        self.bars[t] = bars
        self.creates[t + 1 :] &= self.rest[t] >= bars
        return t + 1 < self.n_tiers and bool(self.creates[t + 1].any())

    def accumulators(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(document * questions + question, score) of the accumulators that some documents have after tier `upto`, and how many there were."""
        keys, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t in range(upto + 1):
            first, count, item, gain = self.tiers[t]
            size = count[term]
            at = ragged(first[term], size)
            of = np.repeat(np.arange(len(term)), size)
            new, add = doc[of] * self.n_items + item[at], gain[at] * impact[of]
            order = np.argsort(new, kind="stable")
            new, add = new[order], add[order]
            edge = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
            new, add = new[edge], np.add.reduceat(add, edge) if len(edge) else add[:0]
            place = np.minimum(np.searchsorted(keys, new), max(len(keys) - 1, 0))
            old = keys[place] == new if len(keys) else np.zeros(len(new), bool)
            score[place[old]] += add[old]
            asks = new % self.n_items if self.n_items else new
            rest, bar = self.rest[t], self.bars[t - 1] if t else np.zeros(self.n_items, np.int64)
            born = ~old & self.creates[t][asks] & (add + rest[asks] >= bar[asks])
            keys, score = np.concatenate([keys, new[born]]), np.concatenate([score, add[born]])
            asks = keys % self.n_items if self.n_items else keys
            alive = np.flatnonzero(score + rest[asks] >= bar[asks])
            alive = alive[np.argsort(keys[alive], kind="stable")]
            keys, score = keys[alive], score[alive]
        return keys, score


def _top(item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, best: int) -> np.ndarray:
    """Places of the best rows of each item: highest score, then smallest doc_id."""
    order = np.lexsort((doc_id, -score, item))
    return order[np.arange(len(order)) - np.searchsorted(item[order], item[order]) < best]


def _best(shared, upto: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own best documents of each question after tier `upto`."""
        search = shared.value
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        rows = max(1, _CELLS // max(1, search.n_items))
        for batch in (whole.slice(a, rows) for whole in batches for a in range(0, whole.num_rows, rows)):
            keys, score = search.accumulators(*_postings(batch, search.n_docs, search.n_terms), upto)
            some = score > 0
            ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            held = tuple(np.concatenate(x) for x in zip(held, (keys[some] % search.n_items, score[some], ids[keys[some] // search.n_items]), strict=True))
            if len(held[0]) > 4 * search.best * search.n_items:
                keep = _top(*held, search.best)
                held = tuple(x[keep] for x in held)
        keep = _top(*held, search.best)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in held], names=["item", "score", "doc"])
    return run


def _ranked(vectors: DataFrame, search: Search, upto: int) -> DataFrame:
    """item, score, doc and rank: the best of all tasks, first by groups of tasks, so that no task gets rows of all."""
    shared = vectors.sparkSession.sparkContext.broadcast(search)
    found = vectors.mapInArrow(_best(shared, upto), "item long, score long, doc long").withColumn("part", F.spark_partition_id())
    order = [F.col("score").desc(), F.col("doc")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.floor(F.col("part") / 256)).orderBy(*order))).where(F.col("rank") <= search.best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= search.best).select("item", "score", "doc", "rank")


def _block_best(docs: DataFrame, asked: Questions, best: int, first_tier: int) -> DataFrame:
    spark = docs.sparkSession
    vectors = checkpointed(document_vectors(docs, asked.terms))
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df, most = np.zeros(len(asked.terms), np.int64), np.zeros(len(asked.terms), np.int64)
    held = vectors.where(F.size("terms") > 0)
    for r in held.mapInArrow(_weights(len(asked.terms), n_docs, n_terms), "term int, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).collect():  # a row for each term of the block at most
        df[r.term], most[r.term] = r.df, r.most
    search = Search(asked, df, most, n_docs, n_terms, best, first_tier)
    t = 0
    while t + 1 < search.n_tiers:
        bars = np.zeros(search.n_items, np.int64)
        for r in _ranked(held, search, t).where(F.col("rank") == best).select("item", "score").collect():  # a row for each question of the block at most
            bars[r["item"]] = r.score
        if not search.raise_bars(t, bars):
            break
        t += 1
    out = checkpointed(_ranked(held, search, search.n_tiers - 1))
    names = spark.createDataFrame([(n, i) for n, i in enumerate(asked.ids)], "item long, item_id long")
    # A row for each question of a block, so it may be broadcast however many documents there are.
    real = F.when(F.col("doc") != NULL_ID, F.col("doc"))
    return out.join(F.broadcast(names), "item").select("item_id", "rank", real.alias("doc_id"), "score")


def best_documents(docs: DataFrame, items: DataFrame, best: int = BEST, first_tier: int = FIRST_TIER, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score: for each row of `items` its `best` documents with a score above 0."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-count // block_items), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    out = None
    for b in range(n):
        rows = asked.where(block == b).orderBy("item_id", "text").collect()  # a block of bounded number and size
        found = _block_best(docs, Questions(rows), best, first_tier)
        out = found if out is None else out.unionByName(found)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH terms AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), asked AS MATERIALIZED (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id
), corpus AS MATERIALIZED (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes
), held AS MATERIALIZED (
  SELECT doc_id, t, count(*) AS tf FROM terms WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, t
), weights AS MATERIALIZED (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY t, docs
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words))))) AS BIGINT) AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
