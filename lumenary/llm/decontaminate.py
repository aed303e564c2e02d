"""Benchmark decontamination by Wu-Manber search over words.

Every window of `WINDOW` consecutive words of a benchmark item is a pattern (a shorter item is one pattern of its own
length). A shift table over hashed blocks of `BLOCK` words says how far a search may jump. Texts are cut into overlapping
lanes that advance together, each by its own shift, so numpy moves all lanes of a batch at once. Where the shift is 0 and a
bit table holds the hash of the whole window, the place is a candidate: the hash selects the bucket of patterns that it
meets in a join, and their words are compared directly.

The benchmark never passes through the driver. Its patterns are a table; only the shift and bit tables are collected and
sent to all tasks, and their size is fixed (at most 13 lengths of 384 KB) however many items there are. A larger benchmark
fills them, which makes more candidates, not other results. Documents are scanned once.

Defined results: a null text has no words, hits nothing and is never contaminated; a null doc_id stays null; rows that
repeat keep a row each; items that repeat are counted by distinct item_id (a null one as an empty string); null items or
items without words match nothing; an empty benchmark leaves all counts 0; an empty document table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U64, alnum_words, blocks, fold, hash_spans, hash_windows, join_words, mix, pieces, powers, ragged, starts_of, string_parts
from .runtime import NULL_ID, checkpointed, small_batches, table

WINDOW, BLOCK = 13, 2
BATCH_BYTES = 2 << 20
LANE = 512
#: Sizes of the two tables of one length: shifts by hashed block, and bits by hashed window.
SHIFT_BITS, WINDOW_BITS = 18, 20
#: Tables of tasks are merged in so many groups before they meet.
MERGE_GROUPS = 64
PATTERN = "m int, h long, words string, item string"
SCANNED = "doc_id long, row_hash long, n_words long, found array<struct<pos:int,m:int,h:long,words:string>>"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, hash) of all words of some texts, and where each text's begin."""
    data, offsets = string_parts(texts)
    data = fold(data)
    start, end, first = alnum_words(data, offsets)
    return data, start, end, hash_spans(data, start, end), first


def window_hash(words: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """hash_windows at some places only."""
    out = mix(words[at])
    for j in range(1, m):
        out += words[at + j] * powers(m + 1)[j]
    return mix(out)


def _block_cells(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = words[at] * U64(0x9E3779B97F4A7C15)
    for j in range(1, size):
        h = (h ^ words[at + j]) * U64(0xBF58476D1CE4E5B9)
    return (h >> U64(64 - SHIFT_BITS)).astype(np.int64)


@dataclass
class Tables:
    """What the search for all patterns of one length needs."""

    length: int
    shift: np.ndarray
    known: np.ndarray

    @classmethod
    def empty(cls, m: int) -> Tables:
        # A block that no pattern holds lets the search jump past it.
        return cls(m, np.full(1 << SHIFT_BITS, m - min(BLOCK, m) + 1, np.uint8), np.zeros(1 << WINDOW_BITS, bool))

    def add(self, words: np.ndarray, at: np.ndarray) -> None:
        block = min(BLOCK, self.length)
        for j in range(self.length - block + 1):
            np.minimum.at(self.shift, _block_cells(words, at + j, block), self.length - block - j)
        self.known[(window_hash(words, at, self.length) >> U64(64 - WINDOW_BITS)).astype(np.int64)] = True

    def pack(self) -> bytes:
        return pa.compress(self.shift.tobytes() + np.packbits(self.known).tobytes(), codec="zstd", asbytes=True)

    @classmethod
    def unpack(cls, m: int, blob: bytes) -> Tables:
        raw = np.frombuffer(pa.decompress(blob, decompressed_size=(1 << SHIFT_BITS) + (1 << WINDOW_BITS - 3), codec="zstd", asbytes=True), np.uint8)
        return cls(m, raw[: 1 << SHIFT_BITS], np.unpackbits(raw[1 << SHIFT_BITS :]).astype(bool))

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where a pattern may begin; text i has words first[i]:first[i + 1]."""
        n, m, b = np.diff(first), self.length, min(BLOCK, self.length)
        if len(words) < m:
            return np.zeros(0, np.int64)
        # The last word of a window, for each lane, and one past the last place that the lane looks at.
        windows = np.maximum(n - m + 1, 0)
        lanes = -(-windows // LANE)
        at = ragged(np.zeros(len(n), np.int64), lanes) * LANE
        at_text = np.repeat(np.arange(len(n)), lanes)
        place = first[at_text] + at + m - 1
        limit = first[at_text] + np.minimum(at + LANE, windows[at_text]) + m - 1
        shifts = self.shift[_block_cells(words, np.arange(len(words) - b + 1), b)].astype(np.int64)
        found = []
        while len(place):
            jump = shifts[place - b + 1]
            stop = place[jump == 0] - m + 1
            if len(stop):
                found.append(stop[self.known[(window_hash(words, stop, m) >> U64(64 - WINDOW_BITS)).astype(np.int64)]])
            place = place + np.maximum(jump, 1)
            alive = place < limit
            place, limit = place[alive], limit[alive]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _item_windows(first: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(item, place) of all patterns of some items, by length."""
    n = np.diff(first)
    length = np.minimum(n, window)
    out = {}
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        count = n[own] - m + 1
        out[m] = np.repeat(own, count), ragged(first[own], count)
    return out


def _patterns(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, BATCH_BYTES)):
            data, start, end, words, first = words_of(batch.column("text").fill_null(""))
            for m, (item, at) in _item_windows(first, window).items():
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), m, np.int32)), pa.array(hash_windows(words, m)[at].view(np.int64)), join_words(data, start, end, at, np.full(len(at), m)).cast(pa.string()),
                    batch.column("item").take(pa.array(item))], names=["m", "h", "words", "item"])
    return run


def _task_tables(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for batch in (piece for whole in batches for piece in pieces(whole, BATCH_BYTES)):
            _, _, _, words, first = words_of(batch.column("text").fill_null(""))
            for m, (_, at) in _item_windows(first, window).items():
                tables.setdefault(m, Tables.empty(m)).add(words, at)
        lane = TaskContext.get().partitionId() % MERGE_GROUPS
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([lane] * len(tables), pa.int32()), pa.array([t.pack() for t in tables.values()], pa.binary())], names=["m", "lane", "blob"])
    return run


def _merge_tables(rows: pa.Table) -> pa.Table:
    if not rows.num_rows:
        return rows
    m = rows["m"][0].as_py()
    every = Tables.empty(m)
    for blob in rows["blob"]:
        one = Tables.unpack(m, blob.as_py())
        every = Tables(m, np.minimum(every.shift, one.shift), every.known | one.known)
    return pa.table({"m": pa.array([m], pa.int32()), "lane": pa.array([0], pa.int32()), "blob": pa.array([every.pack()], pa.binary())})


def compile_benchmark(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[Tables]]:
    """The table of patterns, and the search tables, whose size does not depend on the benchmark's."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    patterns = checkpointed(items.mapInArrow(_patterns(window), PATTERN).distinct())
    blobs = "m int, lane int, blob binary"
    merged = items.mapInArrow(_task_tables(window), blobs).groupBy("m", "lane").applyInArrow(_merge_tables, blobs).groupBy("m").applyInArrow(_merge_tables, blobs)
    return patterns, [Tables.unpack(r["m"], bytes(r["blob"])) for r in merged.orderBy("m").collect()]  # `window` rows at most


def _search(tables: list[Tables]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, extra in _with_hash(batches):
            data, start, end, words, first = words_of(texts)
            at, m, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            for t in tables:
                places = t.candidates(words, first)
                at.append(places)
                m.append(np.full(len(places), t.length, np.int32))
                h.append(window_hash(words, places, t.length) if len(places) else h[0])
            at, m, h = np.concatenate(at), np.concatenate(m), np.concatenate(h)
            order = np.lexsort((m, at))
            at, m, h = at[order], m[order], h[order]
            text = np.searchsorted(first, at, side="right") - 1
            found = pa.StructArray.from_arrays([pa.array((at - first[text]).astype(np.int32)), pa.array(m), pa.array(h.view(np.int64)), join_words(data, start, end, at, m.astype(np.int64)).cast(pa.string())], names=["pos", "m", "h", "words"])
            border = starts_of(np.bincount(text, minlength=len(ids))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), extra, pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(border), found)], names=["doc_id", "row_hash", "n_words", "found"])
    return run


def _with_hash(batches: Iterator[pa.RecordBatch]):
    """Blocks of each batch with its row_hash column, in step."""
    for batch in batches:
        at = 0
        for key, ids, texts in blocks(iter([batch]), BATCH_BYTES):
            yield key, ids, texts, batch.column("row_hash").slice(at, len(ids))
            at += len(ids)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, row_hash, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of `docs`."""
    patterns, tables = compile_benchmark(benchmark, window)
    read = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_hash"))
    scanned = checkpointed(read.mapInArrow(_search(tables), SCANNED))
    places = scanned.select("doc_id", "row_hash", F.explode("found").alias("c")).select("doc_id", "row_hash", "c.pos", "c.m", "c.h", F.col("c.words").alias("said"))
    hits = places.join(patterns.hint("merge"), ["m", "h"]).where(F.col("said") == F.col("words"))
    # Words covered by windows in order: what each adds beyond the end of all before it.
    covered = F.aggregate(F.array_sort("places"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
                          lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0), p["pos"] + p["m"] - F.greatest(a["upto"], p["pos"]))).alias("n"), F.greatest(a["upto"], p["pos"] + p["m"]).alias("upto")))
    counts = (hits.groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("pos", "m")).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))
              .select("doc_id", "row_hash", covered["n"].cast("long").alias("n_hit"), "items"))
    l, r = scanned.select("doc_id", "row_hash", "n_words").alias("l"), counts.alias("r")
    joined = l.join(r.hint("merge"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.row_hash") == F.col("r.row_hash")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    found = joined.select("l.doc_id", "l.row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose texts are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("row_hash").alias("__bad_hash")).distinct()
    hit = F.col("doc_id").cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__bad_hash"))
    return docs.join(bad.hint("merge"), hit, "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), patterns AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM words, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)
), hits AS (
  SELECT doc_id, item, i, m FROM places JOIN patterns USING (m, p)
), per_word AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM hits) GROUP BY doc_id
), per_item AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN per_word USING (doc_id) LEFT JOIN per_item USING (doc_id)
"""
