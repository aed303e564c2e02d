"""N-gram Jaccard join in the metric space of shingle sets: exact components of all pairs with a least similarity (0.9 in op10).

The Jaccard distance is a metric, so distances to common pivots bound distances between documents.

1. What can be linked at all. Texts that are not copies of each other lie 0.97 to 1 from every pivot, so the triangle
   inequality alone would replicate nearly every document everywhere. Equal sets are merged first (128-bit digests). Then
   the documents of every shingle are counted and each set's shingles are ordered by that count, rarest first. Of two linked
   sets the larger holds a common shingle among its first n - ceil(s n) + 1 and the smaller among its first
   n - ceil(2 s n / (1 + s)) + 1, s the least similarity. A shingle that one set alone holds proves nothing, so most sets
   enter nowhere. Sets that meet in a shingle, one of them as the smaller, are in one region; no link leaves a region.
2. Regions. A region over the byte bound takes pivots: each document belongs to the Voronoi region of its nearest pivot and
   is a guest wherever its distance is within twice the greatest distance of that, which is where the triangle inequality
   lets partners be. The parts are regions again, and so on until they fit. Documents linked with one pivot are connected
   and need no comparison among themselves. Where no pivot divides a region (a family whose members are all about as far
   apart as the threshold), those outside of the largest such ball meet each other and the ball in pairs of blocks.
3. Inside a part documents become pivots one after the other; those already connected, or beyond the triangle window of
   every earlier pivot, are not compared. Comparisons are exact set intersections.

A block of rows sends a shingle or an equal set once however often it holds it, so thousands of copies are one row per block.

Defined results: a null text or one without words has an empty set and no links; with fewer words than a shingle the whole
sequence is the only shingle; rows with equal doc_id are one node that has the links of all its texts, and each keeps a
row; a null doc_id is a node that sorts before all others and stays null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLOCK_BIT, U64, blocks, by_range, fold, from_blob, hash_spans, hash_windows, mix, numbers, pieces, release, space_words, squeeze, starts_of, string_parts, to_blob, unsqueeze
from .components import components
from .runtime import NULL_ID, buckets_for, checkpointed, small_batches, table

#: Words of a shingle and least similarity of op10; the similarity is a fraction, so that comparisons stay exact.
SHINGLE = 3
PER, OF = 90, 100
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: Bytes of text whose shingles one bucket counts.
BUCKET_BYTES = 16 << 20
#: Shingles that one part of a region may hold (8 bytes each); a document counts as so many more.
PART_SHINGLES, DOC_SHINGLES = 1 << 17, 128
#: Pivots of one division.
PIVOTS = 16
#: Kinds of rows between stages, and of links.
OWN, TOKENS, SETS, FOUND = 0, 1, 2, 3
META, SAME, NEAR = 0, 1, 2
_SENT = "k long, block long, kind int, blob binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["k", "block", "kind", "blob"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each begins; a few megabytes at a time."""
    parts = [_sets_of(piece.column("text"), k) for piece in pieces(pa.record_batch([texts], names=["text"]), SLICE_BYTES)]
    sets = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    return sets, starts_of(np.concatenate([np.diff(p[1]) for p in parts] or [np.zeros(0, np.int64)]))


def _sets_of(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_parts(texts)
    data = fold(data)
    start, end, first = space_words(data, offsets)
    words = hash_spans(data, start, end)
    whole = hash_windows(words, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            sets.append(mix(hash_windows(words[a:b], b - a) ^ U64(b - a)))
        else:
            sets.append(words[:0])
    return (np.concatenate(sets) if sets else words[:0]), starts_of(np.array([len(s) for s in sets], np.int64))


class Block:
    """The sets of one block, and which rows speak for equal sets: the smallest doc_id of each."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, shingle: int) -> None:
        self.ids = ids
        self.sets, self.first = shingle_sets(texts, shingle)
        self.size = np.diff(self.first)
        padded = np.append(self.sets, U64(0))
        sums = [np.add.reduceat(mix(padded ^ U64(c)), self.first[:-1]) if len(ids) else np.zeros(0, np.uint64) for c in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
        self.digest = mix(sums[0] + self.size.astype(np.uint64)), mix(sums[1] ^ self.size.astype(np.uint64))
        known = np.flatnonzero(self.size > 0)
        order = known[np.lexsort((ids[known], self.digest[1][known], self.digest[0][known]))]
        new = np.ones(len(order), bool)
        new[1:] = (self.digest[0][order[1:]] != self.digest[0][order[:-1]]) | (self.digest[1][order[1:]] != self.digest[1][order[:-1]])
        #: Speakers by digest, and of each row with words the number of its speaker.
        self.speakers = order[new]
        self.speaker_of = np.full(len(ids), -1, np.int64)
        self.speaker_of[order] = np.cumsum(new) - 1

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of some rows, one row after the other, and the number of the row of each."""
        count = self.size[rows]
        at = np.repeat(self.first[rows] - starts_of(count)[:-1], count) + np.arange(int(count.sum()))
        return self.sets[at], np.repeat(np.arange(len(rows)), count)


def _send_sets(n: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block itself, its distinct shingles with the number of its sets that hold each, and its distinct sets."""
        for key, ids, texts in blocks(batches, BLOCK_BYTES):
            own = Block(ids, texts, shingle)
            rows = [(key, key, OWN, to_blob({"ids": ids, "texts": texts}))]
            tokens, held = np.unique(own.members(own.speakers)[0], return_counts=True)
            at = by_range(tokens, n)
            rows += [(b, key, TOKENS, squeeze(tokens[at[b] : at[b + 1]], held[at[b] : at[b + 1]].astype(np.uint32))) for b in range(n) if at[b] < at[b + 1]]
            sets = own.speakers
            at = by_range(own.digest[0][sets], n)
            rows += [(b, key, SETS, squeeze(own.digest[0][sets[at[b] : at[b + 1]]], own.digest[1][sets[at[b] : at[b + 1]]], ids[sets[at[b] : at[b + 1]]])) for b in range(n) if at[b] < at[b + 1]]
            yield _batch(rows)
            release()
    return run


def _by_kind(rows: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list[tuple[int, bytes]]] = {OWN: [], TOKENS: [], SETS: [], FOUND: []}
    for block, kind, blob in zip(rows["block"].to_pylist(), rows["kind"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        out[kind].append((block, blob))
    return out


def _weigh(rows: pa.Table) -> pa.Table:
    """One bucket: how many sets hold each shingle (quarters of its binary logarithm) and the smallest doc_id of each set, told to the blocks that asked."""
    if not rows.num_rows or rows["k"][0].as_py() >= BLOCK_BIT:
        return _table([])
    bucket, asked = rows["k"][0].as_py(), _by_kind(rows)
    out = []
    parts = [unsqueeze(blob, np.uint64, np.uint32) for _, blob in asked[TOKENS]]
    if parts:
        at = starts_of(np.array([len(p[0]) for p in parts]))
        tokens, held = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        del parts
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        total = np.add.reduceat(held[order].astype(np.int64), edge)
        weight = np.empty(len(tokens), np.uint8)
        weight[order] = np.repeat(np.minimum(255, np.floor(4 * np.log2(total))).astype(np.uint8), np.diff(np.append(edge, len(tokens))))
        out += [(block, bucket, TOKENS, squeeze(weight[at[i] : at[i + 1]])) for i, (block, _) in enumerate(asked[TOKENS])]
        del tokens, held, order, weight
    parts = [unsqueeze(blob, np.uint64, np.uint64, np.int64) for _, blob in asked[SETS]]
    if parts:
        at = starts_of(np.array([len(p[0]) for p in parts]))
        high, low, docs = (np.concatenate([p[c] for p in parts]) for c in (0, 1, 2))
        order = np.lexsort((docs, low, high))
        new = np.concatenate([[True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
        least = np.empty(len(docs), np.int64)
        least[order] = docs[order[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        out += [(block, bucket, SETS, squeeze(least[at[i] : at[i + 1]])) for i, (block, _) in enumerate(asked[SETS])]
    release()
    return _table(out)


def _answered(answers: list[tuple[int, bytes]], kind, n: int) -> np.ndarray:
    """A block's answers in the order of its questions."""
    parts = [unsqueeze(blob, kind)[0] for _, blob in sorted(answers)]
    every = np.concatenate(parts) if parts else np.zeros(0, kind)
    if len(every) != n:
        raise RuntimeError("a block's questions were not all answered")
    return every


def entries(own: Block, rows: np.ndarray, tokens: np.ndarray, weight: np.ndarray, per: int, of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, whether as the smaller set) of the shingles that rows can be linked through."""
    size = own.size[rows]
    larger, smaller = size + per * size // -of + 1, size + 2 * per * size // -(of + per) + 1
    sets, row = own.members(rows)
    heavy = weight[np.searchsorted(tokens, sets)]
    shared = heavy > 0
    alone = size - np.bincount(row[shared], minlength=len(rows))
    shared &= (alone < larger)[row]
    sets, row, heavy = sets[shared], row[shared], heavy[shared]
    order = np.lexsort((sets, heavy, row))
    sets, row = sets[order], row[order]
    place = np.arange(len(row)) - starts_of(np.bincount(row, minlength=len(rows)))[row] + alone[row]
    early = place < larger[row]
    return rows[row[early]], sets[early], (place < smaller[row])[early]


def _local_regions(row: np.ndarray, token: np.ndarray, joins: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches through shingles that join."""
    label = np.arange(int(row.max()) + 1 if len(row) else 0)
    row, token = row[joins[token]], token[joins[token]]
    while len(row):
        of_token = np.full(int(token.max()) + 1, len(label))
        np.minimum.at(of_token, token, label[row])
        new = label.copy()
        np.minimum.at(new, row, of_token[token])
        if (new == label).all():
            break
        label = new
    return label


def _enter(n: int, shingle: int, per: int, of: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        """One block: its sizes and equal sets, and the shingles through which its speakers can be linked."""
        out = []
        told = _by_kind(answers)
        for key, blob in _by_kind(own)[OWN]:
            packed = from_blob(blob)
            block = Block(numbers(packed, "ids"), packed.column("texts"), shingle)
            tokens = np.unique(block.members(block.speakers)[0])
            weight = _answered(told[TOKENS], np.uint8, len(tokens))
            least = _answered(told[SETS], np.int64, len(block.speakers))
            ids = block.ids
            full = np.flatnonzero(block.speaker_of >= 0)
            same = np.stack([ids[full], least[block.speaker_of[full]]], axis=1)
            same = np.unique(same[same[:, 0] != same[:, 1]], axis=0)
            # Rows in the order of their ids, so that the smallest row of a region is its smallest id.
            rows = block.speakers[least == ids[block.speakers]]
            rows = rows[np.argsort(ids[rows], kind="stable")]
            row, held, smaller = entries(block, rows, tokens, weight, per, of)
            known, token = np.unique(held, return_inverse=True)
            joins = np.bincount(token[smaller], minlength=len(known)) > 0
            place = np.empty(len(ids), np.int64)
            place[rows] = np.arange(len(rows))
            number = place[row]
            label = _local_regions(number, token, joins)
            near = np.stack([ids[rows[: len(label)]], ids[rows[label]]], axis=1) if len(label) else np.zeros((0, 2), np.int64)
            near = near[near[:, 0] != near[:, 1]]
            found = [np.stack([np.full(len(ids), META), ids, block.size], axis=1)] + [np.concatenate([np.full((len(x), 1), kind), x], axis=1) for kind, x in ((SAME, same), (NEAR, near))]
            found = np.concatenate(found)
            out.append((key % n, key, FOUND, squeeze(found[:, 0].astype(np.int8), found[:, 1], found[:, 2])))
            asks = np.unique(np.stack([token, label[number] if len(number) else number], axis=1), axis=0)
            at = by_range(known[asks[:, 0]], n)
            sent = known[asks[:, 0]], ids[rows[asks[:, 1]]], joins[asks[:, 0]].astype(np.uint8)
            out += [(b, key, TOKENS, squeeze(*[c[at[b] : at[b + 1]] for c in sent])) for b in range(n) if at[b] < at[b + 1]]
        release()
        return _table(out)
    return run


def _meet(rows: pa.Table) -> pa.Table:
    """One bucket: sets of all blocks that meet in a shingle, at least one as the smaller, are linked with the smallest of them."""
    asked = _by_kind(rows)
    found = [np.stack([c.astype(np.int64) for c in unsqueeze(blob, np.int8, np.int64, np.int64)], axis=1) for _, blob in asked[FOUND]]
    parts = [unsqueeze(blob, np.uint64, np.int64, np.uint8) for _, blob in asked[TOKENS]]
    if parts:
        token, doc, joins = (np.concatenate([p[c] for p in parts]) for c in (0, 1, 2))
        order = np.lexsort((doc, token))
        token, doc = token[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(edge, len(token)))
        joins = np.repeat(np.maximum.reduceat(joins[order], edge) > 0, length)
        centre = np.repeat(doc[edge], length)
        links = np.unique(np.stack([doc, centre], axis=1)[joins & (doc != centre)], axis=0)
        found.append(np.concatenate([np.full((len(links), 1), NEAR), links], axis=1))
    every = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    release()
    return pa.table({"kind": pa.array(every[:, 0].astype(np.int32)), "u": pa.array(every[:, 1]), "v": pa.array(every[:, 2])})


def _overlap(sets: np.ndarray, first: np.ndarray):
    """A function from a document to the sizes of its intersections with all, through an inverted list of the region."""
    by = np.argsort(sets).astype(np.int32)
    new = np.concatenate([[True], sets[by][1:] != sets[by][:-1]]) if len(sets) else np.zeros(0, bool)
    ids = np.empty(len(sets), np.int32)
    ids[by] = np.cumsum(new, dtype=np.int32) - 1
    holder = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))[by]
    border = np.append(np.flatnonzero(new), len(sets))
    del by, new

    def of(i: int) -> np.ndarray:
        own = ids[first[i] : first[i + 1]]
        length = border[own + 1] - border[own]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(border[own] - (ends - length), length)
        return np.bincount(holder[at], minlength=len(first) - 1)
    return of


def region_links(docs: np.ndarray, sets: np.ndarray, first: np.ndarray, home: np.ndarray, ball: np.ndarray, per: int = PER, of: int = OF) -> list[tuple[int, int]]:
    """Links that connect what is connected in one part; what `ball` marks is known to be connected.

    Documents at home are pivots in turn. A pivot is compared only if some document of another component lies within the
    window that the distances to the pivots before it leave: |d(x, p) - d(y, p)| <= 1 - similarity. A component that holds
    much of the part needs no pivots of its own if all documents outside of it, guests too, are compared with it.
    """
    size = np.diff(first)
    overlap = _overlap(sets, first)
    group = np.arange(len(docs))
    core = -1  # a document of that component
    if ball.any():
        core = int(np.flatnonzero(ball)[0])
        group[ball] = core
    window = (of - per) / of + 1e-9
    seen: list[np.ndarray] = []
    out = []
    for i in [*np.flatnonzero(home).tolist(), *np.flatnonzero(~home).tolist()]:
        if not home[i] and core < 0:
            break
        if core >= 0 and group[i] == group[core]:
            continue
        open_ = (group != group[i]) & (size * of >= size[i] * per) & (size[i] * of >= size * per)
        for far in seen:
            open_ &= np.abs(far - far[i]) <= window
        if not open_.any():
            continue
        common = overlap(i)
        union = size + size[i] - common
        for j in np.flatnonzero(open_ & (of * common >= per * union) & (common > 0)).tolist():
            if group[j] != group[i]:
                out.append((int(docs[i]), int(docs[j])))
                group[group == group[j]] = group[i]
        if len(seen) < 8:
            seen.append(1 - common / np.maximum(union, 1))
            if len(seen) == 8 and core < 0:
                count = np.bincount(group)
                if 4 * count.max() >= len(docs):
                    core = int(np.flatnonzero(group == count.argmax())[0])
    return out


def _join_region(shingle: int, per: int, of: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        flag = {c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)[order].astype(bool) for c in ("home", "ball")}
        sets, first = shingle_sets(rows["text"].combine_chunks().fill_null("").take(pa.array(order)), shingle)
        found = region_links(ids[order], sets, first, flag["home"], flag["ball"], per, of)
        del sets
        if len(ids) > 200:
            release()
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})
    return run


_MEMBER = "doc_id long, text string, size long, region long"
_PARTED = _MEMBER + ", was_home boolean, part int, own boolean, near array<int>, linked array<long>"
_TASK = ["doc_id", "text", "size", "region", "part", "home", "ball"]


def _to_pivots(shingle: int, per: int, of: int):
    """Some documents of one region: each in the part of its nearest pivot, and a guest wherever the distance is within twice the greatest one of that."""
    def run(members: pa.Table, chosen: pa.Table) -> pa.Table:
        reach = 2 * (of - per) / of + 1e-9
        pivots = chosen["pivots"][0].as_py() if chosen.num_rows and members.num_rows else []
        pivot_ids = [NULL_ID if p["doc_id"] is None else p["doc_id"] for p in pivots]
        held, at = shingle_sets(pa.array([p["text"] for p in pivots], pa.string()), shingle)
        sets, first = shingle_sets(members["text"].combine_chunks().fill_null(""), shingle)
        size = np.diff(first)
        border = starts_of(size)
        common = np.zeros((len(pivots), len(size)), np.int64)
        for k in range(len(pivots)):
            own = held[at[k] : at[k + 1]]
            hit = np.append(0, np.cumsum(own[np.minimum(np.searchsorted(own, sets), len(own) - 1)] == sets)) if len(own) else np.zeros(len(sets) + 1, np.int64)
            common[k] = hit[border[1:]] - hit[border[:-1]]
        union = np.maximum(np.diff(at)[:, None] + size - common, 1)
        far = 1 - common / union
        linked = of * common >= per * union
        nearest = far.argmin(axis=0) if len(pivots) else np.zeros(len(size), np.int64)
        part, take = np.nonzero(far <= far.min(axis=0) + reach) if len(pivots) else (np.zeros(0, np.int64),) * 2
        own = part == nearest[take]
        rows = members.take(pa.array(take, pa.int64()))
        near = [np.flatnonzero(linked[:, i]).tolist() if o else None for i, o in zip(take.tolist(), own.tolist(), strict=True)]
        return pa.table({c: rows[c] for c in ("doc_id", "text", "size", "region")} | {
            "was_home": rows["home"], "part": pa.array(part.astype(np.int32)), "own": pa.array(own), "near": pa.array(near, pa.list_(pa.int32())),
            "linked": pa.array([None if n is None else [pivot_ids[k] for k in n] for n in near], pa.list_(pa.int64()))})
    return run


def _weight() -> Column:
    return F.col("size") + DOC_SHINGLES


def _measured(rows: DataFrame) -> DataFrame:
    """region, its rows `n` and its weight in shingles."""
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.sum(_weight()).alias("weight"))


def _divide(inside: DataFrame, level: int, rule: tuple[int, int, int]) -> DataFrame:
    """Regions with parts, by pivots of their own: the documents at home with the smallest hashes, a hash for each pivot."""
    best = [F.min_by(F.struct("doc_id", "text"), F.xxhash64("doc_id", "text", F.lit(level * PIVOTS + j))) for j in range(PIVOTS)]
    pivots = inside.where("home").groupBy("region", "shares").agg(F.array_distinct(F.array(*best)).alias("pivots"))
    pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "pivots").toDF("region", "share", "pivots")
    # Members are dealt out over as many shares as there are bounds in the region, so no task holds a whole region.
    shares = inside.select("doc_id", "text", "size", "region", "home", F.pmod(F.xxhash64("doc_id", "text", F.lit(-1 - level)), F.col("shares")).cast("int").alias("share"))
    # Rows come dealt by region; a task of its own for each share needs them dealt anew.
    shares = shares.repartition("region", "share")
    return shares.groupBy("region", "share").cogroup(pivots.groupBy("region", "share")).applyInArrow(_to_pivots(*rule), _PARTED)


def _pair_blocks(members: DataFrame) -> DataFrame:
    """Regions that pivots do not divide, without the ball around the pivot that most are linked with: blocks of half the bound meet in pairs, two of the ball never."""
    most = members.select("region", F.explode("near").alias("pivot")).groupBy("region", "pivot").count()
    most = most.groupBy("region").agg(F.max_by("pivot", "count").alias("pivot"))
    placed = members.join(most.hint("merge"), "region", "left").withColumn("ball", F.coalesce(F.array_contains("near", F.col("pivot")), F.lit(False)))
    placed = checkpointed(placed.select("doc_id", "text", "size", "region", F.col("was_home").alias("home"), "ball"))
    count = lambda ball: F.ceil(2 * F.coalesce(F.sum(F.when(F.col("ball") == ball, _weight())), F.lit(0)) / PART_SHINGLES).cast("int")
    blocks_ = placed.groupBy("region").agg(count(False).alias("outside"), count(True).alias("inside"))
    dealt = placed.join(blocks_.hint("merge"), "region").withColumn("h", F.xxhash64("doc_id", "text", F.lit(-7)))
    dealt = dealt.withColumn("mine", F.when(F.col("ball"), F.col("outside") + F.pmod("h", F.greatest("inside", F.lit(1)))).otherwise(F.pmod("h", F.greatest("outside", F.lit(1)))).cast("int"))
    every = F.col("outside") + F.col("inside")
    others = F.filter(F.sequence(F.lit(0), every - 1), lambda b: (b != F.col("mine")) & (~F.col("ball") | (b < F.col("outside"))))
    met = dealt.withColumn("other", F.explode(others))
    return met.withColumn("part", (F.least("mine", "other") * every + F.greatest("mine", "other")).cast("int")).select(_TASK)


def bounded_regions(held: DataFrame, rule: tuple[int, int, int] = (SHINGLE, PER, OF)) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (doc_id, text, size, region, home) of regions, dealt into parts that a task can hold, and the links found on the way.

    A region within the bound is one part. Others are divided by pivots, and so are parts of theirs, until all are within
    the bound. A division that doubles the rows, or leaves a part over half of its region, is given up for pairs of blocks;
    others at least halve a region, so the rounds end.
    """
    done, links, level = [], [], 0
    while True:
        size = checkpointed(_measured(held))
        whole = size.where(F.col("weight") <= PART_SHINGLES)
        task = lambda df: df.withColumn("part", F.lit(0)).withColumn("ball", F.lit(False)).select(_TASK)
        done.append(task(held.join(whole.select("region").hint("merge"), "region", "left_semi")))
        large = size.where(F.col("weight") > PART_SHINGLES).withColumn("shares", F.ceil(F.col("weight") / PART_SHINGLES).cast("int"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done), links
        parted = checkpointed(_divide(held.join(large.hint("merge"), "region"), level, rule))
        links.append(parted.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("u"), F.explode("linked").alias("v")).where("u != v"))
        each = parted.groupBy("region", "part").agg(F.count("*").alias("k"))
        judged = each.groupBy("region").agg(F.sum("k").alias("total"), F.max("k").alias("most")).join(large.hint("merge"), "region")
        split = checkpointed(judged.select("region", (F.col("total") <= 2 * F.col("n")) & (2 * F.col("most") <= F.col("n"))).toDF("region", "split"))
        chosen = lambda yes: parted.join(split.where(F.col("split") == yes).select("region").hint("merge"), "region", "left_semi")  # noqa: E731, B023
        if not split.where("NOT split").isEmpty():
            done.append(_pair_blocks(chosen(False).where("own")))
        held = checkpointed(chosen(True).select("doc_id", "text", "size", F.xxhash64("region", "part").alias("region"), (F.col("own") & F.col("was_home")).alias("home")))
        level += 1


def regions(found: DataFrame) -> DataFrame:
    """node and region of every set that can be linked at all; no link leaves a region."""
    coarse = components(found.where(F.col("kind") == NEAR).select("u", "v"))
    return coarse.select(F.col("u").alias("node"), F.col("v").alias("region")).unionByName(coarse.select(F.col("v").alias("node"), F.col("v").alias("region")).distinct())


def _exact_links(docs: DataFrame, found: DataFrame, rule: tuple[int, int, int]) -> DataFrame:
    """Links (u, v) between different sets, from the regions outside of which there are none."""
    sizes = found.where(F.col("kind") == META).groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("size"))
    nodes = checkpointed(regions(found).join(sizes.hint("merge"), "node"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("node", F.coalesce("doc_id", F.lit(NULL_ID)))
    held = read.join(nodes.hint("merge"), "node").dropDuplicates(["node", "text"]).select("doc_id", "text", "size", "region", F.lit(True).alias("home"))
    dealt, links = bounded_regions(checkpointed(held), rule)
    # Rows come dealt by region; a task of its own for each part needs them dealt anew.
    joined = dealt.repartition("region", "part").groupBy("region", "part").applyInArrow(_join_region(*rule), "u long, v long")
    return reduce(DataFrame.unionByName, [joined, *links])


def coarse_links(docs: DataFrame, shingle: int, per: int, of: int) -> DataFrame:
    """(kind, u, v): META rows with a document's set size, SAME links of equal sets, NEAR links of what may be linked."""
    n = buckets_for(docs, BUCKET_BYTES)
    sent = small_batches(docs).select("doc_id", "text").mapInArrow(_send_sets(n, shingle), _SENT).repartition("k")
    answers = sent.groupBy("k").applyInArrow(_weigh, _SENT)
    entered = sent.groupBy("k").cogroup(answers.groupBy("k")).applyInArrow(_enter(n, shingle, per, of), _SENT)
    return checkpointed(entered.groupBy("k").applyInArrow(_meet, "kind int, u long, v long"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, per: int = PER, of: int = OF) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach), one row per row of `docs`.

    Sets of shingles of `shingle` words are linked from a similarity of per / of on, which lies between 0 and 1.
    """
    found = coarse_links(docs, shingle, per, of)
    links = found.where(F.col("kind") == SAME).select("u", "v").unionByName(_exact_links(docs, found, (shingle, per, of)))
    label = checkpointed(components(links).select("u", F.col("v").alias("component_id")))
    sizes = found.where(F.col("kind") == META).select("u", F.col("v").alias("n_shingles"))
    out = sizes.join(label.hint("merge"), "u", "left").withColumn("component_id", F.coalesce("component_id", "u"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("u").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, per: int = PER, of: int = OF) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, with all their columns."""
    others = jaccard_components(docs, shingle, per, of).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__other_copy")).distinct()
    return docs.join(others.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("__other_copy")), "left_anti")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 2)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), least_ids AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least_ids LEFT JOIN sizes USING (doc_id)
"""
