"""Substring dedup: every word in a window of `WINDOW` words that also starts earlier in the corpus is removed.

Suffixes (one per word) are split by prefixes of variable length. A suffix's prefix reaches to the end of the
content-defined anchor in its first window: of the `PREFIX`-word runs in it the one with the smallest hash, so prefixes are
`PREFIX` to `WINDOW` words long. Anchors are counted first. Suffixes whose anchor occurs in one place are leaves that
nothing repeats. All others are grouped by anchor; where the counted suffixes of an anchor are over the byte bound, its
group is divided by whole prefixes, and beyond that by the whole window. Each group's suffixes meet in one task with their
words: sorted by words (a suffix array, ties by place) with the lengths of common prefixes between neighbours, which is the
group's suffix tree. Its internal nodes of at least `WINDOW` words are the repeats; all leaves below one but the earliest
start a repeated window, and neighbouring windows merge into the maximal repeats.

Texts travel once, in compressed blocks. A block sends an anchor or a window once however often it holds it, so a passage
in a third of all texts reaches a task once per block; answers name positions within the block. Hashes only choose groups
and buckets (as many as the counted bytes of text need): whether windows are equal is decided by their words.

Defined results: a null text has no words; a null doc_id sorts before all others and stays null; rows with equal doc_id
are one place in the order, so neither of two windows with equal doc_id and start is the earlier; texts shorter than a
window lose nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLOCK_BIT, U64, binary_batch, blocks, from_blob, from_parts, hash_spans, hash_windows, join_words, mix, numbers, ragged, release, sliding, space_words, squeeze, starts_of, string_parts, to_blob, unsqueeze
from .runtime import NULL_ID, buckets_for, small_batches, table

WINDOW, PREFIX = 20, 10
BLOCK_BYTES = 8 << 20
#: Bytes of text whose anchors and suffixes one bucket holds.
BUCKET_BYTES = 16 << 20
#: Bytes of suffixes that one group may hold, and what the suffixes of one place of an anchor take.
GROUP_BYTES, PLACE_BYTES = 4 << 20, 200
ANSWER = ("k", "part", "blob")
LINKED = "k long, part long, blob binary"


class Words:
    """Words of one block, its rows by doc_id: hashes, row borders, and which words begin a window."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, hashed: bool = True) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.data, offsets = string_parts(texts.take(pa.array(order)))
        self.start, self.end, self.first = space_words(self.data, offsets)
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.first))
        if hashed:
            self.hash = hash_spans(self.data, self.start, self.end)
            n = max(0, len(self.hash) - window + 1)
            self.begins = self.row[:n] == self.row[window - 1 :] if n else np.zeros(0, bool)

    def prefixes(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each short prefix, and for each window the smallest one in it (0 where no window begins)."""
        short = hash_windows(self.hash, prefix)
        least = sliding(short, window - prefix + 1)[: len(self.begins)] if len(self.begins) else np.zeros(0, np.uint64)
        return short, np.where(self.begins, least, U64(0))

    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        lengths = self.end - self.start
        return from_parts(self.data[ragged(self.start, lengths)], starts_of(lengths)).dictionary_encode().indices.to_numpy()

    def anchors(self, window: int, prefix: int) -> np.ndarray:
        """Hashes of the prefixes that are smallest in some window, once per place."""
        short, least = self.prefixes(window, prefix)
        if not len(least):
            return least
        width = window - prefix
        padded = np.concatenate([np.zeros(width, np.uint64), least, np.zeros(len(short) - len(least), np.uint64)])
        best = sliding(padded, width + 1, np.maximum)
        return short[(best == short) & (best > 0)]


def _bucketed(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by bucket, and where each bucket begins."""
    bucket = (keys >> U64(20)) % U64(n)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _send_prefixes(n: int, window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, texts in blocks(batches, BLOCK_BYTES):
            found, count = np.unique(Words(ids, texts, window).anchors(window, prefix), return_counts=True)
            rows = [(key, -1, to_blob({"ids": ids, "texts": texts}))]
            order, at = _bucketed(found, n)
            rows += [(b, key, squeeze(found[order[at[b] : at[b + 1]]], count[order[at[b] : at[b + 1]]].astype(np.uint32))) for b in range(n) if at[b] < at[b + 1]]
            yield binary_batch(rows)
    return run


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([binary_batch(rows, ANSWER)])


def _repeated_prefixes(window: int, prefix: int, group_bytes: int):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket: anchors in two places or more and how long the prefixes of their groups must be, told to each block that holds them.

        Length 0 is the anchor alone, 1 the prefix that ends with it (which divides by the anchor's place in the window), 2 the whole window.
        """
        if not rows.num_rows or rows["k"][0].as_py() >= BLOCK_BIT:
            return _answers([])
        parts = [unsqueeze(b.as_py(), np.uint64, np.uint32) for b in rows["blob"]]
        anchor, places = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
        order = np.argsort(anchor, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
        total = np.empty(len(anchor), np.int64)
        total[order] = np.repeat(np.add.reduceat(places[order].astype(np.int64), edge), np.diff(np.append(edge, len(order))))
        weight = total * PLACE_BYTES
        length = (weight > group_bytes).astype(np.uint8) + (weight > group_bytes * (window - prefix + 1))
        at = starts_of(np.array([len(p[0]) for p in parts], np.int64))
        bucket, out = rows["k"][0].as_py(), []
        for i, block in enumerate(rows["block"].to_pylist()):
            mine = slice(at[i], at[i + 1])
            hit = total[mine] > 1
            if hit.any():
                out.append((block, bucket, squeeze(anchor[mine][hit], length[mine][hit].astype(np.uint8))))
        return _answers(out)
    return run


def _is_block(own: pa.Table) -> bool:
    return own.num_rows > 0 and own["k"][0].as_py() >= BLOCK_BIT


def equal_windows(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of words that begins at `at`, equal for equal words; hashes only bring candidates together."""
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]) if len(at) else np.zeros(0, bool)
    head = at[order[np.flatnonzero(new)[np.cumsum(new) - 1]]] if len(at) else at
    if not all((codes[at[order] + j] == codes[head + j]).all() for j in range(window)):
        return np.unique(np.stack([codes[at + j] for j in range(window)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def group_keys(words: Words, at: np.ndarray, anchor: np.ndarray, length: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The group of each suffix: its anchor, its whole prefix or its whole window, as `length` says."""
    key = anchor.copy()
    longer = np.flatnonzero(length)
    if len(longer):
        begin = at[longer]
        short = hash_windows(words.hash, prefix)
        place = np.full(len(longer), -1)
        for o in range(window - prefix + 1):
            place[(place < 0) & (short[begin + o] == anchor[longer])] = o
        reach = np.where(length[longer] == 1, place + prefix, window)
        h = np.zeros(len(longer), np.uint64)
        for j in range(window):
            h = np.where(j < reach, mix(h * U64(0x9E3779B97F4A7C15) + words.hash[begin + j]), h)
        key[longer] = h
    return key


def _send_suffixes(n: int, window: int, prefix: int):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        """One block: the words of its suffixes under repeated anchors, each window once with its earliest place; local repeats as marks."""
        if not _is_block(own) or not answers.num_rows:
            return pa.Table.from_batches([binary_batch([])])
        told = [unsqueeze(b.as_py(), np.uint64, np.uint8) for b in answers["blob"]]
        repeated, length = (np.concatenate([t[c] for t in told]) for c in (0, 1))
        order = np.argsort(repeated)
        repeated, length = repeated[order], length[order]
        block, packed = own["k"][0].as_py(), from_blob(own["blob"][0].as_buffer())
        words = Words(numbers(packed, "ids"), packed.column("texts"), window)
        least = words.prefixes(window, prefix)[1]
        at = np.flatnonzero(words.begins)
        spot = np.minimum(np.searchsorted(repeated, least[at]), len(repeated) - 1)
        held = repeated[spot] == least[at]
        at, length = at[held], length[spot[held]]
        if not len(at):
            return pa.Table.from_batches([binary_batch([])])
        doc, place = words.ids[words.row[at]], at - words.first[words.row[at]]
        group = equal_windows(words.codes(), at, hash_windows(words.hash, window)[at], window)
        # The earliest window of each group; rows come in any order, those of one doc_id too.
        early = np.lexsort((place, doc))
        head = early[np.unique(group[early], return_index=True)[1]][group]
        later = (doc != doc[head]) | (place != place[head])
        rows = []
        if later.any():
            rows.append((block, 0, squeeze(at[later])))
        sent, length = at[~later], length[~later]
        key = group_keys(words, sent, least[sent], length, window, prefix)
        # Neighbouring suffixes of one group travel as one run of words.
        new = np.ones(len(sent), bool)
        new[1:] = (sent[1:] != sent[:-1] + 1) | (key[1:] != key[:-1]) | (length[1:] > 0)
        begin = np.flatnonzero(new)
        starts = np.diff(np.append(begin, len(sent)))
        first, n_words = sent[begin], starts + window - 1
        place, doc = (first - words.first[words.row[first]]).astype(np.int64), words.ids[words.row[first]]
        order, border = _bucketed(key[begin], n)
        for b in range(n):
            pick = order[border[b] : border[b + 1]]
            if len(pick):
                text = join_words(words.data, words.start, words.end, first[pick], n_words[pick])
                rows.append((b, block, to_blob({"at": first[pick], "starts": starts[pick].astype(np.int32), "doc": doc[pick], "place": place[pick], "words": text})))
        release()
        return pa.Table.from_batches([binary_batch(rows)])
    return run


def suffix_array(codes: np.ndarray, at: np.ndarray, window: int, ties: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at `at`, by their first `window` words and then by `ties`, and the words that each shares with the one before."""
    bits = max(1, int(codes.max()).bit_length()) if len(codes) else 1
    each = 63 // bits
    keys = []
    for a in range(0, window, each):
        packed = np.zeros(len(at), np.int64)
        for j in range(a, min(window, a + each)):
            packed = (packed << bits) | codes[at + j]
        keys.append(packed)
    order = np.lexsort((*reversed(ties), *reversed(keys)))
    common = np.zeros(len(at), np.int64)
    same = np.ones(max(0, len(at) - 1), bool)
    for j in range(window):
        word = codes[at[order] + j]
        same &= word[1:] == word[:-1]
        common[1:] += same
    return order, common


def _repeats(window: int):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket's suffix trees: leaves of each internal node of at least a window but the earliest, told to their blocks."""
        if _is_block(rows):  # local repeats pass through
            return _answers([(rows["k"][0].as_py(), part, blob.as_py()) for part, blob in zip(rows["block"].to_pylist(), rows["blob"], strict=True)])
        if not rows.num_rows:
            return _answers([])
        parts = [from_blob(b.as_buffer()) for b in rows["blob"]]
        get = lambda name: np.concatenate([numbers(p, name) for p in parts])
        first, starts, doc, place = get("at"), get("starts").astype(np.int64), get("doc"), get("place")
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        data, offsets = zip(*[string_parts(p.column("words")) for p in parts], strict=True)
        begin, end, _ = space_words(np.concatenate(data), np.zeros(1, np.int64))  # every run ends with a space
        size = end - begin
        codes = from_parts(np.concatenate(data)[ragged(begin, size)], starts_of(size)).dictionary_encode().indices.to_numpy().astype(np.int64)
        del data, offsets, begin, end, size, parts
        run_first = starts_of(starts + window - 1)[:-1]
        step = np.arange(int(starts.sum())) - np.repeat(starts_of(starts)[:-1], starts)
        spread = lambda x: np.repeat(x, starts) + step
        doc, place = np.repeat(doc, starts), spread(place)
        order, common = suffix_array(codes, spread(run_first), window, (doc, place))
        new = common < window
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = np.zeros(len(order), bool)
        later[order] = (doc[order] != doc[head]) | (place[order] != place[head])
        at, owner = spread(first)[later], np.repeat(owner, starts)[later]
        border = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        out = [(block, 1 + rows["k"][0].as_py(), squeeze(at[border[i] : border[i + 1]])) for i, block in enumerate(rows["block"].to_pylist()) if border[i] < border[i + 1]]
        release()
        return _answers(out)
    return run


def _remove(window: int, digests: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    fields += [("kept_sha256", pa.string())] if digests else [("text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        """One block: words outside of all repeated windows, joined by spaces."""
        rows: list[tuple] = []
        marks = [unsqueeze(blob.as_py(), np.int64)[0] for blob in answers["blob"]]
        for blob in own["blob"] if _is_block(own) else ():
            packed = from_blob(blob.as_buffer())
            words = Words(numbers(packed, "ids"), packed.column("texts"), window, hashed=False)
            step = np.zeros(len(words.start) + 1, np.int64)
            for at in marks:
                np.add.at(step, at, 1)
                np.add.at(step, at + window, -1)
            gone = np.cumsum(step[:-1]) > 0
            # Each kept word takes its bytes and a space; a text's last space is left out.
            lengths = np.where(gone, 0, words.end - words.start + 1)
            border = starts_of(lengths)
            out = np.full(int(border[-1]), 32, np.uint8)
            kept = ~gone
            out[ragged(border[:-1][kept], lengths[kept] - 1)] = words.data[ragged(words.start[kept], lengths[kept] - 1)]
            out = out.tobytes()
            removed = np.concatenate([[0], np.cumsum(gone)])
            for i, doc_id in enumerate(words.ids.tolist()):
                a, b = int(words.first[i]), int(words.first[i + 1])
                text = out[border[a] : max(border[a], border[b] - 1)]
                head = (None if doc_id == NULL_ID else doc_id, b - a, int(removed[b] - removed[a]))
                if digests:
                    rows.append((*head, hashlib.sha256(text).hexdigest()))
                else:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
                    rows.append((*head, text.decode(), [{"start": s, "end": e} for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]))
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        return pa.table([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, digests: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and text without repeats, with the removed word spans; with `digests` the text's SHA-256 alone."""
    n = buckets_for(docs, BUCKET_BYTES)
    sent = small_batches(docs).select("doc_id", "text").mapInArrow(_send_prefixes(n, window, prefix), "k long, block long, blob binary").repartition("k")
    repeated = sent.groupBy("k").applyInArrow(_repeated_prefixes(window, prefix, group_bytes), LINKED)
    suffixes = sent.groupBy("k").cogroup(repeated.groupBy("k")).applyInArrow(_send_suffixes(n, window, prefix), "k long, block long, blob binary")
    marks = suffixes.groupBy("k").applyInArrow(_repeats(window), LINKED)
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digests else "text string, removed array<struct<start:bigint,end:bigint>>")
    return sent.groupBy("k").cogroup(marks.groupBy("k")).applyInArrow(_remove(window, digests), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), digests=True)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM words WHERE len(w) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM repeated
), flat AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM words
), kept AS (
  SELECT doc_id, count(*) AS n_kept, sha256(string_agg(word, ' ' ORDER BY j)) AS kept_sha256 FROM flat ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""
