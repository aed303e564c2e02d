"""Byte-level BPE over the distinct words of the corpus, and back.

Texts are split into pre-tokens once. Each block of texts keeps its pre-tokens as positions in its own list of distinct
words and sends that list, divided by hash, to buckets. A bucket encodes each distinct word once for all blocks and
answers every block with the ids of its words (there are as many buckets as the counted bytes of text need); blocks put them back by position. Decoding looks ids up in the table of
token bytes, which the vocabulary bounds. A word is sent once per block however often it occurs, so frequent words are no
hot keys.

Defined results: a null text is empty and has no tokens; a null doc_id stays null; equal rows each keep a row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BLOCK_BIT, binary_batch, blocks, from_blob, from_parts, hash_spans, numbers, ragged, release, starts_of, string_parts, to_blob
from .runtime import NULL_ID, buckets_for, small_batches, table

BLOCK_BYTES = 12 << 20
#: Bytes of text whose distinct words one bucket encodes.
BUCKET_BYTES = 64 << 20
EMIT = "k long, block long, blob binary"
ENCODED = "doc_id long, ids array<int>, decoded binary"


def vocabulary(path: str) -> list[tuple[bytes, int]]:
    """(token bytes, rank) of a rank file."""
    with open(path, "rb") as f:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, f) if token]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(vocabulary(path)), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, by id, and where each begins."""
    ranks = vocabulary(path)
    by_id = [b""] * (max(r for _, r in ranks) + 1)
    for token, rank in ranks:
        by_id[rank] = token
    return np.frombuffer(b"".join(by_id), np.uint8), starts_of(np.array([len(t) for t in by_id], np.int64))


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, which is what the rank files' library takes."""
    out, inside = [], False
    for part in regex.split(r"(\\.|[\[\]])", pattern):
        inside = {"[": True, "]": False}.get(part, inside)
        out.append({r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}"}.get(part, part))
    return regex.compile("".join(out))


class _Codes(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _split(n_buckets: int, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern).findall
        for key, ids, texts in blocks(batches, BLOCK_BYTES):
            codes = _Codes()
            number = codes.__getitem__
            per_text, counts = [], np.empty(len(ids), np.int64)
            for i, text in enumerate(texts):
                words = find(text.as_py())
                counts[i] = len(words)
                per_text.append(np.fromiter(map(number, words), np.int32, len(words)))
            data, offsets = string_parts(pa.array(list(codes), pa.large_string()))
            del codes
            bucket = (hash_spans(data, offsets[:-1], offsets[1:]) % np.uint64(n_buckets)).astype(np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            # Words are renumbered by (bucket, first use), so that the answers need no numbers.
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            flat = place[np.concatenate(per_text)] if per_text else np.zeros(0, np.int32)
            rows = [(key, -1, to_blob({"ids": ids, "counts": counts})), (key, -2, to_blob({"codes": flat}))]
            for b in range(n_buckets):
                words = order[at[b] : at[b + 1]]
                if len(words):
                    first, lengths = offsets[words], offsets[words + 1] - offsets[words]
                    rows.append((b, key, to_blob({"words": from_parts(data[ragged(first, lengths)], starts_of(lengths))})))
            del texts, per_text, flat, place, order, data, offsets
            yield binary_batch(rows)
    return run


def _encode(path: str, pattern: str):
    def run(rows: pa.Table) -> pa.Table:
        """One bucket: every distinct word once, then an answer to each block that asked."""
        if not rows.num_rows or rows["k"][0].as_py() >= BLOCK_BIT:
            return pa.Table.from_batches([], schema=binary_batch([], ("k", "part", "blob")).schema)
        encode = _encoder(path, pattern)._encode_single_piece
        known: dict[str, list[int]] = {}
        out, bucket = [], rows["k"][0].as_py()
        for block, blob in zip(rows["block"].to_pylist(), rows["blob"], strict=True):
            found = []
            for word in from_blob(blob.as_buffer()).column("words").to_pylist():
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode(word)
                found.append(ids)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((t for ids in found for t in ids), np.int32, int(lengths.sum()))
            out.append((block, bucket, to_blob({"n": lengths.astype(np.int32)})))
            out.append((block, bucket + BLOCK_BIT, to_blob({"t": flat})))
        del known, found
        release()
        return pa.Table.from_batches([binary_batch(out, ("k", "part", "blob"))])
    return run


def _assemble(path: str, digests: bool):
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _rows(path, own, answers, digests) if own.num_rows and own["k"][0].as_py() >= BLOCK_BIT else []
        names, types = (("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), (pa.int64(), pa.int64(), pa.string(), pa.string())) if digests else (("doc_id", "ids", "decoded"), (pa.int64(), pa.list_(pa.int32()), pa.binary()))
        schema = pa.schema(list(zip(names, types, strict=True)))
        out = []
        for at in range(0, len(rows), 500):  # small batches on their way to the JVM
            cols = zip(*rows[at : at + 500], strict=True)
            out.append(pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema))
            rows[at : at + 500] = [None] * len(rows[at : at + 500])
        release()
        return pa.Table.from_batches(out, schema=schema)
    return run


def _rows(path: str, own: pa.Table, answers: pa.Table, digests: bool) -> list[tuple]:
    """Texts of one block: ids by position, and the bytes that they stand for."""
    by_part = dict(zip(answers["part"].to_pylist(), answers["blob"], strict=True))
    parts = sorted(p for p in by_part if p < BLOCK_BIT)
    lengths = np.concatenate([numbers(from_blob(by_part[p].as_buffer()), "n") for p in parts] or [np.zeros(0, np.int32)]).astype(np.int64)
    tokens = np.concatenate([numbers(from_blob(by_part[p + BLOCK_BIT].as_buffer()), "t") for p in parts] or [np.zeros(0, np.int32)])
    first = starts_of(lengths)
    data, at = _token_bytes(path)
    out = []
    heads = [b for n, b in zip(own["block"].to_pylist(), own["blob"], strict=True) if n == -1]
    tails = [b for n, b in zip(own["block"].to_pylist(), own["blob"], strict=True) if n == -2]
    for head, tail in zip(heads, tails, strict=True):  # blocks with equal ids and lengths share a key
        meta, codes = from_blob(head.as_buffer()), numbers(from_blob(tail.as_buffer()), "codes")
        if len(codes) and codes.max() >= len(lengths):
            raise RuntimeError("a block's words were not all answered")
        ends = starts_of(numbers(meta, "counts"))
        for i, doc_id in enumerate(numbers(meta, "ids").tolist()):
            words = codes[ends[i] : ends[i + 1]]
            ids = tokens[ragged(first[words], lengths[words])]
            decoded = data[ragged(at[ids], at[ids + 1] - at[ids])]
            doc_id = None if doc_id == NULL_ID else doc_id
            out.append((doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.tobytes()).hexdigest()) if digests else (doc_id, ids, decoded.tobytes()))
    return out


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, ids and decoded bytes of each row; with `digests` their count and SHA-256 instead, which spares the way back."""
    n = buckets_for(docs, BUCKET_BYTES)
    sent = small_batches(docs).select("doc_id", "text").mapInArrow(_split(n, pattern), EMIT).repartition("k")
    answers = sent.groupBy("k").applyInArrow(_encode(path, pattern), "k long, part long, blob binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED
    return sent.groupBy("k").cogroup(answers.groupBy("k")).applyInArrow(_assemble(path, digests), schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
