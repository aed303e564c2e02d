"""Arrow and numpy helpers that run inside tasks: packed text blocks, word spans, hashes, ragged gathers.

A *block* is a memory-sized run of rows (doc_id, text) of one partition, held as one compressed Arrow stream in a binary
column. Its key is its place: partition and number, so a task that runs again produces the same keys. Blocks pre-aggregate
what they send: a key that a third of all rows hold leaves each block once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

from .runtime import NULL_ID

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  glibc only
except (OSError, AttributeError):
    _libc = None

#: Keys of blocks have this bit, those of buckets are small.
BLOCK_BIT = 1 << 62

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
BYTE_CODES = np.random.default_rng(20_011).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """(key, ids, texts) of runs of rows with about `size` bytes of text; a null text is empty, a null id NULL_ID."""
    held_ids: list[pa.Array] = []
    held_texts: list[pa.Array] = []
    weight = 0

    context = TaskContext.get()
    first_key = BLOCK_BIT | (context.partitionId() if context else 0) << 28
    done = 0

    def flush():
        nonlocal done
        ids = pa.concat_arrays(held_ids).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
        done += 1
        return first_key + done, ids, pa.concat_arrays(held_texts)

    for batch in batches:
        texts = batch.column("text").fill_null("")
        ids = batch.column("doc_id")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < len(texts):
            room = size - weight
            before = int(ends[start - 1]) if start else 0
            stop = min(len(texts), int(np.searchsorted(ends, before + max(room, 1), side="left")) + 1)
            held_ids.append(ids.slice(start, stop - start))
            held_texts.append(texts.slice(start, stop - start))
            weight += int(ends[stop - 1]) - before
            start = stop
            if weight >= size:
                yield flush()
                held_ids, held_texts, weight = [], [], 0
        del batch, texts, ids
    if held_ids:
        yield flush()
    held_ids, held_texts = [], []
    release()


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def pieces(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with about `size` bytes in a string column, so that what is worked out beside them stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = min(batch.num_rows, int(np.searchsorted(ends, before + size, side="left")) + 1)
        yield batch.slice(start, stop - start)
        start = stop
    release()


def to_blob(columns: dict[str, pa.Array | np.ndarray]) -> bytes:
    """Columns of equal length as one compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def from_blob(blob) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_next_batch()


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes, byte plane by byte plane: far less than an Arrow stream where rows are few."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueeze(blob: bytes, *types) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    widths = [np.dtype(t).itemsize for t in types]
    n, at, out = size // sum(widths), 0, []
    for t, w in zip(types, widths, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(t).reshape(n))
        at += n * w
    return out


def by_range(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Borders of n equal ranges of 64-bit hashes in sorted hashes: range b holds [out[b], out[b + 1])."""
    edges = np.array([(b << 64) // n for b in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]]).astype(np.int64)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def binary_batch(rows: list[tuple], names: tuple[str, ...] = ("k", "block", "blob")) -> pa.RecordBatch:
    """Rows of two long keys and a blob."""
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "blob" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=list(names))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... lengths[i] of them, for every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - lengths), lengths)


def join_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """Strings of count[i] words from first[i] on, for every i, each word followed by a space."""
    words = ragged(first, count)
    size = end[words] - start[words] + 1
    ends = starts_of(size)
    out = np.full(int(ends[-1]), 32, np.uint8)
    out[ragged(ends[:-1], size - 1)] = data[ragged(start[words], size - 1)]
    return from_parts(out, ends[starts_of(count)])


def string_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets from 0."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, np.int64))


def from_parts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes of words: 0-9, a-z and everything beyond ASCII; A-Z fold to a-z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of maximal runs of bytes that `inside` marks, texts apart; text i has words first[i]:first[i + 1]."""
    flag = inside[data]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    if len(flag) and flag[-1]:
        edge = np.concatenate([edge, [len(flag)]])
    start, end = edge[0::2], edge[1::2]
    # A run that reaches over the border of two texts is cut there.
    inner = offsets[1:-1]
    at = np.searchsorted(start, inner, side="left") - 1
    cut = np.unique(inner[(at >= 0) & (end[at] > inner) & (start[at] < inner)]) if len(start) and len(inner) else inner[:0]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets, side="left")


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, ~_SPACE)


def alnum_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(data, offsets, _ALNUM)


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd constant modulo 2**64, n of them."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 4096), _ODD)
        grown[0] = 1
        _powers = np.cumprod(grown)
    return _powers[:n]


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order, apart and not empty."""
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), step):
        s, e = start[a : a + step], end[a : a + step]
        lengths = e - s
        at = ragged(s, lengths)
        place = at - np.repeat(s, lengths)
        value = BYTE_CODES[data[at]] * powers(int(lengths.max()))[place]
        out[a : a + step] = mix(np.add.reduceat(value, starts_of(lengths)[:-1]) + lengths.astype(np.uint64))
    return out


def hash_windows(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words, by word of begin; runs may reach over texts, callers drop those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(words[:n])
    for j in range(1, k):
        out += words[j : j + n] * powers(k + 1)[j]
    return mix(out)


def sliding(x: np.ndarray, w: int, best=np.minimum) -> np.ndarray:
    """best of x[i : i + w] for every i, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out
