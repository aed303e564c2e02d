"""The k best items of each query by cosine: vectors lie packed in blocks, a block of items meets a block of queries in one matrix product.

Spark deals the blocks out and joins them; a task keeps the best of each query that it has seen, so what it holds and what is
shuffled grow with the queries times k. Products only choose pairs: a pair that may be among the best is scored once more by
plain sums in the order of the components, as `dot` adds them, so results don't depend on how blocks fall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, and queries whose best a task keeps at once.
ROWS, QUERIES = 1000, 10_000
#: Stands for a null id inside packed ids; it sorts before every real one.
NULL_ID = -(2**63)
#: Room for the last bits of a product, far above what sums of another order differ by.
SLACK = 1e-9

_PACKED = "size int, list int, ids binary, vectors binary, norms binary, marks binary"
Mark = Callable[[np.ndarray], np.ndarray]


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of rows; squares are added in the order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * x[:, d]
    return np.sqrt(out)


def _blocks(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, list, ids, vectors, known) of the rows of a batch that have one size and list; `known` is false where a component is null."""
    ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("list").to_numpy(zero_copy_only=False)
    sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = batch.column("embedding").flatten()
    nulls = values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    kinds, which = np.unique(np.stack([sizes, lists], 1), axis=0, return_inverse=True)
    for n, (size, in_list) in enumerate(kinds):
        of_kind = np.flatnonzero(which.reshape(-1) == n)
        for i in range(0, len(of_kind), rows):
            mine = of_kind[i : i + rows]
            at = starts[mine][:, None] + np.arange(size)
            yield int(size), int(in_list), ids[mine].astype(np.int64), flat[at], ~nulls[at].any(axis=1)


def packed(df: DataFrame, mark: Mark | None = None, rows: int = ROWS) -> DataFrame:
    """Blocks of vectors (id, embedding, perhaps list) of one size and list; rows without a vector are in none.

    `mark` makes bytes for each vector, by which a search tells whether two may meet. Vectors of one list make large blocks only
    if rows come in the order of lists.
    """
    list_ = F.col("list").cast("int") if "list" in df.columns else F.lit(0)
    known = df.where(F.col("embedding").isNotNull()).select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("id"), list_.alias("list"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for size, in_list, ids, x, whole in _blocks(batch, rows):
                    row = {"ids": ids, "vectors": x, "norms": np.where(whole, _lengths(x), -1.0), "marks": mark(x) if mark else np.empty(0)}
                    yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "list": pa.array([in_list], pa.int32())} | {c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in row.items()})

    return known.mapInArrow(run, _PACKED)


def _may_be_best(k: int, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may be among a query's k best by the score rounded to six places, then by item; and each query's least such place, times 10^6.

    A score near a half may be rounded either way, so it stands for both. Of equal scores of a query the k smallest items do.
    """
    v = np.where(np.isnan(s), np.inf, s)
    low, high = np.floor(v * 1e6 + (0.5 - 1e-3)), np.floor(v * 1e6 + (0.5 + 1e-3))

    def nth(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(new)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        return out

    by_rank = np.lexsort((i, -low, q))
    place = nth(by_rank, np.append(True, q[by_rank][1:] != q[by_rank][:-1]))
    last = np.flatnonzero(place == k - 1)
    n = int(q.max()) + 1 if len(q) else 0
    least, item = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
    least[q[last]], item[q[last]] = low[last], i[last]
    keep = np.flatnonzero((high > least[q]) | ((high == least[q]) & (i <= item[q])))
    same = np.lexsort((i[keep], v[keep], q[keep]))
    qs, vs = q[keep][same], v[keep][same]
    few = nth(same, np.append(True, (qs[1:] != qs[:-1]) | (vs[1:] != vs[:-1]))[: len(keep)]) < k
    return keep[few], least


def nearest(items: DataFrame, queries: DataFrame, k: int, mark: Mark | None = None, meets: Callable[[int, np.ndarray, np.ndarray], np.ndarray] | None = None, most: int = QUERIES) -> DataFrame:
    """(qid, vec_id, similarity) of pairs that may be among a query's k best, some more than those; null where a component is null.

    Packed items meet the queries (id, embedding), which are packed and broadcast, about `most` at once. `meets` (list, marks of
    the items, marks of the queries) gives the pairs that may be scored, queries by items; without it all are.
    """
    n = queries.count()
    times = max(1, -(-n // most))
    out = None
    for t in range(times):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(times)) == t) if times > 1 else queries
        found = _nearest(items, packed(part.repartition(max(1, -(-n // times // ROWS))), mark), k, meets)
        out = found if out is None else out.unionByName(found)
    score = F.when(F.col("s") != float("-inf"), F.col("s"))
    return out.select(*[F.nullif(F.col(c), F.lit(NULL_ID)).alias(c) for c in ("qid", "vec_id")], F.round(score, 6).alias("similarity"))


def _nearest(items: DataFrame, queries: DataFrame, k: int, meets: Callable | None) -> DataFrame:
    """The pairs of `nearest` with scores that are not rounded, for one broadcast of packed queries."""
    both = items.join(F.broadcast(queries.select("size", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "norms", "marks")])), "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        bars: dict[tuple[int, bytes], np.ndarray] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                r = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                key, size = (r["size"], r["q_ids"]), r["size"]
                ids, norm, q_norm = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["norms"]), np.frombuffer(r["q_norms"])
                x, y = np.frombuffer(r["vectors"]).reshape(len(norm), size), np.frombuffer(r["q_vectors"]).reshape(len(q_norm), size)
                may = None
                if meets:
                    may = meets(r["list"], np.frombuffer(r["marks"], np.uint8).reshape(len(norm), -1), np.frombuffer(r["q_marks"], np.uint8).reshape(len(q_norm), -1))
                asked = np.arange(len(q_norm))
                if may is not None:
                    asked = np.flatnonzero(may.any(axis=1))
                    if not len(asked):
                        continue
                    may = may[asked]
                with np.errstate(all="ignore"):
                    near = (y[asked] @ x.T) / (q_norm[asked][:, None] * norm)
                    unknown = (q_norm[asked] < 0)[:, None] | (norm < 0)
                    near[unknown] = -np.inf
                    if may is not None:
                        near[~may] = -np.inf
                    bar = bars.get(key, np.full(len(q_norm), -np.inf))[asked]
                    if len(norm) > k:
                        bar = np.fmax(bar, np.partition(near, len(norm) - k, axis=1)[:, len(norm) - k] - 2e-6 - SLACK) if np.isneginf(bar).any() else bar
                    found = ~(near < bar[:, None])
                    if may is not None:
                        found &= may
                    a, b = np.nonzero(found)
                    s = np.zeros(len(a))
                    for d in range(size):
                        s += y[asked[a], d] * x[b, d]
                    s = np.where(unknown[a, b], -np.inf, s / (norm[b] * q_norm[asked[a]]))
                old = best.get(key)
                new = (asked[a], s, ids[b])
                every = tuple(np.concatenate(c) for c in zip(old, new, strict=True)) if old else new
                if not len(every[0]):
                    continue
                keep, least = _may_be_best(k, *every)
                best[key] = tuple(c[keep] for c in every)
                bars[key] = np.append(least, np.full(len(q_norm) - len(least), -np.inf)) / 1e6 - 1e-6 - SLACK
        for (_, q_ids), (a, s, b) in best.items():
            yield pa.RecordBatch.from_pydict({"qid": pa.array(np.frombuffer(q_ids, np.int64)[a]), "vec_id": pa.array(b), "s": pa.array(s, pa.float64())})

    return both.mapInArrow(run, "qid long, vec_id long, s double")
