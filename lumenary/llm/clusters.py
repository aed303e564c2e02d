"""Centroid clustering in integers: Lloyd's rounds with bounds that follow the geometry of the centroids' moves.

Every vector carries its centroid, its exact distance to it, and a lower bound of the distance to all other centroids.

1. When centroids move, a vector's distance to its own one is worked out again, exactly; only the lower bound is loosened.
2. The vectors of a cluster lie in a sphere around the centroid that they were assigned to. For another centroid that moves
   from p to q, the distances to p and q differ by the same amount on one branch of a hyperbola, which lies within its
   asymptotes. So in the plane through the sphere's centre, p and q, no vector comes nearer by more than the move times the
   cosine of the angle that is left between the move and the sphere, seen from the middle of p and q. This is less than the
   whole move unless the sphere holds that middle; it is 0 if the centroid moves away from the sphere.
3. A vector whose distance is surely under its bound keeps its centroid; all others are ambiguous and are scanned against all
   centroids in exact integers, so ties go to the smaller number.

A round is one pass over the vectors and one over sums: a task adds up its own vectors by cluster, so a cluster with a third
of all vectors is a row per task. Centroids, their sums and radii (a row for each cluster and component) are all that passes
through the driver; vectors and their bounds are checkpointed after each round, in the smallest integers that hold them.

Defined results: a null array, one of another length, or one with a null or non-finite component is left out; components
beyond 2**52 in scaled integers are cut there, and distances and sums beyond a long come out as the largest long; rows with
equal vec_id are vectors of their own, of which the componentwise smaller comes first among the seeds; a null vec_id has the
hash of `2:`; with fewer vectors than clusters each vector is a seed; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import checkpointed, table

N_CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Scaled components are cut here; beyond it doubles have gaps.
FARTHEST = 1 << 52
#: Up to this size of components all distances and products are whole doubles below 2**53, for up to 128 dimensions.
EXACT = 1 << 21
LONGEST = (1 << 63) - 1
_SLICE = 1 << 14


def scaled_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of vectors whose components are all there and finite."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    inside = lambda x: F.greatest(F.least(x * float(scale), F.lit(float(FARTHEST))), F.lit(-float(FARTHEST)))
    return vectors.where((F.size(e) == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(inside(x))).alias("v"))


def first_centroids(kept: DataFrame, k: int = N_CLUSTERS) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in kept.withColumn("hash", key).orderBy("hash", "v").limit(k).select("v").collect()]


def loosening(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much, for each cluster, any other centroid can have come nearer to a vector in the cluster's sphere."""
    move = after - before
    length = np.sqrt((move**2).sum(axis=1))
    middle = (before + after) / 2
    seen = before[:, None, :] - middle[None, :, :]
    far = np.sqrt((seen**2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.clip((seen * move[None, :, :]).sum(axis=2) / (far * length[None, :]), -1, 1)
        left = np.arccos(along) - np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    nearer = length[None, :] * np.cos(np.clip(left, 0, np.pi / 2))
    nearer = np.where(radius[:, None] < far, nearer, length[None, :])
    nearer[:, length == 0] = 0
    np.fill_diagonal(nearer, 0)
    return nearer.max(axis=1, initial=0)


def _flat(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def assign(x: np.ndarray, centroids: list[list[int]], cluster: np.ndarray, lower: np.ndarray, loose: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, lower bound, whether scanned) of some vectors; without `loose` all are scanned."""
    small = max((abs(c) for row in centroids for c in row), default=0) <= EXACT and (np.abs(x).max(initial=0) <= EXACT)
    kind = np.float64 if small else object
    x, c = x.astype(kind), np.array(centroids, kind)
    if loose is None or not small:
        own, open_ = np.zeros(len(x), kind), np.ones(len(x), bool)
    else:
        own = ((x - c[cluster]) ** 2).sum(axis=1)
        lower = lower - loose[cluster] - 1e-9 * (1 + np.abs(lower))
        open_ = ~(np.sqrt(own) * (1 + 1e-9) < lower)
    cluster, lower = cluster.copy(), lower.copy()
    for a in range(0, int(open_.sum()), _SLICE):
        at = np.flatnonzero(open_)[a : a + _SLICE]
        all_ = (x[at] ** 2).sum(axis=1)[:, None] - 2 * x[at].dot(c.T) + (c**2).sum(axis=1)[None, :]
        best = all_.argmin(axis=1)
        cluster[at], own[at] = best, all_[np.arange(len(at)), best]
        all_ = all_.astype(np.float64)
        all_[np.arange(len(at)), best] = np.inf
        lower[at] = np.sqrt(all_.min(axis=1)) if small else 0
    distance = np.array([min(int(d), LONGEST) for d in own], np.int64) if not small else own.astype(np.int64)
    return cluster, distance, lower, open_


def _assigned(centroids: list[list[int]], loose: np.ndarray | None, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, lower, scanned = assign(_flat(batch.column("v"), dimensions), centroids, batch.column("cluster").to_numpy(), batch.column("lower").to_numpy(), loose)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(lower), pa.array(scanned)],
                                             names=["vec_id", "v", "cluster", "distance", "lower", "scanned"])
    return run


def _sums(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's own sums: a row for each of its clusters."""
        held: dict[int, list] = {}
        for batch in batches:
            x, cluster, distance = _flat(batch.column("v"), dimensions), batch.column("cluster").to_numpy(), batch.column("distance").to_numpy()
            for c in np.unique(cluster).tolist():
                mine = cluster == c
                # Whole numbers under 2**53 a component, fewer than 2**10 of them at a time: no sum is beyond a long.
                part = [sum(x[mine][a : a + 512].astype(np.int64).sum(axis=0).astype(object) for a in range(0, int(mine.sum()), 512)), int(mine.sum()), int(distance[mine].max()), sum(distance[mine].tolist())]
                if c in held:
                    part = [held[c][0] + part[0], held[c][1] + part[1], max(held[c][2], part[2]), held[c][3] + part[3]]
                held[c] = part
        number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.int32()), pa.array([[Decimal(int(s)) for s in h[0]] for h in held.values()], pa.list_(number)),
            pa.array([h[1] for h in held.values()], pa.int64()), pa.array([h[2] for h in held.values()], pa.int64()), pa.array([Decimal(h[3]) for h in held.values()], number)],
            names=["cluster", "sums", "n", "far", "inertia"])
    return run


def cluster_sums(state: DataFrame, dimensions: int = DIMENSIONS) -> dict[int, tuple[list[int], int, int, int]]:
    """By cluster: sums of the components, vectors, largest and summed squared distance. A row for each cluster and component comes to the driver."""
    part = state.select("v", "cluster", "distance").mapInArrow(_sums(dimensions), "cluster int, sums array<decimal(38,0)>, n long, far long, inertia decimal(38,0)")
    by = part.select("cluster", "n", "far", "inertia", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(*[f(c).alias(c) for f, c in ((F.sum, "s"), (F.sum, "n"), (F.max, "far"), (F.sum, "inertia"))])
    out: dict[int, tuple[list[int], int, int, int]] = {}
    for r in sorted(by.collect(), key=lambda r: (r.cluster, r["at"])):
        out.setdefault(r.cluster, ([], int(r.n), int(r.far), int(r.inertia)))[0].append(int(r.s))
    return out


def cluster_vectors(vectors: DataFrame, k: int = N_CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, list[list[int]], dict[int, int]]:
    """(vec_id, v, cluster, distance, lower, scanned) after `rounds` rounds and one more assignment, the centroids, and each cluster's inertia."""
    kept = scaled_vectors(vectors, dimensions, scale)
    most = kept.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if most < 1 << bits)
    centroids = first_centroids(kept, k)
    state = kept.select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("lower"))
    schema = f"vec_id long, v array<{kind}>, cluster int, distance long, lower double, scanned boolean"
    loose, sums = None, {}
    for done in range(rounds + 1):
        state = checkpointed(state.select("vec_id", "v", "cluster", "lower").mapInArrow(_assigned(centroids, loose, dimensions), schema))
        sums = cluster_sums(state, dimensions)
        if done < rounds:
            before = np.array(centroids, np.float64).reshape(-1, dimensions)
            centroids = [[s // sums[c][1] for s in sums[c][0]] if c in sums else row for c, row in enumerate(centroids)]
            radius = np.sqrt(np.array([sums[c][2] if c in sums else 0 for c in range(len(centroids))], np.float64)) * (1 + 1e-9)
            loose = loosening(before, np.array(centroids, np.float64).reshape(-1, dimensions), radius)
    return state, centroids, {c: s[3] for c, s in sums.items()}


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, centroids, inertia = cluster_vectors(table(spark, sf_dir, "embeddings"))
    whole = min(sum(inertia.values()), LONGEST)
    rows = [(c, min(inertia.get(c, 0), LONGEST), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)]
    # A row for each cluster, so it may be broadcast however many vectors there are.
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _op12_sql(k: int = N_CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in SQL: a table of kept vectors, and for each round one of assignments and one of centroids."""
    nearest = """, a{r} AS MATERIALIZED (
  SELECT id, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT x.id, x.vec_id, x.v, y.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.m[i]) * (x.v[i] - y.m[i]))) AS BIGINT) AS d FROM kept x CROSS JOIN c{r} y)
  GROUP BY id, vec_id, v
)"""
    moved = """, s{r} AS (
  SELECT c, list(f ORDER BY i) AS m FROM (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{p} CROSS JOIN range(1, 65) t(i) GROUP BY c, i))
  GROUP BY c
), c{r} AS MATERIALIZED (
  SELECT o.c, coalesce(s.m, o.m) AS m FROM c{p} o LEFT JOIN s{r} s ON s.c = o.c
)"""
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS c, v AS m FROM kept QUALIFY c < {k}
)"""
    body = "".join((moved.format(r=r, p=r - 1) if r else "") + nearest.format(r=r) for r in range(rounds + 1))
    return head + body + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


OP12_SQL = _op12_sql()
