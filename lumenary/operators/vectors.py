"""Vector search by an inverted file: trained centroids, a list of vectors for each, as many lists probed as measured recall asks for."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .products import nearest, packed
from .retrieval import dot, top_k, vector_search

#: Rows that centroids are trained on, and queries that recall is measured by; both are bounds, every row is indexed.
TRAINING_ROWS, TUNING_QUERIES = 20_000, 200


@dataclass
class InvertedFile:
    """items: list, vec_id, embedding, norm; centres: list, centre (one row for each list)."""

    items: DataFrame
    centres: DataFrame
    model: KMeansModel
    n_lists: int


def unit(df: DataFrame) -> DataFrame:
    """Vectors with a length above 0, as doubles, with `norm`."""
    e = F.col("embedding").cast("array<double>")
    return df.select("vec_id", e.alias("embedding")).where(F.col("embedding").isNotNull()).withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding")))).where("norm > 0")


def build_inverted_file(items: DataFrame, n_lists: int | None = None, most: int = TRAINING_ROWS, seed: int = 7) -> InvertedFile:
    """Lists by the nearest of centroids that are trained by cosine on at most `most` rows, those of the smallest hashes; about the root of the count by default."""
    known = checkpointed(unit(items))
    n = n_lists or max(1, round(known.count() ** 0.5))
    with_features = lambda df: df.withColumn("features", array_to_vector("embedding"))
    sample = with_features(checkpointed(known.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(most)))
    model = KMeans(k=n, seed=seed, distanceMeasure="cosine", maxIter=15).fit(sample)
    spark = items.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
    listed = model.transform(with_features(known)).select(F.col("prediction").alias("list"), "vec_id", "embedding", "norm")
    # In the order of lists, so that a block of vectors is of one list; a large list is divided by ids.
    return InvertedFile(checkpointed(listed.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id")), centres, model, n)


def probe_order(index: InvertedFile, queries: DataFrame) -> DataFrame:
    """(qid, list, nth): the lists of each query, nearest centroid first. A row for each list is broadcast."""
    q = unit(queries).select(F.col("vec_id").alias("qid"), "embedding")
    near = q.join(F.broadcast(index.centres)).select("qid", "list", dot(F.col("embedding"), F.col("centre")).alias("near"))
    return near.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "list"))).select("qid", "list", "nth")


def recall_by_probes(index: InvertedFile, queries: DataFrame, k: int = 20) -> DataFrame:
    """(probes, recall, share): of the exact k best the part in the first lists, and the part of all vectors that these hold.

    Measured on at most TUNING_QUERIES of the queries by exact search; the neighbour's list has a place in the query's order.
    """
    some = checkpointed(queries.orderBy(F.xxhash64("vec_id")).limit(TUNING_QUERIES))
    order = checkpointed(probe_order(index, some))
    truth = vector_search(index.items, some, k).select("qid", "vec_id").join(index.items.select("vec_id", "list").hint("merge"), "vec_id")
    found = truth.join(order.hint("merge"), ["qid", "list"]).groupBy(F.col("nth").alias("probes")).agg(F.count("*").alias("found"))
    sizes = index.items.groupBy("list").agg(F.count("*").alias("n"))
    scored = order.join(F.broadcast(sizes), "list").groupBy(F.col("nth").alias("probes")).agg(F.sum("n").alias("scored"))
    upto = lambda c: F.expr(f"sum({c}) OVER (ORDER BY probes) / sum({c}) OVER ()")  # noqa: E731  a row for each list
    return scored.join(F.broadcast(found), "probes", "left").withColumn("found", F.coalesce("found", F.lit(0))).select("probes", upto("found").alias("recall"), upto("scored").alias("share"))


def inverted_search(index: InvertedFile, queries: DataFrame, k: int = 20, least: float = 0.93, probes: int | None = None) -> DataFrame:
    """(qid, vec_id, similarity, nth) of the probed lists, scored exactly; without `probes` the fewest with a measured recall of `least`."""
    if probes is None:
        probes = recall_by_probes(index, queries, k).where(F.col("recall") >= least).agg(F.min("probes")).first()[0] or index.n_lists
    centres, n = np.array(index.model.clusterCenters()), probes

    def probed(x: np.ndarray) -> np.ndarray:
        """A bit for each list, set for those of `probe_order`: sums are added in the same order."""
        near = np.zeros((len(x), len(centres)))
        for d in range(centres.shape[1]):
            near += x[:, d][:, None] * centres[:, d]
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable")[:, :n], True, axis=1)
        return np.packbits(out, axis=1)

    def meets(in_list: int, items: np.ndarray, asked: np.ndarray) -> np.ndarray:
        return np.repeat((asked[:, in_list // 8] >> (7 - in_list % 8) & 1).astype(bool)[:, None], len(items), axis=1)

    k = min(20, max(1, k))
    items = packed(index.items.select(F.col("vec_id").alias("id"), "list", "embedding"))
    found = nearest(items, unit(queries).select(F.col("vec_id").alias("id"), "embedding"), k, probed, meets)
    return top_k(found, "qid", [F.desc("similarity"), F.col("vec_id")], k)
