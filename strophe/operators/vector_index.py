"""An index of vectors in clusters, and exact search that skips the clusters whose bound says that they can't matter.

Vectors lie with the nearest of some of them (centres), in a folder a cluster and, where asked, a folder for each value of a column, so that a filter on it
reads only those files. A cluster keeps its centre, its size and its radius. No inner product of a query with its vectors is above
``query . centre + |query| * radius``: the best clusters of a query are read first, and then those whose bound reaches its k-th score so far.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import keyed
from ..functions.vectors import dot
from ..stash import discard, stash
from . import retrieval
from .nearest import HUGE, Best, least_first, matrix

#: Centres at most, a matrix that every task holds; and pairs (query, cluster) that are broadcast at a time, two numbers each.
CENTRES = 1024
PAIRS = 1_000_000
#: What a bound is raised by against rounding, as a share of the greatest possible score.
SLACK = 1e-6


def _assign(centres: np.ndarray, at: int):
    """Each vector's nearest centre and its distance."""
    half = (centres**2).sum(1) / 2

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(at)) if len(batch) else np.zeros((0, centres.shape[1]))
            near = (x @ centres.T - half).argmax(1) if len(x) else np.zeros(0, np.int64)
            far = np.sqrt(((x - centres[near]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cluster", "distance"])

    return run


def write_index(vectors: DataFrame, path: str, clusters: int = 64, by: str | None = None, seed: int = 0) -> None:
    """Write ``vectors`` (vec_id, embedding, more columns but cluster and distance) as an index of up to ``clusters`` clusters below ``path``.

    Centres are the vectors of least keyed hash of vec_id, a bounded sample; all fine vectors are indexed: null or empty ones, those with
    an entry that is null or not finite (or so large that products overflow) and those of another length than the commonest (of equals the greatest) can't be scored and stay out. ``by`` names a column of few
    values that filters ask for. Repeated rows stay rows.
    """
    if not 0 < clusters <= CENTRES:
        raise ValueError(f"1 to {CENTRES} clusters")
    fine = vectors.where((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < HUGE)))
    d = fine.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    fine = fine.where(F.size("embedding") == (d.d if d else 0))
    sample = fine.select("vec_id", "embedding").orderBy(keyed(seed, "vec_id"), "vec_id").limit(clusters).collect()
    centres = np.unique(np.array([r.embedding for r in sample], np.float64).reshape(len(sample), -1), axis=0)
    rows = fine.mapInArrow(_assign(centres, fine.columns.index("embedding")), fine.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0)).schema)
    folders = ["cluster"] if by is None else [by, "cluster"]
    # ranges: a task writes few folders, a cluster that holds a third of all vectors is written by many
    rows.repartitionByRange(*folders, "vec_id").write.partitionBy(*folders).parquet(f"{path}/vectors")
    kept = read_vectors(vectors.sparkSession, path, vectors).groupBy("cluster").agg(F.count("*").alias("size"), F.max("distance").alias("radius"))
    table = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
    kept.join(F.broadcast(table), "cluster").write.parquet(f"{path}/clusters")


def read_vectors(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The vectors of an index, with the columns of ``like``, cluster and distance."""
    schema = like.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0)).schema
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def _bounds(queries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(row, query_id, cluster, size, reach, bound) of each query and cluster: its centre's score and the most that a vector of it can have."""
    pairs = queries.join(F.broadcast(clusters))  # at most CENTRES rows
    size = F.sqrt(F.aggregate("query", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    wide = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x))
    reach = dot(F.col("centre"), F.col("query"))
    return pairs.select("row", "query_id", "cluster", "size", reach.alias("reach"), (reach + size * F.col("radius") + SLACK * size * (wide + F.col("radius"))).alias("bound"))


def _best(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query among the vectors of the clusters that it is paired with, in each task; ``pairs`` (row, cluster) are collected."""
    table = queries.withColumn("query", F.col("query").cast("array<double>")).toArrow()
    met = pairs.select("row", "cluster").toArrow()
    row, cluster = (met[c].to_numpy() for c in ("row", "cluster"))
    order = np.argsort(cluster, kind="stable")
    row, cluster = np.searchsorted(np.sort(table["row"].to_numpy()), row[order]), cluster[order]
    table = table.take(pa.array(np.argsort(table["row"].to_numpy())))
    shared = vectors.sparkSession.sparkContext.broadcast((table.select(["query_id"]), matrix(table["query"]) if len(table) else np.zeros((0, 0)), row, cluster))

    def run(batches):
        told, x, row, cluster = shared.value
        best = Best(x, np.zeros(len(x), np.int64), k)
        for batch in batches if len(row) else ():
            if not len(batch):
                continue
            of, ids, v = batch["cluster"].to_numpy(), least_first(batch["vec_id"]), matrix(batch["embedding"])
            for c in np.unique(of):
                a, b = np.searchsorted(cluster, [c, c + 1])
                if a < b:
                    at = np.flatnonzero(of == c)
                    best.add(v[at], np.zeros(len(at), np.int64), ids[at], pa.table([batch["vec_id"].take(pa.array(at))], ["vec_id"]), row[a:b])
        yield from best.found(told)

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "cluster")
    rows = rows.mapInArrow(run, T.StructType([vectors.schema["vec_id"], queries.schema["query_id"], T.StructField("score", T.DoubleType())]))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search_index(vectors: DataFrame, clusters: DataFrame, queries: DataFrame, k: int, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, vec_id, score), (query_id, scored)): the ``k`` best by inner product, ties by vec_id, and how many vectors were scored for it.

    The rows are those of a search of all vectors. ``vectors`` as ``read_vectors`` gives them, ``clusters`` the index's table of clusters,
    ``queries`` (query_id, query); those that are null, of another length or not finite are asked of all vectors, pair by pair. ``keep``, over columns of ``vectors``, is a filter; on the index's ``by`` column it leaves out files unread. Queries are
    asked in blocks so that at most about ``PAIRS`` (query, cluster) are broadcast at a time; each block reads first the clusters with the best centres that hold
    ``k`` vectors (of any kind), then the others whose bound reaches the k-th score.
    """
    vectors = vectors if keep is None else vectors.where(keep)
    if keep is not None:
        sizes = vectors.groupBy("cluster").agg(F.count("*").alias("size"))
        clusters = stash(clusters.drop("size").join(sizes, "cluster"), "clusters")
    some = clusters.select("centre").first()
    fine = retrieval.fine("query", len(some.centre)) if some else F.lit(False)
    odd, asked = queries.select("query_id", "query").where(~fine), stash(queries.select("query_id", "query").where(fine).withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() * max(1, clusters.count()) // PAIRS))
    part = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found, scored = [], []
    for i in range(blocks):
        block = asked.where(part == i)
        pairs = stash(_bounds(block, clusters), "pairs")
        before = Window.partitionBy("row").orderBy(F.desc("reach"), "cluster").rowsBetween(Window.unboundedPreceding, -1)
        pairs = pairs.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)) < k)
        near = stash(_best(vectors, block, pairs.where("first"), k), "near")
        least = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        rest = pairs.where("not first").join(least, pairs["query_id"].eqNullSafe(least["query_id"]), "left").where((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") >= F.col("least")))
        rest = stash(rest.select("row", pairs["query_id"], "cluster", "size"), "rest")
        by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        both = near.drop("rank").unionByName(_best(vectors, block, rest, k).drop("rank"))
        found.append(stash(both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "found"))
        read = pairs.where("first").select("query_id", "size").unionByName(rest.select("query_id", "size"))
        scored.append(stash(read.groupBy("query_id").agg(F.sum("size").alias("scored")), "scored"))
        discard(near, rest)
    if odd.head(1):  # no bound tells anything of these
        found.append(retrieval.search(vectors.select("vec_id", "embedding"), odd, k).select("query_id", "vec_id", "score", "rank"))
        scored.append(odd.groupBy("query_id").count().crossJoin(vectors.agg(F.count("*").alias("all"))).select("query_id", (F.col("count") * F.col("all")).alias("scored")))
    return tuple(reduce(DataFrame.unionByName, x) for x in (found, scored))
