"""Exact vector search: queries travel to the vectors, each task keeps its best, the few survivors are ranked."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import overlap
from ..functions.vectors import boosted, dot
from ..stash import discard, stash
from .nearest import HUGE, Best, least_first, matrix
from .originality import gram_counts, gram_prefixes

#: Queries that are broadcast at once; more are asked in blocks.
QUERIES = 10_000
#: Pairs of kinds (values of the columns that a filter or a preference compares) that are worked out beforehand.
KINDS = 1_000_000


def search(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, mode: str = "prefilter", over: int = 10, prefer: Column | None = None, boost: float = 0.15, least: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score, keep columns): the ``k`` best of each query by inner product, ties by vec_id.

    ``queries`` (query_id, query, ..) may be any number: blocks of about ``QUERIES``, by a hash of query_id, are broadcast one at a time and
    their results united. ``keep`` may compare columns of both sides. ``prefilter`` searches what it holds for; ``overfetch`` takes the best
    ``over * k`` first and may return fewer than ``k``. ``prefer`` raises scores by ``boost`` before they are ranked; scores up to ``least`` don't count.

    Vectors and queries of the commonest length of queries are scored by matrix products, a range of vectors a task, whose tasks keep ``k`` rows a query;
    what such products can't take (nulls, other lengths, entries that aren't finite or overflow) and conditions on columns of too many
    values are scored pair by pair.
    """
    if mode not in ("prefilter", "overfetch"):
        raise ValueError(mode)
    sizes = queries.groupBy(F.size("query").alias("d")).count().collect()  # a row a length
    n, d = sum(r["count"] for r in sizes), max(((r["count"], r.d) for r in sizes if r.d and r.d > 0), default=(0, 0))[1]
    blocks = max(1, -(-n // QUERIES))
    fetch, ask = (k, keep) if keep is None or mode == "prefilter" else (over * k, None)
    kinds = _kinds(vectors, queries, ask, prefer)
    usable = (fine("embedding", d), fine("query", d)) if d and kinds is not None and dict(vectors.dtypes)["vec_id"] == "bigint" else (F.lit(False), F.lit(False))
    good, bad, asked, odd = vectors.where(usable[0]), vectors.where(~usable[0]), queries.where(usable[1]), queries.where(~usable[1])
    if kinds is not None and (blocks > 1 or vectors.sparkSession.sparkContext.defaultParallelism > 1):
        good = good.repartition(2 * vectors.sparkSession.sparkContext.defaultParallelism)  # a file of vectors may be a single task's
    good = stash(good, "vectors") if blocks > 1 else good
    any_bad, any_odd = bool(bad.head(1)), bool(odd.head(1))
    found = []
    for i in range(blocks):
        in_block = lambda q: q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)  # noqa: B023, E731
        near = [] if kinds is None else [_products(good, in_block(asked), fetch, kinds, boost, least)]
        near += [_pairs(bad, in_block(asked), ask, prefer, boost, least)] if any_bad else []
        near += [_pairs(vectors, in_block(odd), ask, prefer, boost, least)] if any_odd else []
        near = near or [_pairs(bad, in_block(asked), ask, prefer, boost, least)]
        found.append(_ranked(reduce(DataFrame.unionByName, near), k, fetch, keep if ask is None else None))
    if blocks == 1:
        return found[0]
    found = [stash(x, "found") for x in found]
    discard(good)
    return reduce(DataFrame.unionByName, found)


def _ranked(pairs: DataFrame, k: int, fetch: int, keep: Column | None) -> DataFrame:
    """The rank limit is pushed below the shuffle."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= fetch)
    if keep is None:
        return out
    return out.where(keep).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _pairs(vectors: DataFrame, queries: DataFrame, keep: Column | None, prefer: Column | None, boost: float, least: float | None) -> DataFrame:
    pairs = vectors.join(F.broadcast(queries), F.lit(True) if keep is None else keep)
    score = dot(F.col("embedding"), F.col("query"))
    pairs = pairs.withColumn("score", score if prefer is None else boosted(score, prefer, boost)).drop("embedding", "query")
    return pairs if least is None else pairs.where(F.col("score") > least)


def fine(column: str, d: int) -> Column:
    """Whether a vector has ``d`` entries, known and finite, that no product of two of them overflows."""
    x = F.col(column)
    return F.coalesce((F.size(x) == d) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < HUGE)), F.lit(False))


def _kinds(vectors: DataFrame, queries: DataFrame, keep: Column | None, prefer: Column | None):
    """(columns of vectors, their kinds, columns of queries, their kinds, kept pairs, preferred pairs) of the columns beside ids and
    vectors; None where a condition needs more than those, or they have too many values."""
    if set(vectors.columns) & set(queries.columns):
        return None
    if keep is None and prefer is None:
        return [], [()], [], [()], None, None
    spark = vectors.sparkSession
    of = [[c for c in df.columns if c not in out] for df, out in ((vectors, ("vec_id", "embedding")), (queries, ("query_id", "query")))]
    simple = ("boolean", "tinyint", "smallint", "int", "bigint", "string", "date")
    if any(t not in simple for df, cs in zip((vectors, queries), of, strict=True) for c, t in df.select(*cs).dtypes):
        return None
    values = [[tuple(r) for r in df.select(*cs).distinct().limit(KINDS + 1).collect()] if cs else [()] for df, cs in zip((vectors, queries), of, strict=True)]
    if len(values[0]) * len(values[1]) > KINDS:
        return None
    x, y = (spark.createDataFrame([(i, *v) for i, v in enumerate(vs)], T.StructType([T.StructField(n, T.LongType()), *[df.schema[c] for c in cs]])) for n, vs, df, cs in zip(("_x", "_y"), values, (vectors, queries), of, strict=True))
    told = [F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)), F.lit(False) if prefer is None else F.coalesce(prefer, F.lit(False))]
    tables = np.zeros((2, len(values[1]), len(values[0])), bool)
    try:
        pairs = y.crossJoin(x).select("_x", "_y", told[0].alias("_k"), told[1].alias("_p")).where("_k or _p")
    except AnalysisException:  # a condition on ids or vectors
        return None
    for r in pairs.collect():
        tables[:, r._y, r._x] = r._k, r._p
    return of[0], values[0], of[1], values[1], None if keep is None else tables[0], None if prefer is None else tables[1]


def _numbers(rows: pa.RecordBatch | pa.Table, columns: list[str], kinds: list[tuple]) -> np.ndarray:
    """The number of each row's kind."""
    if not columns:
        return np.zeros(len(rows), np.int64)
    at = {v: i for i, v in enumerate(kinds)}
    return np.fromiter((at[v] for v in zip(*(rows[c].to_pylist() for c in columns), strict=True)), np.int64, len(rows))


def _products(vectors: DataFrame, queries: DataFrame, k: int, kinds: tuple, boost: float, least: float | None) -> DataFrame:
    """The ``k`` best of each query in each task."""
    spark = vectors.sparkSession
    table = queries.withColumn("query", F.col("query").cast("array<double>")).toArrow()  # a block
    told, of_vectors, of_queries, allowed, preferred = table.drop_columns("query"), kinds[:2], kinds[2:4], *kinds[4:]
    shared = spark.sparkContext.broadcast((told, matrix(table["query"]) if len(table) else np.zeros((0, 0)), _numbers(table, *of_queries), allowed, preferred))

    def run(batches):
        told, x, kind, allowed, preferred = shared.value
        best = Best(x, kind, k, allowed, preferred, boost, least)
        for batch in batches if len(x) else ():
            if len(batch):
                rows = pa.Table.from_batches([batch]).drop_columns("embedding")
                best.add(matrix(batch["embedding"]), _numbers(batch, *of_vectors), least_first(batch["vec_id"]), rows)
        yield from best.found(told)

    rest = [f for f in vectors.schema.fields if f.name != "embedding"] + [f for f in queries.schema.fields if f.name != "query"]
    return vectors.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(run, T.StructType([*rest, T.StructField("score", T.DoubleType())]))


def _greedy(k: int, most: float):
    def grams(t: str) -> set[str]:
        return {t[i : i + 5] for i in range(len(t) - 4)}

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["score"], r["vec_id"]))
        taken, seen = [], []
        for r in rows:
            if taken and len(taken) >= k:
                break
            g = grams(r["text"] or "")
            if any(r["text"][:100] == t["text"][:100] for t in taken) or any(g and s and len(g & s) / len(g | s) > most for s in seen):
                continue
            taken.append(r)
            seen.append(g)
        return pa.table({"query_id": pa.array([r["query_id"] for r in taken], pa.int64()), "rank": pa.array(range(1, len(taken) + 1), pa.int32()), "vec_id": pa.array([r["vec_id"] for r in taken], pa.int64()), "score": pa.array([r["score"] for r in taken], pa.float64())})

    return run


def diverse(found: DataFrame, k: int = 5, prefer: Column | None = None, boost: float = 0.15, most: float = 0.6) -> DataFrame:
    """Greedy re-ranking of each query's fetched rows (query_id, vec_id, score, text): the first stays, later ones leave where a
    chosen one has the same first 100 characters or a five-character overlap above ``most``. A group holds what was fetched, a few rows."""
    if prefer is not None:
        found = found.withColumn("score", boosted(F.col("score"), prefer, boost))
    rows = found.select("query_id", "vec_id", "score", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("query_id").applyInArrow(_greedy(k, most), "query_id long, rank int, vec_id long, score double")


def with_fallback(first: DataFrame, second: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of ``first``, and of ``second`` for the queries that ``first`` left empty."""
    empty = queries.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.unionByName(second.join(empty, "query_id", "left_semi"))


def within_budget(found: DataFrame, most: int, joint: int = 2) -> DataFrame:
    """The first results of each query whose joined texts stay within ``most`` characters."""
    by = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("_used", F.sum(F.length("text") + joint).over(by)).where(F.col("_used") <= most).drop("_used")


def gram_overlap_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, overlap): the texts of ``texts`` (id, text; ids distinct) whose five-character substrings overlap by more than ``least`` (above 0).

    A text stands under its least id: pairs of different texts are pairs of those, a < b. Each copy of a text has one row of its own, with
    the least id and overlap 1, so copies cost their number. Null texts and texts under five characters have no rows. Texts meet where they
    share one of their rarest substrings, as many as ``least`` asks for (see ``gram_prefixes``); pairs are verified on whole texts.
    """
    ids = texts.where(F.length("text") >= 5).select("id", F.xxhash64("text").alias("h"))
    least_id = ids.groupBy("h").agg(F.min("id").alias("first"))
    whole = texts.join(least_id.select("first"), F.col("id") == F.col("first"), "left_semi").select("id", "text", F.xxhash64("text").alias("h"))
    rows = stash(gram_prefixes(whole, "text", gram_counts(whole, "text"), least), "prefixes")
    met = rows.toDF("x", "nx", "gram").join(rows.toDF("y", "ny", "gram"), "gram")
    met = met.where((F.col("x") < F.col("y")) & (F.col("nx") >= least * F.col("ny")) & (F.col("ny") >= least * F.col("nx"))).select("x", "y").distinct()
    left, right = (whole.toDF(i, t, h) for i, t, h in (("a", "ta", "x"), ("b", "tb", "y")))
    pairs = met.join(left, "x").join(right, "y").withColumn("overlap", overlap(F.col("ta"), F.col("tb"))).where(F.col("overlap") > least)
    copies = ids.join(least_id, "h").where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("overlap"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap").unionByName(copies.where(F.lit(1.0) > least))
