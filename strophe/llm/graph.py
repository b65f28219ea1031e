"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import discard, stash

#: Edges that a task joins at once; no more ever meet in one task.
CHUNK = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (a > b). Large: join larger neighbours to the least one; small: smaller ones and the node itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        out = linked.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _forest(batches):
    """Edges of each CHUNK as (node, least node of its component there): what they join, in fewer rows than they have nodes."""
    held, size = [], 0

    def joined():
        a, b = (np.concatenate([x[c].to_numpy(zero_copy_only=False) for x in held]) for c in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            np.minimum.at(root, high, low)
            while ((up := root[root]) != root).any():
                root = up
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.record_batch([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK:
            held = [joined()]
            if (size := len(held[0])) >= CHUNK // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield joined()


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (a > b) are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
    ends = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull()).alias("root"))
    return ends.where("lo <> hi or (root and lo is not null)").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60, local: bool = True) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the least node of its component. No edges give no rows.

    Each round runs on the executors and is written to the shared folder; the driver sees one count a round. With ``local`` each
    task first joins the edges that it reads, a chunk at a time, and up to CHUNK of what is left meet in one; without it, all is DataFrame operations.
    """
    edges = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    near = (lambda x: x.mapInArrow(_forest, "a long, b long")) if local else (lambda x: x)
    edges = stash(near(edges) if local else edges.distinct(), "components")
    for _ in range(rounds):
        if few := local and edges.count() <= CHUNK:
            before, edges = edges, stash(near(edges.coalesce(1)), "components")
            discard(before)
        if few or _settled(edges):
            break
        before, edges = edges, stash(_star(_star(near(edges), True), False), "components")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = stash(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(edges)
    return roots
