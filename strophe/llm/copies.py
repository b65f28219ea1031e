"""Groups of near copies in DataFrame functions only, for the line stage: sets of five-word shingles with a Jaccard of 0.8 or more.

Sets meet by the prefix that operator 1 has too (in hash order, two that meet the threshold share one of the first ``n - ceil(0.8 n) + 1``
shingles of either), but each is compared with the least set of its block and size only, not with all: every link told is exact, and
a group's members reach each other through the leads of their blocks. Two near copies that share no lead's links stay apart.

Whole sets travel only to the pairs that their heads (those prefixes) leave possible: up to the lesser of the two heads' last shingles
both sets are known, and of the rest no more can be shared than the smaller rest.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .stash import discard, stash

SHINGLE = 5
#: Pairs whose ends may be broadcast, to pick the sets that travel.
SMALL = 250_000


def _possible(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """Those of ``pairs`` (node, lead) that may meet the threshold by their ``heads`` (node, n, head), the first shingles in order, of which
    32 bits travel: what has less than the last one of either head is known of both sets, and those equal in 32 bits count as shared."""
    short = F.transform("head", lambda i: F.shiftright(i, 32).cast("int"))
    x = heads.select("node", "n", short.alias("x"))
    y = heads.select(F.col("node").alias("lead"), F.col("n").alias("m"), short.alias("y"))
    met = pairs.join(x, "node").join(y, "lead")
    last = F.least(F.element_at("x", -1), F.element_at("y", -1))
    rest = F.least(F.col("n") - F.size(F.filter("x", lambda i: i < last)), F.col("m") - F.size(F.filter("y", lambda i: i < last)))
    both = F.size(F.array_intersect("x", "y")) + F.size("x") - F.size(F.array_distinct("x"))
    return met.where(9 * (both + rest) >= 4 * (F.col("n") + F.col("m"))).select("node", "lead")


def _alike(pairs: DataFrame, sets: DataFrame, small: int) -> DataFrame:
    """Those of ``pairs`` (node, lead) whose ``sets`` (node, items) meet the threshold; only sets of their ends are shuffled."""
    ends = pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct()
    sets = sets.join(F.broadcast(ends) if pairs.count() <= small else ends, "node", "left_semi")
    met = pairs.join(sets.select("node", F.col("items").alias("x")), "node").join(sets.select(F.col("node").alias("lead"), F.col("items").alias("y")), "lead")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(100 * both >= 80 * (F.size("x") + F.size("y") - both)).select("node", "lead")


def near_copies(pages: DataFrame, id: str, text: str, small: int = SMALL) -> DataFrame:
    """(id, group): of each row of ``pages`` whose text has words; equal sets of shingles are one group."""
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = pages.select(F.col(id).alias("id"), words.alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (SHINGLE - 1), F.lit(1)))
    rows = rows.select("id", F.sort_array(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, SHINGLE))))).alias("items"))
    rows = stash(rows.select("id", F.xxhash64("items").alias("node"), "items"), "shingles")
    ids = stash(rows.select("id", "node"), "ids")
    sets = stash(rows.groupBy("node").agg(F.first("items").alias("items")), "sets")
    discard(rows)
    n = F.size("items")
    heads = sets.select("node", n.alias("n"), F.slice("items", 1, n - F.ceil(0.8 * n).cast("int") + 1).alias("head"))
    keys = heads.select("node", "n", F.explode("head").alias("key"))
    keys = keys.withColumn("wide", F.floor(F.log("n") / F.log(F.lit(1.25))))  # sizes that may meet are in one class or in two that touch
    leads = keys.groupBy("key", "wide").agg(F.min("node").alias("lead"), F.min_by("n", "node").alias("m"))
    each = keys.withColumn("wide", F.explode(F.array(F.col("wide"), F.col("wide") + 1)))
    pairs = each.join(leads, ["key", "wide"]).where("node <> lead and 5 * n >= 4 * m and 5 * m >= 4 * n").select("node", "lead").distinct()
    pairs = stash(pairs, "pairs")
    near = stash(_possible(pairs, heads), "possible")
    met = stash(_alike(near, sets, small).select(F.col("node").alias("a"), F.col("lead").alias("b")), "edges")
    roots = components(met, local=False)
    out = stash(ids.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("group")), "groups")
    discard(ids, sets, pairs, near, met, roots)
    return out
