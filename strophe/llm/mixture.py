"""Operator 6: mixing sources to target weights by hash-threshold histograms.

Sources share ``share`` times all words by weight, none above ``most`` times its own. A source gives each document as often as its
target holds it whole, and the documents below a hash threshold once more. The threshold is found by nested histograms: words
are summed by source and 12 hash bits, the bucket in which the remaining budget ends is the only one summed again by the next 12
bits, three times over; nothing is sorted. What is left, the documents of one 36-bit value, is taken where that comes nearer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import stash

BITS = 12
LEVELS = 3
SMALL = 100_000
WEIGHTS = (3, 1, 2)
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words of the text and 36 hash bits of the id."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 9), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"))


def targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from a row (source, source_size) a source; weights repeat over sources by code point, null last.

    In the order of size by weight, sources that would go above their limit stop there; the rest share what remains.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.array(*[F.lit(w).cast("long") for w in weights])[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")])
    s = s.withColumn("limit", most * F.col("source_size"))
    by_fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, every = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("given", F.coalesce(F.sum("limit").over(before), F.lit(0))).withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("all", F.sum("source_size").over(every))
    full = 100 * F.col("limit") * F.col("left") <= (percent * F.col("all") - 100 * F.col("given")) * F.col("w")
    s = s.withColumn("full", full)
    s = s.withColumn("given", F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(every)).withColumn("left", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every))
    shared = (F.col("w") * (percent * F.col("all") - 100 * F.col("given"))).cast("double") / (100 * F.col("left"))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def thresholds(rows: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """(source, whole, below): how often a source gives each document, and the hash below which once more."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    at = at.select("source", "whole", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    total = BITS * LEVELS
    for level in range(1, LEVELS + 1):
        high, low = total - BITS * (level - 1), total - BITS * level
        inside = rows.join(F.broadcast(at) if few else at, rows["source"].eqNullSafe(at["source"])).where(F.shiftright("h", high) == F.col("prefix"))
        sums = inside.groupBy(at["source"].alias("source"), F.shiftright("h", low).alias("bucket")).agg(F.sum("size").alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("done").alias("done"))
        order = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("after", F.col("done") + F.sum("size").over(order))
        # the first bucket that ends above the budget, or the one after the last
        found = sums.groupBy("source").agg(
            F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.min(F.when(F.col("after") > F.col("rest"), F.struct("bucket", (F.col("after") - F.col("size")).alias("done"), "size"))).alias("x"), F.max("after").alias("end")
        )
        none = F.lit(1 << (BITS * level)).cast("long")
        at = found.select("source", "whole", "rest", F.coalesce("x.bucket", none).alias("prefix"), F.coalesce("x.done", "end").alias("done"), F.coalesce("x.size", F.lit(0)).alias("edge"))
        at = stash(at, "thresholds")
        last = at
        at = at.drop("edge")
    nearer = (F.col("edge") > 0) & (2 * (F.col("rest") - F.col("done")) >= F.col("edge"))
    return last.select("source", "whole", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("below"))


def mixture(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; ``taken`` counts repeats.

    Null text has size 0; null source is a source. Equal doc_ids share a hash and so are taken alike. An empty table or one without
    words takes nothing. Other columns are ignored. Rows move as (source, hash, size) sums only.
    """
    rows = stash(sized(docs), "sizes")
    goal = stash(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), percent, most, weights), "targets")
    few = goal.count() <= SMALL
    cut = thresholds(rows, goal, few)
    plan = goal.join(cut, goal["source"].eqNullSafe(cut["source"]), "left").select(goal["source"].alias("of"), "source_size", "target", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("below", F.lit(0)).alias("below"))
    out = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("of")))
    taken = F.col("size") * (F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 2 * source_size AS lim, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given0,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left0,
    sum(source_size) OVER () AS every FROM w),
f AS (SELECT *, 100 * lim * left0 <= (150 * every - 100 * given0) * w AS is_full FROM o),
g AS (SELECT *, sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER () AS given, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS rest_w FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST(w * (150 * every - 100 * given) AS DOUBLE) / CAST(100 * rest_w AS DOUBLE) END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT source, h, sum(size) AS size FROM sized GROUP BY source, h),
c AS (SELECT b.source, b.h, b.size, p.target - p.whole * p.source_size AS rest, sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h) AS after
  FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(CASE WHEN after > rest THEN h END) AS edge FROM c GROUP BY source),
k AS (SELECT c.source, coalesce(max(CASE WHEN c.h < e.edge OR e.edge IS NULL OR (c.h = e.edge AND 2 * (c.rest - (c.after - c.size)) >= c.size) THEN c.h END), -1) AS last
  FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source GROUP BY c.source)
SELECT d.doc_id, d.source, d.size, p.source_size, p.target, CAST(d.size * (p.whole + CASE WHEN d.h <= k.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
