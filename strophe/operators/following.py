"""What follows a row in its group, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stash import stash


def ranges(df: DataFrame, order: str, parts: int) -> Column:
    """The range of about equal counts in which ``order`` lies; cuts are approximate quantiles."""
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:  # binary search: how many cuts lie at or below
        return F.when(F.coalesce(F.get(table, at + width - 1) <= F.col(order), F.lit(False)), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]), F.lit(0), step)


def numbered(df: DataFrame, group: str, order: str, *then: str, parts: int | None = None) -> DataFrame:
    """``df`` with _no (rank from 1 in its group by ``order``, ``then``; nulls first) and _all (rows of the group).

    Rows are ranked inside (group, range of order); what the ranges before hold is summed over a row a range, so no task takes a whole
    group. ``order`` is a whole number.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # exploded, so that Spark works it out once and can't carry it over the join to rows that have no ``order`` (it did, and failed)
    df = df.select("*", F.explode_outer(F.array(ranges(df, order, parts))).alias("_range"))
    sizes = df.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_g")
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(by))
    inside = Window.partitionBy(group, "_range").orderBy(order, *then)
    df = df.withColumn("_no", F.row_number().over(inside))
    out = df.join(sizes.drop("_n"), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("_no", F.col("_no") + F.col("_before")).drop("_range", "_g", "_r", "_before")


def numbered_values(df: DataFrame, column: str) -> DataFrame:
    """(column, id): the distinct known values of a column, numbered from 1 in their order.

    They are written in ranges of their order and ranked inside each, so no task takes all of them; what the ranges before hold is
    summed over a row a range.
    """
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    rows = stash(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("_range")), "values")
    sizes = rows.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_no", F.row_number().over(Window.partitionBy("_range").orderBy(column)))
    out = rows.join(sizes.select("_r", before.alias("_before")), F.col("_range") == F.col("_r"))
    return out.select(column, (F.col("_no") + F.col("_before")).cast("int").alias("id"))


def with_following(df: DataFrame, group: str, order: str, items: str, n: int, to: str, parts: int | None = None) -> DataFrame:
    """``df`` (a row a document, ``items`` an array) with ``to``: the first ``n`` items after the document, over all later ones.

    Windows run inside (group, range of order), so a group that holds a third of all rows is spread; each range passes its first
    items to the one before. Rows without items pass nothing. ``order`` is a unique whole number.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_range", ranges(df, order, parts)).withColumn("_first", F.slice(F.col(items), 1, n))
    full = df.where(F.size(items) > 0)
    by = Window.partitionBy(group, "_range").orderBy(order)
    full = full.withColumn("_near", F.flatten(F.collect_list("_first").over(by.rowsBetween(1, n)))).withColumn("_n", F.row_number().over(by))
    head = full.where(F.col("_n") <= n).groupBy(group, "_range").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "_first"))), lambda x: x["_first"])), 1, n).alias("_head"))
    after = head.withColumn("_after", F.flatten(F.collect_list("_head").over(Window.partitionBy(group).orderBy("_range").rowsBetween(1, n))))
    after = after.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), "_after")
    out = full.join(after, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    out = out.withColumn(to, F.slice(F.concat("_near", F.coalesce("_after", F.array().cast(dict(df.dtypes)[items]))), 1, n))
    return out.drop("_range", "_first", "_near", "_n", "_g", "_r", "_after")
