"""Operator 7: line dedup by site-relative frequency, in DataFrame functions only.

Pages and lines are grouped by host: pages containing the line by pages of the host, each text of a host being a page. A line that exceeds
``ratio``, on ``pages`` pages at least, is boilerplate of that host and leaves all its pages. Lines are compared without blanks at their
ends, by 64-bit hash; blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import discard, stash

#: See the README for the gap that the ratio lies in.
RATIO = 0.01
PAGES = 5
#: Boilerplate lines that may be broadcast, and lines of a host that each of its lines is compared with; beyond that, pages are joined line by line.
SMALL = 500_000
FEW = 500


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = PAGES, copies: bool = False, id: str | None = None, groups: DataFrame | None = None, among: DataFrame | None = None,
) -> DataFrame:
    """(host, line): hashes of each host's boilerplate lines, those on at least ``least`` and more than ``ratio`` of its pages.

    Pages of one host and text are one page; ``copies`` makes each row a page. With ``groups`` (id, group), say near-duplicate components, all rows
    of one host whose ``id`` is in one group are one page, which holds the lines of all of them; rows of no group are told apart by their text.
    ``among`` (host, line) names the lines that may be found; pages are counted alike.
    """
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key)).alias("keys")
    hosts, page = F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("page")
    if copies:
        each = pages.select(hosts, keys)
    elif groups is None:
        each = stash(pages.select(hosts, page, keys).distinct(), "pages")  # copies meet in the map-side aggregation
    else:
        known = groups.select(F.col(groups.columns[0]).alias("id"), F.col(groups.columns[1]).alias("group")).where("id is not null and group is not null").groupBy("id").agg(F.min("group").alias("group"))
        each = pages.select(hosts, page, keys, F.col(id).alias("of")).join(known, F.col("of") == F.col("id"), "left")
        each = stash(each.select("host", F.struct("group", F.when(F.col("group").isNull(), F.col("page"))).alias("page"), "keys"), "pages")
    rows = each.select("host", F.explode("keys").alias("line"), *([] if groups is None else ["page"]))
    if among is not None:
        few = among.select(F.col("host").alias("in"), F.col("line").alias("may"))
        rows = rows.join(F.broadcast(few) if few.count() <= SMALL else few, F.col("host").eqNullSafe(F.col("in")) & (F.col("line") == F.col("may")), "left_semi")
    if groups is not None:
        rows = rows.distinct()
    total = each if groups is None else each.select("host", "page").distinct()
    total = total.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"))
    often = rows.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = stash(often.join(total, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages")).select("host", "line"), "boilerplate")
    discard(each)
    return found


def line_dedup(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = PAGES, dropped: str | None = None, small: int = SMALL, few: int = FEW, copies: bool = False,
    id: str | None = None, groups: DataFrame | None = None, bad: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with boilerplate lines gone from ``text``; the other columns unchanged, ``dropped`` (if named) added: lines that left.

    Null text stays null; a null host is a host; an empty text stays empty; a text of boilerplate only becomes empty. A line counts once a
    page however often it is repeated, and all its repeats leave. What counts as one page, ``copies``, ``id`` and ``groups`` say (see
    ``boilerplate``): by default each text of a host, so that exact copies and repeated rows count once, near copies one by one. ``bad`` is the
    boilerplate (host, line) where it is known. No text of a host with up to ``few`` such lines is shuffled while all of them
    fit a broadcast of ``small`` hashes; elsewhere lines meet hashes in a join.
    """
    bad = boilerplate(pages, host, text, ratio, least, copies, id, groups) if bad is None else bad
    a, b, c = (_free(pages, x) for x in ("_host", "_bad", "_lines"))
    lines = _lines(F.col(text).cast("string"))
    sizes = stash(bad.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    all_few = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)) <= small, F.coalesce(F.max("n"), F.lit(0)) <= few).first()
    many = sizes.where(F.col("n") > (few if all_few[0] else 0)).select(F.col("host").alias(b))
    here = F.col(host).cast("string")

    def by_array(rows: DataFrame) -> DataFrame:
        sets = bad.groupBy(F.col("host").alias(a)).agg(F.collect_set("line").alias(b))
        out = rows.join(F.broadcast(sets.where(F.size(b) <= few)), here.eqNullSafe(F.col(a)), "left")
        return out.withColumn(c, F.when(F.col(b).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(b), _key(x)) | _blank(x))))

    def by_join(rows: DataFrame) -> DataFrame:
        rows = stash(rows.withColumn(a, F.expr("uuid()")), "pages")
        each = rows.select(F.col(a), here.alias("h"), F.posexplode(lines).alias("pos", "line"))
        kept = each.join(bad, each["h"].eqNullSafe(bad["host"]) & (_key(each["line"]) == bad["line"]) & ~_blank(each["line"]), "left_anti")
        kept = kept.groupBy(F.col(a).alias(b)).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias(c))
        return rows.join(kept, F.col(a) == F.col(b), "left").withColumn(c, F.coalesce(F.col(f"{c}.line"), F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))))

    names = [F.array_join(F.col(c), "\n").alias(x) if x == text else F.col(x) for x in pages.columns]
    if dropped:
        names.append((F.size(lines) - F.size(c)).cast("long").alias(dropped))
    if all(all_few):
        return by_array(pages).select(*names)
    if not all_few[0]:
        return by_join(pages).select(*names)
    many = F.broadcast(many)  # each has over ``few`` of at most ``small`` lines
    apart = here.eqNullSafe(F.col(b))
    return by_array(pages.join(many, apart, "left_anti")).select(*names).unionByName(by_join(pages.join(many, apart, "left_semi")).select(*names))


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


_TRIM = "trim(x, ' ' || chr(9) || chr(13))"
SQL = f"""
WITH p AS (SELECT DISTINCT source, text FROM documents),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
e AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM}), lambda x: x <> ''))) AS line FROM p),
n AS (SELECT source, line, count(*) AS n FROM e GROUP BY source, line),
b AS (SELECT n.source, list(n.line) AS bad FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n.n >= {PAGES} AND n.n > {RATIO}::DOUBLE * t.pages GROUP BY n.source),
k AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS ls, CASE WHEN b.bad IS NULL THEN string_split(d.text, chr(10))
    ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.bad, {_TRIM})) END AS kept
  FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k
"""
