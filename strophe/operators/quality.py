"""Verse metrics, candidate scores and aggregates over runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.scheme import SCORING, group_array
from .lines import line_suffixes


def distinct_n(words: Column, n: int) -> Column:
    """Distinct by all runs of ``n`` of an array of words; 0 of a shorter one."""
    size = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(size >= n, F.size(F.array_distinct(grams)) / (size - n + 1)).otherwise(0.0)


def known_suffixes(lines: Column) -> Column:
    """Sorted suffixes of the last words of lines, without unknown ones."""
    return F.array_sort(F.filter(F.transform(lines, lambda x: phonetics.spelled_suffix(text.last_word(x))), lambda s: s.isNotNull()))


def rhyme_density(lines: Column, known: Column) -> Column:
    """Share of lines whose suffix ends another line too, by their sorted ``known`` suffixes; 0 of under two lines."""
    same = lambda s, other: F.coalesce(s == other, F.lit(False))
    hits = F.filter(known, lambda s, i: same(s, F.get(known, i - 1)) | same(s, F.get(known, i + 1)))
    return F.when(F.size(lines) >= 2, F.size(hits) / F.size(lines)).otherwise(0.0)


def structure(lines: Column) -> dict[str, Column]:
    """num_lines, avg_line_length, unique_line_ratio, reasonable_line_ratio of unstripped lines."""
    n = F.greatest(F.size(lines), F.lit(1))
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    return {
        "num_lines": F.size(lines).cast("long"),
        "avg_line_length": F.round(total / n, 1),
        "unique_line_ratio": F.round(F.size(F.array_distinct(lines)) / n, 3),
        "reasonable_line_ratio": F.round(F.size(F.filter(lines, lambda x: F.length(x).between(5, 120))) / n, 3),
    }


def verse_metrics(docs: DataFrame, *keep: str, body: str = "text") -> DataFrame:
    """The eight metrics of each text. Arrays that expressions use again are columns first, so that each is made once a row."""
    c = F.coalesce(F.col(body), F.lit(""))
    raw = F.filter(text.split_lines(text.strip(c)), lambda x: text.strip(x) != "")
    rows = docs.select(*keep, text.words(c).alias("_words"), text.stripped_lines(c).alias("_lines"), raw.alias("_raw"))
    rows = rows.withColumn("_known", known_suffixes(F.col("_lines")))
    cols = {f"distinct_{n}": F.round(distinct_n(F.col("_words"), n), 4) for n in (1, 2, 3)}
    cols |= {"rhyme_density": F.round(rhyme_density(F.col("_lines"), F.col("_known")), 4)} | structure(F.col("_raw"))
    return rows.select(*keep, *[v.alias(k) for k, v in cols.items()])


def score_verses(verses: DataFrame, scheme: str, target: int) -> DataFrame:
    """``verses`` (.., lines) with score, n_lines, pairs and hits.

    Pairs: equal known suffixes at most four lines apart. Hits: lines of a rhyme group, after its first, that equal the group's
    first known suffix; lines beyond the scheme's pattern are groups of their own and can't hit. Verses under four lines or half the target score -1, mostly unknown endings -0.5, free schemes 0.
    """
    s = verses.withColumn("_s", line_suffixes(F.col("lines"))).withColumn("n_lines", F.size("lines"))
    idx = F.sequence(F.lit(0), F.greatest(F.col("n_lines") - 1, F.lit(0)))
    same = lambda i, k: F.when(F.coalesce(F.get("_s", i) == F.get("_s", i + k), F.lit(False)), 1).otherwise(0)
    pairs = F.aggregate(F.transform(idx, lambda i: sum((same(i, k) for k in range(1, 5)), F.lit(0))), F.lit(0), lambda a, x: a + x)
    reach = len(SCORING.get(scheme, scheme) or "x")  # the pattern: later lines share no group
    g = F.slice(group_array(scheme, reach), 1, F.least("n_lines", F.lit(reach)))

    def group_hits(k: Column) -> Column:
        mine = F.filter(F.transform("_s", lambda x, i: F.when(F.get("_g", i) == k, F.struct(x.alias("v")))), lambda x: x.isNotNull())
        anchor = F.try_element_at(F.filter(F.transform(mine, lambda x: x["v"]), lambda v: v.isNotNull()), F.lit(1))
        rest = F.slice(mine, 2, F.greatest(F.size(mine) - 1, F.lit(0)))
        return F.size(F.filter(rest, lambda x: F.coalesce(x["v"] == anchor, F.lit(False))))

    s = s.withColumn("pairs", pairs).withColumn("_g", g)
    s = s.withColumn("hits", F.aggregate(F.transform(F.array_distinct("_g"), group_hits), F.lit(0), lambda a, x: a + x))
    known = F.size(F.filter("_s", lambda v: v.isNotNull()))
    length = F.least(F.col("n_lines") / target, F.lit(1.0))
    score = F.when(F.lit(scheme == "free") | (F.col("n_lines") == 0), 0.0).when(F.col("n_lines") < max(4, target // 2), -1.0).when(known / F.col("n_lines") < 0.5, -0.5).otherwise((F.col("pairs") + 0.5 * F.col("hits")) * length + 0.5 * length)
    return s.withColumn("score", score).drop("_s", "_g")


def best_candidate(scored: DataFrame, group: str, verse: str, order: str) -> DataFrame:
    """The candidate of each group with the best (score, number of lines), the first of equals."""
    return scored.groupBy(group).agg(F.max_by(F.struct(verse, "score", "n_lines"), F.struct("score", "n_lines", -F.col(order))).alias("x")).select(group, "x.*")


def mean_std(rows: DataFrame, metrics: list[str], *by: str, digits: int = 4) -> DataFrame:
    """Mean and population deviation of each metric a group; applied again it aggregates the aggregates."""
    out = []
    for m in metrics:
        out += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_pop(m), digits).alias(f"{m}_std")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *out)


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    """(baseline): the share of the most frequent value of ``label``."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("baseline"))


def perplexity(loss: Column) -> Column:
    return F.exp(F.avg(loss))


def learning_rate(step: Column, warmup: int | Column, total: int | Column) -> Column:
    """The factor at a step: linear warm-up, then half a cosine."""
    warmup, total = (x if isinstance(x, Column) else F.lit(x) for x in (warmup, total))
    done = (step - warmup) / F.greatest(total - warmup, F.lit(1))
    return F.when(step < warmup, step / F.greatest(warmup, F.lit(1))).otherwise(0.5 * (1 + F.cos(F.pi() * done)))


def evals_since_best(rows: DataFrame, run: str | list[str], step: str | list[str], loss: str) -> DataFrame:
    """``rows`` with best (least loss so far) and since_best (evaluations since it first fell to that)."""
    w = Window.partitionBy(run).orderBy(step)
    out = rows.withColumn("best", F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    better = F.col(loss) < F.coalesce(F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("inf")))
    out = out.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.max(F.when(better, F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("since_best", (F.col("_n") - F.col("_b")).cast("long")).drop("_n", "_b")
