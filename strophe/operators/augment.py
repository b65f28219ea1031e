"""Seeded augmentation: draws are keyed hashes instead of a random state, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.draws import keyed
from ..stash import stash
from .following import numbered
from .lines import once

#: A small default table (word, replacements); pass another (see ``read_synonyms``) to swap more.
SYNONYMS = {"the": ["this", "that"], "of": ["from"], "and": ["plus"], "is": ["stays"], "to": ["toward"]}


def _reordered(lines: Column, by: str, block: int, seed: int) -> Column:
    """Lines of each full block in an order keyed by the column ``by``."""
    full = F.floor(F.size(lines) / block) * block

    def key(x: Column, i: Column) -> Column:
        order = F.when(i < full, keyed(seed, by, i)).otherwise(i.cast("long"))
        return F.struct(F.floor(i / block).alias("b"), order.alias("o"), x.alias("x"))

    return F.transform(F.array_sort(F.transform(lines, key)), lambda s: s["x"])


def _shuffled(t: Column, by: str, block: int = 4, seed: int = 0) -> Column:
    """A text with its full blocks reordered; null where that changes nothing."""
    other = lambda old, new: F.when((F.size(old) >= block) & (new != old), F.array_join(new, "\n"))
    return text.named(text.stripped_lines(t, fed_only=True), lambda old: text.named(_reordered(old, by, block, seed), lambda new: other(old, new)))


def _swapped(t: Column, by: str, table: dict[str, list[str]] | None, share: float, seed: int) -> Column:
    """A text with words of the table swapped, keyed by the column ``by``."""
    table = SYNONYMS if table is None else table
    known = F.create_map(*[x for w, r in sorted(table.items()) for x in (F.lit(w), F.array(*map(F.lit, r)))])
    parts = F.regexp_extract_all(t, F.lit(r"\w+|\W+"), 0)  # ASCII words; a written-out complement takes five times as long

    def swap(x: Column, i: Column) -> Column:
        options = F.try_element_at(known, F.lower(x))
        h = F.pmod(keyed(seed, by, i), F.lit(1_000_000))
        new = F.get(options, F.pmod(keyed(seed + 1, by, i), F.size(options)).cast("int"))
        new = F.when(x.rlike("^[A-Z]"), F.concat(F.upper(F.substring(new, 1, 1)), F.substr(new, F.lit(2)))).otherwise(new)
        return F.when(options.isNotNull(), F.when(h < int(share * 1_000_000), new).otherwise(x)).otherwise(x)

    return F.array_join(F.transform(parts, swap), "")


def _changed(new: Column, old: Column) -> Column:
    return text.named(new, lambda x: F.when(x != old, x))


def shuffled_blocks(docs: DataFrame, *keep: str, block: int = 4, seed: int = 0, changed: bool = True) -> DataFrame:
    """(keep..., text): lines of each full block in an order keyed by the first of ``keep``.

    Texts of under ``block`` lines or without change leave, or stay as they are where not only the ``changed`` ones are asked for.
    """
    rows = once(docs, text.stripped_lines(F.col("text"), fed_only=True), *keep, "text", name="lines")
    rows = once(rows, _reordered(F.col("lines"), keep[0], block, seed), *keep, "text", "lines", name="new").withColumn("other", (F.size("lines") >= block) & (F.col("new") != F.col("lines")))
    rows = rows.where("other") if changed else rows
    return rows.select(*keep, F.when(F.col("other"), F.array_join("new", "\n")).otherwise(F.col("text")).alias("text"))


def full_chunks(docs: DataFrame, group: str, order: str, size: int = 8) -> DataFrame:
    """(group, order, chunk, lines): full chunks of ``size`` lines, each with its own lines only."""
    lines = text.stripped_lines(F.col("text"), fed_only=True)
    n = F.floor(F.size("_l") / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(group, order, lines.alias("_l")).select(group, order, F.posexplode(F.transform(starts, lambda i: F.slice("_l", i * size + 1, size))))
    return cut.toDF(group, order, "chunk", "lines")


def recombined(docs: DataFrame, group: str, order: str, draws: DataFrame | None = None, size: int = 8, seed: int = 0) -> DataFrame:
    """(group, draw, text): two full chunks of a group a draw, of different texts where it has them, else any two; groups of one chunk have none.

    ``draws`` (group, draw), or one a group. Chunks are numbered by (order, chunk), so those of a text lie together: the first is
    drawn from all, the second from what is left of them. Chunks are numbered and drawn without their lines, which meet the draws
    in one join; no group is collected. Texts that share an id are told apart by a hash of the chunk.
    """
    cut = full_chunks(docs, group, order, size).withColumn("_t", F.xxhash64("lines"))
    found = stash(cut.select(group, order, "chunk", "_t"), "chunks")
    rows = stash(numbered(found, group, order, "chunk", "_t").select(group, order, "chunk", "_t", (F.col("_no") - 1).alias("j"), F.col("_all").alias("m")), "numbered")
    own = rows.groupBy(group, order).agg(F.min("j").alias("s"), F.count("*").alias("c"))
    if draws is None:
        draws = rows.select(group).distinct().withColumn("draw", F.lit(0).cast("long"))
    sizes = rows.groupBy(group).agg(F.first("m").alias("m")).where("m >= 2")
    same = lambda x, y: x[group].eqNullSafe(y[group])
    ref = lambda side: F.struct(F.lit(side).alias("side"), F.col(order).alias("o"), F.col("chunk").alias("c"), F.col("_t").alias("t"))
    one = draws.join(sizes, same(draws, sizes)).select(draws[group].alias("g"), "draw", "m").withColumn("j1", F.pmod(keyed(seed, "g", "draw"), F.col("m")))
    a = one.join(rows.drop("m"), F.col("g").eqNullSafe(F.col(group)) & (F.col("j1") == F.col("j"))).select("g", "draw", "m", "j1", F.col(order).alias("o"), ref(0).alias("left"))
    own = own.toDF("og", "oo", "s", "c")
    a = a.join(own, F.col("g").eqNullSafe(F.col("og")) & F.col("o").eqNullSafe(F.col("oo"))).drop("og", "oo")
    alone = F.col("m") == F.col("c")
    first, width = F.when(alone, F.col("j1")).otherwise(F.col("s")), F.when(alone, 1).otherwise(F.col("c"))
    r = F.pmod(keyed(seed + 1, "g", "draw"), F.col("m") - width)
    a = a.withColumn("j2", F.when(r < first, r).otherwise(r + width))
    b = rows.select(F.col(group).alias("bg"), "j", ref(1).alias("right"))
    drawn = a.join(b, F.col("g").eqNullSafe(F.col("bg")) & (F.col("j2") == F.col("j"))).select("g", "draw", F.explode(F.array("left", "right")).alias("x"))
    at = F.col("g").eqNullSafe(F.col(group)) & F.col("x.o").eqNullSafe(F.col(order)) & (F.col("x.c") == F.col("chunk")) & (F.col("x.t") == F.col("_t"))
    both = drawn.join(cut, at).select("g", "draw", "x.side", F.array_join("lines", "\n").alias("text"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("text")))
    return both.groupBy(F.col("g").alias(group), "draw").agg(F.concat_ws("\n", side(0), side(1)).alias("text"))


def swapped_synonyms(docs: DataFrame, *keep: str, table: dict[str, list[str]] | None = None, share: float = 0.3, seed: int = 0) -> DataFrame:
    """(keep..., text): each word of the table replaced with probability ``share``, keyed by the first of ``keep``; swaps don't cascade; unchanged texts leave."""
    out = once(docs.where(F.col("text").isNotNull()), _swapped(F.col("text"), keep[0], table, share, seed), *keep, "text", name="new")
    return out.where("new <> text").select(*keep, F.col("new").alias("text"))


def augmented(docs: DataFrame, group: str = "source", order: str = "doc_id", multiplier: int = 3, seed: int = 0, table: dict[str, list[str]] | None = None) -> DataFrame:
    """(pass_no, group, text): towards ``multiplier`` times the originals, each text once, the earliest pass first.

    Originals (0), one shuffled (1), swapped (2) and split (3) text each; then recombined ones (4) until the target is met or three
    draws for each text of the target have failed; then, where that falls short, swapped and shuffled ones (5). Draws pick a group
    each; those of groups that can't be recombined fail, and count. Texts without lines leave first.

    Only hashes of the new texts are written and compared; what is left is worked out again from the originals, which are shuffled
    once. Recombined texts, of two joins, are written. Of rows that are the same in all columns one is left.
    """
    rows = docs.select(order, group, "text").where(text.strip(F.coalesce("text", F.lit(""))) != "")
    sha = lambda c: F.unhex(F.sha2(c, 256))
    whose = F.col(group).cast("string")
    whole = F.concat(F.coalesce(F.col(order).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.length(whose), F.lit(-1)).cast("string"), F.lit("|"), F.coalesce(whose, F.lit("")), "text")
    rows = once(rows, sha(whole), order, group, "text", name="_id")
    own, number = F.col("text"), F.col(order).cast("long").alias("_o")
    made = {0: own, 1: _shuffled(own, order, seed=seed), 2: _changed(_swapped(own, order, table, 0.3, seed), own), 3: text.bar_split(own)}

    def worked_out(df: DataFrame, made: dict[int, Column], *keep: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(n).alias("pass_no"), new.alias("text")) for n, new in made.items()])
        return df.select(*keep, F.explode_outer(each).alias("_x")).select(*keep, "_x.pass_no", "_x.text").where("text is not null")

    keys = stash(worked_out(rows, made, order, group, "_id").select("pass_no", group, number, "_id", sha("text").alias("_k")), "keys")
    n, short = keys.agg(F.count_if(F.col("pass_no") == 0), F.count("*")).first()
    short = n * multiplier - short
    every, mixed = keys.drop(group), None
    if short > 0:
        able = full_chunks(rows, group, order).groupBy(group).count().where("count >= 2").select(group)
        names = keys.select(group).distinct().withColumn("_h", keyed(seed + 8, group)).withColumn("_one", F.lit(0))
        names = stash(numbered(names, "_one", "_h", group).select(group, "_no"), "groups")
        fits = names.join(able.toDF("_able"), F.col(group).eqNullSafe(F.col("_able")), "left_semi")
        tries = rows.sparkSession.range(3 * n * multiplier).withColumn("_no", F.pmod(keyed(seed + 2, "id"), F.lit(names.count())) + 1)
        hits = stash(tries.join(fits, "_no").select(group, F.col("id").alias("draw"), F.lit(0).alias("_one")), "hits")
        draws = stash(numbered(hits, "_one", "draw").where(F.col("_no") <= short).select(group, "draw"), "draws")
        mixed = stash(recombined(rows, group, order, draws, seed=seed + 3).withColumn("_k", sha("text")), "mixed")
        every = every.unionByName(mixed.select(F.lit(4).alias("pass_no"), F.col("draw").alias("_o"), F.lit(None).cast("binary").alias("_id"), "_k"))
        short -= draws.count()
    if short > 0:
        more = _changed(_swapped(own, order, table, 0.5, seed + 5), own)
        made[5] = text.named(more, lambda new: F.coalesce(_shuffled(new, order, seed=seed + 6), new))
        more = stash(worked_out(rows, {5: made[5]}, order, "_id").select("pass_no", order, number, "_id", sha("text").alias("_k")), "more")
        more = numbered(more.withColumn("_h", keyed(seed + 7, order)).withColumn("_one", F.lit(0)), "_one", "_h", order, "_id").where(F.col("_no") <= short)
        every = every.unionByName(more.select("pass_no", "_o", "_id", "_k"))
    first = every.groupBy("_k").agg(F.min(F.struct("pass_no", "_o", "_id")).alias("_x")).select("_x.*")
    kept = first.where("pass_no <> 4").groupBy("_id").agg(F.collect_set("pass_no").alias("_kept"))
    left = rows.join(kept, "_id").withColumn("_no", F.row_number().over(Window.partitionBy("_id").orderBy("_id"))).where("_no = 1")
    out = worked_out(left, {n: F.when(F.array_contains("_kept", n), new) for n, new in made.items()}, group).select("pass_no", group, "text")
    if mixed is None:
        return out
    drawn = mixed.join(first.where("pass_no = 4").select(F.col("_o").alias("draw")), "draw", "left_semi")
    return out.unionByName(drawn.select(F.lit(4).alias("pass_no"), group, "text"))


def interleaved(verses: DataFrame, words: DataFrame, order: str, share: float = 0.25, block: int = 50, seed: int = 0) -> DataFrame:
    """(order, part, text): verses in order, some followed by the next block of dictionary words, a share of all parts.

    ``words`` (rank from 0, word). Which verses are followed is a keyed draw; blocks are given out in order of their draws while there
    are any, at most ``floor(verses * share / (1 - share))``.
    """
    n = verses.count()
    most = int(n * share / (1 - share))
    blocks = words.groupBy(F.floor(F.col("rank") / block).cast("long").alias("b")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("text"))
    drawn = verses.where(F.pmod(keyed(seed, order), F.lit(1_000_000)) < int(share * 1_000_000)).select(order, F.lit(0).alias("_one"))
    ranked = numbered(drawn, "_one", order).select(order, (F.col("_no") - 1).alias("b")).where(F.col("b") < most)
    inserted = ranked.join(blocks, "b").select(order, F.lit(1).alias("part"), "text")
    return verses.select(order, F.lit(0).alias("part"), "text").unionByName(inserted)
