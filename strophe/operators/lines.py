"""The line table, cleaning of whole corpora, dedup, chunks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.scheme import classify, window_schemes
from ..stash import discard, stash
from .following import with_following


def line_table(docs: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """(keep..., line_no, line): a row for each line of the array ``lines``, numbered from 0."""
    return docs.select(*keep, F.posexplode(lines).alias("line_no", "line"))


def once(docs: DataFrame, new: Column, *keep: str, name: str = "text") -> DataFrame:
    """(keep..., name): ``new`` of each row, worked out once where conditions on it follow: a filter is pushed below a projection and
    works it out again, but not below an explosion."""
    return docs.select(*keep, F.explode_outer(F.array(new)).alias(name))


def line_suffixes(lines: Column) -> Column:
    """Rhyme suffix of each line of an array, by spelling."""
    return F.transform(lines, lambda x: phonetics.spelled_suffix(text.end_word(x)))


def join_suffixes(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``lines`` (.., line) with end_word, suffix and syllables from a lexicon; unknown words have null. Spark broadcasts a lexicon whose size allows it."""
    known = phonetics.pronounced(lexicon).withColumnRenamed("word", "_word")
    return lines.withColumn("end_word", text.end_word(F.col("line"))).join(known, F.col("end_word") == F.col("_word"), "left").drop("_word")


def suffixes_of_lines(docs: DataFrame, lexicon: DataFrame, lines: Column, *keep: str) -> DataFrame:
    """(keep..., suffixes): the lexicon's suffix of each line's end word, null where it has none; a text without lines has no row."""
    rows = join_suffixes(line_table(docs, lines, *keep), lexicon)
    got = rows.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("line_no", "suffix"))).alias("_x"))
    return got.select(*keep, F.col("_x.suffix").alias("suffixes"))


def syllables_of_lines(lines: DataFrame, lexicon: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no, syllables) of ``lines`` (keep..., line_no, line): the lexicon's count of each word, by spelling where it has none."""
    known = phonetics.pronounced(lexicon).select(F.col("word").alias("_word"), F.col("syllables").alias("_n"))
    rows = lines.select(*keep, "line_no", F.explode_outer(text.words(F.col("line"))).alias("_w")).withColumn("_w", text.bare_word(F.col("_w")))
    n = F.when(F.col("_w").isNull(), 0).otherwise(F.coalesce("_n", phonetics.spelled_syllables(F.col("_w"))))
    return rows.join(known, F.col("_w") == F.col("_word"), "left").groupBy(*keep, "line_no").agg(F.sum(n).alias("syllables"))


def _page(docs: DataFrame, name: str, *keep: str) -> DataFrame:
    """``keep`` and the cleaned lines of each text, null where they have 100 characters or fewer; a condition here, not a filter, so that texts are cut once."""
    cut = docs.select(*keep, text.page_lines(F.col("text")).alias(name))
    return cut.withColumn(name, F.when(F.length(F.array_join(name, "\n")) > 100, F.col(name)))


def spam_lines(docs: DataFrame, least: int = 5) -> DataFrame:
    """(line, n): cleaned lines that occur at least ``least`` times in cleaned texts of over 100 characters."""
    return _frequent(_page(docs, "lines"), least)


def _frequent(cut: DataFrame, least: int) -> DataFrame:
    each = cut.select(F.explode_outer("lines").alias("line")).where("line is not null")  # a filter on the array would cut the texts again
    return each.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without_spam(docs: DataFrame, least: int = 5, small: int = 500) -> DataFrame:
    """(doc_id, source, text): cleaned texts without spam lines, over 100 characters before and after.

    Each row stays a row, repeated ones too. Texts are cleaned once and written; spam is counted once. The spam set travels to the texts as one
    array while it has at most ``small`` lines, and only texts that hold one of them are gone through; a larger one meets the lines of the
    rows in an anti join. Lines themselves are compared both ways.
    """
    rows = stash(_page(docs.withColumn("row", F.monotonically_increasing_id()), "lines", "row", "doc_id", "source"), "cleaned").where("lines is not null")
    spam = stash(_frequent(rows, least).select("line"), "spam")
    if spam.count() <= small:
        one = spam.agg(F.collect_list("line").alias("spam"))
        left = F.filter("lines", lambda x: ~F.array_contains(F.col("spam"), x))
        out = rows.join(F.broadcast(one)).select("doc_id", "source", F.when(F.arrays_overlap("lines", "spam"), left).otherwise(F.col("lines")).alias("lines"))
    else:
        each = line_table(rows, F.col("lines"), "row", "doc_id", "source").join(spam, "line", "left_anti")
        out = each.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines")).withColumn("lines", F.col("lines.line"))
    return out.select("doc_id", "source", F.array_join("lines", "\n").alias("text")).where(F.length("text") > 100)


def exact_dedup(docs: DataFrame, key: Column | str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each key, by ``order``, nulls last; a null key is a key. Rows equal in both become one.

    Partial aggregation on a hash finds the winners, which the rows then meet by key and order.
    """
    key = F.col(key) if isinstance(key, str) else key
    name = "_key" + "_" * max(map(len, docs.columns))  # no column of the caller's
    named = docs.withColumn(name, F.sha2(key, 256))
    first = named.groupBy(F.col(name).alias(f"{name}k")).agg(F.min(order).alias(f"{name}first"))
    won = named.join(first, F.col(name).eqNullSafe(F.col(f"{name}k")) & F.col(order).eqNullSafe(F.col(f"{name}first")), "left_semi")
    if named.groupBy(name, order).agg(F.count("*").alias(f"{name}n")).where(F.col(f"{name}n") > 1).head(1):
        won = won.dropDuplicates([name, order])
    return won.drop(name)


def chunks(docs: DataFrame, lines: Column, size: int, stride: int, least: int, *keep: str) -> DataFrame:
    """(keep..., chunk_id, lines): windows of ``size`` lines every ``stride``, the last ones shorter, of at least ``least``."""
    n = F.size("_lines")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(*keep, lines.alias("_lines"))
    cut = cut.select(*keep, F.posexplode(F.transform(starts, lambda i: F.slice("_lines", i + 1, size))).alias("chunk_id", "lines"))
    return cut.where(F.size("lines") >= least)


def verse_chunks(docs: DataFrame, *keep: str, size: int = 16, least: int = 8) -> DataFrame:
    return chunks(docs, text.verse_lines(F.col("text")), size, size, least, *keep)


def index_chunks(docs: DataFrame, *keep: str, size: int = 16, least: int = 4) -> DataFrame:
    """Half overlapping chunks with their first window's scheme and end suffixes."""
    out = chunks(docs.where(F.length("text") >= 50), text.style_lines(F.col("text")), size, size // 2, least, *keep)
    out = out.withColumn("end_suffixes", line_suffixes(F.slice("lines", 1, 4)))
    return out.withColumn("rhyme_scheme", classify(*(F.get("end_suffixes", k) for k in range(4))))


def with_vocabulary_ids(rows: DataFrame, column: str, vocab: DataFrame) -> DataFrame:
    """``rows`` with ``id`` of ``vocab`` (column, id): 0 for what it lacks, null too."""
    return rows.join(vocab.toDF("_v", "id"), F.col(column) == F.col("_v"), "left").drop("_v").withColumn("id", F.coalesce("id", F.lit(0)))


def style_texts(docs: DataFrame) -> DataFrame:
    """(source, doc_id, lines) of texts of 50 or more characters, cut once and written: what reads them goes on from there."""
    return stash(docs.where(F.length("text") >= 50).select("source", "doc_id", text.style_lines(F.col("text")).alias("lines")), "lines")


def suffix_docs(docs: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(source, doc_id, suffixes) of texts of 50 or more characters, by ``lexicon`` or, without one, by spelling."""
    if lexicon is not None:
        return suffixes_of_lines(docs.where(F.length("text") >= 50), lexicon, text.style_lines(F.col("text")), "source", "doc_id")
    return docs.where(F.length("text") >= 50).select("source", "doc_id", line_suffixes(text.style_lines(F.col("text"))).alias("suffixes"))


def followed_suffixes(suffixes: DataFrame, parts: int | None = None) -> DataFrame:
    """(source, s): the suffixes of each text of ``suffixes`` (source, doc_id, suffixes) and the three after it in its source, in order of doc_id.

    Suffixes are written first, as ranges, filters and windows would each work them out again, and so is what windows make of them.
    """
    held = stash(suffixes, "suffixes")
    rows = with_following(held, "source", "doc_id", "suffixes", 3, "after", parts).select("source", F.concat("suffixes", "after").alias("s"))
    rows = stash(rows, "followed")
    discard(held)
    return rows


def windows_of(followed: DataFrame) -> DataFrame:
    """(source, scheme) of each run of four in ``followed`` (source, s)."""
    return followed.select("source", F.explode(window_schemes(F.col("s"))).alias("scheme"))


def scheme_windows(docs: DataFrame, parts: int | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(source, scheme): each run of four lines of a source's texts in order of doc_id; runs cross from text to text."""
    return windows_of(followed_suffixes(suffix_docs(docs, lexicon), parts))


def pairs_of(followed: DataFrame) -> DataFrame:
    """(source, pairs, rhymes) of ``followed`` (source, s): a pair counts in each run of four that holds it, so by its place, three times at most."""
    n = F.size("s")
    near = F.arrays_zip(F.slice("s", 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("s", 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    runs = lambda i: F.least(i, n - 4) - F.greatest(i - 2, F.lit(0)) + 1

    def count(test):
        return F.aggregate(F.transform(near, lambda x, i: F.when(test(x["a"], x["b"]), runs(i)).otherwise(0)), F.lit(0), lambda s, x: s + x)

    known = F.when(n >= 4, count(lambda a, b: a.isNotNull() & b.isNotNull())).otherwise(0)
    same = F.when(n >= 4, count(lambda a, b: F.coalesce(a == b, F.lit(False)))).otherwise(0)
    return followed.select("source", known.alias("pairs"), same.alias("rhymes")).groupBy("source").agg(F.sum("pairs").alias("pairs"), F.sum("rhymes").alias("rhymes"))


def adjacent_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(source, pairs, rhymes): adjacent known suffixes inside every run of four lines of a source, an inner pair up to three times."""
    return pairs_of(followed_suffixes(suffix_docs(docs), parts))


def artist_starters(docs: DataFrame, most: int = 50) -> DataFrame:
    """(source, starter_no, starter): first 40 characters of every sixteenth line of over ten and under 80 characters, once a source."""
    lines = F.filter(text.stripped_lines(F.col("text")), lambda x: F.length(x) > 10)
    rows = line_table(docs, lines, "source", "doc_id").where("line_no % 16 = 0 and length(line) < 80")
    rows = rows.select("source", "doc_id", "line_no", F.substring("line", 1, 40).alias("starter"))
    once = rows.groupBy("source", F.lower("starter").alias("k")).agg(F.min(F.struct("doc_id", "line_no", "starter")).alias("x"))
    by = Window.partitionBy("source").orderBy("x.doc_id", "x.line_no")
    return once.withColumn("starter_no", F.row_number().over(by)).where(F.col("starter_no") <= most).select("source", "starter_no", F.col("x.starter").alias("starter"))
