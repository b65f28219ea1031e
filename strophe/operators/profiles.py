"""Style profiles of sources and signature words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.phonetics import line_syllables
from ..functions.scheme import NAMED
from ..stash import discard, stash
from . import lines as L

# Words that never sign, and English stop words of four or more letters.
NEVER = (
    "verse", "chorus", "intro", "outro", "bridge", "hook", "skit", "feat", "remix", "produced", "interlude", "instrumental",
    "yeah", "yo", "uh", "ooh", "huh", "ay", "aye", "haha", "uhh", "woah", "oooh", "ahh", "eyh", "yuh", "hol", "hmm", "wha",
    "like", "just", "got", "one", "know", "get", "going", "cause", "that", "this", "with", "they", "them", "your", "youre",
    "from", "have", "what", "when", "where", "than", "then", "now", "all",
)
STOP = (
    "about above across after afterwards again against almost alone along already also although always among amongst another anyhow anyone anything "
    "anyway anywhere around back became because become becomes becoming been before beforehand behind being below beside besides between beyond both "
    "bottom call cannot could describe detail done down during each eight either eleven else elsewhere empty enough even ever every everyone everything "
    "everywhere except fifteen fifty fill find fire first five former formerly forty found four from front full further give have hence here hereafter "
    "hereby herein hereupon hers herself himself however hundred indeed interest into itself keep last latter latterly least less made many meanwhile "
    "might mill mine more moreover most mostly move much must myself name namely neither never nevertheless next nine nobody none noone nothing nowhere "
    "often once only onto other others otherwise ours ourselves over part perhaps please rather same seem seemed seeming seems serious several should "
    "show side since sincere sixty some somehow someone something sometime sometimes somewhere still such system take than that their them themselves "
    "then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though three through throughout thru thus "
    "together toward towards twelve twenty under until upon very well were what whatever when whence whenever where whereafter whereas whereby wherein "
    "whereupon wherever whether which while whither whoever whole whom whose will with within without would your yours yourself yourselves"
).split()


def scheme_counts(windows: DataFrame) -> DataFrame:
    """(source, scheme, n) of ``windows`` (source, scheme): a few rows a source."""
    return windows.groupBy("source", "scheme").agg(F.count("*").alias("n"))


def scheme_profile(docs: DataFrame, parts: int | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """(source, dominant_scheme, both confidences, window counts): ties go to the first of AABB, ABAB, ABBA, AAAA."""
    return _scheme_profile(scheme_counts(L.scheme_windows(docs, parts, lexicon)))


def _scheme_profile(counts: DataFrame) -> DataFrame:
    n = counts.groupBy("source").agg(
        F.sum(F.when(F.col("scheme") != "unknown", F.col("n")).otherwise(0)).cast("long").alias("scheme_window_count"), *[F.sum(F.when(F.col("scheme") == s, F.col("n")).otherwise(0)).cast("long").alias(s) for s in NAMED]
    )
    named = sum((F.col(s) for s in NAMED), F.lit(0))
    top = F.greatest(*NAMED)
    dominant = F.lit("free")
    for s in reversed(NAMED):
        dominant = F.when((F.col(s) == top) & (top > 0), s).otherwise(dominant)
    share = lambda whole: F.coalesce(F.round(F.try_divide(top, whole), 3), F.lit(0.0))
    return n.select("source", dominant.alias("dominant_scheme"), share(F.col("scheme_window_count")).alias("scheme_confidence"), share(named).alias("scheme_confidence_named"), "scheme_window_count", named.cast("long").alias("scheme_named_count"))


def scheme_distribution(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(source, scheme, n, share) of classified windows."""
    return _scheme_distribution(scheme_counts(L.scheme_windows(docs, parts)))


def _scheme_distribution(counts: DataFrame) -> DataFrame:
    return counts.where("scheme <> 'unknown'").withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 3))


def line_statistics(docs: DataFrame) -> DataFrame:
    """(source, total_lines, avg_syllables, syllable_stddev, avg_line_length_chars, contraction_rate)."""
    return _line_statistics(docs.where(F.length("text") >= 50).select("source", text.style_lines(F.col("text")).alias("lines")))


def _line_statistics(cut: DataFrame) -> DataFrame:
    rows = cut.select("source", F.explode("lines").alias("line"))
    syl = F.nullif(line_syllables(F.col("line")), F.lit(0))
    rows = rows.select("source", syl.alias("s"), F.length("line").alias("c"), F.size(text.words(F.col("line"))).alias("w"), F.regexp_count("line", F.lit(text.CONTRACTION)).alias("k"))
    return rows.groupBy("source").agg(
        F.count("*").alias("total_lines"),
        F.coalesce(F.round(F.avg("s"), 1), F.lit(0.0)).alias("avg_syllables"),
        F.coalesce(F.round(F.stddev_samp("s"), 2), F.lit(0.0)).alias("syllable_stddev"),
        F.round(F.avg("c"), 1).alias("avg_line_length_chars"),
        F.coalesce(F.round(F.try_divide(F.sum("k"), F.sum("w")), 3), F.lit(0.0)).alias("contraction_rate"),
    )


def signature_words(docs: DataFrame, top: int = 30, features: int = 10_000) -> DataFrame:
    """(source, rank, word, score): sublinear TF-IDF with sources as documents; ties by word.

    Words of four or more letters that at least two and at most half of the sources use; of those, the most frequent ``features``. Texts
    are cut once; the counts of each source's words, which several steps read, are written.
    """
    return _signature_words(docs.where(F.length("text") >= 50).select("source", text.style_lines(F.col("text")).alias("lines")), top, features)


def _signature_words(cut: DataFrame, top: int, features: int) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower(F.array_join("lines", " ")), F.lit(r"[\p{L}\p{N}_]+"), 0)
    # beside the words a null for each text that holds a line: its source counts
    marked = F.concat(F.filter(tokens, lambda w: w.rlike("^[a-z]{4,}$")), F.when(F.size("lines") > 0, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    counted = stash(cut.select("source", F.explode(marked).alias("word")).groupBy("source", "word").agg(F.count("*").alias("tf")), "words")
    tf = counted.where(F.col("word").isNotNull() & ~F.col("word").isin(STOP))
    sources = counted.where("word is null").agg(F.countDistinct("source").alias("all"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).join(F.broadcast(sources)).where("df >= 2 and df <= 0.5 * all")
    df = df.orderBy(F.desc("total"), "word").limit(features)
    scored = tf.join(F.broadcast(df), "word")  # at most ``features`` rows
    scored = scored.withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("all")) / (1 + F.col("df"))) + 1))
    norm = scored.groupBy("source").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    scored = scored.join(norm, "source").withColumn("score", F.round(F.col("raw") / F.col("norm"), 6)).where(~F.col("word").isin(*NEVER))
    by = Window.partitionBy("source").orderBy(F.desc("score"), "word")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("source", "rank", "word", "score")


def style_profiles(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """All profile fields of each source; texts are cut into lines once, and suffixes meet those that follow once."""
    cut = L.style_texts(docs)
    followed = L.followed_suffixes(cut.select("source", "doc_id", L.line_suffixes(F.col("lines")).alias("suffixes")), parts)
    counts = stash(scheme_counts(L.windows_of(followed)), "schemes")
    pairs = stash(L.pairs_of(followed).select("source", F.coalesce(F.round(F.try_divide("rhymes", "pairs"), 3), F.lit(0.0)).alias("rhyme_density")), "pairs")
    discard(followed)
    out = stash(_line_statistics(cut), "statistics")
    sign = _signature_words(cut, 30, 10_000).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("x")).select("source", F.col("x.word").alias("signature_words"))
    discard(cut)  # read: counts of words are written
    dist = _scheme_distribution(counts).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("scheme", "share")))).alias("scheme_distribution"))
    out = out.join(_scheme_profile(counts), "source", "left")
    return out.join(dist, "source", "left").join(pairs, "source", "left").join(sign, "source", "left")
