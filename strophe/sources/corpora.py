"""Readers and writers: schemas are explicit, missing columns take defaults."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.following import numbered
from ..operators.lines import exact_dedup

CHUNK = "artist string, title string, text string, chunk_id int, rhyme_scheme string, end_suffixes array<string>"
PROFILE = (
    "artist string, dominant_scheme string, scheme_distribution map<string,double>, scheme_confidence double, scheme_confidence_named double, scheme_window_count int, "
    "scheme_named_count int, avg_syllables double, syllable_stddev double, avg_line_length_chars double, rhyme_density double, contraction_rate double, total_lines int, signature_words array<string>"
)
SONG = "artist string, title string, lyrics string"


def read_lyrics(spark: SparkSession, path: str, column: str = "artist_verses") -> DataFrame:
    """(artist, text) of a CSV with quoted line ends; rows without text leave, a missing artist column is ``unknown``."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    artist = F.col("artist") if "artist" in df.columns else F.lit("unknown")
    return df.select(artist.alias("artist"), F.col(column).alias("text")).where("text is not null")


def read_training_lyrics(spark: SparkSession, path: str, column: str = "artist_verses") -> DataFrame:
    return read_lyrics(spark, path, column).where(F.length("text") > 50)


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """Rows with an artist and a cleaned text, neither empty."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    return df.where("lyrics_clean <> '' and artist <> ''")


def write_lyrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_songs(spark: SparkSession, pattern: str, stream: bool = False) -> DataFrame:
    """Songs of JSON arrays, a file an artist; missing names become Unknown and Untitled, missing lyrics empty. Of a torn file no song is taken."""
    torn = "_torn string"
    df = (spark.readStream if stream else spark.read).schema(f"{SONG}, {torn}").json(pattern, multiLine=True, columnNameOfCorruptRecord="_torn")
    return df.where("_torn is null").select(F.coalesce("artist", F.lit("Unknown")).alias("artist"), F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("lyrics", F.lit("")).alias("lyrics"))


def read_index_rows(spark: SparkSession, path: str, column: str = "lyrics_clean", artist: str = "artist", title: str | None = None) -> DataFrame:
    """(artist, title, text) of a CSV to index: without a title column, ``Track n`` with n the row's place in its file from 0.

    A missing artist is Unknown. Texts of under 50 characters leave, but count for n.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')
    name = F.coalesce(F.col(artist), F.lit("Unknown")) if artist in df.columns else F.lit("Unknown")
    if title in df.columns:
        rows = df.select(name.alias("artist"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.col(column).alias("text"))
    else:
        rows = df.select(name.alias("artist"), F.col(column).alias("text"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        rows = numbered(rows, "_file", "_at").select("artist", F.concat(F.lit("Track "), (F.col("_no") - 1).cast("string")).alias("title"), "text")
    return rows.where(F.length("text") >= 50)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant, phones) of a pronouncing dictionary in text form: ``WORD(1)  P1 P2 ...``; ``;;;`` starts a comment."""
    rows = spark.read.text(path).where(~F.col("value").startswith(";;;") & (F.trim("value") != ""))
    head = F.regexp_extract("value", r"^(\S+)", 1)
    variant = F.regexp_extract(head, r"\((\d+)\)$", 1)
    phones = F.split(F.trim(F.regexp_replace(F.regexp_extract("value", r"^\S+\s+(.*)$", 1), r"\s+#.*$", "")), r"\s+")
    return rows.select(F.lower(F.regexp_replace(head, r"\(\d+\)$", "")).alias("word"), F.when(variant == "", 0).otherwise(F.expr(f"try_cast(regexp_extract(regexp_extract(value, r'^(\\S+)', 1), r'\\((\\d+)\\)$', 1) as int)")).alias("variant"), phones.alias("phones"))


def dictionary(lexicon: DataFrame, english: DataFrame, most: int = 15, other: int = 12) -> DataFrame:
    """(word, origin): lexicon words of 2 to ``most`` letters, then English words of 2 to ``other`` that the lexicon lacks."""
    known = lexicon.select("word").distinct()
    first = known.where(F.length("word").between(2, most)).withColumn("origin", F.lit(0))
    rest = english.select(F.lower("word").alias("word")).distinct().where(F.length("word").between(2, other)).join(known, "word", "left_anti")
    return first.unionByName(rest.withColumn("origin", F.lit(1)))


def write_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors); columns that an older index lacks take defaults."""
    chunks = spark.read.option("mergeSchema", "true").parquet(f"{path}/chunks")
    for name, default in (("rhyme_scheme", F.lit("unknown")), ("end_suffixes", F.lit(None).cast("array<string>"))):
        chunks = chunks.withColumn(name, F.coalesce(F.col(name), default) if name in chunks.columns else default)
    return chunks, spark.read.parquet(f"{path}/vectors")


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("overwrite").json(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def profile_of(profiles: DataFrame, artist: str) -> DataFrame:
    """The profile named exactly so, else one that differs in case only."""
    hit = profiles.where(F.lower("artist") == artist.lower())
    return hit.orderBy((F.col("artist") != artist).cast("int"), "artist").limit(1)


def write_tokenizer(spark: SparkSession, merges: list[tuple[str, str]], vocab: dict[str, int], path: str) -> None:
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string").write.mode("overwrite").json(f"{path}/merges")
    spark.createDataFrame(sorted(vocab.items()), "token string, id int").write.mode("overwrite").json(f"{path}/vocab")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    merges = spark.read.schema("rank int, left string, right string").json(f"{path}/merges").orderBy("rank").collect()
    return [(r.left, r.right) for r in merges], {r.token: r.id for r in spark.read.schema("token string, id int").json(f"{path}/vocab").collect()}


def scraped_union(sources: list[DataFrame], most: int | None = None) -> DataFrame:
    """Songs (title, lyrics, pos) of sources in order of priority: texts over 100 characters, the first of each title key."""
    out = None
    for rank, df in enumerate(sources):
        part = df.select(F.lit(rank).alias("source_rank"), "pos", "title", "lyrics").where(F.length("lyrics") > 100)
        out = part if out is None else out.unionByName(part)
    first = out.groupBy(text.title_key(F.col("title")).alias("k")).agg(F.min(F.struct("source_rank", "pos", "title", "lyrics")).alias("x")).select("x.*")
    return first if most is None else first.orderBy("source_rank", "pos").limit(most)


def without_versions(songs: DataFrame) -> DataFrame:
    """Titles that name a remix, live, demo or skit version leave."""
    return songs.where(~F.col("title").rlike("Remix|Live|Demo|Skit"))


def training_corpus(songs: DataFrame, group: str, order: str) -> DataFrame:
    """(group, part_no, text): the texts of each group in order, a blank line after each but the last; a row a text, so no group is one row."""
    rows = numbered(songs.select(group, order, "text"), group, order, "text")
    return rows.select(group, F.col("_no").alias("part_no"), F.concat("text", F.when(F.col("_no") < F.col("_all"), "\n\n").otherwise("")).alias("text"))


def built_dataset(songs: DataFrame, order: str, *keep: str) -> DataFrame:
    """(order, keep..., lyrics): songs (.., lyrics) cleaned, each text once, the first by ``order``, those of over 100 characters."""
    rows = songs.select(order, *keep, text.clean_page(F.coalesce("lyrics", F.lit(""))).alias("lyrics"))
    return exact_dedup(rows, "lyrics", order).where(F.length("lyrics") > 100)


def songs_of(corpus: DataFrame, artist: str, order: str) -> DataFrame:
    """(artist, title, lyrics): an artist's texts (artist, text) of over 100 characters, whatever the case of the name, as Track 1, 2, .. by ``order``."""
    rows = corpus.where((F.lower("artist") == artist.lower()) & (F.length("text") > 100))
    rows = numbered(rows.withColumn("_one", F.lit(0)), "_one", order)
    return rows.select(F.lit(artist).alias("artist"), F.concat(F.lit("Track "), F.col("_no").cast("string")).alias("title"), text.clean_page(F.col("text")).alias("lyrics"))


def existing_songs(artist: str, *corpora: DataFrame, order: str) -> DataFrame:
    """``songs_of`` the first of ``corpora`` (cleaned, then raw) that has a row of the artist, whatever the case; of the last where none has."""
    for corpus in corpora[:-1]:
        if corpus.where(F.lower("artist") == artist.lower()).head(1):
            return songs_of(corpus, artist, order)
    return songs_of(corpora[-1], artist, order)


def cached_songs(spark: SparkSession, artist: str, folder: str, fetch: Callable[[str], DataFrame]) -> DataFrame:
    """(artist, title, lyrics) of ``folder``'s table for the artist; where it has none, what ``fetch`` gives, which is kept there unless empty."""
    path = f"{folder}/{re.sub('[^a-z0-9]+', '_', artist.lower()).strip('_')}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    kept = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done) or []
    if len(kept):
        return spark.read.schema(SONG).parquet(min(f.getPath().getParent().toString() for f in kept))
    songs = fetch(artist).select("artist", "title", "lyrics")
    if not songs.head(1):
        return songs
    path = f"{path}/{uuid.uuid4().hex}"  # two drivers may fetch at once: neither overwrites what the other reads
    songs.write.parquet(path)
    return spark.read.schema(SONG).parquet(path)


def read_synonyms(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A table of replacements from JSON lines (word, replacements): a vocabulary's worth, so it travels inside expressions."""
    rows = spark.read.schema("word string, replacements array<string>").json(path).where(F.size("replacements") > 0)
    return {r.word.lower(): list(r.replacements) for r in rows.collect()}
