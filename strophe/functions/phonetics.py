"""Suffixes and syllables. A lexicon (word, variant, phones) is a table; without one, spelling stands in for sound.

No pronouncing dictionary comes with this package. ``spelled_suffix`` is a substitute: the last run of vowel letters and what
follows it. It is used wherever no lexicon is passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The phoneme inventory.
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
CONSONANTS = ("B", "CH", "D", "DH", "F", "G", "HH", "JH", "K", "L", "M", "N", "NG", "P", "R", "S", "SH", "T", "TH", "V", "W", "Y", "Z", "ZH")


def phonemes(spark) -> DataFrame:
    """(symbol, id, is_vowel): padding is 0, then all phonemes by name, a vowel once for each stress."""
    rows = [("<PAD>", False)]
    for p in sorted(VOWELS + CONSONANTS):
        rows += [(f"{p}{s}", True) for s in (0, 1, 2)] if p in VOWELS else [(p, False)]
    return spark.createDataFrame([(s, i, v) for i, (s, v) in enumerate(rows)], "symbol string, id int, is_vowel boolean")


def spelled_suffix(word: Column) -> Column:
    return F.nullif(F.regexp_extract(word, "([aeiouy]+[^aeiouy]*)$", 1), F.lit(""))


def spelled_syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("[aeiouy]+"))).cast("int")


def phone_suffix(phones: Column) -> Column:
    """From the last phone with a stress digit to the end; null without one."""
    marked = F.transform(phones, lambda p, i: F.when(p.rlike("[0-9]"), i + 1))
    at = F.array_max(marked)
    return F.when(at.isNotNull(), F.array_join(F.slice(phones, at, F.size(phones)), " "))


def phone_syllables(phones: Column) -> Column:
    return F.size(F.filter(phones, lambda p: p.rlike("[0-9]")))


def strip_stress(phone: Column) -> Column:
    return F.regexp_replace(phone, "[0-9]", "")


def pronounced(lexicon: DataFrame) -> DataFrame:
    """(word, suffix, syllables) of each word's first pronunciation, worked out once a word."""
    first = lexicon.where(F.col("variant") == 0)
    return first.select("word", phone_suffix(F.col("phones")).alias("suffix"), phone_syllables(F.col("phones")).alias("syllables"))


def words_rhyme(word: Column, other: Column, suffix: Column, other_suffix: Column) -> Column:
    """Equal known suffixes of different words."""
    return F.coalesce((suffix == other_suffix) & (F.lower(word) != F.lower(other)), F.lit(False))


def syllable_bucket(n: Column) -> Column:
    return F.when(n <= 6, 0).when(n <= 9, 1).when(n <= 12, 2).when(n <= 15, 3).otherwise(4)


def line_syllables(line: Column) -> Column:
    """Syllables of a line by spelling: its runs of vowels, as none crosses a blank, and one for each word without a vowel."""
    low = F.lower(line)
    return (F.regexp_count(low, F.lit("[aeiouy]+")) + F.regexp_count(low, F.lit(r"(?<!\S)[^aeiouy\s]++(?!\S)"))).cast("int")
