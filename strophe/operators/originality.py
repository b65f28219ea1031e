"""Copied lines, near copies and continuations of a training text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..stash import stash
from .tokenizers import _codes, characters

SIMILAR = 0.85
#: Counts of substrings by hash that order them, rarest first.
BUCKETS = 65_536


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def training_lines(corpus: DataFrame) -> DataFrame:
    """(line): distinct lower-cased lines of over 15 characters."""
    lines = F.transform(text.stripped_lines(F.col("text")), F.lower)
    return corpus.select(F.explode(F.filter(lines, lambda x: F.length(x) > 15)).alias("line")).distinct()


def probe_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no, line): lower-cased lines of 15 or more characters."""
    return docs.select(*keep, F.posexplode(F.transform(text.stripped_lines(F.col("text")), F.lower)).alias("line_no", "line")).where(F.length("line") >= 15)


def copied_lines(docs: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """Lines that the corpus has word for word."""
    return probe_lines(docs, *keep).join(training_lines(corpus), "line", "left_semi").select(*keep, "line_no", "line")


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct substrings of ``n`` characters of each text, in that order."""
    codes, lengths = _codes(texts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(max(len(codes) - n + 1, 0))
    at = at[row[at] == row[at + n - 1]]
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = mix(h + codes[at + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    row, order = row[at], np.lexsort((h, row[at]))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(BUCKETS)).astype(np.int64)


def gram_counts(texts: DataFrame, column: str, n: int = 5) -> DataFrame:
    """(bucket, freq): how often substrings of ``n`` characters of each bucket occur, each counted once a row; at most BUCKETS rows."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(_grams(batch.column(0), n)[1]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "freq"])

    return texts.select(column).mapInArrow(run, "bucket long, freq long").groupBy("bucket").agg(F.sum("freq").alias("freq"))


def gram_prefixes(texts: DataFrame, column: str, freq: DataFrame, similar: float, n: int = 5) -> DataFrame:
    """(h, size, gram): of each text, named by its 64-bit hash, the first ``size - ceil(similar * size) + 1`` substrings, those of the rarest
    buckets in ``freq`` first. Substrings are 64-bit hashes. Rows that repeat a text repeat its rows.

    Two texts above ``similar`` share one of them, whatever the order is, so buckets lose nothing and no substring travels to be ordered.
    Substrings of buckets that ``freq`` lacks come first of all and have no row, as nothing shares them; a text with enough of those has no row at all.
    """
    weight = np.zeros(BUCKETS, np.int64)
    for r in freq.collect():  # BUCKETS rows at most
        weight[r.bucket] = r.freq

    def run(batches):
        for batch in batches:
            row, h = _grams(batch.column(1), n)
            w = weight[_bucket(h)]
            order = np.lexsort((h, w, row))
            row, h, w = row[order], h[order], w[order]
            size = np.bincount(row, minlength=len(batch))
            place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            keep = (place < (size - np.ceil(similar * size) + 1)[row]) & (w > 0)
            name = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(name[row[keep]]), pa.array(size[row[keep]], pa.int32()), pa.array(h[keep].view(np.int64))], ["h", "size", "gram"])

    return texts.select(F.xxhash64(column).alias("h"), column).mapInArrow(run, "h long, size int, gram long")


def near_copies(docs: DataFrame, corpus: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(line, known_line, similarity): distinct probe lines whose five-character Jaccard with a training line exceeds ``similar``.

    Exact, by prefix (see ``gram_prefixes``): frequent substrings of the training lines come last and so join few lines. Only hashes,
    sizes and single substrings travel; sizes must agree within ``similar``; candidates are verified on whole lines. Equal lines count 1.
    """
    known, probe = training_lines(corpus), stash(probe_lines(docs).select("line").distinct(), "lines")
    freq = stash(gram_counts(known, "line"), "grams")
    ours = gram_prefixes(known, "line", freq, similar).toDF("k", "known_size", "gram")
    met = gram_prefixes(probe, "line", freq, similar).join(ours, "gram")
    met = met.where((F.col("size") >= similar * F.col("known_size")) & (F.col("known_size") >= similar * F.col("size"))).select("h", "k").distinct()
    met = met.join(known.select(F.xxhash64("line").alias("k"), F.col("line").alias("known_line")), "k").join(probe.select(F.xxhash64("line").alias("h"), "line"), "h")
    a, b = (F.array_distinct(text.char_ngrams(F.col(c), 5)) for c in ("line", "known_line"))
    met = met.withColumn("_a", a).withColumn("_b", b).withColumn("_i", F.size(F.array_intersect("_a", "_b")))
    met = met.withColumn("similarity", F.col("_i") / (F.size("_a") + F.size("_b") - F.col("_i")))
    return met.where(F.col("similarity") > similar).select("line", "known_line", "similarity")


def continuations(corpus: DataFrame, n: int = 25) -> DataFrame:
    """(prefix, next_chars): for each run of ``n`` characters of a text the sorted set of what follows it.

    Windows slide over the text's characters inside its row, in time proportional to it; a row of them carries no text.
    """
    chars = corpus.select(characters(F.col("text")).alias("c")).where(F.size("c") > n)
    window = lambda i: F.struct(F.array_join(F.slice("c", i, n), "").alias("prefix"), F.element_at("c", i + n).alias("c"))
    rows = chars.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - n), window)).alias("x")).select("x.*")
    return rows.groupBy("prefix").agg(F.sort_array(F.collect_set("c")).alias("next_chars"))


def blocked(docs: DataFrame, index: DataFrame, *keep: str, n: int = 25) -> DataFrame:
    """(keep..., blocked): characters that would continue a training run after each text; none for a short text."""
    probe = docs.withColumn("prefix", F.when(F.length("text") >= n, F.expr(f"right(text, {n})")))
    return probe.join(index, "prefix", "left").select(*keep, F.coalesce("next_chars", F.array().cast("array<string>")).alias("blocked"))


def penalised(logit: Column, is_blocked: Column, penalty: float = 10.0) -> Column:
    return F.when(is_blocked, logit - penalty).otherwise(logit)
