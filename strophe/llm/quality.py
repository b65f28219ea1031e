"""Operator 9: quality by importance resampling.

Two generative models of hashed n-grams (words and word pairs in ``BUCKETS`` buckets): of target text, a bounded sample of rows labelled
good, and of raw text, every document. A document's weight is the ratio of both models over its n-grams, as a mean log-ratio an n-gram,
so that length alone neither keeps nor drops a text. Gumbel noise keyed by doc_id is added to ``SHARPNESS`` times the weight and the k
largest sums are the sample: sampling without replacement in proportion to the weights.

The k-th largest sum is found by nested histograms of counts; only the rows of the last bin are put in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import stash
from .words import mix, slices, words

BUCKETS = 1 << 16
#: Labelled rows that the target model is fitted on at most, those with the least hash of doc_id.
TARGET_ROWS = 5_000
KEEP = 0.85
SHARPNESS = 1.0
PER_NGRAM = False
_BIN = 4096
_LAST = 10_000


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first) of each text's words and word pairs."""
    w = words(texts)
    n = np.diff(w.first)
    one = w.hashes
    inner = np.ones(len(one), bool)
    inner[w.first[1:][n > 0] - 1] = False  # the last word of a text starts no pair
    at = np.flatnonzero(inner)
    two = mix(one[at] * np.uint64(3) + one[at + 1])
    doc = w.doc()
    order = np.argsort(np.concatenate([doc, doc[at]]), kind="stable")
    feature = (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return feature, np.concatenate([[0], np.cumsum(n + np.maximum(n - 1, 0))])


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for batch in slices(whole):
            total += np.bincount(ngrams(batch["text"])[0], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Corpus counts of each n-gram bucket."""
    found = docs.select("text").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row a bucket
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy(np.int64)] = found["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target by raw probability of each bucket; the target is smoothed towards raw."""
    base = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    prior = 0.05 * max(target.sum(), 1.0)
    return np.log((target + prior * base) / (target.sum() + prior)) - np.log(base)


def _weigh(ratio: np.ndarray, per_ngram: bool):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                feature, first = ngrams(batch["text"])
                total = np.concatenate([[0.0], np.cumsum(ratio[feature])])
                n, weight = np.diff(first), total[first[1:]] - total[first[:-1]]
                yield pa.record_batch([batch["doc_id"], pa.array(n), pa.array(weight / np.maximum(n, 1) if per_ngram else weight)], ["doc_id", "n_ngrams", "log_weight"])

    return run


def kth_largest(rows: DataFrame, key: Column, k: int) -> tuple[object, int, int]:
    """(value, rows above it, rows equal to it) of the ``k``-th largest ``key`` of ``rows``, 1 <= k <= their count, by nested histograms."""
    rows = rows.select(key.alias("key"))
    low, high = rows.agg(F.min("key"), F.max("key")).first()
    left = k
    while low < high:
        step = (high - low) / _BIN
        inside = rows.where((F.col("key") >= F.lit(low)) & (F.col("key") <= F.lit(high)))
        bins = inside.groupBy(F.least(F.floor((F.col("key") - F.lit(low)) / step), F.lit(_BIN - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most _BIN rows
            if row["n"] >= left:
                break
            left -= row["n"]
        if (row["low"], row["high"]) == (low, high) or row["n"] <= _LAST:
            low = high = inside.where((F.col("key") >= F.lit(row["low"])) & (F.col("key") <= F.lit(row["high"]))).orderBy(F.desc("key")).limit(left).agg(F.min("key")).first()[0]
        else:
            low, high = row["low"], row["high"]
    above, equal = rows.agg(F.count_if(F.col("key") > F.lit(low)), F.count_if(F.col("key") == F.lit(low))).first()
    return low, above, equal


def first_rows(rows: DataFrame, order: list[Column], k: int) -> Column:
    """A condition that holds for exactly ``k`` of ``rows``: the largest by ``order``, whose columns have no nulls and whose last tells all rows apart."""
    if k >= rows.count():
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    taken, tied = F.lit(False), F.lit(True)
    for c in order:
        value, above, equal = kth_largest(rows.where(tied), c, k)
        taken, tied, k = taken | (tied & (c > F.lit(value))), tied & (c == F.lit(value)), k - above
        if k == equal:
            break
    return taken | tied


def importance_sample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sharpness: float = SHARPNESS, per_ngram: bool = PER_NGRAM, seed: int = 9) -> DataFrame:
    """(doc_id, n_ngrams, log_weight, gumbel_key, keep) of every row; ``keep`` marks the round(keep * rows) largest keys, of equal ones the least doc_id, null last.

    ``log_weight`` is the log of target by raw probability of the whole text, or its mean an n-gram with ``per_ngram``. ``labels`` has
    doc_id, quality and toxic; target rows are quality 1 and not toxic. Without any, all weights are 0 and the sample is
    uniform. Null and empty texts have weight 0 and no n-grams. Rows of one doc_id share their noise; of rows that are equal in key and
    id as many are kept as are due, whichever. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("id")).distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(TARGET_ROWS)
    target = bucket_counts(docs.join(F.broadcast(good), F.col("doc_id") == F.col("id"), "left_semi"))
    ratio = log_ratio(target, bucket_counts(docs)) if target.sum() else np.zeros(BUCKETS)
    rows = docs.mapInArrow(_weigh(ratio, per_ngram), "doc_id long, n_ngrams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = stash(rows.withColumn("gumbel_key", sharpness * F.col("log_weight") - F.log(-F.log(u))).withColumn("row", F.monotonically_increasing_id()), "weights")
    order = [F.col("gumbel_key"), F.when(F.col("doc_id").isNull(), 0).otherwise(1), -F.coalesce("doc_id", F.lit(0)), -F.col("row")]
    return rows.withColumn("keep", first_rows(rows, order, round(keep * rows.count()))).drop("row")
