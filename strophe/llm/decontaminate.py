"""Operator 2: benchmark decontamination by SimHash windows of item size.

Of a document, windows of as many words as a benchmark item has are fingerprinted (64-bit SimHash of five-word shingles, each as
often as it occurs). Windows lie wherever a shingle of the document and one of an item align them; a window without a shared shingle
can't be similar. A multi-index over the items' fingerprints, cut into ``RADIUS + 1`` blocks of which one must be equal, yields
all items within ``RADIUS`` bits. At such a radius blocks are short and hold a good part of all items, so the index is one of bit sets,
and what it yields is cut down to the items that share a shingle with the window, which a similar one must. Those are verified by exact
weighted-shingle similarity: over all shingles, the sum of lesser counts by the sum of greater counts, at least ``SIMILAR``.

The benchmark is taken in blocks of at most about ``BLOCK`` items and ``BYTES`` of text, a pass each, so that what a task holds stays
bounded however large it grows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import stash
from .words import SHINGLE, slices, words
from .worker import kept

RADIUS = 20
SIMILAR = 0.8
BLOCK = 10_000
BYTES = 16 << 20
_LEAK = "array<struct<item_id:long,similarity:double,start_word:long>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64())]))


def simhash(shingles: np.ndarray) -> int:
    """64-bit SimHash; equal shingles add their weight again."""
    bits = (shingles[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    votes = (2 * bits.astype(np.int64) - 1).sum(0)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[votes > 0].sum(dtype=np.uint64))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts."""
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


class Items:
    """Benchmark items: shingles, which items hold them, places, fingerprints and their multi-index."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(pa.array(texts, pa.string()))
        s, first = w.shingles()
        self.ids, self.size = ids, np.diff(w.first)
        self.count = [Counter(s[a:b].tolist()) for a, b in zip(first, first[1:], strict=False)]
        self.has = np.diff(first) > 0
        self.prints = np.array([simhash(s[a:b]) if b > a else 0 for a, b in zip(first, first[1:], strict=False)], np.uint64)
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        place = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
        # where a window starts and ends follows from the place of a shingle and the item's size, so items that agree in both are one
        at = np.zeros(len(s), np.dtype([("shingle", np.uint64), ("place", np.int64), ("size", np.int64)]))
        at["shingle"], at["place"], at["size"] = s, place, self.size[item]
        at = np.unique(at)
        self.shingle, self.place, self.width = (np.ascontiguousarray(at[c]) for c in ("shingle", "place", "size"))
        held = np.zeros(len(s), np.dtype([("shingle", np.uint64), ("item", np.int64)]))
        held["shingle"], held["item"] = s, item
        held = np.unique(held)
        self.held, self.holder = np.ascontiguousarray(held["shingle"]), np.ascontiguousarray(held["item"])
        edges = np.linspace(0, 64, RADIUS + 2).astype(np.uint64)
        self.shift, self.mask = edges[:-1], (np.uint64(1) << np.diff(edges)) - np.uint64(1)
        # a row of bits, one an item, for each value of each block
        self.row = np.concatenate([[0], np.cumsum(self.mask[:-1] + np.uint64(1))]).astype(np.int64)
        values = self._values(self.prints[:, None])
        self.index = np.concatenate([np.packbits((values[:, k] == np.arange(int(m) + 1)[:, None]) & self.has, 1) for k, m in enumerate(self.mask)])

    def _values(self, prints):
        return (prints >> self.shift & self.mask).astype(np.int64)

    def sharing(self, shingles: np.ndarray) -> np.ndarray:
        """The items that hold one of the shingles, ascending."""
        lo, hi = np.searchsorted(self.held, shingles), np.searchsorted(self.held, shingles, "right")
        n = hi - lo
        return np.unique(self.holder[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])

    def within(self, fingerprint: int, among: np.ndarray | None = None) -> np.ndarray:
        """All items, of ``among`` where given, whose fingerprint differs in at most RADIUS bits, ascending."""
        fingerprint = np.uint64(fingerprint)
        rows = self.row + self._values(fingerprint)
        if among is None:
            found = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.index[rows], 0), count=len(self.prints)))
        else:
            bits = self.index[rows[:, None], among >> 3] >> (7 - (among & 7)).astype(np.uint8) & 1
            found = among[bits.any(0)]
        return found[np.bitwise_count(self.prints[found] ^ fingerprint) <= RADIUS]


def find(items: Items, texts: pa.Array) -> list[list[dict]]:
    """For each text its (item_id, similarity, start_word), the best window of each item, by item_id."""
    w = words(texts)
    s, first = w.shingles()
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(items.shingle) or not len(s):
        return out
    lo = np.searchsorted(items.shingle, s)
    hit = np.flatnonzero(items.shingle[np.minimum(lo, len(items.shingle) - 1)] == s)
    if not len(hit):
        return out
    hits = s[hit]
    hi = np.searchsorted(items.shingle, hits, "right")
    many = hi - lo[hit]
    at = np.repeat(hit, many)
    row = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    doc = np.searchsorted(first, at, "right") - 1
    n, size = np.diff(w.first)[doc], items.width[row]
    start = np.clip(at - first[doc] - items.place[row], 0, np.maximum(n - size, 0))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for d, x, m in np.unique(np.stack([doc, start, size], 1), axis=0).tolist():
        words_in = int(w.first[d + 1] - w.first[d])
        take = max(min(m, words_in - x) - SHINGLE + 1, 1) if words_in >= SHINGLE else 1
        a = int(first[d]) + (x if words_in >= SHINGLE else 0)
        if words_in >= SHINGLE and m < SHINGLE:
            continue  # an item shorter than a shingle equals whole texts only
        window = s[a : min(a + take, int(first[d + 1]))]
        count, some = None, hits[slice(*np.searchsorted(hit, (a, a + len(window))))]
        for i in items.within(simhash(window), items.sharing(np.unique(some))).tolist():
            count = count or Counter(window.tolist())
            like = similarity(count, items.count[i])
            if like >= SIMILAR and (like, -x) > best.get((d, i), (0.0, 1)):
                best[d, i] = like, -x
    for (d, i), (like, x) in sorted(best.items(), key=lambda e: (e[0][0], items.ids[e[0][1]])):
        out[d].append({"item_id": items.ids[i], "similarity": like, "start_word": -x})
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks") -> DataFrame:
    """``docs`` with an array of (item_id, similarity, start_word) added, by item_id: the benchmark items that each text holds.

    ``docs`` has text, ``benchmark`` has item_id and text. Null, empty and word-less texts hold nothing and are held by nothing. Items
    of fewer than five words match texts that are just them. Repeated items are each named, and so are windows of equal likeness by
    their first start. Very long texts are read whole. One block of items: no shuffle. More of them: a pass over the texts a block, one at
    a time, and what they find meets the rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size.n // BLOCK), -(-size.bytes // BYTES))
    if blocks == 1:
        docs = docs.withColumn(column, F.array().cast(_LEAK))
        return docs.mapInArrow(_run(_known(items), docs.columns.index(column)), docs.schema)
    row, found = "_row" + "_" * len(docs.columns), []
    docs = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        one = docs.select(row, "text").withColumn("x", F.array().cast(_LEAK))
        one = one.mapInArrow(_run(_known(items.where(part == k)), 2), one.schema)
        found.append(stash(one.select(F.col(row).alias("_of"), F.explode("x").alias("x")), "leaks"))
    every = reduce(DataFrame.unionByName, found).groupBy("_of").agg(F.sort_array(F.collect_list("x")).alias(column))
    out = docs.join(every, F.col(row) == F.col("_of"), "left").drop(row, "_of")
    return out.withColumn(column, F.coalesce(column, F.array().cast(_LEAK)))


def _known(items: DataFrame):
    rows = items.orderBy("item_id", "text").collect()  # a block: at most about BLOCK items of BYTES in all
    ids, texts = tuple(r.item_id for r in rows), tuple(r.text for r in rows)
    name = hashlib.sha256(repr((ids, texts)).encode("utf-8", "surrogatepass")).hexdigest()
    return items.sparkSession.sparkContext.broadcast((name, ids, texts))


def _run(known, at: int):
    """Each worker holds the index of the block that it last saw."""

    def run(batches):
        name, ids, texts = known.value
        items = kept("items", name, lambda: Items(list(ids), list(texts)))
        for whole in batches:
            for batch in slices(whole):
                cols = [*batch.columns[:at], pa.array(find(items, batch["text"]), _ARROW), *batch.columns[at + 1 :]]
                yield pa.record_batch(cols, batch.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): a row for each item that a document holds."""
    found = leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.similarity", "x.start_word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns unchanged."""
    name = "_leaks"
    while name in docs.columns:
        name += "_"
    return leaks(docs, benchmark, name).where(F.size(name) == 0).drop(name)
