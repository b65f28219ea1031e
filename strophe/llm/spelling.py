"""Operator 13: spelling variants by Levenshtein automata over broadcast trie shards.

Counted words are put in order and cut into shards of at most ``WORDS`` words and ``BYTES`` bytes, each a front-coded list: what a word shares with the
one before, the rest of it, its count. Blocks of shards are broadcast one after another; a task builds one shard's trie at a time, edges
without branches joined, and walks it depth-first with the distance-one automaton of every word that it holds. The automaton goes along the word
itself until the two part; at that place one code point is replaced, inserted or deleted and the rest has to be the word's. So each
neighbour is reached once. A task keeps of a word and shard how many neighbours there are and the best of them, which a grouping reduces.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stash import discard, partitions, stash
from .worker import kept

WORDS = 50_000
BYTES = 1 << 20
#: Bytes of shards that are broadcast at a time (a word longer than this is a block of its own).
BLOCK = 16 << 20
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, every: int = 97, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, with a code point gone where the hash of document and run says so."""
    runs = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), runs.alias("run")).where(F.char_length("run") >= length)
    rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    left = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, left).otherwise(F.col("run")).alias("word")
    return rows.select(word).groupBy("word").agg(F.count("*").alias("n")).where((F.char_length("word") >= length) & (F.col("n") >= count))


def encoded(words: list[str], counts: list[int]) -> bytes:
    """A shard: words in order, front-coded."""
    shared = [0] + [len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:], strict=False)]
    rest = [w[k:] for w, k in zip(words, shared, strict=True)]
    head = [np.array([len(words), *counts], np.int64), np.array([*shared, *map(len, rest)], np.int32)]
    return b"".join([x.tobytes() for x in head] + ["".join(rest).encode("utf-8")])


def decoded(shard: bytes) -> tuple[list[str], list[int]]:
    n = int(np.frombuffer(shard, np.int64, 1)[0])
    counts = np.frombuffer(shard, np.int64, n, 8).tolist()
    shared, sizes = np.frombuffer(shard, np.int32, 2 * n, 8 + 8 * n).reshape(2, n).tolist()
    rest, words, last, at = shard[8 + 16 * n :].decode("utf-8"), [], "", 0
    for k, size in zip(shared, sizes, strict=True):
        last = last[:k] + rest[at : at + size]
        at += size
        words.append(last)
    return words, counts


def _shards(batches):
    """Ordered words of a task as shards."""
    words, counts, size = [], [], 0
    for batch in batches:
        for w, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            if words and (len(words) >= WORDS or size + len(w.encode()) + 16 > BYTES):
                yield pa.record_batch([pa.array([encoded(words, counts)], pa.binary())], ["shard"])
                words, counts, size = [], [], 0
            words.append(w)
            counts.append(n)
            size += len(w.encode()) + 16
    if words:
        yield pa.record_batch([pa.array([encoded(words, counts)], pa.binary())], ["shard"])


class Trie:
    """A compact trie of one shard: a node is (label of the edge to it, children by first code point, the word's number or -1)."""

    def __init__(self, shard: bytes):
        self.words, self.counts = decoded(shard)
        words = self.words
        self.root: tuple[str, dict, int] = ("", {}, 0 if words and not words[0] else -1)
        todo = [(self.root[1], 0, len(words), 0)]
        while todo:  # children of the node whose words, ``depth`` code points deep, are words[lo:hi]
            into, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo]) == depth:
                lo += 1
            while lo < hi:
                c, to = words[lo][depth], lo + 1
                if to < hi and words[to][depth] == c:
                    to = self._past(lo, hi, depth, c)
                first, last = words[lo], words[to - 1]
                if to - lo == 1:
                    into[c] = first[depth:], {}, lo
                else:
                    deep = len(os.path.commonprefix([first, last]))
                    node = first[depth:deep], {}, lo if len(first) == deep else -1
                    into[c] = node
                    todo.append((node[1], lo, to, deep))
                lo = to

    def _past(self, lo: int, hi: int, depth: int, c: str) -> int:
        """The end of the words that have ``c`` at ``depth``: a step that doubles, then halves."""
        step = 1
        while lo + step < hi and self.words[lo + step][depth] == c:
            lo += step
            step *= 2
        while step:
            if lo + step < hi and self.words[lo + step][depth] == c:
                lo += step
            step //= 2
        return lo + 1

    def near(self, w: str) -> list[int]:
        """Numbers of the shard's words at distance one of ``w``, each once."""
        found: list[int] = []
        node, i, n = self.root, 0, len(w)

        def rest(node: tuple, skip: int, at: int) -> None:
            """Accept the word below ``node`` that reads as w[at:] from place ``skip`` of the node's label on."""
            label = node[0]
            while True:
                if not w.startswith(label[skip:] if skip else label, at):
                    return
                at += len(label) - skip
                if at == n:
                    if node[2] >= 0:
                        found.append(node[2])
                    return
                node = node[1].get(w[at])
                if node is None:
                    return
                label, skip = node[0], 0

        while True:  # w[:i] leads to ``node``
            own = w[i] if i < n else None
            after = w[i + 1] if i + 1 < n else None
            children = node[1]
            for c, child in children.items():
                if c != own:
                    label, below = child[0], child[1]
                    if len(label) > 1:
                        x = label[1]
                        if x == own:
                            rest(child, 1, i)  # inserted
                        if own is not None and x == after:
                            rest(child, 1, i + 1)  # replaced
                    else:
                        if own is None or i + 1 == n:
                            if child[2] >= 0:
                                found.append(child[2])  # inserted after the last, or the last replaced
                        if own is not None and own in below:
                            rest(below[own], 0, i)
                        if after is not None and after in below:
                            rest(below[after], 0, i + 1)
            if own is None:
                break
            if i + 1 == n:
                if node[2] >= 0:
                    found.append(node[2])  # the last deleted
            elif after != own and after in children:
                rest(children[after], 0, i + 1)  # deleted
            child = children.get(own)
            if child is None:
                break
            label = child[0]
            k, m = 1, len(label)
            if m > 1 and not w.startswith(label, i):  # the two part inside the edge
                while i + k < n and label[k] == w[i + k]:
                    k += 1
                rest(child, k + 1, i + k)
                if i + k < n:
                    rest(child, k + 1, i + k + 1)
                    rest(child, k, i + k + 1)
                break
            node, i = child, i + m
        return found


def _walk(block):
    """(word, near, best_n, best) of the words of each row's shard and each shard of the block; words without neighbours there have no row."""

    def run(batches):
        for batch in batches:
            for own in batch["shard"].to_pylist():
                words, _ = decoded(own)
                for name, shard in block.value:
                    trie = kept("trie", name, lambda shard=shard: Trie(shard))
                    counts, other = trie.counts, trie.words
                    rows = []
                    for w in words:
                        near = trie.near(w)
                        if near:
                            best = min(near, key=lambda j: (-counts[j], other[j]))
                            rows.append((w, len(near), counts[best], other[best]))
                    if rows:
                        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "best_n", "best"])

    return run


def _neighbours(shards: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) over all shards, a block of them broadcast at a time."""
    spark = shards.sparkSession
    sized = shards.select("no", F.octet_length("shard").alias("size"))
    sized = sized.select("no", F.floor(F.sum("size").over(Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)) / BLOCK).alias("block"))  # a row a shard
    sized = stash(sized.select("no", F.coalesce("block", F.lit(0)).alias("block")), "blocks")
    blocks = sized.agg(F.max("block")).first()[0]
    found = []
    for k in range(0 if blocks is None else blocks + 1):
        part = [(hashlib.sha256(r.shard).hexdigest(), bytes(r.shard)) for r in shards.join(F.broadcast(sized.where(F.col("block") == k)), "no").select("shard").collect()]
        block = spark.sparkContext.broadcast(part)  # at most BLOCK bytes and a shard
        found.append(stash(shards.repartition(partitions(shards), "no").mapInArrow(_walk(block), "word string, near long, best_n long, best string"), "neighbours"))
        block.unpersist()
    discard(sized)
    every = found[0] if found else spark.createDataFrame([], "word string, near long, best_n long, best string")
    for other in found[1:]:
        every = every.unionByName(other)
    every = stash(every.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")), "near")
    discard(*found)
    return every.select("word", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, twice as far each round. Counts at least double with a form, so no path returns."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        after = stash(now.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after
        if not now.where("moved").head(1):
            return now.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of rows (word, n), each word once.

    ``n_near`` words differ by exactly one code point inserted, deleted or replaced. ``form`` is the one of greatest n (of equals the smallest in
    code-point order) where that is at least ``ratio`` times the word's own, else null with a null ``form_n``; ``root`` follows forms to the last.
    Rows with a null word or n are left out; no rows give none. The driver passes on a block of shards at a time.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, so that following forms ends")
    counts = stash(counts.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "counts")
    size = counts.count()
    parts = max(partitions(counts), -(-size // WORDS))
    shards = counts.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(_shards, "shard binary")
    shards = stash(shards.withColumn("no", F.monotonically_increasing_id()), "shards")
    near = _neighbours(shards)
    discard(shards)
    formed = (F.col("best_n") >= ratio * F.col("n")).alias("formed")
    rows = counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best", "best_n", formed)
    rows = stash(rows.select("word", "n", "n_near", F.when(F.col("formed"), F.col("best")).alias("form"), F.when(F.col("formed"), F.col("best_n")).alias("form_n")), "forms")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs``. Null and empty texts have none; a null doc_id hashes as empty; repeated rows count again."""
    return variants(word_counts(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
