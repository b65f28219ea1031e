"""Operator 3: quartile bucket digests of whole texts.

Every window of five UTF-8 bytes counts six of its byte triplets in ``BUCKETS`` hashed buckets. The digest holds, for each
bucket, in which quarter of the bucket counts it lies (two bits), the logarithm of the length and the two quartile ratios. Two
digests differ by the sum of quarter distances (a jump over all quarters counts double) plus bounded header terms; likeness
is one less the share of the largest such difference. Texts under five bytes count what windows of a zero-padded text give.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import partitions

BUCKETS = 128
_R = np.random.Generator(np.random.PCG64(7)).integers(0, BUCKETS, (6, 3, 256)).astype(np.uint8)
#: The triplets of a window (last byte first).
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])
_HEADER_MAX = 60
_WORST = 6 * BUCKETS + _HEADER_MAX


def counts(raw: bytes) -> np.ndarray:
    """Bucket counts of the byte triplets of a text."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < 5:
        b = np.concatenate([b, np.zeros(5 - len(b), np.uint8)])
    n, total = len(b) - 4, np.zeros(BUCKETS, np.int64)
    back = [b[4 - k : 4 - k + n] for k in range(5)]
    for r, (x, y, z) in zip(_R, _TRIPLETS, strict=True):
        total += np.bincount(r[0][back[x]] ^ r[1][back[y]] ^ r[2][back[z]], minlength=BUCKETS)
    return total


def digest(raw: bytes) -> str:
    """Hexadecimal: length code (2), quartile ratios (2), quarters of the buckets."""
    c = counts(raw)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quarter = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    packed = quarter[0::4] << 6 | quarter[1::4] << 4 | quarter[2::4] << 2 | quarter[3::4]
    size = min(255, round(np.log(len(raw) + 1) * 12))
    ratio = [int(q * 100 // q3) % 16 if q3 else 0 for q in (q1, q2)]
    return f"{size:02x}{ratio[0]:x}{ratio[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, towards 0 for unlike ones."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    ring = lambda p, q, n: min(abs(int(p) - int(q)), n - abs(int(p) - int(q)))
    head = min(_HEADER_MAX - 16, abs(int(x[0]) - int(y[0]))) + ring(x[1] >> 4, y[1] >> 4, 16) + ring(x[1] & 15, y[1] & 15, 16)
    p, q = (np.stack([d[2:] >> s & 3 for s in (6, 4, 2, 0)]) for d in (x, y))
    return 1.0 - float(head + _COST[p, q].sum()) / _WORST


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _pairs(batches):
    """Rows sorted by (chunk, copy, order): a row is told the one after it. The last of a chunk is a copy of the next chunk's first. A text is digested once."""
    held = None
    for batch in batches:
        out = []
        for chunk, doc_id, text, copy in zip(*(batch[c].to_pylist() for c in ("chunk", "doc_id", "text", "copy")), strict=True):
            own = digest(text.encode("utf-8", "surrogatepass"))
            if held is not None and held[0] == chunk and not held[3]:
                out.append(_row(held[1], held[2], held[4], text, own))
            held = chunk, doc_id, text, copy, own
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _row(doc_id, text, mine, following, its):
    raw = edited(text, following).encode("utf-8", "surrogatepass")
    other = digest(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), mine, other, likeness(mine, other), likeness(mine, its)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _batch(rows):
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def _at_or_above(cuts: list[int], value: Column) -> Column:
    """How many of ``cuts``, in descending order, lie at or above ``value``: a binary search, so that thousands of cuts cost a dozen steps a row."""
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(table, at + width - 1) >= value, F.lit(False)), at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if cuts else F.lit(0)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Digest of each text and of its edited text, with the likeness of both and of the next document's text.

    The next document follows in descending doc_id (null last, equal ids by hash of the text, then text); after the last comes the first.
    A table of one row is its own next. Null text is empty. Repeated rows each give a row. Other columns are ignored. Documents move once, by
    ranges of doc_id of about equal counts, a range a task; a range also gets the first document of the next one. An id (or null) that
    holds more than a range is cut by the hash of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = parts or partitions(docs)
    cuts = docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = [int(c) for c in cuts or []]
    # an id between equal cuts has a range of its own
    alone = {c for c, d in zip(cuts, cuts[1:], strict=False) if c == d}
    cuts = sorted({*cuts, *(c - 1 for c in alone if c > -(1 << 63))}, reverse=True)
    last = len(cuts) + 1  # null ids
    band = F.when(F.col("doc_id").isNull(), last).otherwise(_at_or_above(cuts, F.col("doc_id")))
    sizes = docs.select(band.alias("band"), "doc_id").groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()  # a row a range
    if not sizes:
        return docs.sparkSession.createDataFrame([], _OUT)
    share = max(1, sum(r.n for r in sizes) // n)
    pieces, first = [1] * (last + 1), [0] * (last + 1)
    for r in sizes:
        if r.lo == r.hi:
            pieces[r.band] = -(-r.n // share)
    for i in range(last):
        first[i + 1] = first[i] + pieces[i]
    count, start = (F.get(F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>"), F.col("band")) for x in (pieces, first))
    docs = docs.withColumn("band", band).withColumn("h", F.xxhash64("text"))
    piece = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * count), count - 1)
    docs = docs.select("doc_id", "text", "h", (start + piece).cast("int").alias("chunk"))
    heads = docs.select("chunk", "doc_id").groupBy("chunk").agg(F.max("doc_id").alias("head")).orderBy("chunk").collect()  # a row a chunk
    to = {b.chunk: a.chunk for a, b in zip(heads, heads[1:], strict=False)} | {heads[0].chunk: heads[-1].chunk}
    table = docs.sparkSession.createDataFrame([(r.chunk, r.head, to[r.chunk]) for r in heads], "of int, head long, to int")
    firsts = docs.join(F.broadcast(table), (F.col("chunk") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")))
    firsts = firsts.groupBy("to", "doc_id").agg(F.min(F.struct("h", "text")).alias("x"))
    firsts = firsts.select("doc_id", "x.text", "x.h", F.col("to").alias("chunk"), F.lit(True).alias("copy"))
    both = docs.withColumn("copy", F.lit(False)).unionByName(firsts).repartitionById(heads[-1].chunk + 1, F.col("chunk"))
    both = both.sortWithinPartitions("chunk", "copy", F.col("doc_id").desc_nulls_last(), "h", "text")
    return both.select("chunk", "doc_id", "text", "copy").mapInArrow(_pairs, _OUT)
