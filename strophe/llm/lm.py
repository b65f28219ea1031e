"""Operator 5: log-bilinear language model, trained in numpy by noise-contrastive estimation.

Tokens are words and one end a document. The model predicts a unit from the two units before it: the ``TOP`` most frequent
words are units of their own, every other word belongs to one of ``SHAPES`` units by its last bytes. A context's vector is the
sum of its units' vectors, each scaled by place; its product with a unit's vector, plus a bias, is the unit's score. Scores
are normalised over all units (the normaliser of each pair of units is worked out once, rows of them in each task, by batched matrix products), and a word
inside its unit has add-half probability, so texts get log-probabilities over an open vocabulary.

Counts cover all training documents and are joined, not collected: at most the ``WIDE`` most frequent words travel to the tasks, the
rest of each document's words meet their counts in a shuffle. Training learns once from each training document. They are dealt by a hash of
id and text to ``ROUNDS`` rounds of shards; with more text, both the shards and the tokens of a shard become more. The shards of a round
run AdaGrad from the same start over their documents in the order of the hashes; the average by tokens of their parameters and of AdaGrad's
sums is the next round's start. Averages are sums of integers, taken in levels, so neither the files' split nor the order of tasks changes
a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stash import discard, partitions, stash
from .words import mix, slices, words

TOP = 1024
SHAPES = 256
WIDE = 262_144
DIM = 16
NOISE = 32
BATCH = 1024
#: Tokens that are shuffled together in training.
CHUNK = 262_144
#: A corpus of this many tokens is one shard; one of k times as many is dealt to k ** (2/3) shards.
SHARD = 524_288
#: Averages are taken so many times.
ROUNDS = 3
#: A parameter times its shard's tokens is rounded to so small a part of 1 before the sum.
FINE = 4096
#: Rows of parameters that one task adds up.
FAN = 32
END = int(mix(np.array([1], np.uint64)).view(np.int64)[0])


def tokens(texts: pa.Array):
    """(word ids, shapes, first) of the documents of an Arrow array, each with its end."""
    w = words(texts)
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    ids, shape = np.full(first[-1], END, np.int64), np.zeros(first[-1], np.int64)
    at = np.arange(len(w.hashes)) + np.repeat(np.arange(len(n)), n)
    ids[at] = w.hashes.view(np.int64)
    if len(w.hashes):
        lower = lambda b: np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
        last = lower(w.data[w.ends - 1].astype(np.uint64))
        size = w.ends - w.starts
        before = np.where(size > 1, lower(w.data[np.maximum(w.ends - 2, 0)].astype(np.uint64)), np.uint64(0))
        shape[at] = mix(last * np.uint64(256) + before.astype(np.uint64) + np.uint64(65536) * (size > 4).astype(np.uint64)) % np.uint64(SHAPES)
    return ids, shape, first


def _count(batches):
    held, size = [], 0

    def merged():
        word, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at, inverse = np.unique(word, return_index=True, return_inverse=True)
        return word, shape[at], np.bincount(inverse, n).astype(np.int64)

    for whole in batches:
        for batch in slices(whole):
            ids, shape, _ = tokens(batch["text"])
            word, at, n = np.unique(ids, return_index=True, return_counts=True)
            held.append((word, shape[at], n))
            size += len(word)
            if size > 1_500_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield pa.record_batch([pa.array(held[0][0]), pa.array(held[0][1].astype(np.int32)), pa.array(held[0][2])], ["word", "shape", "n"])
                    held, size = [], 0
    if held:
        word, shape, n = merged()
        yield pa.record_batch([pa.array(word), pa.array(shape.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])


class Units:
    """Maps words to units; counts of frequent words."""

    def __init__(self, top: np.ndarray, wide: np.ndarray, wide_n: np.ndarray):
        order = np.argsort(top)
        self.top, self.unit = top[order], order
        order = np.argsort(wide)
        self.wide, self.n = wide[order], wide_n[order]
        self.size = len(top) + SHAPES

    @staticmethod
    def _find(table, ids):
        at = np.minimum(np.searchsorted(table, ids), max(len(table) - 1, 0))
        return at, (table[at] == ids) if len(table) else np.zeros(len(ids), bool)

    def units(self, ids, shape):
        at, hit = self._find(self.top, ids)
        return np.where(hit, self.unit[at] if len(self.top) else 0, len(self.top) + shape)

    def counts(self, ids):
        """(count, whether it is among the frequent words)."""
        at, hit = self._find(self.wide, ids)
        return (np.where(hit, self.n[at], 0) if len(self.wide) else np.zeros(len(ids), np.int64)), hit


class Model:
    """Parameters: context vectors R (one more for the start), place scales C, unit vectors Q and biases b."""

    def __init__(self, unigram: np.ndarray, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        m = len(unigram)
        self.R = r.normal(0, 0.1, (m + 1, DIM)).astype(np.float32)
        self.C = np.ones((2, DIM), np.float32)
        self.Q = r.normal(0, 0.1, (m, DIM)).astype(np.float32)
        self.b = np.log(unigram).astype(np.float32)
        self.noise = unigram

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.R, self.C, self.Q, self.b)])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for name in ("R", "C", "Q", "b"):
            x = getattr(self, name)
            setattr(self, name, flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def norm(self, u: int) -> np.ndarray:
        """log of the sum over units of exp(score), after ``u`` and each unit before it."""
        s = (self.C[0] * self.R[u] + self.C[1] * self.R) @ self.Q.T + self.b
        top = s.max(1)
        return np.log(np.exp(s - top[:, None]).sum(1)) + top

    def norms(self) -> np.ndarray:
        return np.stack([self.norm(u) for u in range(len(self.R))])

    def score(self, u, u1, u2, norm) -> np.ndarray:
        """Normalised natural log-probability of each unit after its context."""
        h = self.C[0] * self.R[u1] + self.C[1] * self.R[u2]
        return (np.einsum("ij,ij->i", h, self.Q[u]) + self.b[u] - norm[u1, u2]).astype(np.float64)


def contexts(u: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each, and the one before that; ``start`` before a document."""
    u1, u2 = np.full(len(u), start), np.full(len(u), start)
    u1[1:], u2[2:] = u[:-1], u[:-2]
    u1[first[:-1]] = start
    u2[first[:-1]] = start
    second = first[:-1] + 1
    u2[second[second < first[1:]]] = start
    return u1, u2


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch, AdaGrad."""

    def __init__(self, model: Model, seed: int, start: np.ndarray | None = None, rate: float = 0.1):
        self.m, self.rate = model, rate
        self.r = np.random.Generator(np.random.PCG64(seed))
        self.cdf = np.cumsum(model.noise)
        self.log_noise = np.log(NOISE * model.noise).astype(np.float32)
        self.sum = {k: np.full(getattr(model, k).shape, 1e-7, np.float32) for k in ("R", "C", "Q", "b")}
        if start is not None:
            model.load(start)
            at = len(model.flat())
            for x in self.sum.values():
                np.maximum(x, start[at : at + x.size].reshape(x.shape), out=x, casting="same_kind")
                at += x.size

    def state(self) -> np.ndarray:
        """Parameters, then AdaGrad's sums."""
        return np.concatenate([self.m.flat(), *(x.ravel() for x in self.sum.values())])

    def _step(self, name, grad):
        self.sum[name] += grad * grad
        setattr(self.m, name, getattr(self.m, name) + self.rate * grad / np.sqrt(self.sum[name]))

    def _rows(self, index, values, rows):
        cells = (index[:, None] * DIM + np.arange(DIM)).ravel()
        return np.bincount(cells, values.ravel(), rows * DIM).reshape(rows, DIM).astype(np.float32)

    def batch(self, u, u1, u2):
        m = self.m
        z = np.minimum(np.searchsorted(self.cdf, self.r.random(NOISE) * self.cdf[-1]), len(m.b) - 1)
        r1, r2 = m.R[u1], m.R[u2]
        h = m.C[0] * r1 + m.C[1] * r2
        q = m.Q[u]
        good = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, q) + m.b[u] - self.log_noise[u], -30, 30)))
        bad = -1 / (1 + np.exp(-np.clip(h @ m.Q[z].T + m.b[z] - self.log_noise[z], -30, 30)))
        scale = np.float32(1 / len(u))
        dh = (good[:, None] * q + bad @ m.Q[z]) * scale
        dq = self._rows(u, good[:, None] * h * scale, len(m.b))
        np.add.at(dq, z, bad.T @ h * scale)
        db = np.bincount(u, good, len(m.b)).astype(np.float32) * scale
        np.add.at(db, z, bad.sum(0) * scale)
        dr = self._rows(u1, m.C[0] * dh, len(m.R)) + self._rows(u2, m.C[1] * dh, len(m.R))
        dc = np.stack([(r1 * dh).sum(0), (r2 * dh).sum(0)])
        for name, g in (("R", dr), ("C", dc), ("Q", dq), ("b", db)):
            self._step(name, g)


def _train(units: Units, unigram: np.ndarray, start: np.ndarray | None):
    """Each partition is a shard, in order; its draws are keyed by the shard's number, and it trains on ``CHUNK`` tokens of the stream at a
    time, wherever Arrow's batches end."""

    def run(batches):
        trainer, seen, shard, held, size = None, 0, 0, [], 0

        def train(k):
            nonlocal held, size
            u, u1, u2 = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [(u[k:], u1[k:], u2[k:])], size - k
            order = trainer.r.permutation(k)
            for a in range(0, k, BATCH):
                at = order[a : a + BATCH]
                trainer.batch(u[at], u1[at], u2[at])

        for whole in batches:
            for batch in slices(whole):
                if trainer is None:
                    shard = batch["shard"][0].as_py()
                    trainer = Trainer(Model(unigram), 100 + shard, start)
                ids, shape, first = tokens(batch["text"])
                u = units.units(ids, shape)
                held.append((u, *contexts(u, first, units.size)))
                size += len(u)
                seen += len(u)
                while size >= CHUNK:
                    train(CHUNK)
        if size:
            train(size)
        if seen:
            sums = np.rint(trainer.state().astype(np.float64) * seen * FINE).astype(np.int64)
            yield pa.record_batch([pa.array([shard]), pa.array([sums.tobytes()], pa.binary()), pa.array([seen])], ["k", "sums", "seen"])

    return run


def _added(batches):
    """The sum of a task's rows of parameters, under the least of their numbers."""
    least, total, seen = None, None, 0
    for batch in batches:
        for k, sums, n in zip(*(batch[c].to_pylist() for c in ("k", "sums", "seen")), strict=True):
            x = np.frombuffer(sums, np.int64)
            least, total, seen = (k, x.copy(), n) if total is None else (min(least, k), total + x, seen + n)
    if total is not None:
        yield pa.record_batch([pa.array([least]), pa.array([total.tobytes()], pa.binary()), pa.array([seen])], ["k", "sums", "seen"])


def averaged(learned: DataFrame, shards: int) -> np.ndarray | None:
    """Parameters averaged by tokens over the rows (k, sums, seen) of ``shards`` shards, ``FAN`` rows a task, until few are left; None without rows."""
    while shards > FAN:
        shards = -(-shards // FAN)
        learned = learned.repartitionById(shards, (F.col("k") % shards).cast("int")).mapInArrow(_added, "k long, sums binary, seen long")
    total, seen = None, 0
    for r in learned.toLocalIterator():  # at most FAN rows
        x = np.frombuffer(r.sums, np.int64)
        total, seen = (x.copy() if total is None else total + x), seen + r.seen
    return total / (float(FINE) * seen) if seen else None


def norm_table(spark: SparkSession, unigram: np.ndarray, flat: np.ndarray, parts: int) -> np.ndarray:
    """``Model.norms``, a task some rows of it: (units + 1) squared numbers, whatever the corpus."""

    def run(batches):
        model = Model(unigram).load(flat)
        for batch in batches:
            yield pa.record_batch([batch["id"], pa.array([model.norm(u).tobytes() for u in batch["id"].to_pylist()], pa.binary())], ["id", "norm"])

    rows = spark.range(0, len(unigram) + 1, 1, parts).mapInArrow(run, "id long, norm binary").collect()
    return np.stack([np.frombuffer(r.norm, np.float32) for r in sorted(rows, key=lambda r: r.id)])


def _score(units: Units, unigram, flat, log_class, norms):
    def run(batches):
        model, norm = Model(unigram).load(flat), norms.value
        row, part = 0, TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole):
                ids, shape, first = tokens(batch["text"])
                u = units.units(ids, shape)
                u1, u2 = contexts(u, first, units.size)
                lp = model.score(u, u1, u2, norm) / np.log(10)
                n, hit = units.counts(ids)
                logn = np.where(hit, np.log10(n + 0.5), 0.0)
                own = u < units.size - SHAPES  # a unit of its own: nothing inside it to choose
                lp += np.where(own, 0.0, logn - log_class[np.maximum(u - (units.size - SHAPES), 0)])
                sums = [np.add.reduceat(x, first[:-1]) for x in (lp, logn, (hit & (n > 0)).astype(np.int64))]
                docs = np.repeat(np.arange(len(batch)), np.diff(first))[~hit]
                rare = ids[~hit]
                order = np.lexsort((rare, docs))
                docs, rare = docs[order], rare[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (docs[1:] != docs[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rare))).astype(np.int32)
                cut = np.searchsorted(docs[at], np.arange(len(batch) + 1)).astype(np.int32)
                rid = part + row + np.arange(len(batch))
                row += len(batch)
                yield pa.record_batch(
                    [pa.array(rid), batch["doc_id"], batch["held_out"], pa.array(np.diff(first)), *(pa.array(s) for s in sums), pa.ListArray.from_arrays(pa.array(cut), pa.array(rare[at])), pa.ListArray.from_arrays(pa.array(cut), pa.array(times))],
                    ["rid", "doc_id", "held_out", "n_tokens", "part", "logs", "known", "rare", "times"],
                )

    return run


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of ``counts`` (n, ...) above the least count that at most ``most`` words reach, by a histogram of a few hundred bins."""
    bins = F.floor(F.log2("n") * 8)
    sizes = {r.bin: r.words for r in counts.groupBy(bins.alias("bin")).agg(F.count("*").alias("words")).collect()}  # a row a bin
    total, least = 0, None
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return counts.where(bins >= least) if least is not None else counts.limit(0)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learned where crc32(doc_id) mod 5 is not 1.

    Null and empty texts are one end. A null doc_id is held out. Without training rows, counts are 0 and every word is unseen. Repeated
    rows each give a row; other columns are ignored. Words are compared by 64-bit hashes. Copies of a text under other ids are learned in
    other shards; rows of equal id and text in the same one.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    train = docs.where(~F.col("held_out")).select("doc_id", "text")
    counts = stash(train.select("text").mapInArrow(_count, "word long, shape int, n long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    wide = frequent(counts, WIDE).select("word", "n", "shape").toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)  # at most WIDE rows
    word, n = wide["word"].to_numpy(np.int64), wide["n"].to_numpy(np.int64)
    units = Units(word[:TOP], word, n)
    rest = counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # a row a shape
    inside, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    inside[rest["shape"].to_numpy(np.int64)] = rest["n"]
    kinds[rest["shape"].to_numpy(np.int64)] = rest["v"]
    for s, c in zip(wide["shape"][:TOP], n[:TOP], strict=True):
        inside[s] -= c
        kinds[s] -= 1
    log_class = np.log10(inside + 0.5 * (kinds + 1))
    unigram = np.concatenate([n[:TOP], inside]) + 0.5
    unigram = unigram / unigram.sum()
    known = spark.sparkContext.broadcast(units)
    pack = lambda f, *a: (lambda batches: f(known.value, *a)(batches))
    shards = max(1, int(np.ceil((total.n / SHARD) ** (2 / 3) / ROUNDS)))
    hashed = train.select(F.xxhash64("doc_id", "text").alias("h"), "text").withColumn("shard", F.pmod("h", F.lit(shards * ROUNDS)).cast("int"))
    state = None
    for part in range(ROUNDS):
        dealt = hashed.where(F.col("shard") % ROUNDS == part).repartitionById(shards, F.floor(F.col("shard") / ROUNDS).cast("int"))
        learned = dealt.sortWithinPartitions("h").select("shard", "text").mapInArrow(pack(_train, unigram, state), "k long, sums binary, seen long")
        learned = stash(learned.withColumn("k", F.floor(F.col("k") / ROUNDS)), "learned")
        better = averaged(learned, shards)
        discard(learned)
        state = state if better is None else better
    model = Model(unigram)
    flat = model.flat() if state is None else state[: len(model.flat())]
    norms = spark.sparkContext.broadcast(norm_table(spark, unigram, flat, partitions(docs)))
    out = docs.mapInArrow(pack(_score, unigram, flat, log_class, norms), "rid long, doc_id long, held_out boolean, n_tokens long, part double, logs double, known long, rare array<long>, times array<int>")
    out = stash(out, "scores")
    # words beyond the frequent ones meet their counts here
    rare = out.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("word"), F.col("x.times").alias("k"))
    met = rare.join(counts.select("word", "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    more = met.groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).cast("long").alias("seen"))
    out = out.drop("rare", "times").join(more, "rid", "left").fillna(0, ["more", "seen"])
    norm = float(np.log10(total.n + 0.5 * (total.v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("seen")).alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("logs") + F.col("more") - F.col("n_tokens") * norm).alias("base_score"), (F.col("part") + F.col("more")).alias("score"))
