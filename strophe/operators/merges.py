"""Byte-pair merges learned from counted words that stay on the executors; the driver sees pairs and their counts only.

A pass guesses the next merges from a bounded sample of the words, which only steers the guesses, applies them in the guessed order to all words and sums by how much each one changed which pair. From the counts
before and these changes the driver knows the exact counts after any of them, and follows the true order, the most frequent pair each time:
a guess that comes too early is put off, by splitting its token again in the counts, which is exact as long as no merge that was
taken shares a token with it; a pair that wasn't guessed, or shares a token with one put off, ends the pass. The first guess is always right.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stash import discard, stash

#: Merges guessed in a pass; merges that are applied anew each pass before the words are written with them.
AHEAD = 128
KEEP = 64
#: Words of each half of the sample (the most frequent ones, and others by hash), and their longest.
SAMPLE = 10_000
LONGEST = 64
#: Codes of pairs up to which a table tells which ones are watched.
TABLE = 1 << 22
#: Tokens of a block of words (a longer word is a block of its own).
TOKENS = 400_000
Pair = tuple[str, str]
_BLOCK = "tokens array<int>, n array<bigint>"


def _blocks(known: dict[str, int]):
    """Counted words as blocks: characters' numbers, -1 before the first and after each word, and the words' counts."""

    def run(batches):
        tokens, counts = [-1], []
        for batch in batches:
            for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if counts and len(tokens) + len(word) > TOKENS:
                    yield _block(tokens, counts)
                    tokens, counts = [-1], []
                tokens += [known[c] for c in word]
                tokens.append(-1)
                counts.append(n)
        if counts:
            yield _block(tokens, counts)

    return run


def _block(tokens, counts) -> pa.RecordBatch:
    return pa.record_batch([pa.array([tokens], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))], ["tokens", "n"])


class Block:
    """The words of a block as a linked list of tokens; ``watch`` are the pairs that will be merged, in their order, with their new tokens."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, watch: list[tuple[int, int, int]], span: int):
        self.tokens, self.counts, self.span = tokens.astype(np.int64), counts, span
        size = len(tokens)
        self.next, self.before = np.arange(1, size + 1), np.arange(-1, size - 1)
        ends = tokens == -1
        self.weight = np.append(counts, 0)[np.cumsum(ends) - 1]
        self.codes = np.array([a * span + b for a, b, _ in watch], np.int64)
        self.watched = None
        if span * span <= TABLE:
            self.watched = np.zeros(span * span, bool)
            self.watched[self.codes] = True
        self.where: dict[int, list[np.ndarray]] = defaultdict(list)
        self._see(np.flatnonzero(~ends))

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, codes) of those of ``at`` where a pair starts."""
        at = at[self.tokens[at] >= 0]
        to = self.tokens[self.next[at]]
        at, to = at[to >= 0], to[to >= 0]
        return at, self.tokens[at] * self.span + to

    def _see(self, at: np.ndarray) -> None:
        at, code = self._pairs(at)
        on = np.isin(code, self.codes) if self.watched is None else self.watched[code]
        at, code = at[on], code[on]
        order = np.argsort(code, kind="stable")
        at, code = at[order], code[order]
        cuts = np.flatnonzero(np.diff(code)) + 1
        for part, c in zip(np.split(at, cuts), code[np.concatenate([[0], cuts])] if len(code) else (), strict=False):
            self.where[int(c)].append(part)

    def _places(self, a: int, b: int) -> np.ndarray:
        """Where the pair (a, b) is to become one token, from the left."""
        if (found := self.where.pop(a * self.span + b, None)) is None:
            return np.empty(0, np.int64)
        at = np.unique(found[0] if len(found) == 1 else np.concatenate(found))
        at = at[(self.tokens[at] == a) & (self.tokens[self.next[at]] == b)]
        if a == b and len(at):  # runs of one token: every other place from the left
            starts = ~np.isin(self.before[at], at)
            run = np.arange(len(at)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
            at = at[run % 2 == 0]
        return at

    def _put(self, at: np.ndarray, to: int) -> np.ndarray:
        """Make the pairs at these places the token ``to``; the places whose pairs are new."""
        second = self.next[at]
        after = self.next[second]
        self.tokens[at], self.tokens[second] = to, -2
        self.next[at], self.before[after] = after, at
        near = np.unique(np.concatenate([self.before[at], at]))
        self._see(near)
        return near

    def join(self, a: int, b: int, to: int) -> np.ndarray:
        """Make each pair (a, b), from the left, one token; the places."""
        if len(at := self._places(a, b)):
            self._put(at, to)
        return at

    def merge(self, a: int, b: int, to: int) -> tuple[int, np.ndarray, np.ndarray] | None:
        """As ``join``; (merges, codes, changes) weighted by the words' counts."""
        if not len(at := self._places(a, b)):
            return None
        old, old_code = self._pairs(np.unique(np.concatenate([self.before[at], at, self.next[at]])))
        new, new_code = self._pairs(self._put(at, to))
        codes = np.concatenate([old_code, new_code])
        return int(self.weight[at].sum()), codes, np.concatenate([-self.weight[old], self.weight[new]])

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        return self.tokens[self.tokens != -2].astype(np.int32), self.counts


def _each(batches):
    for batch in batches:
        for tokens, counts in zip(batch["tokens"], batch["n"], strict=True):
            yield tokens.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)


def _applied(watch: list[tuple[int, int, int]], span: int):
    def run(batches):
        for tokens, counts in _each(batches):
            block = Block(tokens, counts, watch, span)
            for a, b, to in watch:
                block.join(a, b, to)
            yield _block(*block.rows())

    return run


def _changes(watch: list[tuple[int, int, int]], first: int, span: int):
    """(step, left, right, n): what each merge from the ``first`` on changes; left -1: how often it was made."""

    def run(batches):
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for tokens, counts in _each(batches):
            block = Block(tokens, counts, watch, span)
            for i, (a, b, to) in enumerate(watch):
                if i < first:
                    block.join(a, b, to)
                elif (got := block.merge(a, b, to)) is not None:
                    made, codes, by = got
                    found[i - first].append(_summed(np.append(codes, -1), np.append(by, made)))
        for i, parts in found.items():
            keys, sums = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            keys, sums = keys[sums != 0], sums[sums != 0]
            left, right = np.where(keys < 0, -1, keys // span), np.where(keys < 0, -1, keys % span)
            yield pa.record_batch([pa.array(np.full(len(keys), i), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(sums, pa.int64())], ["step", "left", "right", "n"])

    return run


def _summed(codes: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, by)
    return keys, sums


def _first(batches):
    """(left, right, n): pairs of the blocks as they are."""
    total: dict[tuple[int, int], int] = defaultdict(int)
    for tokens, counts in _each(batches):
        weight = np.append(counts, 0)[np.cumsum(tokens == -1) - 1]
        on = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
        keys, inverse = np.unique(np.stack([tokens[:-1][on], tokens[1:][on]]), axis=1, return_inverse=True)
        sums = np.zeros(keys.shape[1], np.int64)
        np.add.at(sums, inverse.ravel(), weight[:-1][on])
        for a, b, n in zip(*keys.tolist(), sums.tolist(), strict=True):
            total[a, b] += n
    if total:
        rows = [(a, b, n) for (a, b), n in total.items()]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)], ["left", "right", "n"])


def best(counts: dict[Pair, int]) -> Pair | None:
    """The most frequent pair, of equals the least; None where no pair is left."""
    top = max(counts.values(), default=0)
    return min(p for p, n in counts.items() if n == top) if top > 0 else None


def _joined(tokens: list[str], left: str, right: str) -> list[str]:
    out, i = [], 0
    while i < len(tokens):
        joins = i + 1 < len(tokens) and tokens[i] == left and tokens[i + 1] == right
        out.append(left + right if joins else tokens[i])
        i += 2 if joins else 1
    return out


class Sample:
    """Weighted words on the driver, a bounded number, from which guesses take what a merge does to the pairs around it."""

    def __init__(self, words: list[tuple[str, int]]):
        self.tokens, self.weight = [list(w) for w, _ in words], [n for _, n in words]
        self.where: dict[Pair, set[int]] = defaultdict(set)
        for i, tokens in enumerate(self.tokens):
            for p in zip(tokens, tokens[1:]):
                self.where[p].add(i)

    def apply(self, pair: Pair) -> None:
        for i in list(self.where.pop(pair, ())):
            self.tokens[i] = _joined(self.tokens[i], *pair)
            for p in zip(self.tokens[i], self.tokens[i][1:]):
                self.where[p].add(i)

    def changes(self, pair: Pair, tokens: dict[int, list[str]], where: dict[Pair, set[int]]) -> tuple[int, dict[Pair, int]]:
        """(merges, changes of the counts) by ``pair`` where ``tokens`` and ``where`` stand for the words that guesses changed before."""
        by: dict[Pair, int] = defaultdict(int)
        for i in self.where.get(pair, set()) | where.get(pair, set()):
            old, n = tokens.get(i, self.tokens[i]), self.weight[i]
            new = _joined(old, *pair)
            if len(new) == len(old):
                continue
            tokens[i] = new
            for p in zip(old, old[1:]):
                by[p] -= n
            for p in zip(new, new[1:]):
                by[p] += n
                where[p].add(i)
        return -by.pop(pair, 0), by


def sampled(words: DataFrame, size: int = 0) -> Sample:
    """The most frequent of ``words`` (word, n) and as many others by hash, which stand for all others."""
    size = size or SAMPLE
    words = words.where(F.length("word").between(2, LONGEST))
    top = [(r.word, r.n) for r in words.orderBy(F.desc("n"), "word").limit(size).collect()]
    if len(top) < size:
        return Sample(top)
    rest = words.where(F.col("n") < top[-1][1])
    each = max(1, rest.count() // size)
    return Sample(top + [(r.word, r.n * each) for r in rest.where(F.pmod(F.xxhash64("word"), F.lit(each)) == 0).limit(2 * size).collect()])


def guess(counts: dict[Pair, int], known: set[str], sample: Sample, ahead: int = AHEAD) -> list[Pair]:
    """The next merges if the pairs around a merged one change as in the sample, in proportion. No later one than one that makes a known string."""
    top = sorted(counts.values(), reverse=True)[: 8 * ahead]
    floor = top[-1] if top else 0  # rarer ones aren't reached
    now: dict[Pair, float] = {p: n for p, n in counts.items() if n >= floor and n > 0}
    out: list[Pair] = []
    made: set[str] = set()
    tokens: dict[int, list[str]] = {}
    where: dict[Pair, set[int]] = defaultdict(set)
    while now and len(out) < ahead:
        pair = min(now, key=lambda p: (-now[p], p))
        if pair[0] + pair[1] in known or pair[0] + pair[1] in made:
            return out or [pair]
        if now[pair] <= 0:
            break
        out.append(pair)
        made.add(pair[0] + pair[1])
        n = now.pop(pair)
        times, by = sample.changes(pair, tokens, where)
        for p, m in by.items():
            if times > 0 and p != pair and (p in now or m > 0):
                now[p] = now.get(p, counts.get(p, 0)) + m * n / times
    return out


@dataclass
class Step:
    """What one guessed merge changed in the counts, and how often it was made."""

    changes: dict[Pair, int]
    made: int = 0


def follow(counts: dict[Pair, int], guessed: list[Pair], steps: list[Step], most: int) -> tuple[list[Pair], dict[Pair, int]]:
    """(merges in their true order, counts after them) as far as the guessed ones tell."""
    at = {p: i for i, p in enumerate(guessed)}
    tokens = [{a, b, a + b} for a, b in guessed]
    holds: dict[str, set[Pair]] = {a + b: set() for a, b in guessed}  # pairs that a new token may be in

    def see(p: Pair) -> None:
        for t in p:
            if t in holds:
                holds[t].add(p)

    reached, ahead, now = -1, dict(counts), counts
    taken: list[int] = []
    while len(taken) < most:
        i = at.get(best(now))
        if i is None or i in taken:
            break
        if i > reached:
            if any(tokens[i] & tokens[j] for j in range(i) if j not in taken):
                break
            for step in steps[reached + 1 : i + 1]:
                for p, n in step.changes.items():
                    see(p)
                    ahead[p] = ahead.get(p, 0) + n
                    if not ahead[p]:
                        del ahead[p]
            reached = i
        taken.append(i)
        off = [j for j in range(reached, -1, -1) if j not in taken]
        now = dict(ahead) if off else ahead
        for j in off:  # split its token again
            (a, b), ab = guessed[j], "".join(guessed[j])
            for p in [p for p in holds[ab] if p in now]:
                n, q = now.pop(p), (b if p[0] == ab else p[0], a if p[1] == ab else p[1])
                now[q] = now.get(q, 0) + n
                see(q)
            if steps[j].made:
                now[a, b] = now.get((a, b), 0) + steps[j].made
    return [guessed[i] for i in taken], dict(now)


def learn(words: DataFrame, chars: list[str], most: int, ahead: int = AHEAD, keep: int = KEEP) -> list[Pair]:
    """The first ``most`` merges over ``words`` (word, n), whose characters are ``chars``: the most frequent pair each time, ties by
    (left, right). Fewer where no pair is left. A merged string that exists already is that token."""
    names = list(chars)
    number = {c: i for i, c in enumerate(names)}
    blocks = stash(words.mapInArrow(_blocks(dict(number)), _BLOCK), "blocks")
    rows = blocks.mapInArrow(_first, "left int, right int, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n")).collect()
    counts: dict[Pair, int] = {(names[r.left], names[r.right]): r.n for r in rows}
    span = len(names) + most + ahead + 1
    sample = sampled(words)
    done: list[Pair] = []
    since: list[tuple[int, int, int]] = []

    def numbers(pair: Pair) -> tuple[int, int, int]:
        text = "".join(pair)
        if text not in number:
            number[text] = len(names)
            names.append(text)
        return number[pair[0]], number[pair[1]], number[text]

    while len(done) < most and best(counts):
        guessed = guess(counts, set(number), sample, min(ahead, most - len(done)))
        held = len(names)
        watch = since + [numbers(p) for p in guessed]
        steps = [Step({}) for _ in guessed]
        got = blocks.mapInArrow(_changes(watch, len(since), span), "step int, left int, right int, n bigint")
        told = got.groupBy("step", "left", "right").agg(F.sum("n").alias("n")).toArrow()
        for step, a, b, n in zip(*(c.to_pylist() for c in told.columns), strict=True):
            if a < 0:
                steps[step].made = n
            elif n:
                steps[step].changes[names[a], names[b]] = n
        new, counts = follow(counts, guessed, steps, most - len(done))
        for name in names[held:]:
            del number[name]
        del names[held:]
        since += [numbers(p) for p in new]
        done += new
        for p in new:
            sample.apply(p)
        if len(since) >= keep and len(done) < most:
            before, blocks = blocks, stash(blocks.mapInArrow(_applied(since, span), _BLOCK), "blocks")
            discard(before)
            since = []
    discard(blocks)
    return done
