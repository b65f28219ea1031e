"""Operator 8: language identification by unigrams over the pieces of a fixed public vocabulary, summed over all segmentations.

A word (a run of letters, lower-cased, with U+2581 in front) has, in a language, the probability of all ways to write it as
pieces: a forward pass multiplies piece probabilities over the matches that an Aho-Corasick automaton enumerates. A text is the
product of its words; the prediction is the language of the largest posterior under equal priors.

Piece probabilities are fitted by expectation-maximisation, one task a language, on a bounded sample: at most ``per_language``
labelled rows of each language, those with the least hash of doc_id, whole texts. Every row of the table is predicted.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import PIECES, pieces
from .words import slices

PER_LANGUAGE = 200
ROUNDS = 3
#: Words kept by one Python worker, and new words scored at once.
KEPT, AT_ONCE = 200_000, 4096
_STRETCH = 48
_LETTERS = re.compile(r"[^\W\d_]+")  # with numerals that are no decimal digits, which _spoken leaves out
_FLOOR = 1e-9
#: A piece's number and length are one number in the automaton; pieces are shorter than this.
_CODE = 1024
_LOADED: dict[str, Model] = {}


def _spoken(text: str | None) -> list[str]:
    """The words of a text that have a letter."""
    return [w for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def _matches(automaton, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece) of the pieces in a word, by end."""
    return [(end + 1 - value % _CODE, end + 1, value // _CODE) for end, value in automaton.iter(word)]


def _automaton(vocabulary: list[str], keep=None):
    a = ahocorasick.Automaton()
    for i, p in enumerate(vocabulary):
        if keep is None or keep[i]:
            a.add_word(p, i * _CODE + len(p))
    a.make_automaton()
    return a


def expected(automaton, p: np.ndarray, words: dict[str, int]) -> np.ndarray:
    """Expected piece counts over all segmentations of weighted words (forward-backward)."""
    out = np.zeros(len(p))
    prob = p.tolist()
    for word, weight in words.items():
        text = "▁" + word
        n, found = len(text), _matches(automaton, text)
        ended = {e for _, e, _ in found}
        steps = found + [(e - 1, e, -1) for e in range(1, n + 1) if e not in ended]
        steps.sort(key=lambda m: m[1])
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        ahead[0] = behind[n] = 1.0
        for s, e, k in steps:
            ahead[e] += ahead[s] * (prob[k] if k >= 0 else _FLOOR)
        for s, e, k in sorted(steps, key=lambda m: -m[0]):
            behind[s] += behind[e] * (prob[k] if k >= 0 else _FLOOR)
        if ahead[n] > 0:
            scale = weight / ahead[n]
            for s, e, k in steps:
                if k >= 0:
                    out[k] += scale * ahead[s] * prob[k] * behind[e]
    return out


def fit(vocabulary: list[str], words: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language."""
    automaton = _automaton(vocabulary)
    p = np.array([0.1 ** len(v) for v in vocabulary])
    p /= p.sum()
    for _ in range(rounds):
        c = expected(automaton, p, words)
        p = (c + 1e-4) / (c.sum() + 1e-4 * len(c))
    return p


class Model:
    """languages, and for each piece its probability in each of them."""

    def __init__(self, vocabulary: list[str], languages: list[str], table: np.ndarray):
        self.languages = languages
        # pieces that no language uses leave; characters stay, so that every word of known letters has a segmentation
        keep = (table.max(1) > 1e-6) | np.array([len(v) == 1 for v in vocabulary]) if languages else np.zeros(0, bool)
        self.automaton = _automaton(vocabulary, keep)
        self.table = table
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, summed over all segmentations; very long words go in stretches of 48.

        One pass of the automaton runs over all words, as no piece goes on beyond a word's mark; sums go place by place over all words.
        """
        parts = [w[i : i + _STRETCH] for w in words for i in range(0, len(w), _STRETCH)]
        of = np.repeat(np.arange(len(words)), [-(-len(w) // _STRETCH) for w in words])
        size = np.array([len(x) + 1 for x in parts])
        begin = np.cumsum(size) - size
        found = np.fromiter(chain.from_iterable(self.automaton.iter("▁" + "▁".join(parts))), np.int64)
        end, piece, width = found[::2], found[1::2] // _CODE, found[1::2] % _CODE
        word = np.searchsorted(begin, end, "right") - 1
        level, target = end - begin[word] + 1, end + 1 + word  # a word has a place more than characters
        order = np.lexsort((target, level))
        level, target, source, piece = level[order], target[order], (target - width)[order], piece[order]
        ahead = np.zeros((size.sum() + len(parts), len(self.languages)))
        first = begin + np.arange(len(parts))
        ahead[first] = 1.0
        cut = np.searchsorted(level, np.arange(1, size.max() + 2))
        for at in range(1, size.max() + 1):
            k = slice(cut[at - 1], cut[at])
            if k.start < k.stop:
                head = np.flatnonzero(np.diff(target[k], prepend=-1))
                ahead[target[k][head]] = np.add.reduceat(ahead[source[k]] * self.table[piece[k]], head)
            here = first[size >= at] + at
            bare = here[ahead[here, 0] == 0]  # a place that ends no piece is crossed by an unknown character
            ahead[bare] = ahead[bare - 1] * _FLOOR
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, of, np.log(np.maximum(ahead[first + size], 1e-300)))
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, posterior) of each text; ``und`` and 0 where there is no letter."""
        found = [_spoken(t) for t in texts] if self.languages else [[] for _ in texts]
        if len(self.known) > KEPT:
            self.known, self.rows = {}, self.rows[:0]
        known = self.known
        new = [w for w in set().union(*found) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(self.words(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE))])
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            total = self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
            best = len(total) - 1 - int(total[::-1].argmax())
            out.append((self.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())))
        return out


def train(docs: DataFrame, path: str = PIECES, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, probability of each piece in each of them) from rows of ``docs`` (doc_id, text, lang) with text and lang."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("of"))
    sample = docs.join(F.broadcast(ids.distinct()), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")), "left_semi").select("lang", "text")

    def words(batches):
        for batch in batches:
            count = Counter((lang, w) for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True) for w in _spoken(text) if len(w) <= _STRETCH)
            yield pa.record_batch([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(count.values(), pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def learn(group: pa.Table) -> pa.Table:
        vocabulary = [p for p, _ in pieces(path)]
        p = fit(vocabulary, dict(zip(group["word"].to_pylist(), group["n"].to_pylist(), strict=True)))
        lang = group["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang], pa.string()), "p": pa.array([p.tolist()], pa.list_(pa.float64()))})

    found = counted.groupBy("lang").applyInArrow(learn, "lang string, p array<double>").collect()  # a row a language, as long as the vocabulary
    found.sort(key=lambda r: r.lang)
    return [r.lang for r in found], np.array([r.p for r in found], np.float64).T if found else np.zeros((0, 0))


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, path: str = PIECES, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with its predicted language and score added, from text alone, as ``names``, which ``docs`` must not have; no shuffle."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((languages, table))  # bounded: vocabulary times languages
    name = hashlib.sha256(repr(languages).encode() + table.tobytes()).hexdigest()

    def run(batches):
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Model([p for p, _ in pieces(path)], *model.value) if model.value[0] else Model([], [], np.zeros((0, 0)))
        m = _LOADED[name]
        for whole in batches:
            for batch in slices(whole, most=250_000):
                got = m.texts(batch["text"].to_pylist())
                yield pa.record_batch([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def language_id(docs: DataFrame, path: str = PIECES, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; trained on rows whose crc32(doc_id) mod 4 is not 2.

    Null text and text without a letter: ``und``, 0. A null doc_id has no remainder: it is held out. Where no row has a language, every
    row is ``und``. Other columns are ignored; repeated rows each give a row; equal posteriors go to the last language by code point.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    languages, table = train(docs.where(~held), path, per_language)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), languages, table, path).drop("text")
