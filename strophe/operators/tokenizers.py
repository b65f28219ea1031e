"""Character and byte-pair tokenizers as tables."""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stash import discard, stash
from .merges import Block, _joined, learn

_PARTS = r"\S+|\s"
_WORD = re.compile(_PARTS, re.ASCII)
#: Vocabulary that training goes up to.
SIZE = 1000
#: Words that an encoding task keeps, and their longest.
KEPT = 200_000
LONGEST = 64


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one text after the other, and the lengths of the texts; a null has none."""
    whole = column.fill_null("")
    return np.frombuffer("".join(whole.to_pylist()).encode("utf-32-le"), "<u4"), pc.utf8_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def char_vocab(docs: DataFrame) -> DataFrame:
    """(char, id): distinct characters by code point, from 0. As large as an alphabet."""

    def run(batches):
        seen = np.zeros(0x110000, bool)
        for b in batches:
            seen[_codes(b.column(0))[0]] = True
        yield pa.record_batch([pa.array([chr(c) for c in np.flatnonzero(seen)], pa.string())], ["char"])

    chars = docs.select("text").mapInArrow(run, "char string").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) - 1).cast("long").alias("id"))


def char_encode(docs: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """(keep..., tokens); null for a null text. A character outside the vocabulary is an error when rows are read. The vocabulary, an
    alphabet, is collected; texts are looked up a batch at a time."""
    ids = np.full(0x110000, -1, np.int64)
    for r in vocab.select("char", "id").collect():
        ids[ord(r.char)] = r.id
    ids = ids[: np.flatnonzero(ids >= 0).max(initial=0) + 2]  # the last stands for what lies beyond
    rows = docs.select(*keep, F.col("text").alias("_text"))

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            codes, lengths = _codes(texts)
            tokens = ids[np.minimum(codes, len(ids) - 1)]
            if (tokens < 0).any():
                raise ValueError(f"not in the vocabulary: {chr(codes[tokens < 0][0])!r}")
            starts = pa.array(_starts(lengths), pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
            yield pa.record_batch([*b.columns[:-1], pa.ListArray.from_arrays(starts, pa.array(tokens))], [*b.schema.names[:-1], "tokens"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.ArrayType(T.LongType()))]))


def char_decode(encoded: DataFrame, vocab: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text) of ``encoded`` (keep..., tokens); null for null tokens. Ids that the vocabulary, an alphabet, lacks become ``?``."""
    known = {r.id: ord(r.char) for r in vocab.select("char", "id").collect()}
    chars = np.full(max(known, default=-1) + 2, ord("?"), "<u4")
    chars[list(known)] = list(known.values())
    last = len(chars) - 1
    rows = encoded.select(*keep, F.col("tokens").alias("_tokens"))

    def run(batches):
        for b in batches:
            tokens = b.column(b.num_columns - 1)
            ids = tokens.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            whole = chars[np.where((ids < 0) | (ids > last), last, ids)].tobytes().decode("utf-32-le")
            starts = _starts(pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
            texts = [whole[i:j] if ok else None for i, j, ok in zip(starts, starts[1:], tokens.is_valid().to_pylist(), strict=False)]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): runs of non-blanks and single blanks."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(_PARTS), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) over ``words`` (tokens, n)."""
    at = F.when(F.size("tokens") > 1, F.sequence(F.lit(0), F.size("tokens") - 2)).otherwise(F.array().cast("array<int>"))
    rows = words.select("n", "tokens", F.explode(at).alias("i"))
    return rows.groupBy(F.get("tokens", F.col("i")).alias("left"), F.get("tokens", F.col("i") + 1).alias("right")).agg(F.sum("n").alias("n"))


def bpe_train(docs: DataFrame, merges: int | None = None, size: int = SIZE) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(merges, vocabulary): the most frequent pair each time, ties by (left, right); as many merges as named, or up to ``size`` tokens.

    Runs over distinct words, which stay on the executors (see ``merges.learn``): the driver holds the alphabet, pairs and their counts. A
    merged string that exists already takes a new id, as ids count what the vocabulary holds. Null and empty texts have no words.
    """
    counts = stash(word_counts(docs), "words")
    chars = [r.c for r in counts.select(F.explode(characters(F.col("word"))).alias("c")).distinct().orderBy("c").collect()]  # an alphabet
    vocab = {c: i for i, c in enumerate(chars)}
    done = learn(counts, chars, max(0, size - len(vocab)) if merges is None else merges)
    discard(counts)
    for a, b in done:
        vocab[a + b] = len(vocab)
    return done, vocab


class Bpe:
    """Encodes texts in a task; keeps up to ``KEPT`` words with their ids."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int]):
        self.rank, self.vocab = {p: i for i, p in enumerate(merges)}, vocab
        self.known: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        tokens = list(word)
        while len(tokens) > 1:
            first = min(self.rank.get(p, len(self.rank)) for p in zip(tokens, tokens[1:]))
            if first == len(self.rank):
                break
            tokens = _joined(tokens, *self.pairs[first])
        return [self.vocab.get(t, 0) for t in tokens]

    @cached_property
    def pairs(self) -> list[tuple[str, str]]:
        return list(self.rank)

    @cached_property
    def _steps(self) -> tuple[dict[str, int], list[tuple[int, int, int]], set[int], np.ndarray] | None:
        """(numbers of characters, merges by number, those whose string another one makes, ids by number), the last number
        standing for all other characters; None where a merge's parts come after it, so that order is not rank."""
        number: dict[str, int] = {}
        for pair in self.pairs:
            for t in pair:
                if len(t) == 1:
                    number.setdefault(t, len(number))
        for t in self.vocab:
            if len(t) == 1:
                number.setdefault(t, len(number))
        chars, steps, twice = dict(number), [], set()
        for i, (a, b) in enumerate(self.pairs):
            if a not in number or b not in number:
                return None
            if a + b in number:
                twice.add(i)
            steps.append((number[a], number[b], number.setdefault(a + b, len(number))))
        return chars, steps, twice, np.array([*(self.vocab.get(t, 0) for t in number), 0], np.int64)

    def words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word: all merges in their order, over all words at once. Order and rank agree but where two merges make one
        string, so words in which the later one took part are done one by one."""
        if not words or self._steps is None:
            return [self.word(w) for w in words]
        chars, steps, twice, ids = self._steps
        other, lengths = len(ids) - 1, np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths + 1)
        tokens = np.full(ends[-1] + 1, -1, np.int64)
        tokens[np.isin(np.arange(len(tokens)), np.append(0, ends), invert=True)] = [chars.get(c, other) for w in words for c in w]
        block, again = Block(tokens, np.ones(len(words), np.int64), steps, len(ids)), []
        for i, step in enumerate(steps):
            at = block.join(*step)
            if i in twice:
                again += np.searchsorted(ends, at).tolist()
        left = block.rows()[0]
        flat, cuts = ids[left[left >= 0]].tolist(), (np.flatnonzero(left == -1) - np.arange(len(words) + 1)).tolist()
        out = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in set(again):
            out[i] = self.word(words[i])
        return out

    def texts(self, texts: list[str | None]) -> pa.Array:
        """The ids of each text, null for a null; words that aren't kept are encoded together."""
        cut = [_WORD.findall(t) if t else () for t in texts]
        new = list({w for ws in cut for w in ws if w not in self.known})
        ids = dict(zip(new, self.words(new), strict=True))
        known, flat, sizes = self.known, [], np.zeros(len(texts) + 1, np.int32)
        for k, ws in enumerate(cut):
            for w in ws:
                flat += ids[w] if w in ids else known[w]
            sizes[k + 1] = len(flat)
        if len(known) + len(ids) > KEPT:
            known.clear()
        known.update(x for x in ids.items() if len(x[0]) <= LONGEST)
        null = np.array([t is None for t in texts] + [False])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32(), mask=null), pa.array(np.array(flat, np.int64)))


def bpe_encode(docs: DataFrame, merges: list[tuple[str, str]], vocab: dict[str, int], *keep: str) -> DataFrame:
    """(keep... or doc_id, tokens) of each row: no shuffle, as the frequent words and the single blank make up most of a corpus.

    Characters outside the vocabulary are 0. An empty text has no tokens, a null text null; repeated rows each give a row.
    """
    docs = docs.select(*(keep or ("doc_id",)), "text")

    def run(batches):
        bpe = Bpe(merges, vocab)
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], bpe.texts(b["text"].to_pylist())], [*b.schema.names[:-1], "tokens"])

    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("tokens", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, schema)


def _prefixes(word: Column) -> Column:
    """(size, prefix) of all prefixes of a word, the empty one too."""
    chars = characters(word)
    return F.transform(F.sequence(F.lit(0), F.size(chars)), lambda i: F.struct(i.alias("size"), F.array_join(F.slice(chars, 1, i), "").alias("prefix")))


def prefix_table(words: DataFrame) -> DataFrame:
    """(prefix, next_chars, is_word): a trie over ``words`` (word)."""
    n = F.length("word")
    rows = words.select("word", F.explode(F.sequence(F.lit(0), n)).alias("i")).select(F.substring(F.col("word"), F.lit(1), F.col("i")).alias("prefix"), F.nullif(F.substring(F.col("word"), F.col("i") + 1, F.lit(1)), F.lit("")).alias("c"))
    return rows.groupBy("prefix").agg(F.sort_array(F.collect_set("c")).alias("next_chars"), F.max(F.col("c").isNull()).alias("is_word"))


def transitions(words: DataFrame) -> DataFrame:
    """(state, char, next, is_word): a trie over ``words`` (word) as a table of steps; a state is the 64-bit hash of its prefix, ``is_word`` says
    whether the next one ends a word. Repeated and null words add nothing; the empty word is the first state and has no step."""
    rows = words.where("word <> ''").select(F.explode(_prefixes(F.col("word"))).alias("x"), "word").where("x.size > 0")
    rows = rows.select(F.col("x.prefix").alias("p"), (F.length("word") == F.col("x.size")).alias("ends"))
    steps = rows.groupBy("p").agg(F.max("ends").alias("is_word"))
    before = F.expr("substring(p, 1, length(p) - 1)")
    return steps.select(F.xxhash64(before).alias("state"), F.right("p", F.lit(1)).alias("char"), F.xxhash64("p").alias("next"), "is_word")


def walk(open_words: DataFrame, steps: DataFrame, key: str, word: str = "word") -> DataFrame:
    """(key, word, depth, alive, is_word, next_chars): how far each open word (key, word) goes in the trie of ``steps`` and what may follow it.

    A step of the word meets the trie where its state and character do; as a state is known by its prefix, all steps of a word are taken in one
    join. ``depth`` counts the steps before the first that isn't there, a dead state: such a word has no continuation. The
    empty word stands at the root; a null word is dead at depth 0. Keys are distinct.
    """
    at = F.explode(F.transform(_prefixes(F.col(word)), lambda x: F.struct(x["size"].alias("size"), F.xxhash64(x["prefix"]).alias("reached"))))
    taken = open_words.select(key, at.alias("x")).select(key, "x.*").where("size > 0")
    taken = taken.join(steps.select("next", "is_word"), F.col("reached") == F.col("next")).groupBy(key).agg(F.max("size").alias("depth"), F.max_by("is_word", "size").alias("is_word"))
    after = steps.groupBy("state").agg(F.array_join(F.sort_array(F.collect_set("char")), "").alias("next_chars"))  # as wide as the alphabet
    rows = open_words.select(key, word).join(taken, key, "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    rows = rows.withColumn("alive", F.coalesce(F.col("depth") == F.length(word), F.lit(False)))
    rows = rows.withColumn("_state", F.when(F.col("alive"), F.xxhash64(word))).join(after, F.col("_state") == F.col("state"), "left")
    return rows.select(key, word, "depth", "alive", F.coalesce(F.col("alive") & F.col("is_word"), F.lit(False)).alias("is_word"), F.coalesce("next_chars", F.lit("")).alias("next_chars"))


def completion_tokens(words: DataFrame, most: int = 500) -> DataFrame:
    """(suffix, n_words, tokens) of ``words`` (suffix, word, tokens): the distinct last tokens of a rhyme group's first ``most`` words by alphabet, sorted.

    The limit is the lookup's. Words without suffix or tokens take no part; a group is cut to its first words before they meet.
    """
    rows = words.where(F.col("suffix").isNotNull() & (F.size("tokens") > 0)).select("suffix", "word", F.element_at("tokens", -1).alias("token"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("suffix").orderBy("word", "token"))).where(F.col("_r") <= most)
    return rows.groupBy("suffix").agg(F.count("*").alias("n_words"), F.sort_array(F.collect_set("token")).alias("tokens"))
