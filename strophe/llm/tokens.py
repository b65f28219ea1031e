"""Operator 4: token counts of a unigram tokenizer without making tokens.

The vocabulary is that of a public sentencepiece model, read from its file: pieces and scores. An Aho-Corasick automaton
enumerates the pieces at each place of a text and dynamic programming carries the best score and its number of pieces. Ties follow
the tokenizer: at one end, the longest piece (first start) stays unless a later start is strictly better; a character that is no piece
costs the least score less ten, and is then spelled in bytes. Blanks are U+2581 and one is put in front.

No piece has U+2581 after another character, nor a line feed, so a best path is made of the best paths of the stretches between; the
vocabulary is asked for this when it is loaded and whole texts are taken where it doesn't hold. Stretches are kept in a bounded table.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches kept by one Python worker.
KEPT = 600_000
_BLANK = "▁"
_CUT = re.compile(f"{_BLANK}+[^{_BLANK}\n]*|\n|[^{_BLANK}\n]+")
_LOADED: dict[str, Counter] = {}


def pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]


class Counter:
    """Best-path piece counts over a unigram vocabulary with byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min(s for _, s in vocabulary) - 10
        self.cut = not any("\n" in p or _BLANK in p.lstrip(_BLANK) for p, _ in vocabulary)
        self.known: dict[str, tuple[int, int, float]] = {}

    def best(self, text: str) -> tuple[int, int, float]:
        """(pieces, bytes among them, score) of one stretch."""
        n = len(text)
        score, count, spelled = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        score[0] = 0.0
        ends: list[list] = [[] for _ in range(n)]
        for end, (size, s) in self.automaton.iter(text):
            ends[end].append((size, s))
        unknown, single = self.unknown, self.single
        for end in range(n):
            best = None
            c = text[end]
            options = ends[end]
            options.sort(reverse=True)  # first starts first
            for size, s in options:
                start = end + 1 - size
                x = score[start] + s
                if best is None or x > best:
                    best, at, extra = x, start, 0
            if c not in single:
                x = score[end] + unknown
                if best is None or x > best:
                    best, at, extra = x, end, len(c.encode("utf-8", "replace"))
            score[end + 1] = best
            count[end + 1] = count[at] + (extra or 1)
            spelled[end + 1] = spelled[at] + extra
        return count[n], spelled[n], score[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """(tokens, byte tokens among them, score) of a whole text; none for an empty one."""
        if not text:
            return 0, 0, 0.0
        text = _BLANK + text.replace(" ", _BLANK)
        if not self.cut:
            return self.best(text)
        tokens, spelled, score, known = 0, 0, 0.0, self.known
        for part in _CUT.findall(text):
            got = known.get(part)
            if got is None:
                got = self.best(part)
                if len(part) < 64:
                    if len(known) >= KEPT:
                        known.clear()
                    known[part] = got
            tokens += got[0]
            spelled += got[1]
            score += got[2]
        return tokens, spelled, score


def _counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(pieces(path))
    return _LOADED[path]


def _run(path: str):
    def run(batches):
        counter = _counter(path)
        for batch in batches:
            got = [counter.text(t or "") for t in (x.as_py() for x in batch["text"])]
            n, b, s = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "n_tokens", "n_byte_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, score) of each whole text; null and empty texts have no tokens and score 0.

    No shuffle; a task holds one Arrow batch and a table of at most ``KEPT`` short stretches. Other columns are ignored, repeated
    rows each give a row, a null doc_id stays. ``path`` is read on each executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(path), "doc_id long, n_tokens long, n_byte_tokens long, score double")
