"""Operator 12: vector bin packing of examples into training sequences, by the dot-product heuristic.

A sequence has simultaneous limits: tokens, segments and loss-bearing tokens. The next piece of the open sequence is, of those that fit all
three, the one whose needs (as shares of the limits) have the greatest dot product with what the sequence has left. Where examples may
be cut and none fits, the one with the greatest product is cut to fill it. A sequence that a limit closes before it is full, or that is the last,
is cut back to a power of two, a length that needs no padding, and what it loses is packed again. Whole examples (no cuts) are packed alike, with padding.

Each task packs the rows that it reads, keeping some hundred pieces open, so texts are tokenised once and never shuffled. Which examples share a
sequence so depends on how the table is split; every rerun over the same files gives the same sequences. Numbers of sequences are the
task's number times 2^33 plus a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import kept

VOCABULARY = "byte_bpe_50k"
END = 0
#: Open pieces of a task: packing starts at the second number and goes down to the first.
OPEN = 256, 1024
#: Output rows and ids of one Arrow batch.
ROWS, IDS = 8192, 1 << 20
_SPECIAL = "<|endoftext|>"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Encoder:
    """Ids of a byte-level BPE: by ranks, which give the ids of the merges faster; texts with a special token's string by the merges."""

    def __init__(self, name: str = VOCABULARY):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole = public_tokenizers.path(f"{name}.json"), None

    def ids(self, text: str) -> list[int]:
        if _SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


@dataclass
class Piece:
    """Consecutive ids of an example; ``loss`` marks those that bear loss."""

    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray
    total: int

    def cut(self, at: int) -> tuple[Piece, Piece]:
        a, b = self.ids[:at], self.ids[at:]
        return Piece(self.key, self.start, a, self.loss[:at], self.total), Piece(self.key, self.start + at, b, self.loss[at:], self.total)


class Packer:
    """Open pieces of a task and the sequences made of them."""

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cuts = np.array([limits.tokens, limits.segments, limits.loss], np.int64), cut
        self.scale = 1 / np.maximum(self.limits, 1)
        self.pieces: list[Piece] = []
        self.need = np.zeros((OPEN[1] + limits.tokens + 64, 3), np.int64)
        self.low = max(OPEN[0], min(limits.segments, limits.tokens))
        self.high = max(OPEN[1], 2 * self.low)

    def _open(self, piece: Piece) -> None:
        at = len(self.pieces)
        if at == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[at] = len(piece.ids), 1, piece.loss.sum()
        self.pieces.append(piece)

    def _take(self, i: int) -> Piece:
        piece, last = self.pieces[i], self.pieces.pop()
        if i < len(self.pieces):
            self.pieces[i] = last
            self.need[i] = self.need[len(self.pieces)]
        return piece

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[Piece]]:
        """Open an example; stretches that fill a sequence alone, which the heuristic would give one to itself, go at once."""
        piece, tokens = Piece(key, 0, ids, loss, len(ids)), int(self.limits[0])
        while self.cuts and len(piece.ids) >= tokens > 0:
            head, piece = piece.cut(tokens)
            if head.loss.sum() <= self.limits[2] and self.limits[1] > 0:
                yield [head]
            else:
                self._open(head)
        if len(piece.ids):
            self._open(Piece(key, piece.start, piece.ids.copy(), piece.loss.copy(), piece.total))
        if len(self.pieces) > self.high:
            yield from self.pack(self.low)

    def pack(self, least: int = 0) -> Iterator[list[Piece]]:
        """Sequences of the open pieces, until ``least`` or fewer are left. A lone piece that no sequence can hold comes with a None before it."""
        while len(self.pieces) > least:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        rest, chosen = self.limits.copy(), []
        while self.pieces and rest[0] > 0 and rest[1] > 0:
            need = self.need[: len(self.pieces)]
            product = need @ (rest * self.scale * self.scale)
            fits = (need <= rest).all(1)
            if fits.any():
                piece = self._take(int(np.where(fits, product, -1.0).argmax()))
            else:
                i = int(product.argmax())
                head = self._head(self.pieces[i], rest) if self.cuts else 0
                if not head:
                    break
                piece, tail = self._take(i).cut(head)
                self._open(tail)
            chosen.append(piece)
            rest -= len(piece.ids), 1, int(piece.loss.sum())
        if not chosen:
            return [None, self._take(int((self.need[: len(self.pieces)] @ self.scale).argmax()))]
        return self._even(chosen) if self.cuts and rest[0] > 0 else chosen

    @staticmethod
    def _head(piece: Piece, rest: np.ndarray) -> int:
        """How many first ids of a piece fit."""
        return int(np.searchsorted(np.cumsum(piece.loss[: rest[0]]), rest[2], "right"))

    def _even(self, chosen: list[Piece]) -> list[Piece]:
        """Cut a sequence back to the greatest power of two that it reaches."""
        size = 1 << (sum(len(p.ids) for p in chosen).bit_length() - 1)
        out = []
        for p in chosen:
            if size >= len(p.ids):
                out.append(p)
            elif size > 0:
                head, tail = p.cut(size)
                out.append(head)
                self._open(tail)
            else:
                self._open(p)
            size -= min(size, len(p.ids))
        return out


class _Rows:
    """Pieces as Arrow batches."""

    names = ("key", "start", "length", "ids", "example_tokens", "sequence_id", "offset")

    def __init__(self, kind: pa.DataType):
        self.kind, self.rows, self.ids, self.held = kind, [], [], 0
        self.next = TaskContext.get().partitionId() << 33

    def add(self, sequence: list[Piece]) -> None:
        at, number = (0, self.next) if sequence[0] is not None else (None, None)
        self.next += at is not None
        for p in sequence:
            if p is None:
                continue
            self.rows.append((p.key, p.start, len(p.ids), p.total, number, at))
            self.ids.append(p.ids)
            self.held += len(p.ids)
            at = None if at is None else at + len(p.ids)

    def full(self) -> bool:
        return len(self.rows) >= ROWS or self.held >= IDS

    def batch(self) -> pa.RecordBatch:
        key, start, length, total, number, at = zip(*self.rows, strict=True)
        flat = pa.array(np.concatenate(self.ids).astype(np.int32))
        offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        cols = [pa.array(key, self.kind), *(pa.array(x, pa.int64()) for x in (start, length)), pa.ListArray.from_arrays(offsets, flat), *(pa.array(x, pa.int64()) for x in (total, number, at))]
        self.rows, self.ids, self.held = [], [], 0
        return pa.record_batch(cols, list(self.names))


def _run(limits: Limits, cut: bool, vocabulary: str, roles: tuple[str, ...] | None, end: int):
    def run(batches):
        encoder = kept("encoder", vocabulary, lambda: Encoder(vocabulary))
        packer, rows = Packer(limits, cut), None
        for batch in batches:
            rows = rows or _Rows(batch.schema.field("key").type)
            for key, example in zip(batch["key"], batch["example"], strict=True):
                for sequence in packer.add(key.as_py(), *_ids(encoder, example.as_py(), roles, end)):
                    rows.add(sequence)
                    if rows.full():
                        yield rows.batch()
        for sequence in packer.pack():
            rows.add(sequence)
            if rows.full():
                yield rows.batch()
        if rows and rows.rows:
            yield rows.batch()

    return run


def _ids(encoder: Encoder, example, roles: tuple[str, ...] | None, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which bear loss) of a text, or of turns (role, text); the end id belongs to the last turn."""
    if roles is None:
        ids = np.array([*encoder.ids(example or ""), end], np.uint32)
        loss = np.ones(len(ids), bool)
        loss[0] = False
        return ids, loss
    turns = [(t["role"] in roles, encoder.ids(t["text"] or "")) for t in example or [] if t]
    ids = [i for _, t in turns for i in t]
    loss = [y for y, t in turns for _ in t]
    return np.array([*ids, end], np.uint32), np.array([*loss, turns[-1][0] if turns else False], bool)


def pack(examples: DataFrame, key: str, example: str, limits: Limits = Limits(), cut: bool = True, vocabulary: str = VOCABULARY, roles: tuple[str, ...] | None = None, end: int = END) -> DataFrame:
    """(key, start, length, ids, example_tokens, sequence_id, offset): a row a piece; ids of all pieces of an example make up the example.

    ``example`` is a text (all ids but the first bear loss, as nothing precedes that) or, with ``roles``, an array of (role, text), a row an example,
    of which turns of those roles bear loss. Null or empty examples are the end id alone. Repeated rows are examples of their own, a null key stays,
    other columns are ignored; no rows give none. With ``cut`` an example lies in as many pieces as it takes; without, in one, and one beyond the
    limits has null ``sequence_id`` and ``offset``, as have, with ``cut``, stretches of which no single token fits (a limit of 0).
    No shuffle; a task holds its open pieces, an Arrow batch and one example.
    """
    out = f"key {dict(examples.dtypes)[key]}, start long, length long, ids array<int>, example_tokens long, sequence_id long, offset long"
    rows = examples.select(F.col(key).alias("key"), F.col(example).alias("example"))
    return rows.mapInArrow(_run(limits, cut, vocabulary, roles, end), out).withColumnRenamed("key", key)


def _digests(batches):
    for batch in batches:
        ids = batch["ids"]
        at = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
        yield pa.record_batch([*(batch[c] for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(batch[c] for c in ("example_tokens", "sequence_id", "offset"))], [x.split(" ")[0] for x in _OUT.split(", ")])


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row a piece of a document in sequences of at most 1024 tokens."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return pack(docs, "doc_id", "text").mapInArrow(_digests, _OUT)
