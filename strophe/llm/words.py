"""Words, word hashes and word shingles of whole Arrow batches at once.

A word is ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. Every operator that
compares texts by words uses the hashes made here, so they agree with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _SEED.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of a run of documents: ``first[d]:first[d+1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first) of each document's shingles in order; fewer words than ``size`` make one shingle, none make none."""
        n = np.diff(self.first)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(count, out=first[1:])
        at = np.repeat(self.first[:-1] - first[:-1], count) + np.arange(first[-1])
        width = np.repeat(np.minimum(n, size), count)
        padded = np.concatenate([self.hashes, np.zeros(size, np.uint64)])
        out = np.zeros(first[-1], np.uint64)
        whole = width == size
        for k in range(size):
            part = padded[at + k] * _PLACE[k]
            out += part if whole.all() else np.where(whole | (k < width), part, np.uint64(0))
        return mix(out + width.astype(np.uint64) * _PLACE[15]), first


def words(texts: pa.Array) -> Words:
    """Words of an Arrow string array; null is as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    off = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, off, none, none, np.zeros(len(off), np.int64), none.astype(np.uint64))
    inside = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(raw)]] = False
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:-1], out=total[1:])
    hashes = mix((total[stops] - total[starts]) * down[starts])
    return Words(raw, off, starts, stops, np.searchsorted(starts, off), hashes)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``most`` bytes of text or one document; whole documents always."""
    size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
